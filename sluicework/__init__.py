"""Sluicework: a data quality gate expressed as Spark jobs.

Batches of rows are compared with a declared contract, profiled in one narrow
aggregation, scored against their own history and let through or held back.
"""

from sluicework.contracts import Check, ColumnSpec, Contract, load_contract

__all__ = ["Check", "ColumnSpec", "Contract", "load_contract"]
