"""Operators: schema comparison, profiling, baselines, lineage and alerts as DataFrame transforms."""
