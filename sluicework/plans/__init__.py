"""Whole flows: judging batches, the gate with its writes, and reports over history."""
