"""Column expressions: types, rules, z-scores and the verdict chain."""
