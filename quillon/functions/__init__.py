"""Column expressions: the six comparisons with typed literals, and the five aggregates."""
