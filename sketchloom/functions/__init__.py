"""Column expressions: hashing, estimators, ratios and verdicts."""
