"""Column functions: arithmetic, comparison, null and NaN handling, strings, user functions."""
