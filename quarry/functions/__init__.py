"""Column builders: every function takes and returns Spark columns (no Python at run time)."""
