"""Column expressions, all evaluated by Spark itself."""
