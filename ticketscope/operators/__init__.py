"""Domain operators: DataFrames in, a DataFrame or a fitted model out."""
