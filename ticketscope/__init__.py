"""Issue-tracker analytics on Spark DataFrames: cleaning, reports, reopening, sentiment, clusters, models."""
