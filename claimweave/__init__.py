"""claimweave: qualified claims as DataFrames, compared and explained by Spark."""
