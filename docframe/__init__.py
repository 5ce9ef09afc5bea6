"""Documents as DataFrames: parse, query and render document formats with Spark."""
