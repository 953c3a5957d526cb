"""Analytics operators: each takes star-schema DataFrames and returns a lazy DataFrame."""
