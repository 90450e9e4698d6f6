"""threadline: captured web pages to comment tables, on Spark DataFrames."""
