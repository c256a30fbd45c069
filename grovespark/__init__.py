"""Structural graph analytics over batches of graphs held as Spark DataFrames."""
