"""Lodeworks: indexing, searching and analysing code and text corpora as Spark DataFrames."""
