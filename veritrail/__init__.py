"""Grounded retrieval analytics on Spark: corpora, indexes, questions and answers as DataFrames."""
