"""Associative recall and training-data operators on Spark DataFrames."""
