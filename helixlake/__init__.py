"""Sequence annotation and training-data operators as Spark DataFrame code."""
