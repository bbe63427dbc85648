"""Barloom: ordered-series analytics and training-data operators on PySpark."""
