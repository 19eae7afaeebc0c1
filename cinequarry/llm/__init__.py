"""Operators of a large-scale training-data pipeline, on Spark.

Nothing else in the library imports this subpackage.
"""
