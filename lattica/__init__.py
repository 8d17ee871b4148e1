"""Spark-native array, signal and inverse-problem analytics on DataFrames."""
