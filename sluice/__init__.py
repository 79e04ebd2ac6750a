"""Sluice: a Spark-native batch dataflow engine (map, sort, reduce) on DataFrames."""

__version__ = "0.1.0"
