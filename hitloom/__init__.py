"""hitloom: short-read alignment analytics, declared as Spark DataFrames."""

__version__ = "0.1.0"
