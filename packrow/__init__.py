"""packrow: tables of compactly encoded binary records as Spark DataFrames."""

__version__ = "0.1.0"
