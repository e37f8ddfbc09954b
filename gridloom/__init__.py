"""gridloom: array stores and tables as Spark DataFrames."""

__version__ = "0.1.0"
