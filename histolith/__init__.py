"""histolith: quality analytics for spatial molecular data, built on Spark DataFrames."""

__version__ = "0.1.0"
