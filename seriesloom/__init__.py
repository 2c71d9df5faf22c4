"""seriesloom: time-series pattern mining expressed on Spark DataFrames."""

__version__ = "0.1.0"
