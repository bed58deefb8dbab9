"""blockloom: analysis and adaptive compression of ordered columns as Spark DataFrames."""

__version__ = "0.1.0"
