"""recollect: evaluate long-term conversational memory with Spark DataFrames."""

__version__ = "0.1.0"
