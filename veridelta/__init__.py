"""veridelta: uncertainty, retrieval and evaluation operators on Spark DataFrames."""

__version__ = "0.1.0"
