"""corpuslab: distributed text-corpus preparation, classification,
summary evaluation and explanation on Spark DataFrames."""

__version__ = "0.1.0"
