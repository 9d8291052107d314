"""Mass-univariate mixed models on Spark."""

__version__ = "0.1.0"
