"""docketry: analytics over citing document corpora, written for Spark's DataFrame engine."""

__version__ = "0.1.0"
