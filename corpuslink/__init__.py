"""corpuslink: corpora of short texts with chains of transmission, as Spark DataFrame jobs."""

__version__ = "0.1.0"
