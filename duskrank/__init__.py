"""duskrank: a two-stage recommendation pipeline written as Spark DataFrame jobs."""

__version__ = "0.1.0"
