"""Security analytics on Spark: logs and connection records in, incidents and model reports out."""

__version__ = "0.1.0"
