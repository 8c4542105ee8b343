"""Market-data analytics on Spark: captures, sequencing, order books, statistics, pricing."""

__version__ = "0.1.0"
