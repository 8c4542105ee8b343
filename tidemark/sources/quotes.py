"""Touch files: raw integer prices as CSV with a header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "ts_nanos long, symbol string, bid long, bid_size long, ask long, ask_size long"


def write_touches(touches: DataFrame, path: str) -> None:
    """Writes the columns of :data:`SCHEMA`, in as many files as the touches have partitions."""
    touches.select("ts_nanos", "symbol", "bid", "bid_size", "ask", "ask_size").write.csv(path, header=True)


def read_touches(spark: SparkSession, path: str, symbol: str | None = None) -> DataFrame:
    """Touches that :func:`write_touches` wrote; with ``symbol`` that one's, filtered while the files are parsed."""
    found = spark.read.schema(SCHEMA).csv(path, header=True)
    return found if symbol is None else found.where(found["symbol"] == symbol)
