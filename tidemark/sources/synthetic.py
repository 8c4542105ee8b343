"""A seeded synthetic market: updates that never cross, arrivals with known duplicates and losses.

Every value is a hash of the seed and the row number, so rows can be made anywhere, in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _uniform(seed: int, *salt):
    return F.pmod(F.xxhash64(F.lit(seed), *map(F.lit, salt), "id"), F.lit(1 << 30)) / F.lit(float(1 << 30))


def updates(spark: SparkSession, n: int, seed: int = 1, symbols: int = 8, depth: int = 20, delete_share: float = 0.389, incomplete_share: float = 0.2) -> DataFrame:
    """``n`` price-level updates; bids stay below 100 dollars, asks above, so books never cross."""
    base = spark.range(n)
    bid = _uniform(seed, "side") < 0.5
    step = F.floor(_uniform(seed, "level") * depth).cast("long") + 1
    return base.select(
        F.col("id").alias("seq"), F.lit(0).cast("long").alias("book_epoch"), F.concat(F.lit("SYM"), F.floor(_uniform(seed, "symbol") * symbols).cast("string")).alias("symbol"),
        F.when(bid, "B").otherwise("S").alias("side"), F.when(_uniform(seed, "flags") < incomplete_share, 0).otherwise(1).alias("flags"),
        F.when(_uniform(seed, "delete") < delete_share, F.lit(0)).otherwise(F.floor(_uniform(seed, "size") * 9 + 1) * 100).cast("long").alias("size"),
        (F.lit(1_000_000) + F.when(bid, -step).otherwise(step) * 100).cast("long").alias("price"), (F.lit(1_500_000_000_000_000_000) + F.col("id") * 1000).cast("long").alias("ts_nanos"),
    )


def arrivals(spark: SparkSession, segments: int, seed: int = 1, messages: int = 3, duplicate_share: float = 0.1, lost_share: float = 0.0, session: int = 7_001) -> DataFrame:
    """Segment arrivals of one feed: a share is lost, another arrives twice."""
    base = spark.range(segments).where(_uniform(seed, "lost") >= lost_share)
    copies = F.when(_uniform(seed, "twice") < duplicate_share, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = base.select("id", F.explode(copies).alias("copy"))
    return rows.select(
        F.lit("synthetic").alias("capture_id"), F.lit(1).cast("long").alias("channel"), (F.col("id") * 2 + F.col("copy") * 5).alias("arrival_no"),
        F.lit(session).cast("long").alias("session"), (F.col("id") * messages + 1).alias("first_sequence"), F.lit(messages).cast("long").alias("message_count"),
    )


def expected(arrived: DataFrame) -> DataFrame:
    """What a sequencer has to report of :func:`arrivals`: distinct segments, and copies beyond the first."""
    per = arrived.groupBy("first_sequence").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("segments"), F.sum(F.col("n") - 1).alias("duplicates"))
