"""Feeds derived from the ``events`` table by portable arithmetic, in Spark and in DuckDB SQL alike.

They exercise every branch of the operators: both sides, deletes of absent levels, crosses and
locks at event boundaries and inside events, odd lots, duplicates, gaps and reordered segments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import capture

#: Updates in a book epoch, in a segment, and segments in a session.
EPOCH, SEGMENT, SESSION = 4000, 5, 100

_BUY = "event_type IN ('view', 'purchase')"
_UPDATE_COLUMNS = """
    event_id AS seq,
    CAST(event_id {div} 4000 AS BIGINT) AS book_epoch,
    concat('SYM', CAST(user_id % 50 AS {text})) AS symbol,
    CASE WHEN {buy} THEN 'B' ELSE 'S' END AS side,
    CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS flags,
    CASE WHEN event_type = 'signup' OR event_id % 7 = 0 THEN CAST(0 AS BIGINT) ELSE CAST(regexp_extract(props, '([0-9]+)'{group}) AS BIGINT) + 1 END AS size,
    CAST(1000000 + (CASE WHEN {buy} THEN -1 ELSE 1 END) * ((event_id * 7) % 8) * 100 + ((event_id {div} 997) % 5) * 100 AS BIGINT) AS price,
    {micros} * 1000 AS ts_nanos
"""

#: DuckDB's form of :func:`updates`.
UPDATES_SQL = "SELECT" + _UPDATE_COLUMNS.format(div="//", text="VARCHAR", buy=_BUY, group="", micros="epoch_us(ts)") + "FROM events"

#: A trade for every tenth event, a break of one for every fiftieth.
_TRADE_COLUMNS = """
    event_id AS seq, concat('SYM', CAST(user_id % 50 AS {text})) AS symbol, CASE WHEN event_id % 50 = 0 THEN 66 ELSE 84 END AS kind,
    CAST(event_id % 900 + 1 AS BIGINT) AS size, CAST(1000000 + (event_id % 13) * 100 AS BIGINT) AS price
"""
TRADES_SQL = "SELECT" + _TRADE_COLUMNS.format(text="VARCHAR") + "FROM events WHERE event_id % 10 = 0"

#: Copies A and B of every segment, B later; each feed loses some, A holds some back.
ARRIVALS_SQL = """
SELECT session, first_sequence, CAST(message_count AS BIGINT) AS message_count, feed, seg * 40 + slot AS arrival_no FROM (
    SELECT seg, seg // 100 AS session, (seg % 100) * 5 + 1 AS first_sequence, n AS message_count, 'A' AS feed, CASE WHEN seg % 17 = 4 THEN 130 ELSE 0 END AS slot
    FROM (SELECT event_id // 5 AS seg, count(*) AS n FROM events GROUP BY event_id // 5) WHERE seg % 11 <> 3
  UNION ALL
    SELECT seg, seg // 100, (seg % 100) * 5 + 1, n, 'B', 21 + ((seg * 13) % 7) * 41
    FROM (SELECT event_id // 5 AS seg, count(*) AS n FROM events GROUP BY event_id // 5) WHERE seg % 13 <> 5
)
"""

#: The same with a heartbeat after every ninth segment.
BEATS_SQL = ARRIVALS_SQL + """UNION ALL
SELECT seg // 100, (seg % 100) * 5 + 1, 0, 'A', seg * 40 + 39 FROM (SELECT DISTINCT event_id // 5 AS seg FROM events) WHERE seg % 9 = 0
"""

#: Waiting work: arrival and service times in nanoseconds, by user as one server each.
QUEUE_SQL = "SELECT event_id AS item, user_id % 20 AS server, event_id * 1000 AS sched, CAST(floor(value * 400) AS BIGINT) AS service FROM events"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _columns(df: DataFrame, columns: str) -> DataFrame:
    spark = df.sparkSession
    return spark.sql("SELECT" + columns + "FROM {events}", events=df)


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price-level updates: seq, book_epoch, symbol, side, flags, size, price, ts_nanos."""
    return _columns(events(spark, sf_dir), _UPDATE_COLUMNS.format(div="div", text="STRING", buy=_BUY, group=", 1", micros="timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade reports (kind 0x54) and breaks (0x42)."""
    return _columns(events(spark, sf_dir).where("event_id % 10 = 0"), _TRADE_COLUMNS.format(text="STRING"))


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segment arrivals of two feeds: session, first_sequence, message_count, feed, arrival_no."""
    seg = events(spark, sf_dir).groupBy(F.expr("event_id div 5").alias("seg")).agg(F.count("*").alias("n"))
    base = seg.select("seg", F.expr("seg div 100").alias("session"), F.expr("(seg % 100) * 5 + 1").alias("first_sequence"), F.col("n").alias("message_count"))
    a = base.where("seg % 11 <> 3").withColumn("feed", F.lit("A")).withColumn("slot", F.expr("CASE WHEN seg % 17 = 4 THEN 130 ELSE 0 END"))
    b = base.where("seg % 13 <> 5").withColumn("feed", F.lit("B")).withColumn("slot", F.expr("21 + ((seg * 13) % 7) * 41"))
    return a.unionByName(b).select("session", "first_sequence", "message_count", "feed", F.expr("seg * 40 + slot").alias("arrival_no"))


def arrivals_with_beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`arrivals` with heartbeats in between."""
    seg = events(spark, sf_dir).select(F.expr("event_id div 5").alias("seg")).distinct().where("seg % 9 = 0")
    beats = seg.select(F.expr("seg div 100").alias("session"), F.expr("(seg % 100) * 5 + 1").alias("first_sequence"), F.lit(0).cast("long").alias("message_count"), F.lit("A").alias("feed"), F.expr("seg * 40 + 39").alias("arrival_no"))
    return arrivals(spark, sf_dir).unionByName(beats)


def packets(spark: SparkSession, sf_dir: str, sessions: int) -> DataFrame:
    """The arrivals with heartbeats as packets that carry the updates, every tenth a trade instead: a capture and channel for each ``sessions`` sessions."""
    level = F.when(F.col("side") == "B", 0x38).otherwise(0x35)
    kind = F.when(F.col("seq") % 50 == 3, 0x42).when(F.col("seq") % 10 == 3, 0x54).otherwise(level)
    bodies = capture.encode_messages(updates(spark, sf_dir).select("seq", kind.alias("kind"), "ts_nanos", "symbol", "flags", "size", "price", F.col("seq").alias("trade_id")))
    by_segment = bodies.groupBy(F.expr("seq div 5").alias("seg")).agg(F.sort_array(F.collect_list(F.struct("seq", "body"))).alias("m"))
    full = F.expr("session * 100 + (first_sequence - 1) div 5")
    rows = arrivals_with_beats(spark, sf_dir).withColumn("seg", F.when(F.col("message_count") > 0, full)).join(by_segment, "seg", "left")
    channel = F.floor(F.col("session") / F.lit(sessions)).cast("long")
    none = F.array().cast("array<binary>")
    return capture.encode_segments(rows.select(
        F.format_string("feed-%06d", channel).alias("capture_id"), F.col("arrival_no").alias("packet_no"), (F.col("arrival_no") * 1000).alias("ts_nanos"), channel.alias("channel"), "session", "first_sequence",
        F.coalesce(F.transform("m", lambda r: r["body"]), none).alias("bodies"),
    ))


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scheduled items with service times: item, server, sched, service."""
    return events(spark, sf_dir).selectExpr("event_id AS item", "user_id % 20 AS server", "event_id * 1000 AS sched", "CAST(floor(value * 400) AS BIGINT) AS service")
