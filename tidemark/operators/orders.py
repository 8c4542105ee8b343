"""Quotes from touches, order tokens, binary orders and the counters of the whole pipeline."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tidemark.functions.market import KINDS, symbol_bytes
from tidemark.operators import book, sequencing
from tidemark.operators.prefix import running
from tidemark.sources import capture
from tidemark.tables import stored

# The default rule (spread in 1/10000 dollar, shares) and the order message's token range.
MIN_SPREAD, ORDER_SIZE, TOKEN_WRAP, U32 = 200, 100, 10**12, 2**32


def spread_threshold(touches: DataFrame, min_spread: int = MIN_SPREAD, size: int = ORDER_SIZE) -> DataFrame:
    """Buys at the bid wherever a stable, two-sided touch is at least ``min_spread`` wide."""
    wide = touches.where("stable AND bid IS NOT NULL AND ask IS NOT NULL").where(F.col("ask") - F.col("bid") >= min_spread)
    return wide.select("book_epoch", "seq", "symbol", F.lit("B").alias("side"), F.lit(size).cast("long").alias("shares"), F.col("bid").alias("price"))


def with_tokens(quotes: DataFrame, block: int = 100_000, prefix: str = "LL") -> DataFrame:
    """Order tokens in emission order (``seq``): the prefix and a 12-digit count from 0 that wraps.

    The count is a number within a block of sequence numbers plus the quotes of the blocks before,
    so only one row for each block meets in one task.
    """
    cut = quotes.withColumn("block", F.floor(F.col("seq") / F.lit(block)).cast("long"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy("block").agg(F.count("*").alias("n")).select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    number = F.col("start") + F.row_number().over(Window.partitionBy("block").orderBy("seq")) - 1
    token = F.concat(F.lit(prefix), F.lpad((number % TOKEN_WRAP).cast("string"), 12, "0"))
    return cut.join(starts, "block").withColumn("token", token).drop("block", "start")


def big_endian(value: Column) -> Column:
    return F.unhex(F.lpad(F.hex(value), 8, "0"))


def encoded(orders: DataFrame) -> DataFrame:
    """``message``, the 49 bytes of the enter-order message; or ``error``, if the price doesn't fit in 32 unsigned bits.

    An order in error has used its token.
    """
    fits = (F.col("price") >= 0) & (F.col("price") < U32)
    # fixed values of the message: type, firm fields, time in force, display and flags, in this order below
    text = lambda s: F.encode(F.lit(s), "ISO-8859-1")
    message = F.concat(
        text("O"), F.encode("token", "ISO-8859-1"), F.encode("side", "ISO-8859-1"), big_endian(F.col("shares")), symbol_bytes(F.col("symbol")), big_endian(F.col("price")),
        text("IOCE"), text("LTLD"), text("YPN"), big_endian(F.lit(0)), text("NR"),
    )
    return orders.withColumn("message", F.when(fits, message)).withColumn("error", F.when(~fits, "price_out_of_range"))


LEVEL_KINDS, TRADE_KINDS = (0x38, 0x35), (0x54, 0x42)
STAGES = ("receive", "sequence", "parse", "book", "decide", "encode")


def pipeline(updates: DataFrame, upto: str = "encode", decide: Callable[[DataFrame], DataFrame] = spread_threshold, strategy: str = "fold") -> DataFrame:
    """The chain from updates to orders, as far as the stage ``upto``; ``decide`` is the trading rule."""
    if upto not in STAGES:
        raise ValueError(f"unknown stage {upto!r}")
    out = updates
    if STAGES.index(upto) >= STAGES.index("book"):
        out = book.touch(updates, strategy)
    if STAGES.index(upto) >= STAGES.index("decide"):
        out = decide(out)
    if upto == "encode":
        out = encoded(with_tokens(out))
    return out


def counters(updates: DataFrame, upto: str = "encode") -> DataFrame:
    """One row: updates, quotes, orders encoded and encode errors, each 0 beyond the stage ``upto``."""
    at = STAGES.index(upto)
    none = lambda name: F.lit(0).cast("long").alias(name)
    base = updates.agg(F.count("*").alias("messages"), *((F.count("*") if at >= 3 else F.lit(0).cast("long")).alias(n) for n in ("book_updates",)))
    if at < STAGES.index("decide"):
        return base.select("messages", "book_updates", none("quotes"), none("orders_encoded"), none("encode_errors"))
    made = pipeline(updates, upto)
    if upto == "decide":
        orders = made.agg(F.count("*").alias("quotes"), none("orders_encoded"), none("encode_errors"))
    else:
        orders = made.agg(F.count("*").alias("quotes"), F.count("message").alias("orders_encoded"), F.count("error").alias("encode_errors"))
    return base.join(F.broadcast(orders))  # one row each


def arrivals_of(segments: DataFrame) -> DataFrame:
    """Segments as arrivals in packet order, for the sequencer."""
    return segments.select("capture_id", "channel", F.col("packet_no").alias("arrival_no"), "session", "first_sequence", "message_count")


def sequenced(segments: DataFrame, events: DataFrame) -> DataFrame:
    """The packets that the sequencer delivers, by its events: ``start``, the number of their first message in delivery order over all feeds, and ``book_epoch``.

    A held segment is delivered from its last copy up to the arrival that releases it.
    """
    feed = ["capture_id", "channel"]
    out = events.where("delivery_no IS NOT NULL").select(*feed, "session", "first_sequence", "delivery_no", "book_epoch", "arrival_no")
    copies = segments.where("message_count > 0").select(*feed, "session", "first_sequence", "packet_no", "message_count")
    met = out.join(copies, [*feed, "session", "first_sequence"]).where("packet_no <= arrival_no")
    last = F.max(F.struct("packet_no", "message_count")).alias("last")
    packets = met.groupBy(*feed, "delivery_no", "book_epoch").agg(last).select(*feed, "delivery_no", "book_epoch", "last.*")
    before = Window.orderBy(*feed).rowsBetween(Window.unboundedPreceding, -1)  # a row for each feed
    sizes = packets.groupBy(*feed).agg(F.sum("message_count").alias("n"), (F.max("book_epoch") + 1).alias("epochs"))
    starts = sizes.select(*feed, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), F.coalesce(F.sum("epochs").over(before), F.lit(0)).alias("first_epoch"))
    numbered = running(packets, feed, ["delivery_no"], F.floor(F.col("delivery_no") / F.lit(50_000)), {"within": F.col("message_count")}, before=True).join(starts, feed)
    return numbered.select("capture_id", "packet_no", (F.col("first") + F.coalesce("within", F.lit(0))).alias("start"), (F.col("first_epoch") + F.col("book_epoch")).alias("book_epoch"))


def segments_of(packets: DataFrame) -> DataFrame:
    """The packets' segments, decoded once: all that follows reads them again."""
    return stored(capture.chain(packets, "datagrams", "segments"), "segments")


def received(segments: DataFrame, events: DataFrame) -> DataFrame:
    """Typed messages of segments, each once and in sequence: ``seq`` numbers them in delivery order."""
    found = capture.messages(segments).join(sequenced(segments, events), ["capture_id", "packet_no"])
    return found.withColumn("seq", F.col("start") + F.col("msg_no")).drop("start")


def updates_of(messages: DataFrame) -> DataFrame:
    """Price-level messages as updates of the book."""
    levels = messages.where("error IS NULL").where(F.col("kind").isin(*LEVEL_KINDS))
    return levels.select("seq", "book_epoch", "symbol", F.when(F.col("kind") == 0x38, "B").otherwise("S").alias("side"), "flags", "size", "price", "ts_nanos")


def verdict(packets: DataFrame) -> DataFrame:
    """One row on a session's packets: what came, what was in it, and whether it can be trusted.

    Segments that had to wait are not replayed here. Trades include breaks; gaps are those opened;
    ``crossed`` counts stable crosses; low and high are prices that aren't deletes.
    """
    found = segments_of(packets)
    feed = ["capture_id", "channel"]
    done = sequencing.run_feeds(arrivals_of(found), replay_buffered=False)
    stats = done.statistics.agg(F.coalesce(F.sum("gaps_opened"), F.lit(0)).alias("gaps"), F.coalesce(F.sum("duplicates"), F.lit(0)).alias("duplicates"))
    sent = done.events.where(F.col("action").isin(sequencing.DELIVER, sequencing.RESET))
    taken = found.join(sent.select(*feed, F.col("arrival_no").alias("packet_no")), [*feed, "packet_no"], "left_semi")
    m = stored(capture.messages(taken).where("kind IS NOT NULL").select(*feed, "packet_no", "msg_no", "kind", "error", "symbol", "flags", "size", "price", "ts_nanos"), "feed-messages")
    update, good = F.col("kind").isin(*LEVEL_KINDS), F.col("error").isNull()
    live = update & good & (F.col("size") > 0)
    of_messages = m.agg(
        F.count_if(good).alias("messages"), F.count_if(~good).alias("errors"), F.count_if(~F.col("kind").isin(*KINDS)).alias("unknown"), F.count_distinct("symbol").alias("symbols"),
        F.count_if(update & good).alias("price_updates"), F.count_if(good & F.col("kind").isin(*TRADE_KINDS)).alias("trades"), F.min(F.when(live, F.col("price"))).alias("low"), F.max(F.when(live, F.col("price"))).alias("high"),
    )
    starts = running(taken.select(*feed, "packet_no", "message_count"), feed, ["packet_no"], F.floor(F.col("packet_no") / F.lit(50_000)), {"start": F.col("message_count")}, before=True)
    numbered = m.join(starts.select(*feed, "packet_no", F.coalesce("start", F.lit(0)).alias("start")), [*feed, "packet_no"])
    numbered = numbered.withColumn("seq", F.col("start") + F.col("msg_no")).withColumn("book_epoch", F.lit(0).cast("long")).withColumn("symbol", F.concat_ws("/", *feed, "symbol"))
    touches = book.touch(updates_of(numbered))
    crosses = touches.agg(F.count_if(book.crossed(touches)["crossed_when_stable"]).alias("crossed"))
    out = packets.agg(F.count("*").alias("packets"))
    for one in (of_messages, stats, crosses):
        out = out.join(F.broadcast(one))  # one row each
    return out


#: What the chain counts, in the order of the columns.
COUNTERS = ("packets", "resyncs", "book_resets", "messages_lost", "messages", "book_updates", "quotes", "orders_encoded", "encode_errors")


def run_stages(packets: DataFrame, upto: str = "encode") -> Iterator[tuple[str, float, dict[str, int]]]:
    """Runs the chain once, as far as the stage ``upto``: each stage with its seconds and all counters so far.

    A stage's rows are written where it ends, so the next begins with them, a stage's time holds its
    own work alone, and its counts are those of the rows written. Packets are counted on their way
    through the task that decodes and writes them. A resynchronisation begins a new book, so
    ``book_resets`` are the ``resyncs`` from the book stage on.
    """
    if upto not in STAGES:
        raise ValueError(f"unknown stage {upto!r}")
    counts, last = dict.fromkeys(COUNTERS, 0), [time.perf_counter()]

    def border(stage: str, **found: int) -> tuple[str, float, dict[str, int]]:
        counts.update(found)
        now = time.perf_counter()
        seconds, last[0] = now - last[0], now
        return stage, seconds, dict(counts)

    came = Observation()
    segments = segments_of(packets.observe(came, F.count("*").alias("packets")))
    yield border("receive", packets=came.get["packets"])
    if upto == "receive":
        return
    done = sequencing.run_feeds(arrivals_of(segments))
    told = done.statistics.agg(F.coalesce(F.sum("resyncs"), F.lit(0)).alias("resyncs"), F.coalesce(F.sum("messages_lost"), F.lit(0)).alias("lost")).first()
    yield border("sequence", resyncs=told.resyncs, messages_lost=told.lost)
    if upto == "sequence":
        return
    messages = stored(received(segments, done.events), "feed-messages")
    yield border("parse", messages=messages.where("error IS NULL").count())
    if upto == "parse":
        return
    touches = stored(book.touch(updates_of(messages)), "feed-touches")
    yield border("book", book_updates=touches.count(), book_resets=told.resyncs)
    if upto == "book":
        return
    quotes = stored(spread_threshold(touches), "feed-quotes")
    yield border("decide", quotes=quotes.count())
    if upto == "decide":
        return
    made = stored(encoded(with_tokens(quotes)), "feed-orders").agg(F.count("message").alias("orders"), F.count("error").alias("errors")).first()
    yield border("encode", orders_encoded=made.orders, encode_errors=made.errors)


def feed_counters(packets: DataFrame, upto: str = "encode") -> DataFrame:
    """The counters after the stage ``upto``, in one row; those of later stages are 0."""
    *_, (_, _, counts) = run_stages(packets, upto)
    return packets.sparkSession.createDataFrame([tuple(counts[c] for c in COUNTERS)], ", ".join(f"{c} long" for c in COUNTERS))


def stage_counters(packets: DataFrame, upto: str = "encode") -> DataFrame:
    """A row for each stage of one run: ``stage`` and the counters after it."""
    rows = [(stage, *(counts[c] for c in COUNTERS)) for stage, _, counts in run_stages(packets, upto)]
    return packets.sparkSession.createDataFrame(rows, "stage string, " + ", ".join(f"{c} long" for c in COUNTERS))
