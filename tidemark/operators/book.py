"""Order books as intervals: a level lives from its update until the next one of the same price.

Updates are ``(book_epoch, seq, symbol, side, flags, size, price)``; ``seq`` orders them and an
epoch begins with empty books. Everything here is a window over the level's key, except the touch
after each update, which deletes make non-decomposable: it is an offline maximum over the intervals
of a block of updates, or a range join of updates and intervals.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.market import event_complete, is_delete
from tidemark.operators.prefix import dense_blocks, previous, running

LEVEL = ["book_epoch", "symbol", "side", "price"]
BOOK = ["book_epoch", "symbol"]
#: Updates of a book that share a block, sequence numbers of a bucket of the range join, rows of several blocks worked on at once.
FOLD_BLOCK, JOIN_BUCKET, TOUCH_ROWS = 50_000, 1_000, 100_000

DEPTH = ", bid_levels long, bid_far long, ask_levels long, ask_far long"
TOUCH = "book_epoch long, symbol string, seq long, bid long, bid_size long, ask long, ask_size long, stable boolean"


def levels(updates: DataFrame) -> DataFrame:
    """The updates with ``prev_size`` (0 where the level was absent) and ``until``, the next update's seq."""
    w = Window.partitionBy(*LEVEL).orderBy("seq")
    return updates.withColumn("prev_size", F.coalesce(F.lag("size").over(w), F.lit(0))).withColumn("until", F.lead("seq").over(w))


def final_levels(updates: DataFrame) -> DataFrame:
    """What each book holds after the last update: one row per populated level."""
    last = updates.groupBy(*LEVEL).agg(F.max_by("size", "seq").alias("size"))
    return last.where("size > 0")


def best(levels_: DataFrame) -> DataFrame:
    """Best bid and ask with sizes and spread of each book; null where a side is empty."""
    bid, ask = F.col("side") == "B", F.col("side") == "S"
    found = levels_.groupBy(*BOOK).agg(
        F.max(F.when(bid, F.col("price"))).alias("bid"), F.max_by(F.when(bid, F.col("size")), F.when(bid, F.col("price"))).alias("bid_size"),
        F.min(F.when(ask, F.col("price"))).alias("ask"), F.min_by(F.when(ask, F.col("size")), F.when(ask, F.col("price"))).alias("ask_size"),
    )
    return found.withColumn("spread", F.col("ask") - F.col("bid"))


def running_depth(updates: DataFrame, block: int = FOLD_BLOCK) -> DataFrame:
    """After each update: the side's populated levels and displayed size."""
    step = F.when((F.col("size") > 0) & (F.col("prev_size") == 0), 1).when((F.col("size") == 0) & (F.col("prev_size") > 0), -1).otherwise(0)
    sums = {"n_levels": step, "total_size": F.col("size") - F.col("prev_size")}
    found = running(levels(updates), [*BOOK, "side"], ["seq"], F.floor(F.col("seq") / F.lit(block)), sums)
    return found.select("seq", *BOOK, "side", "n_levels", "total_size")


def ladders(levels_: DataFrame) -> DataFrame:
    """Each side as text, prices ascending: ``price x size`` joined by spaces."""
    row = F.sort_array(F.collect_list(F.struct("price", "size")))
    text = F.array_join(F.transform(row, lambda r: F.concat_ws("x", r["price"].cast("string"), r["size"].cast("string"))), " ")
    return levels_.groupBy(*BOOK, "side").agg(text.alias("ladder"), F.count("*").alias("n_levels"))


def _highest(n: int, start: np.ndarray, stop: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The highest rank among the intervals ``[start, stop)`` that hold each of n places; -1 where none does.

    An offline segment tree: a step for each of its levels, over all intervals at once.
    """
    size = 1 << max(0, (n - 1).bit_length())
    tree = np.full(2 * size, -1, np.int64)
    low, high = start + size, stop + size
    while len(low):
        left, right = (low & 1) == 1, (high & 1) == 1
        np.maximum.at(tree, low[left], rank[left])
        np.maximum.at(tree, high[right] - 1, rank[right])
        low, high = (low + 1) >> 1, high >> 1
        going = low < high
        low, high, rank = low[going], high[going], rank[going]
    width = 1
    while width < size:
        np.maximum(tree[2 * width : 4 * width], np.repeat(tree[width : 2 * width], 2), out=tree[2 * width : 4 * width])
        width *= 2
    return tree[size : size + n]


def _ends(group: np.ndarray, bid: np.ndarray, price: np.ndarray) -> np.ndarray:
    """The next row of each row's level, or its group's end."""
    order = np.lexsort((np.arange(len(group)), price, bid, group))
    ends = np.searchsorted(group, group, "right")  # groups are numbered upwards
    same = (group[order[1:]] == group[order[:-1]]) & (bid[order[1:]] == bid[order[:-1]]) & (price[order[1:]] == price[order[:-1]])
    ends[order[:-1][same]] = order[1:][same]
    return ends


def touch_places(group: np.ndarray, bid: np.ndarray, price: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of the best bid and of the best ask after each row, -1 for an empty side. Rows are in order within their group, one book each.

    A row that sets a level holds from its place to the next of the same level, or to its group's end.
    """
    n, ends, found = len(group), _ends(group, bid, price), []
    for side, sign in ((True, 1), (False, -1)):
        held = np.flatnonzero((bid == side) & (size > 0))
        held = held[np.argsort(sign * price[held], kind="stable")]
        best = _highest(n, held, ends[held], np.arange(len(held)))
        found.append(np.where(best < 0, -1, held[best] if len(held) else -1))
    return found[0], found[1]


def depth_places(group: np.ndarray, bid: np.ndarray, price: np.ndarray, size: np.ndarray) -> dict[str, np.ndarray]:
    """After each row, for either side, its number of levels and the row of the level furthest from the touch (-1: none)."""
    ends, found = _ends(group, bid, price), {}
    for name, side, sign in (("bid", True, -1), ("ask", False, 1)):
        held = np.flatnonzero((bid == side) & (size > 0))
        held = held[np.argsort(sign * price[held], kind="stable")]
        worst = _highest(len(group), held, ends[held], np.arange(len(held)))
        found[f"{name}_far"] = np.where(worst < 0, -1, held[worst] if len(held) else -1)
        steps = np.bincount(held, minlength=len(group) + 1) - np.bincount(ends[held], minlength=len(group) + 1)
        found[f"{name}_levels"] = np.cumsum(steps)[: len(group)]
    return found


def _touches(table: pa.Table, depth: bool = False) -> list[pa.RecordBatch]:
    """The touch (and with ``depth`` what :data:`DEPTH` adds) after each row that isn't seeded, for whole groups in order."""
    keys = [pc.fill_null(c.combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False) if pa.types.is_string(c.type) else pc.fill_null(c, -1).to_numpy() for c in (table[k] for k in (*BOOK, "block"))]
    new = np.zeros(table.num_rows, bool)
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    price, size = table["price"].to_numpy(), table["size"].to_numpy()
    sides = (np.cumsum(new), pc.equal(table["side"], "B").to_numpy(), price, size)
    bid, ask = touch_places(*sides)
    own = np.flatnonzero(~table["seeded"].to_numpy())
    columns = {k: table[k].take(pa.array(own)) for k in (*BOOK, "seq")}
    for name, at in (("bid", bid[own]), ("ask", ask[own])):
        columns[name], columns[f"{name}_size"] = (pa.array(v[np.maximum(at, 0)], pa.int64(), mask=at < 0) for v in (price, size))
    columns["stable"] = pa.array((table["flags"].to_numpy()[own] & 1) == 1)
    if depth:
        found = depth_places(*sides)
        for name in ("bid", "ask"):
            far = found[f"{name}_far"][own]
            columns[f"{name}_levels"] = pa.array(found[f"{name}_levels"][own], pa.int64())
            columns[f"{name}_far"] = pa.array(price[np.maximum(far, 0)], pa.int64(), mask=far < 0)
    return pa.table(columns).select([f.split(" ")[0] for f in (TOUCH + DEPTH if depth else TOUCH).split(", ")]).combine_chunks().to_batches(max_chunksize=max(1, len(own)))


def touch_by_fold(updates: DataFrame, block: int = FOLD_BLOCK, depth: bool = False) -> DataFrame:
    """The touch after every update, by blocks of a book's updates; with ``depth`` also each side's levels and furthest price.

    A book's updates are numbered (by sums of blocks, so a hot book is many tasks) and cut into
    blocks of ``block``. A level that outlives its block is copied to the book's later ones until
    its next update; a block has many more updates than a book has levels. Books of a few updates
    share a batch, whose touches are one offline pass in NumPy.
    """
    numbered = running(updates, BOOK, ["seq"], F.floor(F.col("seq") / F.lit(block)), {"n": F.lit(1)}).withColumn("block", F.floor((F.col("n") - 1) / F.lit(block)).cast("long"))
    last = numbered.groupBy(*BOOK).agg(F.max("block").alias("last_block"))  # a row for each book
    w = Window.partitionBy(*LEVEL).orderBy("seq")
    cut = numbered.withColumn("next_block", F.lead("block").over(w)).join(last, BOOK)
    until = F.when(F.col("size") > 0, F.greatest("block", F.coalesce("next_block", "last_block"))).otherwise(F.col("block"))
    dealt = cut.select(*BOOK, "seq", "side", "price", "size", F.col("flags").cast("int").alias("flags"), F.col("block").alias("own"), F.explode(F.sequence("block", until)).alias("block"))
    rows = dealt.withColumn("seeded", F.col("block") != F.col("own")).drop("own").repartition(*BOOK, "block").sortWithinPartitions(*BOOK, "block", F.desc("seeded"), "seq")

    def run(batches):
        held = None
        for batch in batches:
            held = pa.concat_tables([held, pa.table(batch)]) if held is not None else pa.table(batch)
            if held.num_rows >= TOUCH_ROWS:
                ends = held.slice(held.num_rows - 1)
                last_group = pc.and_(pc.and_(pc.equal(held["book_epoch"], ends["book_epoch"][0]), pc.equal(held["symbol"], ends["symbol"][0])), pc.equal(held["block"], ends["block"][0]))
                whole = held.num_rows - int(pc.sum(pc.fill_null(last_group, False)).as_py() or 0)
                if 0 < whole < held.num_rows:
                    yield from _touches(held.slice(0, whole), depth)
                    held = held.slice(whole)
        if held is not None and held.num_rows:
            yield from _touches(held, depth)

    return rows.mapInArrow(run, TOUCH + DEPTH if depth else TOUCH)


def _alive_to(cut: DataFrame, blocks: DataFrame, until_block) -> DataFrame:
    """Levels with ``to_rank``, their book's block in which the level's next update lies, or its last one."""
    last = blocks.groupBy(*BOOK).agg(F.max("rank").alias("last_rank"))  # a row for each book
    ends = blocks.select(*BOOK, F.col("block").alias("until_block"), F.col("rank").alias("until_rank"))
    met = cut.withColumn("until_block", until_block).join(ends, [*BOOK, "until_block"], "left").join(last, BOOK)
    return met.withColumn("to_rank", F.coalesce("until_rank", "last_rank"))


def touch_by_join(updates: DataFrame, bucket: int = JOIN_BUCKET) -> DataFrame:
    """The same by a range join: updates meet the level intervals of their book, bucketed by sequence number.

    An interval goes only to buckets in which its book has updates.
    """
    number = lambda c: F.floor(F.col(c) / F.lit(bucket)).cast("long")
    blocks = dense_blocks(updates, BOOK, "seq", bucket)
    cut = levels(updates).withColumn("block", number("seq")).join(blocks, [*BOOK, "block"])
    span = _alive_to(cut.where("size > 0"), blocks, number("until"))
    span = span.select(*BOOK, "side", "price", "size", F.col("seq").alias("start"), F.coalesce("until", F.lit(2**63 - 1)).alias("end"), F.explode(F.sequence("rank", "to_rank")).alias("rank"))
    at = cut.select(*BOOK, "seq", event_complete(F.col("flags")).alias("stable"), "rank")
    met = at.join(span, [*BOOK, "rank"], "left")
    live = (F.col("start") <= F.col("seq")) & (F.col("seq") < F.col("end"))
    bid, ask = live & (F.col("side") == "B"), live & (F.col("side") == "S")
    return met.groupBy(*BOOK, "seq").agg(
        F.max(F.when(bid, F.col("price"))).alias("bid"), F.max_by(F.when(bid, F.col("size")), F.when(bid, F.col("price"))).alias("bid_size"),
        F.min(F.when(ask, F.col("price"))).alias("ask"), F.min_by(F.when(ask, F.col("size")), F.when(ask, F.col("price"))).alias("ask_size"), F.first("stable").alias("stable"),
    )


def touch(updates: DataFrame, strategy: str = "fold") -> DataFrame:
    """The touch after every update; the strategies give the same rows."""
    if strategy not in ("fold", "join"):
        raise ValueError(f"unknown strategy {strategy!r}")
    return touch_by_fold(updates) if strategy == "fold" else touch_by_join(updates)


def crossed(t: DataFrame) -> dict[str, object]:
    """Conditions on a touch row."""
    both = F.col("bid").isNotNull() & F.col("ask").isNotNull()
    return {
        "two_sided": both, "crossed_when_stable": both & F.col("stable") & (F.col("bid") > F.col("ask")), "crossed_mid_event": both & ~F.col("stable") & (F.col("bid") > F.col("ask")),
        "locked_when_stable": both & F.col("stable") & (F.col("bid") == F.col("ask")),
    }


def book_counters(updates: DataFrame, touches: DataFrame) -> DataFrame:
    """One row of counters over all updates and the touches after them."""
    of_updates = levels(updates).agg(
        F.count("*").alias("updates"), F.count_if(is_delete(F.col("size"))).alias("deletes"), F.count_if((F.col("size") == 0) & (F.col("prev_size") == 0)).alias("absent_deletes"),
    )
    marks = crossed(touches)
    of_touches = touches.agg(*(F.count_if(marks[k]).alias(k) for k in ("crossed_when_stable", "crossed_mid_event", "locked_when_stable")))
    return of_updates.join(F.broadcast(of_touches))  # one row each


def touch_changes(touches: DataFrame, block: int = FOLD_BLOCK) -> DataFrame:
    """Stable, two-sided touches that differ from the symbol's one before."""
    values = ("bid", "bid_size", "ask", "ask_size")
    judged = touches.where("stable AND bid IS NOT NULL AND ask IS NOT NULL")
    judged = previous(judged, BOOK, "seq", F.floor(F.col("seq") / F.lit(block)), {f"was_{v}": v for v in values})
    same = F.lit(True)
    for v in values:
        same = same & F.col(v).eqNullSafe(F.col(f"was_{v}"))
    return judged.where(~same).drop("stable", *(f"was_{v}" for v in values))


def crossed_events(updates: DataFrame, touches: DataFrame, limit: int = 20) -> DataFrame:
    """The first stable crosses (a report of ``limit`` rows) with both ladders at that moment."""
    found = touches.where(crossed(touches)["crossed_when_stable"]).orderBy("seq").limit(limit)
    alive = levels(updates).where("size > 0").select(*BOOK, "side", "price", "size", F.col("seq").alias("start"), "until")
    met = alive.join(F.broadcast(found), BOOK).where((F.col("start") <= F.col("seq")) & (F.col("until").isNull() | (F.col("seq") < F.col("until"))))
    row = lambda side: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("side") == side, F.struct("price", "size")))), lambda r: F.concat_ws("x", r["price"].cast("string"), r["size"].cast("string"))), " ")
    return met.groupBy(*BOOK, "seq", "bid", "ask").agg(row("B").alias("bids"), row("S").alias("asks"))


def quote_board(updates: DataFrame, limit: int = 8) -> DataFrame:
    """Final two-sided touches of the last epoch, the first ``limit`` symbols, with level counts."""
    held = final_levels(updates)
    last = updates.agg(F.max("book_epoch").alias("book_epoch"))
    held = held.join(F.broadcast(last), "book_epoch", "left_semi")
    depth = held.groupBy(*BOOK).agg(F.count_if(F.col("side") == "B").alias("bid_levels"), F.count_if(F.col("side") == "S").alias("ask_levels"))
    return best(held).where("bid IS NOT NULL AND ask IS NOT NULL").join(depth, BOOK).orderBy("symbol").limit(limit)


def shape_samples(updates: DataFrame, every: int, block: int = FOLD_BLOCK) -> DataFrame:
    """Depth, span and spread of each book at every ``every``-th sequence number of its epoch, where it has a level.

    The state after an update holds until the book's next one; it becomes a row for each point in
    between, so rows follow the points of books, not the life of levels.
    """
    states = touch_by_fold(updates, block, depth=True)
    number = F.floor(F.col("seq") / F.lit(block))
    forward = previous(states.withColumn("back", -F.col("seq")), BOOK, "back", -number, {"next": "seq"})  # the row before, seen from the end
    last = updates.groupBy("book_epoch").agg(F.max("seq").alias("last_seq"))  # a row for each epoch
    held = forward.where("bid_levels + ask_levels > 0").join(last, "book_epoch").withColumn("until", F.coalesce(F.col("next") - 1, F.col("last_seq")))
    first, final = F.ceil(F.col("seq") / F.lit(every)).cast("long"), F.floor(F.col("until") / F.lit(every)).cast("long")
    points = held.where(first <= final).withColumn("step", F.explode(F.sequence(first, final)))
    ticks = lambda a, b: ((F.col(a) - F.col(b)) / 100).cast("long")
    return points.select(
        *BOOK, (F.col("step") * every).alias("point"), "bid_levels", "ask_levels", ticks("bid", "bid_far").alias("bid_span"), ticks("ask_far", "ask").alias("ask_span"),
        F.when(F.col("bid").isNotNull() & F.col("ask").isNotNull(), F.greatest(ticks("ask", "bid"), F.lit(0))).alias("spread"),
    )


def deepest(updates: DataFrame, limit: int = 8) -> DataFrame:
    """The books with the most populated levels."""
    return final_levels(updates).groupBy(*BOOK).agg(F.count("*").alias("n_levels")).orderBy(F.desc("n_levels"), *BOOK).limit(limit)


def saturating_histogram(values: DataFrame, column: str, buckets: int) -> DataFrame:
    """Counts by value, everything beyond the last bucket in it, with the running count."""
    found = values.where(F.col(column).isNotNull()).groupBy(F.least(F.col(column), F.lit(buckets - 1)).cast("long").alias("bucket")).agg(F.count("*").alias("n"))
    return found.withColumn("running", F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))  # at most `buckets` rows


def histogram_percentile(histogram: DataFrame, p: float) -> DataFrame:
    """The first bucket whose running count reaches ``trunc(total * p)``."""
    total = histogram.agg(F.sum("n").alias("total"))
    return histogram.join(F.broadcast(total)).where(F.col("running") >= F.floor(F.col("total") * F.lit(p))).agg(F.min("bucket").alias("bucket"))
