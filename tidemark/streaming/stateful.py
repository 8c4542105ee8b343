"""Streaming forms of the ordered folds: the book by symbol, the sequencer by feed.

State is kept by entry: a batch writes the levels it changed and the segments it held or released,
not the whole book or buffer. Each micro-batch's rows of a key are ordered by their sequence or
arrival number; the batch operators give the same rows. Timers of event time close holes that
nothing else closes, and levels can expire.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.book import TOUCH, touch_places
from tidemark.operators.sequencing import DELIVERED, Feed


class BookProcessor(StatefulProcessor):
    """A book's populated levels as map state, by side and price; with ``idle_ms`` a level expires so long after it was last set."""

    def __init__(self, idle_ms: int | None = None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.levels = handle.getMapState("levels", "side string, price long", "size long", self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = pd.concat(list(rows)).sort_values("seq", kind="stable")
        known = [(side, price, size) for (side, price), (size,) in self.levels.iterator()]
        side, price, size = (np.concatenate([np.array([k[i] for k in known], t), fresh[c].to_numpy(t)]) for i, (c, t) in enumerate((("side", object), ("price", np.int64), ("size", np.int64))))
        bid, ask = (p[len(known) :] for p in touch_places(np.zeros(len(side), np.int64), side == "B", price, size))
        for (s, p), z in {(s, int(p)): int(z) for s, p, z in zip(fresh["side"], fresh["price"], fresh["size"], strict=True)}.items():
            if z:
                self.levels.updateValue((s, p), (z,))
            elif self.levels.containsKey((s, p)):
                self.levels.removeKey((s, p))
        of = lambda values, at: pd.arrays.IntegerArray(values[np.maximum(at, 0)], at < 0)
        yield pd.DataFrame({
            "book_epoch": key[0], "symbol": key[1], "seq": fresh["seq"].to_numpy(), "bid": of(price, bid), "bid_size": of(size, bid), "ask": of(price, ask), "ask_size": of(size, ask),
            "stable": (fresh["flags"].to_numpy() & 1) == 1,
        })

    def close(self) -> None:
        pass


def stream_touches(updates: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """The touch after every update of a stream, by book. ``idle_ms`` forgets levels that nothing has set for so long (of processing time)."""
    chosen = updates.select("book_epoch", "symbol", "seq", "side", "price", "size", "flags").groupBy("book_epoch", "symbol")
    return chosen.transformWithStateInPandas(BookProcessor(idle_ms), TOUCH, "Append", "ProcessingTime" if idle_ms else "None")


_COLUMNS = ("session", "first_sequence", "delivery_no", "book_epoch", "action", "arrival_no")


class FeedProcessor(StatefulProcessor):
    """A feed's place as a value, its held segments as map state by first sequence number; a timer gives up a hole after ``patience_ms`` of event time."""

    def __init__(self, replay: bool, patience_ms: int | None):
        self.replay, self.patience_ms = replay, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "session long, due long, epoch long, sent long, tally string, deadline long")
        self.held = handle.getMapState("held", "first long", "size long")

    def _load(self) -> tuple[Feed, int | None, dict[int, int]]:
        feed, deadline = Feed(replay=self.replay), None
        if self.place.exists():
            feed.session, feed.due, feed.epoch, feed.sent, tally, deadline = self.place.get()
            feed.tally = Counter(json.loads(tally))
            feed.sizes = {first: size for (first,), (size,) in self.held.iterator()}
            feed.heap = sorted(feed.sizes)
        return feed, deadline, dict(feed.sizes)

    def _save(self, feed: Feed, was: dict[int, int], deadline: int | None, due_at: int | None) -> None:
        """Writes what changed; a timer stands while something is held, at the time the hole opened and the patience."""
        for first in was.keys() - feed.sizes.keys():
            self.held.removeKey((first,))
        for first, size in feed.sizes.items():
            if was.get(first) != size:
                self.held.updateValue((first,), (size,))
        if due_at != deadline and self.patience_ms:
            if deadline is not None:
                self.handle.deleteTimer(deadline)
            if due_at is not None:
                self.handle.registerTimer(due_at)
        self.place.update((feed.session, feed.due, feed.epoch, feed.sent, json.dumps(feed.tally), due_at))

    def _rows(self, key, columns: dict[str, list]) -> pd.DataFrame:
        return pd.DataFrame({"capture_id": key[0], "channel": key[1], **columns}).astype({"delivery_no": "Int64", "arrival_no": "Int64"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        feed, deadline, was = self._load()
        fresh = pd.concat(list(rows)).sort_values("arrival_no", kind="stable")
        out, due_at = {k: [] for k in _COLUMNS}, deadline
        columns = [fresh[c].tolist() for c in ("arrival_no", "session", "first_sequence", "message_count", "at_ms")]
        for *arrival, at_ms in zip(*columns, strict=True):
            opened = not feed.sizes
            for name, values in feed.rows([tuple(arrival)]).items():
                out[name] += values
            due_at = None if not feed.sizes else at_ms + self.patience_ms if opened and self.patience_ms else due_at
        self._save(feed, was, deadline, due_at)
        yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        feed, deadline, was = self._load()
        now = expiredTimerInfo.getExpiryTimeInMs()
        if deadline != now or not feed.sizes:
            return
        out: dict[str, list] = {k: [] for k in _COLUMNS}
        for action, low in feed.resync():
            for column, value in zip(out.values(), (feed.session, low, feed.sent, feed.epoch, action, None), strict=True):
                column.append(value)
            feed.sent += 1
        self._save(feed, was, None, now + self.patience_ms if feed.sizes else None)
        yield self._rows(key, out)

    def close(self) -> None:
        pass


def stream_sequenced(arrivals: DataFrame, replay_buffered: bool = True, patience_ms: int | None = None) -> DataFrame:
    """Actions and deliveries of a stream of arrivals, by capture and channel.

    With ``patience_ms``, arrivals have a ``ts`` with a watermark, and a hole that is still open when
    the watermark is so long past the arrival that found it is given up: the feed goes on from its
    earliest held segment, in rows without an arrival number.
    """
    timed = patience_ms is not None
    at = (F.unix_millis("ts") if timed else F.lit(0).cast("long")).alias("at_ms")
    chosen = arrivals.select("capture_id", F.col("channel").cast("long").alias("channel"), *(F.col(c).cast("long").alias(c) for c in ("arrival_no", "session", "first_sequence", "message_count")), at, *(["ts"] if timed else []))
    grouped = chosen.groupBy("capture_id", "channel")
    return grouped.transformWithStateInPandas(FeedProcessor(replay_buffered, patience_ms), DELIVERED, "Append", "EventTime" if timed else "None")


def stream_distinct(arrivals: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Arbitration on a stream: the first copy of each segment within the watermark of ``ts``."""
    return arrivals.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["session", "first_sequence"])
