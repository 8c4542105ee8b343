"""Reversible line deduplication: sharded cuckoo filters before exact reference-count tables.

An index holds, dealt into shards by a hash of the line's key:

* ``refs``: how often each document holds each key;
* ``counts``: each key's first and last document, its number of lines and its filter (``part``), in versions;
* ``filters``: cuckoo filters over the keys, a few binary rows for each shard.

A corpus goes in by several insertions (:func:`build`). Each asks the filters first: a key that they
don't know is new and never meets the tables; one that they may know is settled by its exact row.
Every key without a live exact row, the filters' false positives too, gets a fingerprint of its own.
Deleting documents takes their references back, recounts the keys concerned, and removes keys that
nothing holds any more from the filter that got them: each live key always has one fingerprint. So
the rows that come out depend on what the filters answer at every insertion but the first. Shards
double as the index grows, and their filters are then made anew from the exact table.

A line goes when its key is held by two documents or more and this isn't the first.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import SPACE, free_name, join_facts, map_texts, slices
from tidemark.tables import stored

SLOTS = 4
#: Bits of a fingerprint.
BITS = 16
#: Share of its slots that a filter fills before the shard gets another, larger one.
FULL = 0.8
#: Keys of a shard on average, beyond which shards double.
SHARD_KEYS = 200_000
#: Rounds of evictions before an insertion counts as failed and goes to a larger filter.
ROUNDS = 400


class CuckooFilter:
    """Fingerprints of ``bits`` (16 at most) in buckets of four; every operation works on arrays of 64-bit hashes."""

    def __init__(self, buckets: int, slots: np.ndarray | None = None, n: int = 0, bits: int = BITS):
        self.mask, self.n, self.print_mask = np.int64(buckets - 1), n, np.uint64((1 << bits) - 1)
        self.slots = np.zeros((buckets, SLOTS), np.uint16) if slots is None else slots

    @classmethod
    def sized(cls, keys: int, bits: int = BITS) -> CuckooFilter:
        return cls(1 << max(4, int(np.ceil(np.log2(max(1, keys) / (SLOTS * FULL * 0.9))))), bits=bits)

    @property
    def room(self) -> int:
        return int(self.slots.size * FULL) - self.n

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        prints = (hashes & self.print_mask).astype(np.uint16)
        prints[prints == 0] = 1
        return prints, (hashes >> np.uint64(20)).astype(np.int64) & self.mask

    def _other(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        return bucket ^ ((prints.astype(np.int64) * 0x5BD1E995) & self.mask)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        prints, a = self._places(hashes)
        b = self._other(a, prints)
        return (self.slots[a] == prints[:, None]).any(1) | (self.slots[b] == prints[:, None]).any(1)

    def insert(self, hashes: np.ndarray) -> bool:
        """All of the hashes, or none of them if they don't fit."""
        before = self.slots.copy()
        prints, at = self._places(hashes)
        random = np.random.default_rng(len(hashes))
        for turn in range(ROUNDS):
            if not len(prints):
                self.n += len(hashes)
                return True
            other = self._other(at, prints)
            crowded = (self.slots[at] != 0).all(1)
            at = np.where(crowded & ~(self.slots[other] != 0).all(1), other, at)
            order = np.argsort(at, kind="stable")
            lead = order[np.r_[True, at[order][1:] != at[order][:-1]]]  # one for each bucket in a round
            bucket = at[lead]
            free = self.slots[bucket] == 0
            slot = np.where(free.any(1), free.argmax(1), random.integers(0, SLOTS, len(lead)))
            out = self.slots[bucket, slot]
            self.slots[bucket, slot] = prints[lead]
            wait = np.ones(len(prints), bool)
            wait[lead] = False
            evicted = out != 0
            prints, at = np.r_[prints[wait], out[evicted]], np.r_[at[wait], self._other(bucket[evicted], out[evicted])]
        self.slots = before
        return False

    def delete(self, hashes: np.ndarray) -> np.ndarray:
        """Removes one fingerprint for each hash that is found; gives which were."""
        found = np.zeros(len(hashes), bool)
        prints, a = self._places(hashes)
        for bucket in (a, self._other(a, prints)):
            todo = np.flatnonzero(~found)
            while len(todo):
                hit = self.slots[bucket[todo]] == prints[todo, None]
                todo, hit = todo[hit.any(1)], hit[hit.any(1)]
                if not len(todo):
                    break
                cell = bucket[todo] * SLOTS + hit.argmax(1)
                _, lead = np.unique(cell, return_index=True)
                self.slots.reshape(-1)[cell[lead]] = 0
                found[todo[lead]] = True
                todo = np.delete(todo, lead)
        self.n -= int(found.sum())
        return found


@dataclass(frozen=True)
class LineIndex:
    """The tables of an index. ``shards`` is a power of two and grows with the keys, ``keys`` is their number."""

    spark: SparkSession
    min_chars: int = 10
    shards: int = 0
    version: int = 0
    keys: int = 0
    refs: DataFrame | None = None
    counts: DataFrame | None = None
    filters: DataFrame | None = None
    deleted: DataFrame | None = None
    bits: int = BITS

    def live_refs(self) -> DataFrame:
        """References that no later deletion took back."""
        if self.deleted is None:
            return self.refs
        gone = self.deleted.groupBy("doc_id").agg(F.max("version").alias("gone"))
        return self.refs.join(gone, "doc_id", "left").where(F.col("gone").isNull() | (F.col("gone") < F.col("version"))).drop("gone")

    def latest_counts(self) -> DataFrame:
        """The current row of each key."""
        if self.version < 2:
            return self.counts
        row = F.max_by(F.struct("first_doc", "last_doc", "n_lines", "part"), "version").alias("row")
        return self.counts.groupBy("key").agg(row).select("key", "row.*")

    def sharded(self, keys: DataFrame) -> DataFrame:
        """``keys`` with the shard of each."""
        return keys.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(self.shards)).cast("int"))


def save(index: LineIndex, path: str) -> None:
    """Writes an index to a folder of its own, compacted: the current count of each key, the references that still hold, the filters.

    What later deletions or insertions made out of date isn't written, so an index that is saved and
    opened again has tables in proportion to the documents it holds.
    """
    tables = {"counts": index.latest_counts().where("n_lines > 0"), "refs": index.live_refs().select("key", "doc_id", "n"), "filters": index.filters} if index.version else {}
    for name, table in tables.items():
        table.write.parquet(f"{path}/{name}")
    state = index.spark.createDataFrame([(index.min_chars, index.shards, index.version, index.keys, index.bits)], _STATE)
    state.coalesce(1).write.parquet(f"{path}/state")  # the last one: without it the folder holds no index


def opened(spark: SparkSession, path: str) -> LineIndex:
    """The index that :func:`save` wrote; documents can be inserted and deleted as before."""
    state = spark.read.parquet(f"{path}/state").first()
    index = LineIndex(spark, state.min_chars, state.shards, int(state.version > 0), state.keys, bits=state.bits)
    if not state.version:
        return index
    counts, refs = (spark.read.parquet(f"{path}/{name}").withColumn("version", F.lit(1)) for name in ("counts", "refs"))
    return replace(index, counts=counts, refs=refs, filters=spark.read.parquet(f"{path}/filters"))


_STATE = "min_chars int, shards int, version int, keys long, bits int"
_FILTERS = "shard int, part int, n long, slots binary"


def line_keys(text: str | None, min_chars: int) -> list[bytes | None]:
    """The digest of each line's key; None for keys that are too short to count."""
    from xxhash import xxh3_128_digest

    keys = []
    for line in (text or "").split("\n"):
        line = line.strip(SPACE)
        keys.append(xxh3_128_digest(line.encode("utf-8", "surrogatepass").lower()) if len(line) >= min_chars else None)  # bytes.lower() is for A-Z only
    return keys


def document_keys(docs: DataFrame, min_chars: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(key, doc_id, n)``: how many lines with the key each document has. Null ids hold nothing."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, ids, n = [], [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for key, times in Counter(line_keys(text, min_chars)).items():
                if key is not None:
                    keys.append(key)
                    ids.append(doc)
                    n.append(times)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.int64()), pa.array(n, pa.int64())], ["key", "doc_id", "n"])

    chosen = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_texts(chosen, run, "key binary, doc_id long, n long")


def _hashes(keys: pa.ChunkedArray) -> np.ndarray:
    data = b"".join(keys.to_pylist())
    return np.frombuffer(data, np.uint64).reshape(-1, 2)[:, 0].copy() if data else np.empty(0, np.uint64)


def _read(filters: pa.Table, bits: int) -> list[CuckooFilter]:
    rows = sorted(zip(filters["part"].to_pylist(), filters["n"].to_pylist(), filters["slots"].to_pylist(), strict=True))
    return [CuckooFilter(len(s) // (2 * SLOTS), np.frombuffer(s, np.uint16).reshape(-1, SLOTS).copy(), n, bits) for _, n, s in rows]


def _written(keys: pa.Table, filters: pa.Table, chain: list[CuckooFilter]) -> pa.Table:
    """One shard's filter rows."""
    shard = (keys if keys.num_rows else filters)["shard"][0].as_py()
    return pa.table(
        {
            "shard": pa.array([shard] * len(chain), pa.int32()), "part": pa.array(range(len(chain)), pa.int32()),
            "n": pa.array([f.n for f in chain], pa.int64()), "slots": pa.array([f.slots.tobytes() for f in chain], pa.binary()),
        }
    )


def known_keys(keys: pa.Table, filters: pa.Table, bits: int = BITS) -> pa.Table:
    """One shard: the keys that the filters may know."""
    hashes = _hashes(keys["key"])
    known = np.zeros(len(hashes), bool)
    for f in _read(filters, bits):
        known |= f.contains(hashes)
    return keys.select(["key"]).filter(pa.array(known))


def insert_keys(keys: pa.Table, filters: pa.Table, bits: int = BITS) -> pa.Table:
    """One shard: the filters with the keys put in, all of them into the last one."""
    chain, new = _read(filters, bits), _hashes(keys["key"])
    if len(new):
        size = len(new)
        if not chain or chain[-1].room < size or not chain[-1].insert(new):
            while True:
                chain.append(CuckooFilter.sized(max(size, 2 * chain[-1].n if chain else 0), bits))
                if chain[-1].insert(new):
                    break
                chain.pop()
                size *= 2
    return _written(keys, filters, chain)


def remove_keys(keys: pa.Table, filters: pa.Table, bits: int = BITS) -> pa.Table:
    """One shard: the filters without the keys, each taken from the filter of its ``part``."""
    chain, hashes, parts = _read(filters, bits), _hashes(keys["key"]), keys["part"].to_numpy()
    for part, f in enumerate(chain):
        f.delete(hashes[parts == part])
    return _written(keys, filters, chain)


def _by_shard(index: LineIndex, keys: DataFrame, fn, schema: str) -> DataFrame:
    """``fn`` over each shard's keys (of about SHARD_KEYS, as shards grow with them) and filters."""
    filters = index.filters if index.filters is not None else index.spark.createDataFrame([], _FILTERS)
    bits = index.bits

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return fn(left, right, bits)

    return index.sharded(keys).groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(run, schema)


def build(spark: SparkSession, docs: DataFrame, insertions: int = 3, id_col: str = "doc_id", text_col: str = "text", **options) -> LineIndex:
    """An index of ``docs``, put in by ``insertions`` successive insertions of documents dealt by a hash of their ids."""
    index = LineIndex(spark, **options)
    found = stored(document_keys(docs, index.min_chars, id_col, text_col), "line-keys")
    turn = F.pmod(F.xxhash64("doc_id"), F.lit(insertions))
    for k in range(insertions):
        index = insert_refs(index, found.where(turn == k))
    return index


def insert(index: LineIndex, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_keys: int = SHARD_KEYS) -> LineIndex:
    """The index with ``docs`` added. A document should be inserted once; its repeated rows add up."""
    return insert_refs(index, stored(document_keys(docs, index.min_chars, id_col, text_col), "line-keys"), shard_keys)


def insert_refs(index: LineIndex, found: DataFrame, shard_keys: int = SHARD_KEYS) -> LineIndex:
    """The index with the references ``(key, doc_id, n)`` of new documents added."""
    version = index.version + 1
    refs = found.withColumn("version", F.lit(version))
    batch = found.groupBy("key").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.sum("n").alias("n_lines"))
    if not index.version:
        counts = stored(batch.withColumn("part", F.lit(0)), "line-counts")  # the first filter of every shard
        keys = counts.count()
        index = replace(index, shards=_shards_for(keys, shard_keys, 16))
        filters = stored(_by_shard(index, counts.select("key"), insert_keys, _FILTERS), "line-filters")
        return replace(index, version=version, keys=keys, refs=refs, counts=counts.withColumn("version", F.lit(version)), filters=filters)
    batch = stored(batch, "line-batch")
    known = _by_shard(index, batch.select("key"), known_keys, "key binary")
    old = index.latest_counts().where("n_lines > 0").select("key", *(F.col(c).alias(f"old_{c}") for c in ("first_doc", "last_doc", "n_lines", "part")))
    met = stored(known.join(old, "key"), "line-met")  # only what the filters may know is looked up
    new = batch.join(met, "key", "left_anti")
    filters = stored(_by_shard(index, new.select("key"), insert_keys, _FILTERS), "line-filters")
    last = filters.groupBy("shard").agg(F.max("part").alias("last_part"))  # a row for each SHARD_KEYS keys
    fresh = index.sharded(new).join(last, "shard").select("key", "first_doc", "last_doc", "n_lines", F.col("last_part").cast("int").alias("part"))
    again = batch.join(met, "key").select(
        "key", F.least("first_doc", "old_first_doc").alias("first_doc"), F.greatest("last_doc", "old_last_doc").alias("last_doc"), (F.col("n_lines") + F.col("old_n_lines")).alias("n_lines"), F.col("old_part").cast("int").alias("part")
    )
    counts = stored(fresh.unionByName(again).withColumn("version", F.lit(version)), "line-counts")
    keys = index.keys + counts.count() - met.count()
    index = replace(index, version=version, keys=keys, refs=index.refs.unionByName(refs), counts=index.counts.unionByName(counts), filters=filters)
    wanted = _shards_for(keys, shard_keys, index.shards)
    return index if wanted == index.shards else resharded(index, wanted)


def _shards_for(keys: int, shard_keys: int, least: int) -> int:
    """The smallest power of two, from ``least``, that leaves a shard ``shard_keys`` keys."""
    while least * shard_keys < keys:
        least *= 2
    return least


def resharded(index: LineIndex, shards: int) -> LineIndex:
    """The index dealt into ``shards`` shards, each with one filter made from the exact table."""
    index = replace(index, shards=shards, filters=None)
    live = stored(index.latest_counts().withColumn("part", F.lit(0)).withColumn("version", F.lit(index.version)), "line-counts")
    filters = stored(_by_shard(index, live.where("n_lines > 0").select("key"), insert_keys, _FILTERS), "line-filters")
    return replace(index, counts=live, filters=filters)


def delete(index: LineIndex, ids: DataFrame, id_col: str = "doc_id") -> LineIndex:
    """The index without the documents of ``ids``; ids that it doesn't hold change nothing."""
    if not index.version:
        return index
    version = index.version + 1
    ids = ids.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id")).distinct()
    gone = ids.withColumn("version", F.lit(version))
    touched = stored(index.live_refs().join(ids, "doc_id", "left_semi").select("key").distinct(), "line-touched")
    after = replace(index, version=version, deleted=gone if index.deleted is None else index.deleted.unionByName(gone))
    left = after.live_refs().join(touched, "key", "left_semi").groupBy("key").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.sum("n").alias("n_lines"))
    parts = index.latest_counts().select("key", "part")
    recount = touched.join(left, "key", "left").fillna(0, ["n_lines"]).join(parts, "key")
    recount = stored(recount.select("key", "first_doc", "last_doc", "n_lines", "part").withColumn("version", F.lit(version)), "line-counts")
    emptied = stored(recount.where("n_lines = 0").select("key", "part"), "line-emptied")
    filters = stored(_by_shard(index, emptied, remove_keys, _FILTERS), "line-filters")
    return replace(after, keys=index.keys - emptied.count(), counts=index.counts.unionByName(recount), filters=filters)


def dropped_keys(index: LineIndex) -> DataFrame:
    """``(doc_id, key)`` of the lines that go. A line that very many documents hold doesn't meet in one task."""
    repeated = index.latest_counts().where((F.col("n_lines") > 0) & (F.col("first_doc") < F.col("last_doc"))).select("key", "first_doc", "n_lines")
    held = index.live_refs().select("key", "doc_id")
    return join_facts(held, repeated, "key", "n_lines", "doc_id").where(F.col("doc_id") > F.col("first_doc")).select("doc_id", "key")


def clean(index: LineIndex, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """``docs`` (that the index holds) with ``text`` less its dropped lines, and its lines and dropped lines under the names ``counts``.

    Null and empty texts are one empty line. Rows with a null id, and documents that the index
    doesn't hold, lose nothing. Repeated rows are cleaned alike, an empty table gives no rows.
    Input columns of the names ``counts`` are replaced, all others stay.
    """
    drop_id, drop = free_name(docs, "_drop_id"), free_name(docs, "_drop")
    drops = dropped_keys(index).groupBy(F.col("doc_id").alias(drop_id)).agg(F.collect_set("key").alias(drop))
    kept = [f for f in docs.schema.fields if f.name not in (text_col, *counts)]
    schema = T.StructType([*kept, T.StructField(text_col, T.StringType()), *(T.StructField(c, T.LongType()) for c in counts)])
    least = index.min_chars

    def run(batches):
        for batch in batches:
            for part in slices(batch, 4_000_000):
                texts, n_lines, n_dropped = [], [], []
                for text, keys in zip(part.column(len(kept) + 1).to_pylist(), part.column(len(kept)).to_pylist(), strict=True):
                    lines = (text or "").split("\n")
                    n_lines.append(len(lines))
                    if keys:
                        gone = set(keys)
                        lines = [x for x, key in zip(lines, line_keys(text, least), strict=True) if key not in gone]
                    n_dropped.append(n_lines[-1] - len(lines))
                    texts.append("\n".join(lines))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], schema.names)

    joined = docs.join(drops, F.col(f"`{id_col}`").cast("long") == F.col(drop_id), "left")
    return joined.select(*(docs[f"`{f.name}`"] for f in kept), F.col(drop), docs[f"`{text_col}`"]).mapInArrow(run, schema)
