"""What several operators share: tables in the shared folder, bounded caches, word splitting."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.tables import stored

#: ASCII white space as the contracts have it: 0x20 and 0x09 to 0x0D.
SPACE = " \t\n\x0b\x0c\r"

#: A key with more than this share of all rows is dealt to several tasks.
HOT_SHARE = 2000


def join_facts(rows: DataFrame, facts: DataFrame, key: str, n: str, spread: str, counts: DataFrame | None = None) -> DataFrame:
    """``rows`` joined to ``facts`` by ``key`` (and without ``n``), no more than 1 / HOT_SHARE of all rows meeting in one key's task.

    ``facts`` has one row for each key and in ``n`` the number of its rows (an upper bound will do);
    where its rows are wide, ``counts`` has the two columns apart. The rows of keys beyond that
    share are dealt by a hash of their column ``spread``, and such a key's facts are copied to each
    part. Keys beyond it are at most HOT_SHARE and the copies twice that, whatever the size of the
    tables; only these keys and their parts are broadcast.
    """
    if counts is None:
        counts = facts = stored(facts, "facts")
    share = max(1, (counts.agg(F.sum(n)).first()[0] or 0) // HOT_SHARE)
    hot = F.broadcast(counts.where(F.col(n) > share).select(key, F.ceil(F.col(n) / F.lit(share)).cast("int").alias("_parts")))
    part = F.coalesce(F.pmod(F.xxhash64(spread), F.col("_parts")), F.lit(0)).cast("int")
    dealt = rows.join(hot, key, "left").withColumn("_part", part).drop("_parts")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1))
    copied = facts.drop(n).join(hot, key, "left").withColumn("_part", copies).drop("_parts")
    return dealt.join(copied, [key, "_part"]).drop("_part")


def map_texts(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch], schema, chars: int = 4_000_000) -> DataFrame:
    """``mapInArrow`` in slices of about ``chars`` bytes of the last column, so that memory doesn't follow the batch size."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, chars):
                yield fn(part)

    return df.mapInArrow(run, schema)


def free_name(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores more as it takes for no column of ``df`` to have it, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_results(docs: DataFrame, fn: Callable[[list], dict[str, pa.Array]], text_col: str, results: str, chars: int = 4_000_000, keep_text: bool = True) -> DataFrame:
    """``docs`` with the columns that ``fn`` makes from its texts; ``results`` is their schema. Columns of the same names are replaced."""
    added = T.StructType.fromDDL(results)
    kept = [f for f in docs.schema.fields if f.name not in added.names and f.name != text_col]
    text = [docs.schema[text_col]] if keep_text else []
    schema = T.StructType([*kept, *text, *added.fields])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = fn(batch.column(batch.num_columns - 1).to_pylist())
        columns = batch.columns if keep_text else batch.columns[:-1]
        return pa.RecordBatch.from_arrays([*columns, *(made[n] for n in added.names)], schema.names)

    return map_texts(docs.select(*(docs[f"`{f.name}`"] for f in kept), docs[f"`{text_col}`"]), run, schema, chars)


def slices(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """``batch`` cut before a slice's last column passes ``most`` bytes; a longer row is a slice of its own."""
    import numpy as np
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    total, start = np.cumsum(sizes), 0
    while start < len(sizes):
        done = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, done + most, "right")))
        yield batch.slice(start, end - start)
        start = end


class Cache:
    """A dict of bounded size: of two generations the older goes when the younger is full. Values mustn't be None."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def get(self, key):
        value = self.young.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        self.young[key] = value
