"""Running values and neighbours along an order, for keys of any size.

A window by key alone makes one task of a hot key. Here a key's rows are cut into blocks by a number
that doesn't fall along the order; a window works inside a block, and what the blocks before leave
is carried in from one row for each block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cut(df: DataFrame, block: Column) -> DataFrame:
    return df.withColumn("_block", block.cast("long"))


def running(df: DataFrame, keys: list[str], order: list[str], block: Column, sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None, before: bool = False) -> DataFrame:
    """``df`` with running sums and maxima by ``keys`` along ``order``; with ``before``, over the rows before each alone (null where there is none)."""
    sums, maxima = sums or {}, maxima or {}
    values = {**sums, **maxima}
    df = _cut(df, block).withColumns({f"_{n}": c for n, c in values.items()})
    last = -1 if before else 0
    within = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, last)
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    fold = {n: F.sum if n in sums else F.max for n in values}
    blocks = df.groupBy(*keys, "_block").agg(*(fold[n](f"_{n}").alias(n) for n in values))
    carry = blocks.select(*keys, "_block", *(fold[n](n).over(earlier).alias(f"_carry_{n}") for n in values))
    inside = df.withColumns({n: fold[n](f"_{n}").over(within) for n in values})

    def both(name: str) -> Column:
        a, b = F.col(f"_carry_{name}"), F.col(name)
        return F.greatest(a, b) if name in maxima else F.coalesce(a + b, a, b)

    kept = [c for c in inside.columns if c not in values and not c.startswith("_")]
    return inside.join(carry, [*keys, "_block"]).select(*kept, *(both(n).alias(n) for n in values))


def previous(df: DataFrame, keys: list[str], order: str, block: Column, columns: dict[str, str]) -> DataFrame:
    """``df`` with values of the row before by ``keys`` along ``order``: new name to column; null for a key's first row."""
    df = _cut(df, block).withColumn("_row", F.struct(*(F.col(c).alias(n) for n, c in columns.items())))
    within = Window.partitionBy(*keys, "_block").orderBy(order)
    ends = df.groupBy(*keys, "_block").agg(F.max_by("_row", order).alias("_end"))
    carry = ends.select(*keys, "_block", F.lag("_end").over(Window.partitionBy(*keys).orderBy("_block")).alias("_carry"))
    inside = df.withColumn("_was", F.lag("_row").over(within))
    was = F.coalesce("_was", "_carry")
    kept = [c for c in inside.columns if not c.startswith("_")]
    return inside.join(carry, [*keys, "_block"]).select(*kept, *(was[n].alias(n) for n in columns))


def dense_blocks(df: DataFrame, keys: list[str], column: str, size: int) -> DataFrame:
    """``(keys, block, rank)``: the blocks of ``size`` values of ``column`` in which a key has rows, numbered from 1."""
    blocks = df.select(*keys, F.floor(F.col(column) / F.lit(size)).cast("long").alias("block")).distinct()
    return blocks.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("block")))
