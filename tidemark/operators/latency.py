"""Log-linear histograms, quantiles, and latency corrected for queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.prefix import running

#: Fixed values. Each power of two is divided into this many bits of buckets; values from 2^MAX_EXPONENT overflow.
SUB_BITS, MAX_EXPONENT = 11, 42


def bucket_low(value: Column) -> Column:
    """The least value of the bucket, for 0 <= value < 2^MAX_EXPONENT."""
    shift = F.greatest(F.length(F.bin(value)) - 1 - SUB_BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def histogram(values: DataFrame, column: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """``(bucket_low, n)`` by keys; the overflow bucket is null."""
    v = F.col(column)
    low = F.when(v < F.lit(1 << MAX_EXPONENT), bucket_low(v))
    return values.where(v.isNotNull()).groupBy(*keys, low.alias("bucket_low")).agg(F.count("*").alias("n"), F.sum(F.when(low.isNotNull(), v)).alias("total"))


def merge(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return a.unionByName(b).groupBy(*keys, "bucket_low").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def summary(values: DataFrame, column: str) -> DataFrame:
    """Count, overflow, least, greatest and mean: recorded sum over the count with overflow."""
    v = F.col(column)
    inside = v < F.lit(1 << MAX_EXPONENT)
    return values.where(v.isNotNull()).agg(
        F.count("*").alias("n"), F.count_if(~inside).alias("overflow"), F.min(F.when(inside, v)).alias("least"), F.max(F.when(inside, v)).alias("greatest"),
        (F.coalesce(F.sum(F.when(inside, v)), F.lit(0)) / F.count("*")).alias("mean"),
    )


def quantiles(hist: DataFrame, qs: list[float]) -> DataFrame:
    """``(q, bucket_low, overflow)``: the first bucket whose running count reaches ``max(ceil(q n), 1)``.

    A rank in the overflow gives null and a flag; an empty histogram gives 0.
    """
    spark = hist.sparkSession
    order = Window.orderBy(F.col("bucket_low").asc_nulls_last())  # a histogram has at most some 65,000 buckets
    ranked = hist.withColumn("upto", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    total = hist.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("count"))
    wanted = spark.createDataFrame([(float(q),) for q in qs], "q double").join(F.broadcast(total)).withColumn("rank", F.greatest(F.ceil(F.col("q") * F.col("count")), F.lit(1)))
    met = wanted.join(ranked, F.col("upto") >= F.col("rank"), "left")
    first = met.groupBy("q", "count").agg(F.min_by(F.struct("bucket_low"), F.struct("upto")).alias("b"))
    low = F.when(F.col("count") == 0, F.lit(0)).otherwise(F.col("b.bucket_low"))
    return first.select("q", low.alias("bucket_low"), ((F.col("count") > 0) & F.col("b.bucket_low").isNull()).alias("overflow"))


#: A histogram as one value: totals, and the buckets that are not empty in order (at most some 65,000, mostly a few hundred).
SKETCH = ("count", "overflow", "total", "least", "greatest", "buckets")


def sketches(values: DataFrame, column: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """A row for each key with its histogram as columns :data:`SKETCH`, which :func:`merged_sketches` adds up. Null values are passed over.

    Counts by bucket are aggregated first, so a key of any size reaches its row as its buckets.
    """
    v = F.col(column)
    low = F.when(v < F.lit(1 << MAX_EXPONENT), bucket_low(v))
    found = values.where(v.isNotNull()).groupBy(*keys, low.alias("low")).agg(F.count("*").alias("n"), F.sum(v).alias("total"), F.min(v).alias("least"), F.max(v).alias("greatest"))
    return _gathered(found, keys)


def _gathered(found: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    inside = F.col("low").isNotNull()
    return found.groupBy(*keys).agg(
        F.sum("n").alias("count"), F.coalesce(F.sum(F.when(~inside, F.col("n"))), F.lit(0)).alias("overflow"), F.coalesce(F.sum(F.when(inside, F.col("total"))), F.lit(0)).alias("total"),
        F.min(F.when(inside, F.col("least"))).alias("least"), F.max(F.when(inside, F.col("greatest"))).alias("greatest"),
        F.sort_array(F.collect_list(F.when(inside, F.struct("low", "n")))).alias("buckets"),
    )


def merged_sketches(parts: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The sketches of parts added up by key: the same as one over all their values."""
    by_bucket = parts.select(*keys, F.explode("buckets").alias("b")).groupBy(*keys, F.col("b.low").alias("low")).agg(F.sum("b.n").alias("n"))
    buckets = by_bucket.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("low", "n"))).alias("buckets"))
    sums = parts.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("count", "overflow", "total")), F.min("least").alias("least"), F.max("greatest").alias("greatest"))
    if not keys:
        return sums.join(F.broadcast(buckets))  # one row each
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    none = F.array().cast(buckets.schema["buckets"].dataType)
    joined = sums.alias("a").join(buckets.alias("b"), same, "left")
    return joined.select("a.*", F.coalesce("b.buckets", none).alias("buckets"))


def sketch_quantile(q: float) -> Column:
    """The quantile as :func:`quantiles` has it, of a row of :data:`SKETCH`; null in the overflow, 0 for no values."""
    rank = F.greatest(F.ceil(F.lit(float(q)) * F.col("count")), F.lit(1))
    start = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(None).cast("long").alias("low"))
    step = lambda acc, b: F.struct((acc["upto"] + b["n"]).alias("upto"), F.when(acc["low"].isNull() & (acc["upto"] + b["n"] >= rank), b["low"]).otherwise(acc["low"]).alias("low"))
    return F.when(F.col("count") == 0, F.lit(0)).otherwise(F.aggregate("buckets", start, step)["low"])


def keep_sketches(values: DataFrame, column: str, keys: tuple[str, ...], folder: str, checkpoint: str):
    """Starts a stream that keeps each micro-batch's sketches under ``folder``, by batch; the table's :func:`merged_sketches` is the whole.

    A batch that is run again replaces its own files, so no value counts twice.
    """

    def keep(batch: DataFrame, number: int) -> None:
        sketches(batch, column, keys).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return values.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def queued(items: DataFrame, keys: tuple[str, ...] = ("server",), block: int = 100_000_000) -> DataFrame:
    """Finish time, service and corrected latency of each item of a first-come queue, and whether it had to wait.

    With C the running sum of service, the finish is C plus the running maximum of ``sched - (C - service)``.
    A server's items are shared by as many tasks as ``sched`` has blocks.
    """
    cut, order = F.floor(F.col("sched") / F.lit(block)), ["sched", "item"]
    out = running(items, list(keys), order, cut, sums={"c": F.col("service")})
    out = running(out, list(keys), order, cut, maxima={"start": F.col("sched") - F.col("c") + F.col("service")})
    out = out.withColumn("finish", F.col("c") + F.col("start"))
    return out.select(*keys, "item", "sched", "service", "finish", (F.col("finish") - F.col("sched")).alias("corrected"), (F.col("finish") - F.col("service") > F.col("sched")).alias("behind"))


def spread_of_runs(runs: DataFrame, variant: str = "variant", seconds: str = "seconds") -> DataFrame:
    """Best, worst and spread by variant; a step over the variant before is unresolved if smaller than the spread."""
    best = runs.groupBy(variant).agg(F.min(seconds).alias("best"), F.max(seconds).alias("worst")).withColumn("spread", F.col("worst") - F.col("best"))
    step = F.col("best") - F.lag("best").over(Window.orderBy(variant))  # a row for each variant
    return best.withColumn("step", step).withColumn("unresolved", F.abs("step") < F.col("spread"))
