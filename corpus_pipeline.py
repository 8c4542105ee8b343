"""A corpus pipeline: STAGES are applied to ``documents`` in order, each to all that the one before it kept.

In every stage rows with null ids or texts are ordinary rows, an empty table gives an empty one, and
columns of the input stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import langid, line_dedup, near_dedup, packing, quality
from tidemark.llm.common import free_name, stored


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects: by their texts alone, so repeated rows go or stay together."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = quality.score(docs, model, keep=True)
    return found.where(F.col(free_name(docs, "_predicted")) == 1).select(*docs.columns)


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told: no letter, or no language with half of the letters. Null and empty texts go."""
    found = langid.predict(docs, langid.train(docs), keep=True)
    told = (F.col(free_name(docs, "_lang_pred")) != langid.UNDETERMINED) & (F.col(free_name(docs, "_score")) >= 0.5)
    return found.where(told).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines that an earlier document has out of the texts; ``n_chars`` follows.

    Emptied documents stay, with empty texts, as do documents without an id, unchanged. Repeated
    rows of one document are cleaned alike.
    """
    counts = (free_name(docs, "_n_lines"), free_name(docs, "_n_dropped"))
    found = line_dedup.clean(line_dedup.build(spark, docs), docs, counts=counts)
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def _by_text(spark: SparkSession, docs: DataFrame, number: str) -> DataFrame:
    """``docs`` with ``number``: its id, or, where rows of one id have different texts, a number of the row's id and text beyond all ids.

    Ids that stand for several texts are few: up to a counted million are sent to every task, more are joined by a shuffle.
    """
    key = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    several = stored(docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(key).alias("low"), F.max(key).alias("high")).where("low != high").select("doc_id"), "repeated-ids")
    n = several.count()
    if not n:
        return docs.withColumn(number, F.col("doc_id"))
    most, _key = docs.agg(F.max("doc_id")).first()[0], free_name(docs, "_key")
    keyed = docs.withColumn(_key, key)
    pairs = keyed.select("doc_id", _key).join(F.broadcast(several) if n <= near_dedup.BROADCAST_IDS else several, "doc_id", "left_semi").distinct()
    pairs = stored(pairs.repartitionByRange("doc_id", _key).sortWithinPartitions("doc_id", _key).withColumn(number, most + 1 + F.monotonically_increasing_id()), "numbered-texts")
    pairs = F.broadcast(pairs) if pairs.count() <= near_dedup.BROADCAST_IDS else pairs
    return keyed.join(pairs, ["doc_id", _key], "left").withColumn(number, F.coalesce(number, "doc_id")).select(*docs.columns, number)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group of near-duplicates, in one row.

    Rows of one id with different texts are documents of their own, which come after all others (by
    id, then by a digest of the text). Of rows that repeat id and text the smallest by the other columns, which
    must have an order, stays. Documents without words and rows without an id stay.
    """
    number = free_name(docs, "_number")
    docs = _by_text(spark, docs, number)
    kept = near_dedup.near_duplicates(docs, number).where("kept AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias(number)).agg(F.count("*").alias("n"))
    once, again = (docs.join(kept.where(c).select(number), number, "left_semi").select(*docs.columns) for c in ("n = 1", "n > 1"))
    row = F.struct("doc_id", "text", *(c for c in docs.columns if c not in ("doc_id", "text", number)))
    smallest = again.groupBy(number).agg(F.min(row).alias("row")).select("row.*", number).select(*docs.columns)
    return once.unionByName(smallest).unionByName(docs.where(F.col(number).isNull())).drop(number)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the texts into sequences of 1024 tokens; a null text is an empty one, repeated rows are packed each."""
    return packing.pack_documents(docs)


STAGES = [("quality", keep_good), ("language", keep_identified), ("lines", drop_repeated_lines), ("near copies", drop_near_copies), ("packing", pack)]

#: Boosted trees, Viterbi labels and packing have no SQL form; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
