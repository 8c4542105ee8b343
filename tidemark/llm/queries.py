"""The registered queries of this subpackage, with DuckDB oracles where SQL can state the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe_sql, chat, html_extract, langid, line_dedup, near_dedup, packing, pii, quality, repetition, resampling, topk_search, whitening
from tidemark.tables import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = stored(topk_search.quantized(table(spark, sf_dir, "embeddings")), "vectors")
    return topk_search.top_k(vectors.where(F.col("vec_id") % 20 == 0), vectors, 20)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cleaned = line_dedup.clean(line_dedup.build(spark, docs), docs)
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op3_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_rules(table(spark, sf_dir, "documents"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    transcripts = chat.as_transcripts(table(spark, sf_dir, "conversations"))
    return chat.parse(transcripts, chat.train(transcripts))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_sql.bpe_digests(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_topk_search, op2_line_dedup, op3_repetition_rules, op4_near_dedup, op5_html_extraction, op6_packing, op7_chat, op8_quality, op9_bpe, op10_language_id, op11_resampling, op12_whitening, op13_pii)}

ORACLES = {
    "op1_topk_search": """
WITH sound AS (
    SELECT row_number() OVER () AS r, vec_id, embedding AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), terms AS (
    SELECT r, vec_id, i, floor(64 * e[i]::DOUBLE)::BIGINT AS w FROM sound, unnest(range(1, len(e) + 1)) AS u(i)
), scores AS (
    SELECT q.r, q.vec_id AS query_id, c.r AS other, c.vec_id, sum(q.w * c.w)::BIGINT AS score
    FROM terms q JOIN terms c ON q.i = c.i AND q.r <> c.r WHERE q.vec_id % 20 = 0 GROUP BY ALL
)
SELECT query_id, rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scores) WHERE rank <= 20
""",
    "op2_line_dedup": r"""
WITH lines AS (
    SELECT doc_id, i, l, translate(trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), unnest(ls) WITH ORDINALITY AS u(l, i)
), repeated AS (
    SELECT key, min(doc_id) AS first_doc FROM lines WHERE length(key) >= 10 GROUP BY key HAVING min(doc_id) < max(doc_id)
), marked AS (
    SELECT doc_id, i, l, r.key IS NOT NULL AND doc_id > first_doc AS dropped FROM lines LEFT JOIN repeated r USING (key)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
    "op4_near_dedup": r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
    SELECT DISTINCT doc_id, array_to_string(w[i : i + least(len(w), 5) - 1], ' ') AS s FROM words, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS u(i) WHERE len(w) > 0
), sizes AS (
    SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), links AS (
    SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL)
    JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)
), reach AS (
    SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) ON a = d.doc_id
""",
}
