"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors become integers ``floor(64 * x)``. Queries and candidates are dealt into blocks by a
hash; each cell of the grid of query blocks and candidate blocks is one cogroup. Inside a cell
the candidates are postings lists by term (dimension), every query is a sparse row whose terms
scatter weighted postings into a dense score array, and a partition selection keeps the block's
best k. A window over each query's block results merges them. Up to a certain size more rows make
more blocks, beyond it larger ones, until a block fills its share of a task's memory; so what is
copied to meet each block of the other side, and the number of cells, grow slowly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RESULT = "query_id long, rank int, vec_id long, score long"
_FOUND = "query_id long, query_row long, vec_id long, score long"


#: Rows of a block of queries and of candidates, how many such blocks there may be before blocks grow, and what a grown block may hold in bytes.
QUERY_BLOCK, CANDIDATE_BLOCK, QUERY_BLOCKS, CANDIDATE_BLOCKS, BLOCK_BYTES = 2048, 8192, 16, 64, 64 << 20
#: Bytes of copied rows that one task reads.
TASK_BYTES = 64 << 20


def quantized(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, row, v array<bigint>)``: floor(64 * x) of each component; ``row`` numbers the rows.

    Null ids, null vectors and vectors with a null or non-finite component take no part. Rows that
    repeat an id are rows of their own. Components beyond the range of a long saturate. The numbers
    are fixed only once the result is written, which :func:`top_k` expects.
    """
    x = F.col(vector_col)
    sound = x.isNotNull() & ~F.exists(x, lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf")))
    ints = F.transform(x, lambda e: F.floor(e.cast("double") * F.lit(64.0)).cast("bigint"))
    return vectors.where(F.col(id_col).isNotNull() & sound).select(F.col(id_col).cast("long").alias("vec_id"), F.monotonically_increasing_id().alias("row"), ints.alias("v"))


def _sparse(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids and row numbers, and place, term and weight of each component that isn't 0."""
    ids, numbers = table.column("vec_id").to_numpy(), table.column("row").to_numpy()
    lists = table.column("v").combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0) if lists.num_chunks else pa.array([], pa.list_(pa.int64()))
    lengths = np.diff(lists.offsets.to_numpy())
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    starts = np.cumsum(lengths) - lengths
    rows = np.repeat(np.arange(len(ids)), lengths)
    terms = np.arange(len(values)) - np.repeat(starts, lengths)
    some = values != 0
    return ids, numbers, rows[some], terms[some], values[some]


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to smaller ids: a partition selection, then a sort of what ties at the edge."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        among = np.flatnonzero(scores >= edge)
    else:
        among = np.arange(len(scores))
    return among[np.lexsort((ids[among], -scores[among]))[:k]]


def search_block(queries: pa.Table, candidates: pa.Table, k: int) -> pa.Table:
    """The best k of a block of candidates for each of a block of queries."""
    qid, qnumber, qrow, qterm, qweight = _sparse(queries)
    cid, cnumber, crow, cterm, cweight = _sparse(candidates)
    order = np.lexsort((cnumber, cid))
    place = np.empty(len(cid), np.int64)
    place[order] = np.arange(len(cid))
    cid, cnumber, crow = cid[order], cnumber[order], place[crow]
    dims = int(max(qterm.max(initial=-1), cterm.max(initial=-1))) + 1
    largest = lambda x: max(-int(x.min(initial=0)), int(x.max(initial=0)), 1)
    top = largest(qweight) * largest(cweight) * max(dims, 1)
    kind = np.int32 if top < 2**31 else np.int64  # int64 wraps only where no long holds the score
    by_term = np.argsort(cterm, kind="stable")
    crow, cweight, edges = crow[by_term], cweight[by_term].astype(kind), np.searchsorted(cterm[by_term], np.arange(dims + 1))
    postings = [(crow[a:b], cweight[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    ends = np.searchsorted(qrow, np.arange(len(qid) + 1))
    scores = np.empty(len(cid), kind)
    found = ([], [], [], [])
    for q in range(len(qid)):
        scores[:] = 0
        for t, w in zip(qterm[ends[q] : ends[q + 1]].tolist(), qweight[ends[q] : ends[q + 1]].tolist(), strict=True):
            rows, weights = postings[t]
            scores[rows] += weights * kind(w)  # a row occurs once in a term's list
        at = _best(cid, scores, k + 1)
        at = at[cnumber[at] != qnumber[q]][:k]
        for column, values in zip(found, (np.full(len(at), qid[q]), np.full(len(at), qnumber[q]), cid[at], scores[at].astype(np.int64)), strict=True):
            column.append(values)
    columns = [np.concatenate(x) if x else np.empty(0, np.int64) for x in found]
    return pa.table([pa.array(x, pa.int64()) for x in columns], ["query_id", "query_row", "vec_id", "score"])


def _block_count(rows: int, row_bytes: float, block: int, blocks: int) -> int:
    """How many blocks: of ``block`` rows until there are ``blocks``, then of more, until they hold BLOCK_BYTES."""
    most = max(block, int(BLOCK_BYTES / max(row_bytes, 8)))
    return max(1, -(-rows // most), min(blocks, -(-rows // block)))


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """Each query row's ``k`` candidate rows of highest inner product, its own row left out.

    Both sides are written tables ``(vec_id, row, v)`` as :func:`quantized` makes them, with row
    numbers of one table. Fewer candidates than ``k``: all of them. Rows that repeat an id are
    queries and candidates each. Ties go to smaller ids. Vectors of different lengths multiply over
    their common terms; an empty vector scores 0 with each. An empty side gives no rows.
    """
    about = candidates.agg(F.count("*").alias("n"), F.avg(F.size("v")).alias("size")).first()
    row_bytes, n_queries = 8.0 * (about["size"] or 1) + 16, queries.count()
    n_q = _block_count(n_queries, row_bytes, query_block, QUERY_BLOCKS)
    n_c = _block_count(about["n"], row_bytes, candidate_block, CANDIDATE_BLOCKS)
    block = lambda n: F.pmod(F.xxhash64("vec_id", "row"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select("vec_id", "row", "v", block(n_q).alias("qb")).withColumn("cb", each(n_c))
    c = candidates.select("vec_id", "row", "v", block(n_c).alias("cb")).withColumn("qb", each(n_q))
    copied = row_bytes * (n_queries * n_c + about["n"] * n_q)
    tasks = min(n_q * n_c, max(256, int(copied / TASK_BYTES)))

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        return search_block(left, right, k)

    found = q.repartition(tasks, "qb", "cb").groupBy("qb", "cb").cogroup(c.repartition(tasks, "qb", "cb").groupBy("qb", "cb")).applyInArrow(cell, _FOUND)
    order = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
