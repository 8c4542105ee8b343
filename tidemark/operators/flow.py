"""Order-flow imbalance, fixed buckets, and regression with autocorrelation-robust errors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.prefix import previous
from tidemark.tables import stored

#: Sequence numbers of a symbol that are one block.
BLOCK = 50_000
#: Least quotes and returns for a result, and the mark of significance.
MIN_QUOTES, MIN_RETURNS, SIGNIFICANT = 100, 50, 1.96


def mid(quotes: DataFrame) -> DataFrame:
    """Mid prices in dollars: the one step where prices become floating."""
    return quotes.withColumn("mid", (F.col("bid") + F.col("ask")) / F.lit(2.0) / F.lit(10000.0))


def order_flow_imbalance(quotes: DataFrame, key: str = "symbol", block: int = BLOCK) -> DataFrame:
    """``ofi`` of each quote against the one before; a symbol's first quote has none and is left out."""
    cols = ("bid", "bid_size", "ask", "ask_size")
    q = previous(quotes, [key], "seq", F.floor(F.col("seq") / F.lit(block)), {f"p_{c}": c for c in cols}).where(F.col("p_bid").isNotNull())
    when = lambda cond, v: F.when(cond, v).otherwise(0)
    ofi = (
        when(F.col("bid") >= F.col("p_bid"), F.col("bid_size")) - when(F.col("bid") <= F.col("p_bid"), F.col("p_bid_size"))
        - when(F.col("ask") <= F.col("p_ask"), F.col("ask_size")) + when(F.col("ask") >= F.col("p_ask"), F.col("p_ask_size"))
    )
    return q.withColumn("ofi", ofi).drop(*(f"p_{c}" for c in cols))


def buckets(quotes: DataFrame, width_ns: int, key: str = "symbol") -> DataFrame:
    """OFI and last mid of each observed bucket; bucket 0 begins at a symbol's second quote."""
    flow = mid(order_flow_imbalance(quotes, key))
    start = flow.groupBy(key).agg(F.min_by("ts_nanos", "seq").alias("start"))  # a row for each symbol
    idx = F.floor((F.col("ts_nanos") - F.col("start")) / F.lit(width_ns)).cast("long")
    return flow.join(start, key).withColumn("idx", idx).groupBy(key, "idx").agg(F.sum("ofi").alias("ofi"), F.max_by("mid", "seq").alias("last_mid"))


def regressors(quotes: DataFrame, width_ns: int, key: str = "symbol", min_quotes: int = MIN_QUOTES, min_returns: int = MIN_RETURNS) -> DataFrame:
    """``(key, t, x, y)``: a bucket's OFI and the next observed bucket's return. Symbols with too few of either are left out."""
    enough = quotes.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= min_quotes).select(key)
    cut = buckets(quotes.join(enough, key, "left_semi"), width_ns, key)
    w = Window.partitionBy(key).orderBy("idx")
    rows = cut.select(key, F.row_number().over(w).alias("t"), F.col("ofi").cast("double").alias("x"), (F.lead("last_mid").over(w) - F.col("last_mid")).alias("y")).where(F.col("y").isNotNull())
    n = rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= min_returns).select(key)
    return rows.join(n, key, "left_semi")


def with_lagged_flow(rows: DataFrame, key: str = "symbol") -> DataFrame:
    """``rows`` with ``x2``, the OFI of the bucket before; a symbol's first row is left out."""
    lagged = previous(rows, [key], "t", F.floor(F.col("t") / F.lit(BLOCK)), {"x2": "x"})
    return lagged.where("x2 IS NOT NULL")


def lag_sums(u: DataFrame, key: str, width: int, block: int = BLOCK) -> DataFrame:
    """By key the matrix (row by row, in ``s``) of autocovariances of the vectors ``u``: over lags 0 to ``lags``, with falling weights, a lag with its transpose.

    Row numbers ``t`` are cut into blocks, each with the rows up to ``lags`` before it, so a row is copied once at most.
    """
    size = F.greatest(F.lit(block), F.col("lags"))  # the lags never reach beyond the block before
    number = F.floor(F.col("t") / size).cast("long")
    to = F.when((F.pmod(F.col("t"), size) >= size - F.col("lags")), F.array(number, number + 1)).otherwise(F.array(number))
    dealt = u.select(F.col(key).alias("_key"), "t", "u", "lags", number.alias("own"), F.explode(to).alias("block"))

    def sums(table: pa.Table) -> pa.Table:
        table = table.sort_by([("t", "ascending")]).combine_chunks()
        t, own, block = (table[c].to_numpy() for c in ("t", "own", "block"))
        rows = pc.list_flatten(table["u"]).to_numpy().reshape(-1, width)
        lags, mine = int(table["lags"][0].as_py()), own == block
        out = np.zeros((width, width))
        for j in range(lags + 1):
            at = np.searchsorted(t, t[mine] - j)  # the row j before, where there is one
            hit = t[np.minimum(at, len(t) - 1)] == t[mine] - j
            g = rows[np.flatnonzero(mine)[hit]].T @ rows[at[hit]]
            out += g if j == 0 else (1 - j / (lags + 1.0)) * (g + g.T)
        return pa.table({"_key": table["_key"].slice(0, 1), **{f"s{i}": pa.array([v]) for i, v in enumerate(out.ravel().tolist())}})

    kind, parts = u.schema[key].dataType.simpleString(), [f"s{i}" for i in range(width * width)]
    found = dealt.groupBy("_key", "block").applyInArrow(sums, f"_key {kind}, " + ", ".join(f"{p} double" for p in parts))
    return found.groupBy(F.col("_key").alias(key)).agg(*(F.sum(p).alias(p) for p in parts)).select(key, F.array(*parts).alias("s"))


def report(fit: DataFrame, key: str = "symbol") -> DataFrame:
    """``(key, line_no, line)``: each regression as text: its size and fit, then ``term = estimate +- 1.96 errors``, marked where that leaves out 0."""
    by_term = F.struct("term", F.format_string("  %s = %.5e +- %.1e%s", "term", "beta", F.col("stderr") * SIGNIFICANT, F.when(F.col("significant"), " *").otherwise("")).alias("line"))
    head = F.format_string("%d buckets, %.2f%% explained, errors over %d lags", F.first("n"), F.first("r2") * 100, F.first("lags"))
    lines = fit.groupBy(key).agg(F.concat(F.array(head), F.transform(F.sort_array(F.collect_list(by_term)), lambda r: r["line"])).alias("lines"))  # a row for each term
    return lines.select(key, F.posexplode("lines").alias("line_no", "line"))


def planted(rows: DataFrame, beta: float = 0.002) -> DataFrame:
    """``rows`` whose return is made of the flow by a known coefficient and a residue of the row's number, so that the fit can be told right or wrong."""
    return rows.withColumn("y", F.lit(beta) * F.col("x") + ((F.col("t") * 7919) % 1000 - 500) / F.lit(10_000.0))


def covers(fit: DataFrame, beta: float, term: str = "ofi", key: str = "symbol") -> DataFrame:
    """Whether the 95% interval of a term's coefficient has the value ``beta``."""
    return fit.where(F.col("term") == term).select(key, F.lit(beta).alias("true_beta"), (F.abs(F.col("beta") - beta) <= SIGNIFICANT * F.col("stderr")).alias("contains"))


def _solve(moments, k: int, intercept: bool):
    """Slopes and the inverse of the cross products of a batch of keys; ``sound`` where the regressors are independent."""
    n = moments["n"].to_numpy().astype(float)
    c = np.empty((len(n), k, k))
    for i in range(k):
        for j in range(i + 1):
            c[:, i, j] = c[:, j, i] = moments[f"c{j}_{i}"].to_numpy()
    cy = np.stack([moments[f"c{i}_y"].to_numpy() for i in range(k)], 1)
    scale = np.sqrt(np.maximum(np.einsum("kii->ki", c), 0))
    safe = np.where(scale > 0, scale, 1)
    unit = c / safe[:, :, None] / safe[:, None, :]
    sound = (scale > 0).all(1) & (np.linalg.matrix_rank(unit, tol=1e-10, hermitian=True) == k)
    inner = np.linalg.pinv(unit, hermitian=True) / safe[:, :, None] / safe[:, None, :]
    slopes = np.einsum("kij,kj->ki", inner, cy)
    width = k + intercept
    inverse = np.zeros((len(n), width, width))
    inverse[:, intercept:, intercept:] = inner / n[:, None, None]
    if intercept:
        inverse[:, 0, 0] = 1 / n
    return slopes, inverse, sound


def ols_hac(rows: DataFrame, key: str = "symbol", lags: int | None = None, columns: tuple[str, ...] = ("x",), names: tuple[str, ...] = ("ofi",), intercept: bool = True) -> DataFrame:
    """y on ``columns`` (and an intercept) by key, with Newey-West errors: one row for each key and term.

    Moments are aggregates, centred where there is an intercept; a row of them for each key is
    solved in NumPy, many keys at a time. Autocovariances are sums over blocks (:func:`lag_sums`), of
    the centred regressors, and are carried back to the terms at the end. Keys with no more rows
    than terms, or with regressors that depend on each other, give no result.
    """
    k, width = len(columns), len(columns) + intercept
    rows = stored(rows.select(key, "t", *(F.col(c).alias(f"_x{i}") for i, c in enumerate(columns)), "y"), "regression-rows")
    columns = tuple(f"_x{i}" for i in range(k))
    kind = rows.schema[key].dataType.simpleString()
    cross = F.covar_pop if intercept else lambda a, b: F.avg(F.col(a) * F.col(b))
    pairs = [(f"c{j}_{i}", columns[j], columns[i]) for i in range(k) for j in range(i + 1)] + [(f"c{i}_y", c, "y") for i, c in enumerate(columns)]
    means = F.array(*((F.avg(c) if intercept else F.lit(0.0)) for c in columns))
    m = rows.groupBy(key).agg(F.count("*").alias("n"), means.alias("mx"), (F.avg("y") if intercept else F.lit(0.0)).alias("my"), F.var_pop("y").alias("vy"), *(cross(a, b).alias(name) for name, a, b in pairs)).where(F.col("n") > width)
    bandwidth = F.lit(lags).cast("int") if lags is not None else F.greatest(F.lit(1), F.floor(4 * F.pow(F.col("n") / 100, F.lit(2.0 / 9.0))).cast("int"))

    def solve(batches):
        for batch in batches:
            if batch.num_rows:
                slopes, inverse, sound = _solve(batch, k, intercept)
                kept = [batch[c] for c in (key, "n", "lags", "mx", "my", "vy")]
                added = [pa.array(list(slopes), pa.list_(pa.float64())), pa.array(list(inverse.reshape(len(slopes), -1)), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([*kept, *added], [key, "n", "lags", "mx", "my", "vy", "b", "inverse"]).filter(pa.array(sound))

    fields = "n long, lags int, mx array<double>, my double, vy double, b array<double>, inverse array<double>"
    solved = stored(m.withColumn("lags", bandwidth).mapInArrow(solve, f"`{key}` {kind}, {fields}"), "regression-fits")
    x = [F.col(c) - F.col("mx")[i] for i, c in enumerate(columns)]
    e = F.col("y") - F.col("my") - sum((F.col("b")[i] * c for i, c in enumerate(x)), F.lit(0.0))
    u = rows.join(solved, key).withColumn("e", e).select(key, "t", "e", "lags", F.transform(F.array(*([F.lit(1.0)] if intercept else []), *x), lambda v: v * F.col("e")).alias("u"))
    rss = u.groupBy(key).agg(F.sum(F.col("e") * F.col("e")).alias("rss"))
    joined = solved.join(lag_sums(u, key, width), key).join(rss, key)

    def finish(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            n, lag, my, vy, left = (batch[c].to_numpy() for c in ("n", "lags", "my", "vy", "rss"))
            mx, b, inverse, s = (np.array(batch[c].to_pylist(), float).reshape(len(n), -1) for c in ("mx", "b", "inverse", "s"))
            inverse, s = inverse.reshape(-1, width, width), s.reshape(-1, width, width)
            back = np.broadcast_to(np.eye(width), inverse.shape).copy()  # from centred regressors to the terms
            beta = b
            if intercept:
                back[:, 0, 1:] = -mx
                beta = np.concatenate([(my - (b * mx).sum(1))[:, None], b], 1)
            half = back @ inverse
            errors = np.sqrt(np.maximum(np.einsum("kij,kjl,kil->ki", half, s, half), 0))
            tstat = np.divide(beta, errors, out=np.zeros_like(beta), where=errors > 0)
            r2 = np.where(vy > 0, 1 - left / (n * np.where(vy > 0, vy, 1)), 0.0)
            each = pa.array(np.repeat(np.arange(len(n)), width))
            yield pa.RecordBatch.from_arrays(
                [
                    batch[key].take(each), pa.array(terms * len(n)), *(pa.array(v.ravel()) for v in (beta, errors, tstat)), pa.array((np.abs(tstat) > SIGNIFICANT).ravel()), pa.array(np.repeat(r2, width)),
                    batch["n"].take(each), batch["lags"].take(each),
                ],
                [key, "term", "beta", "stderr", "tstat", "significant", "r2", "n", "lags"],
            )

    terms = [*(["intercept"] if intercept else []), *names]
    return joined.mapInArrow(finish, f"`{key}` {kind}, term string, beta double, stderr double, tstat double, significant boolean, r2 double, n long, lags int")
