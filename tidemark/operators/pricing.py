"""European options: prices and Greeks as native expressions, implied volatility, Monte Carlo.

Options are rows ``(spot, strike, rate, vol, time)`` with ``kind`` 'call' or 'put'. Without time or
volatility the price is the undiscounted intrinsic value and delta is a step.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.normal import cdf, cdf_sql, pdf_sql

MIN_VEGA, Z95 = 1e-4, 1.959963985

#: Steps from inputs to results, as SQL expressions: each level may use the ones before.
LEVELS = (
    {"live": "time > 0 AND vol > 0", "disc": "exp(-rate * time)"},
    {"d1": "CASE WHEN live THEN (ln(spot / strike) + (rate + 0.5e0 * vol * vol) * time) / (vol * sqrt(time)) ELSE 0e0 END"},
    {"d2": "CASE WHEN live THEN d1 - vol * sqrt(time) ELSE 0e0 END"},
    {"n1": cdf_sql("d1"), "n2": cdf_sql("d2"), "pdf": pdf_sql("d1"), "sign": "CASE WHEN kind = 'call' THEN 1e0 ELSE -1e0 END"},
    {"m1": "CASE WHEN kind = 'call' THEN n1 ELSE n1 - 1e0 END", "m2": "CASE WHEN kind = 'call' THEN n2 ELSE n2 - 1e0 END"},
    {
        "price": "CASE WHEN live THEN spot * m1 - strike * disc * m2 ELSE greatest(sign * (spot - strike), 0e0) END",
        "delta": "CASE WHEN live THEN m1 WHEN sign * (spot - strike) > 0 THEN sign ELSE 0e0 END",
        "gamma": "CASE WHEN live THEN pdf / (spot * vol * sqrt(time)) ELSE 0e0 END",
        "vega": "CASE WHEN live THEN spot * pdf * sqrt(time) ELSE 0e0 END",
        "theta": "CASE WHEN live THEN -spot * pdf * vol / (2e0 * sqrt(time)) - rate * strike * disc * m2 ELSE 0e0 END",
        "rho": "CASE WHEN live THEN strike * time * disc * m2 ELSE 0e0 END",
    },
)
RESULTS = tuple(LEVELS[-1])


def priced(options: DataFrame) -> DataFrame:
    """The options with price, delta, gamma, vega (per 1.00), theta (per year) and rho."""
    names = options.columns
    for level in LEVELS:
        options = options.withColumns({k: F.expr(v) for k, v in level.items()})
    return options.select(*names, *RESULTS)


def parity_residual(options: DataFrame) -> DataFrame:
    """Call less put less the discounted forward: 0 but for rounding."""
    both = priced(options.withColumn("kind", F.lit("call"))).withColumnRenamed("price", "call").drop(*RESULTS[1:], "kind")
    both = priced(both.withColumn("kind", F.lit("put"))).withColumnRenamed("price", "put").drop(*RESULTS[1:], "kind")
    return both.withColumn("residual", F.expr("call - put - (spot - strike * exp(-rate * time))"))


def _above_intrinsic(x, w):
    """What an out-of-the-money option is worth over the root of forward times strike, at log-moneyness ``x <= 0`` and total deviation ``w``, and its slope in ``w``."""
    with np.errstate(all="ignore"):
        up, down = x / w + w / 2, x / w - w / 2
        value, slope = np.exp(x / 2) * cdf(up) - np.exp(-x / 2) * cdf(down), np.exp(x / 2 - up * up / 2) / np.sqrt(2 * np.pi)
    flat = ~(w > 0)
    return np.where(flat, 0.0, value), np.where(flat, 0.0, slope)


def solve_vol(target, s, k, r, t, call, tol: float = 1e-10, widest: float = 10.0, rounds: int = 120):
    """Implied volatility, vega there, and whether it tells the volatility. NaN outside the no-arbitrage bounds, 0 without time.

    Each price becomes that of the option of the same strike that is out of the money (by parity),
    as a function of the total deviation. That function bends at ``sqrt(2 * abs(x))``: from there
    Newton's steps approach the root from one side. Each step narrows a bracket; one that leaves
    it is replaced by the bracket's middle.
    """
    root, grown = np.sqrt(np.maximum(t, 0)), np.exp(r * t)
    scale, x = np.sqrt(s * grown * k) / grown, -np.abs(np.log(s * grown / k))
    rich = target - np.maximum(np.where(call, s - k / grown, k / grown - s), 0)  # over the bound below
    possible = (rich >= -1e-12) & (target <= np.where(call, s, k / grown) + 1e-12)
    wanted = np.clip(rich / scale, 0, None)
    low, high = np.zeros(len(target)), widest * root
    w = np.clip(np.where(x < 0, np.sqrt(-2 * x), wanted * np.sqrt(2 * np.pi)), 1e-12, np.maximum(high, 1e-12))
    open_ = possible & (root > 0)
    for _ in range(rounds):
        value, slope = _above_intrinsic(x, w)
        miss = value - wanted
        open_ = open_ & (np.abs(miss) * scale >= tol) & (high - low > 1e-15)
        if not open_.any():
            break
        low, high = np.where(open_ & (miss < 0), w, low), np.where(open_ & (miss > 0), w, high)
        with np.errstate(all="ignore"):
            step = w - miss / slope
        w = np.where(open_, np.where((step > low) & (step < high), step, (low + high) / 2), w)
    with np.errstate(all="ignore"):
        vol = np.where(root > 0, w / root, 0.0)
    vega = np.where(possible, _above_intrinsic(x, w)[1] * scale * root, 0.0)
    return np.where(possible, vol, np.nan), vega, possible & (vega >= MIN_VEGA)


@F.pandas_udf(T.StructType([T.StructField("vol", T.DoubleType()), T.StructField("vega", T.DoubleType()), T.StructField("identified", T.BooleanType())]))
def implied_vol(target: pd.Series, spot: pd.Series, strike: pd.Series, rate: pd.Series, time: pd.Series, kind: pd.Series) -> pd.DataFrame:
    """A struct for each option; iterative, so vectorised over Arrow batches."""
    columns = [x.to_numpy(dtype=float) for x in (target, spot, strike, rate, time)]
    vol, vega, well = solve_vol(*columns, (kind == "call").to_numpy())
    return pd.DataFrame({"vol": vol, "vega": vega, "identified": well})


def monte_carlo(spark, spot: float, strike: float, rate: float, vol: float, time: float, kind: str = "call", paths: int = 400_000, steps: int = 0, seed: int = 7, antithetic: bool = True, control: bool = True, chunk: int = 50_000) -> DataFrame:
    """One row: price, standard error and 95 % interval of a European option, or with ``steps`` of an arithmetic Asian one.

    Chunks of paths are tasks' rows, each with a generator seeded by (seed, chunk). The error is of
    antithetic pairs' means, so that the pair's covariance counts; the control variate is the
    discounted terminal price (European only).
    """
    n_chunks = -(-paths // chunk)
    sign = 1.0 if kind == "call" else -1.0

    def simulate(batches):
        for batch in batches:
            rows = []
            for c in batch.column(0).to_pylist():
                rng = np.random.default_rng([seed, c])
                n = min(chunk, paths - c * chunk)
                z = rng.standard_normal((max(1, n // 2 if antithetic else n), max(1, steps)))
                draws = (z, -z) if antithetic else (z,)
                dt, values, ends = time / z.shape[1], [], []
                for d in draws:
                    path = spot * np.exp(np.cumsum((rate - vol * vol / 2) * dt + vol * np.sqrt(dt) * d, 1))
                    end = path.mean(1) if steps else path[:, -1]
                    values.append(np.exp(-rate * time) * np.maximum(sign * (end - strike), 0))
                    ends.append(np.exp(-rate * time) * path[:, -1])
                v, x = sum(values) / len(values), sum(ends) / len(ends)
                rows.append((float(len(v)), float(v.sum()), float((v * v).sum()), float(x.sum()), float((x * x).sum()), float((v * x).sum())))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["n", "v", "vv", "x", "xx", "vx"]) if rows else pa.RecordBatch.from_pylist([], pa.schema([(k, pa.float64()) for k in ("n", "v", "vv", "x", "xx", "vx")]))

    sums = spark.range(0, n_chunks, 1, min(n_chunks, 64)).mapInArrow(simulate, "n double, v double, vv double, x double, xx double, vx double").groupBy().agg(*(F.sum(c).alias(c) for c in ("n", "v", "vv", "x", "xx", "vx")))
    beta = "(vx - v * x / n) / nullif(xx - x * x / n, 0)" if control and not steps else "0e0"
    out = sums.withColumn("beta", F.coalesce(F.expr(beta), F.lit(0.0))).withColumn("price", F.expr(f"v / n - beta * (x / n - {float(spot)!r}e0)" if control and not steps else "v / n"))
    out = out.withColumn("var", F.expr("greatest(((vv - v * v / n) - 2 * beta * (vx - v * x / n) + beta * beta * (xx - x * x / n)) / (n - 1), 0)")).withColumn("stderr", F.expr("sqrt(var / n)"))
    return out.selectExpr("price", "stderr", f"price - {Z95} * stderr AS low", f"price + {Z95} * stderr AS high", "CAST(n AS BIGINT) AS samples")
