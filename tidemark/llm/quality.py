"""Quality classifier: histogram gradient-boosted trees over document statistics.

Features are binned by quantiles, trees grow level by level from histograms of gradients, and the
finished trees are complete binary trees flattened into arrays, traversed for a whole batch at a
time. Training uses a bounded sample of labelled rows; every text is scored whole.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, free_name, map_texts, with_results

FEATURES = (
    "log_words", "mean_word", "std_word", "longest_word", "upper_share", "digit_share", "symbol_share", "bang_share", "pipe_share", "stop_share", "comma_share",
    "other_punct_share", "caps_words", "title_words", "short_words", "type_token", "top_word", "log_lines", "words_per_line", "dup_lines", "line_ends", "ends_well", "plain_words", "adjacent_repeats",
)
SYMBOLS = "#*$%&<>@^~=+\\{}[]_"
_END = re.compile(rf"[.!?][\"')]*[{re.escape(SPACE)}]*(?:\n|\Z)")


def statistics(text: str | None) -> tuple[float, ...]:
    """The features of one whole text; 0 throughout for null and empty texts."""
    t = text or ""
    words = t.encode("utf-8", "replace").split()
    n = len(words)
    if not n:
        return (0.0,) * len(FEATURES)
    chars = len(t)
    sizes = np.fromiter(map(len, words), np.int64, n)
    letters = sum(map(str.isalpha, t)) if not t.isascii() else 0
    raw = np.bincount(np.frombuffer(t.encode("utf-8", "replace"), np.uint8), minlength=256)
    upper, lower, digits = int(raw[65:91].sum()), int(raw[97:123].sum()), int(raw[48:58].sum())
    letters = max(letters, upper + lower, 1)
    count = lambda marks: sum(int(raw[ord(m)]) for m in marks)
    symbols, bangs, pipes, stops, commas = count(SYMBOLS), int(raw[33]), int(raw[124]), count(".?"), int(raw[44])
    punct = int(raw[33:48].sum() + raw[58:65].sum() + raw[91:97].sum() + raw[123:127].sum()) - symbols - bangs - pipes - stops - commas
    seen = Counter(words)
    lines = [x for x in t.split("\n") if x.strip(SPACE)]
    caps = sum(1 for w in words if w.isupper() and len(w) > 1)
    title = sum(map(bytes.istitle, words))
    plain = sum(map(bytes.isalpha, words))
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    return (
        np.log1p(n), sizes.mean(), sizes.std(), sizes.max(), upper / letters, digits / chars, symbols / n, bangs / n, pipes / n, stops / n, commas / n,
        punct / n, caps / n, title / n, float((sizes <= 3).mean()), len(seen) / n, max(seen.values()) / n, np.log1p(len(lines)), n / max(1, len(lines)), 1 - len(set(lines)) / max(1, len(lines)),
        len(_END.findall(t)) / max(1, len(lines)), float(t.rstrip(SPACE)[-1:] in ".!?"), plain / n, repeats / n,
    )


class BoostedTrees:
    """Complete trees of one depth: ``feature`` and ``cut`` of each inner node, ``value`` of each leaf."""

    def __init__(self, base: float, feature: np.ndarray, cut: np.ndarray, value: np.ndarray):
        self.base, self.feature, self.cut, self.value = base, feature, cut, value

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1."""
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range((len(value) - 1).bit_length()):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += value[node - len(feature)]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: float = 1.0) -> BoostedTrees:
    """Gradient boosting on the logistic loss. One class only, or no rows, gives a constant."""
    p = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
    base, inner, n_f = float(np.log(p / (1 - p))), (1 << depth) - 1, x.shape[1]
    feature, cut, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    if not len(y) or y.min() == y.max():
        return BoostedTrees(base, feature[:0], cut[:0], value[:0])
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(n_f)]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)  # bin <= i is x <= edge i
    total = np.full(len(y), base)
    offset = np.arange(n_f) * bins
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            cell = ((node - first)[:, None] * (n_f * bins) + offset + binned).ravel()
            size = width * n_f * bins
            sums = [np.bincount(cell, np.repeat(v, n_f), size).reshape(width, n_f, bins).cumsum(2) for v in (g, h)]
            gl, hl = sums
            gt, ht = gl[:, :1, -1:], hl[:, :1, -1:]
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(hl < least) | (ht - hl < least)] = -1
            best = gain.reshape(width, -1).argmax(1)
            f, b = best // bins, best % bins
            for i in range(width):
                if gain[i, f[i], b[i]] > 1e-9 and b[i] < len(edges[f[i]]):
                    feature[t, first + i], cut[t, first + i] = f[i], edges[f[i]][b[i]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[t, node]] > cut[t, node])
        leaf = node - inner
        value[t] = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        total += value[t, leaf]
    return BoostedTrees(base, feature, cut, value)


def _held_out(id_col: str):
    return (F.crc32(F.col(id_col).cast("string").cast("binary")) % 5) == 0


def _stats_rows(texts: list[str | None]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], float).reshape(len(texts), len(FEATURES))


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> BoostedTrees:
    """A model of ``labels.quality`` from at most ``sample`` labelled documents outside the held-out fold, chosen by a hash of the id.

    The bound is on the labelled ids, so what is broadcast and what reaches the driver (a row of
    figures for each) stays bounded. Null labels and ids are passed over; of several labels of one
    document the smallest counts, and of several texts one.
    """
    chosen = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~_held_out("doc_id")).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(_stats_rows(batch.column(2).to_pylist())), pa.list_(pa.float64()))], ["doc_id", "quality", "x"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = map_texts(texts.select("doc_id", F.col("quality").cast("int").alias("quality"), "text"), run, "doc_id long, quality int, x array<double>")
    found = {r.doc_id: (r.quality, r.x) for r in sorted(rows.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("x").alias("x")).collect())}
    x = np.array([v[1] for v in found.values()], float).reshape(len(found), len(FEATURES))
    return boost(x, np.array([v[0] for v in found.values()], float))


def score(docs: DataFrame, model: BoostedTrees, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.3, keep: bool = False) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every whole text; ``predicted`` is 1 from a score of ``cut``.

    With ``keep`` the input's own columns stay, and ``_score`` and ``_predicted`` are added, under the
    names that :func:`free_name` gives where the input has these. Null
    and empty texts are scored as texts without words. Null ids are kept (``held_out`` is then
    false), repeated rows stay rows of their own; without ``keep`` other columns are left out.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)  # some 80 trees of 15 nodes

    def run(texts: list[str | None]) -> dict[str, pa.Array]:
        p = known.value.predict(_stats_rows(texts))
        return {names[0]: pa.array(p), names[1]: pa.array((p >= cut).astype(np.int32))}

    names = [free_name(docs, n) if keep else n for n in ("_score", "_predicted")]
    results = f"{names[0]} double, {names[1]} int"
    if keep:
        return with_results(docs, run, text_col, results)
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(_held_out(id_col), F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return with_results(chosen, run, "text", results, keep_text=False).withColumnsRenamed({"_score": "score", "_predicted": "predicted"})
