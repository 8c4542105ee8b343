"""Personal data by candidate gradient boosting, in DataFrame and SQL functions throughout.

Base patterns give spans that always count. Beside them generators of high recall propose spans,
overlapping ones and one span for several kinds; boosted trees over features of their form and of
the words around them score each, and a threshold for each kind, set on calibrated probabilities,
selects. The trees become one SQL expression, so scoring is generated code beside the rest of the plan.

A text is matched where it is read. Only its matches go on: a few characters around each and the
lengths between them, from which running sums give places, so texts are never shuffled. All
patterns take time in proportion to the text: no run is entered twice and repetition is possessive.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.pii_examples import AGAINST, CUES, ENDINGS, examples
from tidemark.llm.quality import BoostedTrees, boost
from tidemark.tables import discard, stored

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. They match what the plain forms match; lookbehinds keep long runs from being tried at each of their places.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT, _DOT = r"(?: ?@ ?| ?[\[({<] ?at ?[\])}>] ?| at )", r"(?: ?[\[({<] ?dot ?[\])}>] ?| dot |\.)"
_GAP = "[ ().\\-/ ‐-―]"
#: Generators, each with the kinds it proposes.
WIDE = {
    "email_like": (("email",), rf"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++"),
    "number_like": (("phone", "card"), rf"(?<![0-9A-Za-z])[+(]{{0,2}}[0-9](?:{_GAP}{{0,3}}+[0-9]){{6,}}+"),
    "ip_like": (("ip",), r"(?<![0-9A-Za-z.:])(?:[0-9]{1,3}(?: ?[\[(]\.[\])] ?[0-9]{1,3}){3}|(?=[0-9A-Fa-f]{0,4}:[0-9A-Fa-f]{0,4}:)[0-9A-Fa-f:]{3,45}+)"),
}
_LONG_IPV6, _SHORT_IPV6 = r"^(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$", r"^(?=(?:[^:]*:){2,7}[^:]*$)[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?$"
#: What a text must have for a pattern to give a match that counts; looking for it costs a fraction of matching.
_SIGN = {
    "email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]",
    "email_like": r"@|[ \[({<][aA][tT][ \])}>]", "number_like": rf"[0-9](?:{_GAP}{{0,3}}+[0-9]){{6}}", "ip_like": r"\.[\])]|:[0-9A-Fa-f]{0,4}:",
}
#: Characters of context on either side.
AROUND = 24
FEATURES = (
    "kind_no", "n_chars", "n_digits", "n_groups", "longest_group", "shortest_group", "first_group", "n_marks", "n_mark_kinds", "opens", "luhn", "four_fours", "known_ending",
    "spelt_out", "n_colons", "n_hex_letters", "cue", "against", "touches_before", "touches_after", "date_like", "ip_form",
)


def _matches(between: Column, found: Column) -> Column:
    """Each match with its length, the length of what lies between it and the one before, and the text on either side."""
    none = F.array(F.lit(None).cast("string"))
    pairs = F.arrays_zip(between.alias("gap"), F.concat(found, none).alias("span"), F.concat(F.slice(between, 2, F.size(between)), none).alias("rest"))
    return F.transform(
        F.filter(pairs, lambda p: p["span"].isNotNull()),
        lambda p: F.struct(F.length(p["gap"]).alias("gap"), p["span"].alias("span"), F.substring(p["gap"], -AROUND, AROUND).alias("before"), F.substring(p["rest"], 1, AROUND).alias("after")),
    )


def matched(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(uid, id, one array of matches for each pattern)`` of every row, without the texts; ``uid`` holds once the result is stored."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    patterns = {**BASE, **{name: pattern for name, (_, pattern) in WIDE.items()}}
    made = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), text.alias("text"))
    cut = []
    for name, p in patterns.items():
        signed = F.col("text").rlike(_SIGN[name])
        cut += [F.when(signed, F.split("text", p, -1)).alias(f"{name}_between"), F.when(signed, F.regexp_extract_all("text", F.lit(p), F.lit(0))).alias(f"{name}_found")]
    cut = made.select("uid", "id", *cut)  # a projection of its own: matched once each, used several times
    return cut.select("uid", "id", *(_matches(F.col(f"{name}_between"), F.col(f"{name}_found")).alias(name) for name in patterns))


def proposals(found: DataFrame) -> DataFrame:
    """``(uid, source, start, end, span, before, after)`` of every match, partitioned by ``uid``. Places count code points."""
    rows = None
    for name in (*BASE, *WIDE):
        some = found.where(F.size(F.col(name)) > 0).select("uid", F.lit(name).alias("source"), F.posexplode(name).alias("i", "m"))
        rows = some if rows is None else rows.unionByName(some)
    rows = rows.select("uid", "source", "i", "m.*").repartition("uid")
    ordered = Window.partitionBy("uid", "source").orderBy("i")
    end = F.sum(F.col("gap") + F.length("span")).over(ordered)
    return rows.withColumn("end", end.cast("long")).withColumn("start", F.col("end") - F.length("span")).drop("i", "gap")


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether 13 to 19 digits pass the Luhn check; false for other lengths."""
    padded = F.lpad(digits, 19, "0")
    doubled = F.translate(padded, "0123456789", "0246813579")
    total = sum((F.substring(padded if p % 2 else doubled, p, 1).cast("int") for p in range(1, 20)), F.lit(0))
    return F.length(digits).between(13, 19) & F.when(F.length(digits).between(13, 19), total % 10 == 0).otherwise(F.lit(False))


def valid_base(source: Column, span: Column) -> Column:
    """Whether a match of a base pattern counts."""
    digits = _digits(span)
    over = r"(?:^|\.)0*+(?:[1-9][0-9]{3,}|[3-9][0-9]{2}|2[6-9][0-9]|25[6-9])(?:\.|$)"
    return F.when(source == "email", True).when(source == "ip", ~span.rlike(over)).when(source == "card", luhn(digits)).when(source == "phone", F.length(digits).between(9, 15)).otherwise(False)


def _any_of(words) -> str:
    """A pattern of any of the words, whole, whatever their case."""
    return r"(?iu)(?<![\p{L}])(?:" + "|".join(sorted((rf"\Q{w}\E" for w in words), key=len, reverse=True)) + r")(?![\p{L}])"


def featured(candidates: DataFrame) -> DataFrame:
    """Columns of :data:`FEATURES` (double) beside ``kind``, ``span``, ``before`` and ``after``."""
    span, before, after, kind = (F.col(c) for c in ("span", "before", "after", "kind"))
    digits = _digits(span)
    groups = F.filter(F.split(span, "[^0-9]+"), lambda g: g != "")
    sizes = F.transform(groups, F.length)
    marks = F.regexp_replace(span, "[0-9A-Za-z]", "")
    cue = F.lit(False)
    for name in KINDS:
        cue = cue | ((kind == name) & before.rlike(_any_of(CUES[name])))
    ending = r"(?i)(?:" + "|".join(e.replace(".", r"\.") for e in ENDINGS) + r")$"
    made = {
        "kind_no": F.array_position(F.array(*map(F.lit, KINDS)), kind), "n_chars": F.length(span), "n_digits": F.length(digits), "n_groups": F.size(groups), "longest_group": F.array_max(sizes), "shortest_group": F.array_min(sizes),
        "first_group": F.element_at(F.concat(sizes, F.array(F.lit(0))), 1), "n_marks": F.length(marks), "n_mark_kinds": F.size(F.array_distinct(F.split(marks, ""))),
        "opens": F.when(span.startswith("+"), 3).when(span.startswith("("), 2).when(digits.startswith("00"), 1.5).when(digits.startswith("0"), 1).otherwise(0),
        "luhn": luhn(digits), "four_fours": F.length(digits).between(15, 16) & (F.size(groups) == 4) & (F.array_max(sizes) == 4),
        "known_ending": span.rlike(ending), "spelt_out": span.rlike(r"(?i)[ \[({<]at[ \])}>]") & span.rlike(r"(?i)[ \[({<]dot[ \])}>]|[\[({<] ?at ?[\])}>]"), "n_colons": F.length(F.regexp_replace(span, "[^:]", "")),
        "n_hex_letters": F.length(F.regexp_replace(span, "[^A-Fa-f]", "")), "cue": cue, "against": before.rlike(_any_of(AGAINST) + r"[\x20:#=.]*$"),
        "touches_before": before.rlike(r"[\p{L}\p{N}_$#]$"), "touches_after": after.rlike(r"^[\p{L}\p{N}_%]"), "date_like": span.rlike(r"^(?:(?:19|20)[0-9]{2}[-/. ][0-9]{1,2}[-/. ][0-9]{1,2}|[0-9]{1,2}[-/. ][0-9]{1,2}[-/. ](?:19|20)[0-9]{2})(?![0-9])"),
        "ip_form": F.when(span.rlike(_SHORT_IPV6), 3).when(span.rlike(_LONG_IPV6), 2).when((F.size(groups) == 4) & ~F.exists(groups, lambda g: g.cast("double") > 255) & (F.length(marks) >= 6), 1).otherwise(0),
    }
    return candidates.withColumns({name: F.coalesce(made[name].cast("double"), F.lit(0.0)) for name in FEATURES})


def tree_sql(trees: BoostedTrees) -> str:
    """The sum of all trees as a SQL expression over :data:`FEATURES`."""

    def node(t: int, n: int) -> str:
        if n >= trees.feature.shape[1]:
            return repr(float(trees.value[t, n - trees.feature.shape[1]])) + "D"
        low, cut = node(t, 2 * n + 1), float(trees.cut[t, n])
        if not np.isfinite(cut):
            return low
        high = node(t, 2 * n + 2)
        return low if low == high else f"IF({FEATURES[trees.feature[t, n]]} > {cut!r}D, {high}, {low})"

    return " + ".join([f"{trees.base!r}D", *(node(t, 0) for t in range(len(trees.value)))])


class Model:
    """Trees, the calibration of each kind (probability = logistic(a * score + b)) and the probability from which it is redacted."""

    def __init__(self, trees: BoostedTrees, calibration: dict[str, tuple[float, float]], thresholds: dict[str, float]):
        self.trees, self.calibration, self.thresholds = trees, calibration, thresholds

    def probability(self) -> Column:
        a, b = (F.coalesce(*(F.when(F.col("kind") == k, F.lit(float(self.calibration[k][i]))) for k in KINDS)) for i in (0, 1))
        return 1 / (1 + F.exp(-(a * F.expr(tree_sql(self.trees)) + b)))

    def threshold(self) -> Column:
        return F.coalesce(*(F.when(F.col("kind") == k, F.lit(float(self.thresholds[k]))) for k in KINDS))


def _calibrated(score: np.ndarray, y: np.ndarray, steps: int = 30) -> tuple[float, float]:
    """Logistic regression of the labels on the scores, with a small ridge, by Newton's steps."""
    w, x = np.array([1.0, 0.0]), np.stack([score, np.ones(len(score))], 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2), x.T @ (y - p) - 0.1 * (w - np.array([1.0, 0.0])))
    return float(w[0]), float(w[1])


def train(spark: SparkSession, n_examples: int = 3000, precision: float = 0.98, least: float = 0.6) -> Model:
    """Fits the trees on two thirds of the labelled examples (by their hash), calibrates on the others.

    A kind's threshold is the smallest calibrated probability, ``least`` at least, from which the
    calibration examples have the given precision; a kind that never has it isn't selected. The examples
    and their figures are bounded by ``n_examples``.
    """
    schema = "array<struct<text string, kind string, start long, end long>>"
    rows = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(examples(n_examples))), schema)).alias("e")).select("e.*").withColumn("id", F.xxhash64("text"))
    found = stored(matched(rows.withColumn("all", F.struct("id", "kind", "start", "end")), "all", "text"), "pii-examples")
    labels = found.select("uid", F.col("id.id").alias("fold"), F.col("id.kind").alias("is_kind"), F.col("id.start").alias("is_start"), F.col("id.end").alias("is_end"))
    label = ((F.col("kind") == F.col("is_kind")) & (F.col("start") == F.col("is_start")) & (F.col("end") == F.col("is_end"))).cast("int")
    made = featured(candidates(proposals(found))).join(labels, "uid").select("uid", "start", "kind", F.pmod("fold", F.lit(3)).alias("fold"), F.coalesce(label, F.lit(0)).alias("label"), F.array(*FEATURES).alias("x"))
    figures = sorted(made.collect(), key=lambda r: (r.uid, r.start, r.kind))
    discard(found)
    x, y = np.array([r.x for r in figures]), np.array([r.label for r in figures], float)
    fit, kinds = np.array([r.fold != 0 for r in figures]), np.array([r.kind for r in figures])
    trees = boost(x[fit], y[fit], trees=40, depth=3, rate=0.3)
    p = np.clip(trees.predict(x), 1e-15, 1 - 1e-15)
    score = np.log(p / (1 - p))
    calibration, thresholds = {}, {}
    for kind in KINDS:
        own = ~fit & (kinds == kind)
        a, b = calibration[kind] = _calibrated(score[own], y[own])
        q = 1 / (1 + np.exp(-(a * score[own] + b)))
        cuts = [c for c in np.unique(q) if c >= least and y[own][q >= c].mean() >= precision]
        thresholds[kind] = max(least, float(min(cuts)) - 1e-9) if cuts else 2.0
    return Model(trees, calibration, thresholds)


def candidates(proposed: DataFrame) -> DataFrame:
    """The generators' proposals, one row for each kind that a span is proposed for."""
    kinds = F.coalesce(*(F.when(F.col("source") == name, F.array(*map(F.lit, ks))) for name, (ks, _) in WIDE.items()))
    return proposed.where(F.col("source").isin(*WIDE)).withColumn("kind", F.explode(kinds)).drop("source")


def selected(found: DataFrame, model: Model) -> DataFrame:
    """``(uid, kind_no, start, end, base, probability, cluster)`` of every span that counts.

    Spans that overlap, directly or by others between them, are a cluster. Its base spans all count;
    without one, its likeliest candidate does (ties: the longer, the earlier, the kind listed first).
    """
    number = lambda name: F.array_position(F.array(*map(F.lit, KINDS)), F.col(name)).cast("int") - 1
    proposed = stored(proposals(found).where(F.col("source").isin(*WIDE) | valid_base(F.col("source"), F.col("span"))), "pii-proposals")
    figures = stored(featured(candidates(proposed)).drop("span", "before", "after"), "pii-figures")  # so that each figure is one column to the trees, not its expression
    base = proposed.where(F.col("source").isin(*BASE)).select("uid", number("source").alias("kind_no"), "start", "end", F.lit(True).alias("base"), F.lit(1.0).alias("probability"))
    scored = figures.select("uid", number("kind").alias("kind_no"), "start", "end", F.lit(False).alias("base"), model.probability().alias("probability"), model.threshold().alias("_least"))
    added = scored.where("probability >= _least").drop("_least")
    by_place = Window.partitionBy("uid").orderBy("start", "end", "kind_no", "base")
    reach = F.max("end").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    spans = base.unionByName(added).withColumn("opens", (F.col("start") >= F.coalesce(reach, F.lit(0))).cast("long"))
    spans = spans.withColumn("cluster", F.sum("opens").over(by_place)).drop("opens")
    best = Window.partitionBy("uid", "cluster").orderBy(F.desc("base"), F.desc("probability"), F.desc(F.col("end") - F.col("start")), "start", "kind_no")
    return spans.withColumn("place", F.row_number().over(best)).where("base OR place = 1").drop("place")


def _joined(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat(F.element_at(kinds, s["kind_no"] + 1), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def find_pii(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added)`` of every whole text.

    ``spans`` lists ``kind:start:end`` by kind, then start; the digest is of the base spans alone.
    Null and empty texts have none (an empty list). Null ids and repeated rows stay rows of their own,
    other columns are left out, an empty table gives no rows. A text of any length is one row, its
    spans are a list of one row.
    """
    model = model or train(docs.sparkSession)
    found = stored(matched(docs, id_col, text_col), "pii-matches")
    lists = selected(found, model).groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("kind_no", "start", "end", "base"))).alias("spans"))
    none = F.array().cast("array<struct<kind_no:int,start:bigint,end:bigint,base:boolean>>")
    rows = found.select("uid", F.col("id").cast("long").alias("doc_id")).join(lists, "uid", "left").withColumn("spans", F.coalesce("spans", none))
    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind_no"])
    counts = (F.coalesce(F.size(kinds) - F.size(F.array_remove(kinds, k)), F.lit(0)).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS))
    return rows.select("doc_id", *counts, F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), (F.size("spans") - F.size(base)).cast("long").alias("n_added"))


def redact(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, redacted)``: each text with every cluster of spans replaced by ``[kind]`` of its first span; nulls stay null.

    The work for a text is its length times the number of its clusters.
    """
    model = model or train(docs.sparkSession)
    rows = stored(docs.select(F.struct(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).alias("row"), F.col(text_col).alias("text")), "pii-texts")
    found = stored(matched(rows, "row", "text"), "pii-matches")
    merged = selected(found, model).groupBy("uid", "cluster").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind_no", F.struct("start", "kind_no")).alias("kind_no"))
    cuts = merged.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind_no"))).alias("cuts"))
    kinds, text = F.array(*map(F.lit, KINDS)), F.col("id.text")
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform("cuts", lambda c: c["end"]))
    piece = lambda c, i: F.concat(F.substring(text, F.element_at(ends, i + 1).cast("int") + 1, (c["start"] - F.element_at(ends, i + 1)).cast("int")), F.lit("["), F.element_at(kinds, c["kind_no"] + 1), F.lit("]"))
    tail = F.substring(text, F.element_at(ends, -1).cast("int") + 1, F.length(text))
    made = F.when(F.col("cuts").isNull(), text).otherwise(F.concat(F.array_join(F.transform("cuts", piece), ""), tail))
    return found.select("uid", "id").join(cuts, "uid", "left").select(F.col("id.doc_id").alias("doc_id"), made.alias("redacted"))
