"""Language identification of mixed texts: script ranges, word scores, Viterbi with a switching penalty.

Every word is scored for each learned language by log probabilities of its hashed character
n-grams. The script of a word, from fixed code point ranges, leaves only the languages seen in
that script. A Viterbi pass over the words, where changing the language costs a penalty, labels
spans; the language of most letters is the text's. The pass runs in step for all texts of a slice;
long texts are cut into pieces whose max-plus matrices carry it over the cuts.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import free_name, map_texts, with_results

#: Scripts by first and last code point (Unicode blocks).
SCRIPT_RANGES = (
    ("latin", 0x41, 0x24F), ("latin", 0x250, 0x2AF), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF),
    ("arabic", 0x600, 0x6FF), ("arabic", 0x750, 0x77F), ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF), ("gurmukhi", 0xA00, 0xA7F), ("gujarati", 0xA80, 0xAFF),
    ("oriya", 0xB00, 0xB7F), ("tamil", 0xB80, 0xBFF), ("telugu", 0xC00, 0xC7F), ("kannada", 0xC80, 0xCFF), ("malayalam", 0xD00, 0xD7F), ("sinhala", 0xD80, 0xDFF),
    ("thai", 0xE00, 0xE7F), ("lao", 0xE80, 0xEFF), ("tibetan", 0xF00, 0xFFF), ("myanmar", 0x1000, 0x109F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF),
    ("ethiopic", 0x1200, 0x137F), ("khmer", 0x1780, 0x17FF), ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x4DBF),
    ("han", 0x4E00, 0x9FFF), ("hangul", 0xAC00, 0xD7AF), ("latin", 0xFF21, 0xFF5A), ("han", 0x20000, 0x2FA1F),
)
SCRIPTS = ("other", *dict.fromkeys(s for s, _, _ in SCRIPT_RANGES))
_STARTS = np.array([a for _, a, _ in SCRIPT_RANGES])
_ENDS = np.array([b for _, _, b in SCRIPT_RANGES])
_SCRIPT = np.array([SCRIPTS.index(s) for s, _, _ in SCRIPT_RANGES])

WORD = re.compile(r"[^\W\d_]+")
ORDERS, BUCKET_BITS = 4, 16
_MIX = np.uint64(0x9E3779B97F4A7C15)
UNDETERMINED = "und"


def scripts_of(points: np.ndarray) -> np.ndarray:
    """Script number of each code point; 0 is any other."""
    at = np.maximum(np.searchsorted(_STARTS, points, "right") - 1, 0)
    return np.where((points >= _STARTS[at]) & (points <= _ENDS[at]), _SCRIPT[at], 0)


def gram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The words' hashed n-grams of 1 to ``ORDERS`` characters, ends marked: bucket and word of each."""
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    points = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), sizes)
    rolled, buckets, owners = np.zeros(len(points), np.uint64), [], []
    for n in range(1, ORDERS + 1):
        end = len(points) - n + 1
        if end <= 0:
            break
        rolled = (rolled[:end] * np.uint64(1000003)) ^ points[n - 1 :]
        inside = owner[:end] == owner[n - 1 :]
        if n == 1:
            inside = inside & (points != ord("<")) & (points != ord(">"))
        mixed = (rolled + np.uint64(n)) * _MIX
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _MIX
        buckets.append((mixed[inside] >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
        owners.append(owner[:end][inside])
    return (np.concatenate(buckets), np.concatenate(owners)) if buckets else (np.empty(0, np.int64), np.empty(0, np.int64))


class Words:
    """The distinct words of a slice, each in the script of most of its letters, and each text's words by number."""

    def __init__(self, texts: list[str | None]):
        numbers: defaultdict = defaultdict()
        numbers.default_factory = numbers.__len__
        find = WORD.findall
        self.codes = [np.fromiter(map(numbers.__getitem__, find(t.lower())) if t else (), np.int64) for t in texts]
        self.words = list(numbers)
        self.letters = np.array([len(w) if w.isalpha() else sum(map(str.isalpha, w)) for w in self.words], np.int64)
        points = scripts_of(np.frombuffer("".join(self.words).encode("utf-32-le", "replace"), np.uint32).astype(np.int64))
        owner = np.repeat(np.arange(len(self.words)), [len(w) for w in self.words])
        by_script = np.bincount(owner * len(SCRIPTS) + points, minlength=len(self.words) * len(SCRIPTS)).reshape(-1, len(SCRIPTS))
        self.scripts = by_script.argmax(1) if len(self.words) else np.empty(0, np.int64)


class Model:
    """Languages, log probabilities of n-gram buckets, and which scripts each language has."""

    def __init__(self, langs: list[str], counts: np.ndarray, script_letters: np.ndarray, rest: float = 0.5):
        self.langs = langs
        self.logs = np.log((counts + rest) / (counts.sum(1, keepdims=True) + rest * counts.shape[1])).astype(np.float32)
        self.has = script_letters >= 0.01 * np.maximum(script_letters.sum(1, keepdims=True), 1)
        self.has[:, 0] = True  # of other scripts nothing is known

    def word_scores(self, words: Words) -> np.ndarray:
        """Log score of each word for each language, relative to the word's best."""
        n, buckets = len(words.words), gram_buckets(words.words)
        scores = np.stack([np.bincount(buckets[1], self.logs[k][buckets[0]], n) for k in range(len(self.langs))], 1) / ORDERS if n else np.empty((0, len(self.langs)))
        can = self.has[:, words.scripts].T
        known = can.any(1) & (words.scripts > 0) & (words.letters > 0)
        scores = np.where(can, scores, -np.inf)
        with np.errstate(invalid="ignore"):
            scores = np.maximum(scores - scores.max(1, keepdims=True, initial=-np.inf), -30.0)
        return np.where(known[:, None], scores, 0.0)


def _in_step(starts: np.ndarray, sizes: np.ndarray, flat: np.ndarray, scores: np.ndarray, penalty: float, value: np.ndarray, note=None) -> np.ndarray:
    """Best sums at each piece's end, from ``value`` before its first word; pieces are in falling order of size.

    ``value`` ends in the languages; a dimension before it, if any, is that of separate starts.
    ``note`` receives each step's best language before and where changing to it pays.
    """
    for t in range(int(sizes.max(initial=0))):
        live = int(np.searchsorted(-sizes, -t, "left"))  # the pieces with more than t words
        v = value[:live]
        best = v.argmax(-1)
        change = np.take_along_axis(v, best[..., None], -1) - penalty
        if note is not None:
            note(best, change > v)
        np.maximum(v, change, out=v)
        gain = scores[flat[starts[:live] + t]]
        v += gain if v.ndim == 2 else gain[:, None]
    return value


def label_words(codes: list[np.ndarray], scores: np.ndarray, penalty: float, block: int = 4096) -> list[np.ndarray]:
    """Viterbi labels of each text's words: best sum of scores less ``penalty`` for each change.

    A text is cut into pieces of ``block`` words, so that long and short texts move in step. A
    piece's best score from every language before it to every language at its end (a max-plus
    matrix) carries the values over the borders: the labels are those of one pass at any ``block``.
    """
    n_langs = scores.shape[1]
    pieces = [(i, a) for i, c in enumerate(codes) for a in range(0, len(c), block)]
    by_size = sorted(range(len(pieces)), key=lambda p: -min(block, len(codes[pieces[p][0]]) - pieces[p][1]))
    place = {p: k for k, p in enumerate(by_size)}
    cut = [codes[pieces[p][0]][pieces[p][1] : pieces[p][1] + block] for p in by_size]
    sizes = np.array([len(c) for c in cut], np.int64)
    flat = np.concatenate(cut) if cut else np.empty(0, np.int64)
    starts = np.cumsum(sizes) - sizes
    # matrices only of pieces of texts that have several
    several = np.array([k for k, p in enumerate(by_size) if len(codes[pieces[p][0]]) > block], np.int64)
    matrix = np.full((len(several), n_langs, n_langs), -np.inf)
    matrix[:, np.arange(n_langs), np.arange(n_langs)] = 0.0
    _in_step(starts[several], sizes[several], flat, scores, penalty, matrix)
    row = dict(zip(several.tolist(), range(len(several)), strict=True))
    before = np.zeros((len(pieces), n_langs))  # values before each piece
    ends = np.full(len(pieces), -1, np.int64)
    for p, (i, a) in enumerate(pieces):
        if a:
            before[place[p]] = (before[place[p - 1]][:, None] + matrix[row[place[p - 1]]]).max(0)
    for p in range(len(pieces) - 1, -1, -1):  # languages at the ends, from each text's last piece back
        i, a = pieces[p]
        if len(codes[i]) > block:
            k = place[p]
            if a + block >= len(codes[i]):
                ends[k] = (before[k][:, None] + matrix[row[k]]).max(0).argmax()
            if a:
                ends[place[p - 1]] = (before[k] + matrix[row[k]][:, ends[k]]).argmax()
    steps: list = []
    value = _in_step(starts, sizes, flat, scores, penalty, before.copy(), lambda best, changed: steps.append((best.astype(np.int16), changed)))
    at = np.where(ends >= 0, ends, value.argmax(1)) if len(pieces) else ends
    labels = np.empty(len(flat), np.int16)
    for t in range(len(steps) - 1, -1, -1):
        best, changed = steps[t]
        here = at[: len(best)]
        labels[starts[: len(best)] + t] = here
        at[: len(best)] = np.where(changed[np.arange(len(best)), here], best, here)
    found: list[list] = [[] for _ in codes]
    for p, (i, _) in enumerate(pieces):
        k = place[p]
        found[i].append(labels[starts[k] : starts[k] + sizes[k]])
    return [np.concatenate(f) if f else np.empty(0, np.int16) for f in found]


def _train_fold(id_col: str):
    return (F.crc32(F.col(id_col).cast("string").cast("binary")) % 4) != 2


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 600) -> Model:
    """A model from about ``per_lang`` whole texts of each language, chosen by a hash of the id outside the held-out fold.

    What reaches the driver is a count for each language, then for each language and bucket: some
    256 KB for each distinct value of ``lang_col``, which must be a set of languages, not free text.
    Null ids, texts and languages are passed over; repeated rows count again; an empty table gives
    a model without languages.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & _train_fold("doc_id"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((0, 1 << BUCKET_BITS)), np.zeros((0, len(SCRIPTS))))
    share = F.create_map(*(x for lang in langs for x in (F.lit(lang), F.lit(min(1.0, per_lang / sizes[lang])))))
    some = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)).select("lang", "text")

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        found: dict[str, np.ndarray] = {}
        words = Words(batch.column(1).to_pylist())
        buckets, owner = gram_buckets(words.words)
        width = (1 << BUCKET_BITS) + len(SCRIPTS)
        for lang, codes in zip(batch.column(0).to_pylist(), words.codes, strict=True):
            found.setdefault(lang, np.zeros(len(words.words)))
            found[lang] += np.bincount(codes, minlength=len(words.words))
        out = []
        for lang, times in found.items():
            sums = np.zeros(width)
            sums[: 1 << BUCKET_BITS] = np.bincount(buckets, times[owner], 1 << BUCKET_BITS)
            sums[1 << BUCKET_BITS :] = np.bincount(words.scripts, times * words.letters, len(SCRIPTS))
            some = np.flatnonzero(sums)
            out.append(pa.table({"lang": pa.array([lang] * len(some), pa.string()), "slot": pa.array(some, pa.int32()), "n": pa.array(sums[some].astype(np.int64))}))
        return pa.concat_tables(out).combine_chunks().to_batches()[0] if out and any(t.num_rows for t in out) else pa.RecordBatch.from_arrays([pa.array([], pa.string()), pa.array([], pa.int32()), pa.array([], pa.int64())], ["lang", "slot", "n"])

    counts = np.zeros((len(langs), 1 << BUCKET_BITS))
    letters = np.zeros((len(langs), len(SCRIPTS)))
    found = map_texts(some, count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    lang_of = {lang: k for k, lang in enumerate(langs)}
    k, slot, n = found["lang"].map(lang_of).to_numpy(dtype=np.int64), found["slot"].to_numpy(dtype=np.int64), found["n"].to_numpy(dtype=np.float64)
    gram = slot < 1 << BUCKET_BITS
    counts[k[gram], slot[gram]] = n[gram]
    letters[k[~gram], slot[~gram] - (1 << BUCKET_BITS)] = n[~gram]
    return Model(langs, counts, letters)


def identify(texts: list[str | None], model: Model, penalty: float = 6.0) -> list[tuple[str, float, list[tuple[str, int, int]]]]:
    """Language, score and spans ``(lang, first word, end word)`` of each text."""
    words = Words(texts)
    if not model.langs:
        return [(UNDETERMINED, 0.0, [])] * len(texts)
    scores = model.word_scores(words)
    told = scores.min(1, initial=0.0) < 0  # words that tell languages apart, or lie in a known script
    told |= (words.scripts > 0) & model.has[:, words.scripts].any(0)
    out = []
    for codes, labels in zip(words.codes, label_words(words.codes, scores, penalty), strict=True):
        letters = words.letters[codes]
        if not letters.sum():
            out.append((UNDETERMINED, 0.0, []))
            continue
        by_lang = np.bincount(labels, letters * told[codes], len(model.langs))
        k = int(by_lang.argmax())
        edges = np.flatnonzero(np.r_[True, labels[1:] != labels[:-1], True])
        out.append((model.langs[k], float(by_lang[k] / letters.sum()), [(model.langs[labels[a]], int(a), int(b)) for a, b in zip(edges[:-1], edges[1:], strict=True)]))
    return out


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", penalty: float = 6.0, spans: bool = False, keep: bool = False) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` of every whole text, with ``spans`` on request.

    ``lang_pred`` has the most letters in its spans, ``score`` is its share of all letters; letters
    of scripts that no learned language has count for none. Whole texts are labelled by one Viterbi
    pass whatever their length. Null texts and texts without a letter
    are ``und`` with score 0, as are all texts if nothing could be learned. With ``keep`` the
    input's own columns stay, and ``_lang_pred`` and ``_score`` are added, under the names that
    :func:`free_name` gives where the input has these. Null ids are kept (``held_out`` false),
    repeated rows stay rows of their own; without ``keep`` other columns are left out.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)  # 256 KB for each language
    names = [free_name(docs, n) if keep else n for n in ("_lang_pred", "_score")]

    def run(texts: list[str | None]) -> dict[str, pa.Array]:
        found = identify(texts, known.value, penalty)
        made = {names[0]: pa.array([f[0] for f in found], pa.string()), names[1]: pa.array([f[1] for f in found], pa.float64())}
        if spans:
            kind = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))
            made["spans"] = pa.array([[dict(zip(("lang", "start", "stop"), s, strict=True)) for s in f[2]] for f in found], kind)
        return made

    results = f"{names[0]} string, {names[1]} double" + ", spans array<struct<lang: string, start: int, stop: int>>" * spans
    if keep:
        return with_results(docs, run, text_col, results, chars=8_000_000)
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(~_train_fold(id_col), F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return with_results(chosen, run, "text", results, chars=8_000_000, keep_text=False).withColumnsRenamed({"_lang_pred": "lang_pred", "_score": "score"})
