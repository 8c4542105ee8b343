"""Quality rules on repetition: maximal repeated word runs from a suffix array.

The words of many whole texts are numbered and laid end to end, each text closed by a mark of its
own, so that one suffix array (prefix doubling) serves a slice of texts and no repeat crosses
them. The ranks kept at each doubling give the longest common prefix of neighbouring suffixes by
descending powers of two. A pass over the LCP intervals of at least ``min_words`` words finds those
that are maximal repeats: their words stand in several places, and neither the word before nor the
word after is the same in all of them. The spans of maximal repeats are united; a text is kept when
the covered fraction and its longest repeat stay within limits.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, map_texts

SYMBOLS = "#*$%&|<>"


def suffix_array(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The positions in order of their suffixes, and each one's words in common with the one before. Marks (< 0) are unique and repeat nothing."""
    n = len(codes)
    if n < 2:
        return np.arange(n), np.zeros(n, np.int64)
    order = np.argsort(codes, kind="stable")
    ordered = codes[order]
    first = np.r_[True, ordered[1:] != ordered[:-1]]
    starts = np.flatnonzero(first)
    group = np.repeat(starts, np.diff(np.r_[starts, n]))
    rank = np.empty(n, np.int32)
    rank[order] = group  # a rank is the place where its group begins
    levels = [rank]
    at = np.flatnonzero(np.r_[~first[1:], False] | ~first)  # places, in the order, whose group isn't alone
    step = 1
    while len(at):
        pos, head = order[at], group[at].astype(np.int64)
        key = head * (n + 1) + rank[np.minimum(pos + step, n - 1)]  # a mark ends each text, so pos + step stays inside
        by = np.argsort(key, kind="stable")
        key, pos, head = key[by], pos[by], head[by]
        order[at] = pos
        new = np.r_[True, key[1:] != key[:-1]]
        begun = np.flatnonzero(new)
        group[at] = np.repeat(at[begun], np.diff(np.r_[begun, len(at)]))
        rank = rank.copy()
        rank[pos] = group[at]
        levels.append(rank)
        at = at[np.r_[~new[1:], False] | ~new]
        step *= 2
    # neighbours in the suffix array that share their first word, compared by descending powers of two
    same = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]])
    left, right = order[same].copy(), order[same + 1].copy()
    shared = np.zeros(len(same), np.int64)
    live = np.arange(len(same))
    for k in range(len(levels) - 1, -1, -1):
        lv = levels[k]
        a, b = left[live] , right[live]
        eq = live[lv[a] == lv[b]]
        shared[eq] += 1 << k
        left[eq] += 1 << k
        right[eq] += 1 << k
    lcp = np.zeros(n, np.int64)
    lcp[same + 1] = shared
    return order, lcp


def longest_of(suffixes: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """For each position, how many words starting there also stand elsewhere."""
    order, lcp = suffixes
    longest = np.empty(len(order), np.int64)
    longest[order] = np.maximum(lcp, np.r_[lcp[1:], 0])
    return longest


def maximal_repeats(codes: np.ndarray, suffixes: tuple[np.ndarray, np.ndarray], least: int) -> np.ndarray:
    """For each position, the length of the longest maximal repeat of at least ``least`` words that starts there (0: none).

    Only stretches of the suffix array whose neighbours share ``least`` words or more are walked.
    An interval is closed when a smaller common prefix comes; it is a maximal repeat if the words
    before its places differ. A place belongs to the deepest such interval around it, so it is
    marked once and an interval hands on only the places that none inside it has marked.
    """
    order, lcp = suffixes
    found = np.zeros(len(codes), np.int64)
    deep = lcp >= least
    starts = np.flatnonzero(deep & ~np.r_[False, deep[:-1]])
    stops = np.flatnonzero(deep & ~np.r_[deep[1:], False]) + 1
    differ = None  # stands for: the words before are not all one
    for a, b in zip(starts.tolist(), stops.tolist(), strict=True):
        places = order[a - 1 : b]
        before = np.where(places > 0, codes[np.maximum(places - 1, 0)], -1).tolist()
        stack: list[list] = []  # open intervals: length, the word before their places, places not marked yet
        for place, word, length in zip(places.tolist(), before, [*lcp[a:b].tolist(), 0], strict=True):
            word, loose = differ if word < 0 else word, [place]  # nothing before is like nothing else
            while stack and stack[-1][0] > length:
                _join(stack[-1], word, loose)
                size, word, loose = stack.pop()
                if word is differ:
                    found[loose] = size
                    loose = []
            if stack and stack[-1][0] == length:
                _join(stack[-1], word, loose)
            elif length:
                stack.append([length, word, loose])
    return found


def _join(interval: list, word: int | None, loose: list[int]) -> None:
    """Puts places with the word before them into an interval; the shorter list moves."""
    if interval[1] != word:
        interval[1] = None
    if len(loose) > len(interval[2]):
        interval[2], loose = loose, interval[2]
    interval[2].extend(loose)


def covered(repeats: np.ndarray) -> np.ndarray:
    """Marks the positions inside the union of the repeats' spans."""
    n = len(repeats)
    return np.maximum.accumulate(np.arange(n) + repeats) > np.arange(n)


def _window_covered(longest: np.ndarray, width: int) -> np.ndarray:
    """Marks the positions inside a ``width``-word window that occurs twice or more."""
    n = len(longest)
    reach = np.where(longest >= width, np.arange(n) + width, 0)
    return np.maximum.accumulate(reach) > np.arange(n)


def text_rules(batch: pa.RecordBatch, min_words: int, max_covered: float, max_longest: float, longest_least: int) -> dict[str, np.ndarray]:
    """All rule figures of the batch's texts (its last column)."""
    texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
    ids: defaultdict = defaultdict()
    ids.default_factory = ids.__len__
    words = [t.encode("utf-8", "surrogatepass").split() for t in texts]
    n_words = np.array([len(w) for w in words], np.int64)
    total = int(n_words.sum())
    codes = np.fromiter((ids[w] for ws in words for w in ws), np.int64, total)
    doc = np.repeat(np.arange(len(texts)), n_words)
    laid = np.empty(total + len(texts), np.int64)
    at = np.arange(total) + doc
    laid[at] = doc * max(len(ids), 1) + codes  # a word of another text is another symbol
    ends = np.cumsum(n_words) + np.arange(len(texts))
    laid[ends] = -1 - np.arange(len(texts))
    suffixes = suffix_array(laid)
    repeats = maximal_repeats(laid, suffixes, min_words)
    per_text = lambda flags: np.add.reduceat(np.r_[flags, False].astype(np.int64), ends - n_words) if len(texts) else np.empty(0, np.int64)
    longest = np.maximum.reduceat(np.r_[repeats, 0], ends - n_words) if len(texts) else np.empty(0, np.int64)
    n_repeat, n_covered = per_text(_window_covered(longest_of(suffixes), 3)), per_text(covered(repeats))
    word_chars = np.array([len(t) - sum(map(t.count, SPACE)) for t in texts], np.int64)
    n_symbols = np.array([sum(map(t.count, SYMBOLS)) for t in texts], np.int64)
    n_dup_lines = np.empty(len(texts), np.int64)
    for i, t in enumerate(texts):
        lines = [x for x in t.split("\n") if x.strip(SPACE)]
        n_dup_lines[i] = len(lines) - len(set(lines))
    base_failed = (n_words < 50) | (100 * n_repeat > 50 * n_words)
    verdict = (n_covered <= max_covered * n_words) & ((longest <= longest_least) | (longest <= max_longest * n_words))
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat,
        "base_failed": base_failed, "kept": ~base_failed & verdict, "n_covered_words": n_covered, "longest_repeat": longest,
    }


def repetition_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 8, max_covered: float = 0.3, max_longest: float = 0.2, longest_least: int = 50) -> DataFrame:
    """One row per document: word figures, ``base_failed``, ``kept``, and the repeat figures behind it.

    ``kept`` is false where ``base_failed``, where repeats of ``min_words`` words or more cover more
    than ``max_covered`` of the words, or where one repeat has over ``longest_least`` words and over
    ``max_longest`` of the text. ``longest_repeat`` is the longest of these repeats, 0 where there is none. Null and empty texts have no words and fail the base rule. Repeated
    rows and null ids stay as rows of their own; texts of any length are taken whole, other columns
    are left out, an empty table gives no rows.
    """
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_covered_words long, longest_repeat long"

    def rules(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = text_rules(batch, min_words, max_covered, max_longest, longest_least)
        return pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, found.values())], ["doc_id", *found])

    return map_texts(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), rules, schema)
