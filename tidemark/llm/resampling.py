"""Importance resampling towards a target distribution, over hashed n-gram counts.

Identical texts are collapsed first, by grouping the full text, so counts and weights are computed
once for each and multiplied by the number of copies. One pass over the distinct texts counts
buckets (one row of each bucket and task is shuffled); gains of buckets are broadcast (a fixed
number); a second pass weighs each text. Weights are joined back to the documents by the texts'
SHA-256, hot texts dealt to many tasks, and only then each document gets its noise of its own.

A bucket is a CRC of an n-gram, and CRCs are linear: the CRC of words in a row follows from the
words' own by table look-ups, a step for a whole array of n-grams.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import join_facts, slices
from tidemark.tables import discard, stored

BUCKETS, LONGEST = 10_000, 3
#: Bytes of text worked on at once, rows of a task that numbers the ranks, and distinct words a worker keeps.
TEXT_BYTES, RANK_ROWS, KNOWN_WORDS = 4_000_000, 1_000_000, 400_000

#: Bytes of words: digits, letters (lower-cased) and all beyond ASCII; others part words.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_POLYNOMIAL = 0xEDB88320
_DIRECT = 48


def _zero_bytes() -> tuple[np.ndarray, np.ndarray]:
    """What 0 to 48 zero bytes make of each byte of a CRC, and what 2 ** j of them do: arrays of count, place of the byte, byte."""
    value = np.arange(256, dtype=np.uint32)
    one = value.copy()
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(_POLYNOMIAL), one >> 1).astype(np.uint32)
    direct = [np.stack([value << np.uint32(8 * place) for place in range(4)])]
    for _ in range(_DIRECT):
        direct.append((direct[-1] >> np.uint32(8)) ^ one[direct[-1] & np.uint32(255)])
    powers = [direct[1]]
    for _ in range(40):
        powers.append(_apply(powers[-1][None], np.int64(0), powers[-1]))
    return np.stack(direct), np.stack(powers)


def _apply(tables: np.ndarray, which, crc: np.ndarray) -> np.ndarray:
    byte = np.uint32(255)
    return tables[which, 0, crc & byte] ^ tables[which, 1, (crc >> np.uint32(8)) & byte] ^ tables[which, 2, (crc >> np.uint32(16)) & byte] ^ tables[which, 3, crc >> np.uint32(24)]


_ZEROS, _POWERS = _zero_bytes()


def append_crc(crc: np.ndarray, other: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs of joined strings from those of their parts; ``length`` is that of the second part."""
    made = _apply(_ZEROS, np.minimum(length, _DIRECT), crc)
    for i in np.flatnonzero(length > _DIRECT):
        one = crc[i : i + 1]
        for bit in range(int(length[i]).bit_length()):
            if int(length[i]) >> bit & 1:
                one = _apply(_POWERS, bit, one)
        made[i] = one[0]
    return made ^ other


class Words:
    """Numbers, CRCs and lengths of the words a worker has met; of bounded size."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.crc, self.spaced, self.length = np.zeros(0, np.uint32), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        new = list(set(words) - self.number.keys())
        if new:
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
            own = [zlib.crc32(w) for w in new]
            self.crc = np.append(self.crc, np.array(own, np.uint32))
            self.spaced = np.append(self.spaced, np.array([zlib.crc32(b" ", c) for c in own], np.uint32))
            self.length = np.append(self.length, np.array([len(w) for w in new], np.int64))
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))

    def buckets(self, words: np.ndarray, text: np.ndarray, carried: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Buckets of all runs of 1 to 3 words that end after the first ``carried`` words, with their texts."""
        crc, spaced, length = self.crc[words], self.spaced[words], self.length[words]
        yield crc[carried:] % buckets, text[carried:]
        pair, both = append_crc(spaced[:-1], crc[1:], length[1:]), text[1:] == text[:-1]
        both[: max(carried - 1, 0)] = False
        yield pair[both] % buckets, text[1:][both]
        before = append_crc(spaced[:-2], spaced[1:-1], length[1:-1] + 1)
        triple, all_three = append_crc(before, crc[2:], length[2:]), text[2:] == text[:-2]
        all_three[: max(carried - 2, 0)] = False
        yield triple[all_three] % buckets, text[2:][all_three]


_known = Words()


def features(texts: list[str], buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of whole texts' features: the texts' numbers of words in a block, buckets, and the text of each bucket.

    Texts longer than some megabytes take several blocks, each with the two words before it.
    """
    global _known
    gathered: list[list[bytes]] = []
    for t, text in enumerate(texts):
        letters = text.encode("utf-8", "replace").translate(_LETTERS)
        if len(letters) <= TEXT_BYTES:
            gathered.append(letters.split())
            continue
        gathered.append([])
        start, carried = 0, []
        while start < len(letters):
            end = letters.find(b" ", start + TEXT_BYTES)
            end = len(letters) if end < 0 else end
            words = letters[start:end].split()
            yield _block([*carried, *words], np.full(len(carried) + len(words), t), len(carried), len(texts), buckets)
            carried, start = [*carried, *words][-(LONGEST - 1) :], end
    sizes = [len(w) for w in gathered]
    yield _block([w for ws in gathered for w in ws], np.repeat(np.arange(len(texts)), sizes), 0, len(texts), buckets)


def _block(words: list[bytes], text: np.ndarray, carried: int, n_texts: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    global _known
    if len(_known.number) > KNOWN_WORDS:
        _known = Words()
    numbers = _known.numbers(words)
    found, owners = zip(*_known.buckets(numbers, text, carried, buckets), strict=True)
    return np.bincount(text[carried:], minlength=n_texts), np.concatenate(found), np.concatenate(owners)


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket over all rows of ``(n, text)``, a text counting ``n`` times."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch, TEXT_BYTES):
                n = part.column(0).to_numpy()
                for _, found, owner in features(part.column(1).to_pylist(), buckets):
                    total += np.bincount(found, n[owner], buckets).astype(np.int64)  # exact up to 2 ** 53 in a slice
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    rows = texts.select("n", "text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # at most one for each bucket
    counts = np.zeros(buckets, np.int64)
    for r in rows:
        counts[r.bucket] = r.n
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """``floor(1000 * ln(p_target / p_source))`` of each bucket, both smoothed by one."""
    s_all, t_all, n = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((float(t) + 1) * (float(s_all) + n) / ((float(s) + 1) * (float(t_all) + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weights(texts: DataFrame, gain: np.ndarray) -> DataFrame:
    """``(key, n, n_words, n_features, weight)`` of each row of ``(key, n, text)``."""
    known = texts.sparkSession.sparkContext.broadcast(gain)  # one number for each bucket

    def run(batches):
        gain = known.value
        for batch in batches:
            for part in slices(batch, TEXT_BYTES):
                m = part.num_rows
                words, n, total = np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m, np.int64)
                for found_words, found, owner in features(part.column(2).to_pylist(), len(gain)):
                    words += found_words
                    n += np.bincount(owner, minlength=m)
                    total += np.bincount(owner, gain[found], m).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(words), pa.array(n), pa.array(total)], ["key", "n", "n_words", "n_features", "weight"])

    return texts.select("key", "n", "text").mapInArrow(run, "key binary, n long, n_words long, n_features long, weight long")


def distinct_texts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(key, n, text)``: each text once, with its number of rows and its SHA-256; a null text is an empty one."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.groupBy(text.alias("text")).agg(F.count("*").alias("n")).select(_key(F.col("text")).alias("key"), "n", "text")


def _key(text):
    return F.unhex(F.sha2(text.cast("binary"), 256))


def noise(id_col, seed: int = 42):
    """The Gumbel noise of a document in thousandths: a function of its id and the seed alone."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), id_col.cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(rows: DataFrame, order: list, n: int) -> DataFrame:
    """``rows`` with ``place``, their numbers from 1 in a total order, by ranges: no task sees more than its range.

    Rows that are equal in ``order`` are dealt by their numbers in the table, so any count of them is spread.
    The offsets of the ranges, a million rows each, are what the driver gets.
    """
    spread = rows.withColumn("_row", F.monotonically_increasing_id())
    ranges = spread.repartitionByRange(n // RANK_ROWS + 1, *order, "_row").sortWithinPartitions(*order, "_row")
    numbered = stored(ranges.drop("_row").withColumn("_at", F.monotonically_increasing_id()), "ranked")
    sizes = numbered.groupBy(F.shiftright("_at", 33).alias("_range")).agg(F.count("*").alias("n")).collect()
    starts, total = [], 0
    for r in sorted(sizes, key=lambda r: r["_range"]):
        starts.append((r["_range"], total))
        total += r["n"]
    offsets = F.broadcast(rows.sparkSession.createDataFrame(starts, "_range long, _start long"))
    placed = numbered.withColumn("_range", F.shiftright("_at", 33)).join(offsets, "_range")
    return placed.withColumn("place", F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_range", "_start", "_at")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """``(doc_id, n_features, weight, score, rank, n_words)`` of every document; ``rank`` is null for those that aren't drawn.

    Of the documents with at least ``least_words`` words, the given percentage with the highest
    scores is drawn; ties go to smaller ids, then to more features and weight. Null and empty texts
    have no features and weigh 0. A row without an id has no score, isn't drawn and doesn't count
    among those drawn from; rows that repeat an id count each. Other columns are left out. An empty
    table gives no rows, an empty target one where every feature is equally rare.
    """
    texts = stored(distinct_texts(docs, text_col), "distinct-texts")
    wanted = stored(distinct_texts(target, target_col), "target-texts")
    weighed = weights(texts, gains(bucket_counts(texts, buckets), bucket_counts(wanted, buckets)))
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), _key(F.coalesce(F.col(text_col), F.lit(""))).alias("key"), F.monotonically_increasing_id().alias("_row"))
    joined = join_facts(keyed, weighed, "key", "n", "_row")
    scored = stored(joined.select("doc_id", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"), "n_words"), "scored")
    discard(texts)
    discard(wanted)
    able = F.col("score").isNotNull() & (F.col("n_words") >= least_words)
    n = scored.where(able).count()
    placed = ranked(scored.where(able), [F.desc("score"), F.asc("doc_id"), F.desc("n_features"), F.desc("weight")], n)
    drawn = F.when(F.col("place") <= percent * n // 100, F.col("place")).alias("rank")
    columns = ["doc_id", "n_features", "weight", "score"]
    rest = scored.where(~able).select(*columns, F.lit(None).cast("long").alias("rank"), "n_words")
    return placed.select(*columns, drawn, "n_words").unionByName(rest)
