"""Byte-level BPE in DuckDB: recursive queries inside each partition.

A task gathers the distinct pieces (pattern matches) it hasn't met, and one recursive query
encodes them: rows of token and position join the merge table, and each step contracts every
piece's leftmost pair of least rank until no pair merges. A second query joins the ids to the
vocabulary and decodes each piece by an ordered aggregation. Texts are chains of pieces, so the
results of pieces, kept in a bounded memory, give those of whole texts.

Long pieces would take a step for each token, so there a step contracts all places of the least
pair, from the left, and checks that this is what one place at a time would have done: that no
contraction made a pair of lower rank. A piece that fails the check is encoded one place at a time.

No query holds more than some 400,000 rows. A piece of more than 2,000 bytes becomes windows that
overlap, a query's worth at a time. A chain of tokens is the encoding of its bytes if every two neighbours are the
encoding of theirs (each token encodes to itself): so where two windows have a border in common and
the same token after it, one goes on from the other, as all neighbours then come from one window's
encoding. Where two windows never agree, as in some periodic runs, a part is encoded anew from a
border of the first, and the two tokens that meet there are encoded together as a check.
"""

from __future__ import annotations

import base64
import hashlib
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.chunks import ChunkMemory
from tidemark.llm.common import map_texts

#: A row's key is the piece's number above these bits and the token's position below; no text has as many bytes.
POSITION_BITS = 32
#: Pieces of more bytes are contracted at all places of their least pair in one step, where that is the same.
LONG = 96
#: Bytes of pieces a query takes at once; the step of windows (many token lengths divide it) and their overlap.
QUERY_BYTES, WINDOW, OVERLAP = 400_000, 240, 80
#: Pieces of more bytes become windows: one query would take a step for each distinct rank.
WHOLE = 2000
#: Tokens at a window's end that a part encoded anew takes over, and its bytes at first.
GIVEN_BACK, PART = 16, 4096

_STEP = """
WITH RECURSIVE state(k, id, done) AS (
    SELECT k, id, false FROM tokens
  UNION ALL
    SELECT CASE WHEN s.k > b.k THEN s.k - 1 ELSE s.k END, CASE WHEN s.k = b.k THEN b.merged ELSE s.id END, b.k IS NULL
    FROM state s LEFT JOIN (
        SELECT piece, (piece << {p}) + (best & {mask}) AS k, (best >> {p})::INTEGER AS merged
        FROM (SELECT a.k >> {p} AS piece, min((m.id::BIGINT << {p}) | (a.k & {mask})) AS best
              FROM state a JOIN state n ON n.k = a.k + 1 JOIN merges m ON m.pair = a.id::BIGINT * 65536 + n.id
              WHERE NOT a.done GROUP BY a.k >> {p})
    ) b ON s.k >> {p} = b.piece
    WHERE NOT s.done AND (b.k IS NULL OR s.k <> b.k + 1)
)
SELECT k, id FROM state WHERE done ORDER BY k
""".format(p=POSITION_BITS, mask=(1 << POSITION_BITS) - 1)

#: The same for long pieces. A step takes, of each piece's pairs of least rank, every other one of an unbroken run from
#: the left. ``wrong`` marks pieces where a contraction made a pair of lower rank: one that the next step finds, or one of
#: the new token and the first half of the next place taken.
_LONG_STEP = """
WITH RECURSIVE state(k, id, last, wrong, done) AS (
    SELECT k, id, -1, false, false FROM tokens
  UNION ALL (
    WITH pairs AS (
        SELECT a.k, a.id, a.k >> {p} AS piece, m.id AS merged, a.last
        FROM state a JOIN state n ON n.k = a.k + 1 JOIN merges m ON m.pair = a.id::BIGINT * 65536 + n.id WHERE NOT a.done
    ), least AS (
        SELECT piece, min(merged) AS merged, min(merged) < any_value(last) AS wrong FROM pairs GROUP BY piece
    ), hits AS (
        SELECT k, id, piece, merged, k - row_number() OVER (PARTITION BY piece ORDER BY k) AS run FROM pairs SEMI JOIN least USING (piece, merged)
    ), chosen AS (
        SELECT k, id, piece, merged FROM (SELECT *, row_number() OVER (PARTITION BY piece, run ORDER BY k) AS i FROM hits) WHERE i % 2 = 1
    ), early AS (
        SELECT DISTINCT c.piece FROM chosen c JOIN chosen d ON d.k = c.k + 2 JOIN merges m ON m.pair = c.merged::BIGINT * 65536 + d.id AND m.id < c.merged
    )
    SELECT ((s.k >> {p}) << {p}) + row_number() OVER (PARTITION BY s.k >> {p} ORDER BY s.k) - 1, coalesce(c.merged, s.id),
           coalesce(l.merged, s.last), s.wrong OR coalesce(l.wrong, false) OR e.piece IS NOT NULL, l.piece IS NULL
    FROM state s LEFT JOIN least l ON l.piece = s.k >> {p} LEFT JOIN early e ON e.piece = s.k >> {p} LEFT JOIN chosen c ON c.k = s.k
    WHERE NOT s.done AND NOT EXISTS (SELECT 1 FROM chosen d WHERE d.k = s.k - 1)
  )
)
SELECT k, id, wrong FROM state WHERE done ORDER BY k
""".format(p=POSITION_BITS)

_DECODE = """
SELECT t.k >> {p} AS piece, string_agg(v.hex, '' ORDER BY t.k) AS hex, count(*) AS n
FROM ids t JOIN vocabulary v USING (id) GROUP BY piece ORDER BY piece
""".format(p=POSITION_BITS)


def read_ranks(path: str) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in Path(path).read_bytes().splitlines() if line.strip())}


class SqlBpe:
    """A rank file in a DuckDB database in memory: merge table, vocabulary, encoder and decoder."""

    def __init__(self, path: str, memory: str = "500MB"):
        import duckdb

        ranks = read_ranks(path)
        if max(ranks.values(), default=0) >= 65536:
            raise ValueError("ids must fit in 16 bits")
        splits = [(ranks[t[:i]] * 65536 + ranks[t[i:]], rank) for t, rank in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": memory, "temp_directory": ""})
        self.load("merges", pair=np.array([s[0] for s in splits], np.int64), id=np.array([s[1] for s in splits], np.int32))
        self.load("vocabulary", id=np.array(list(ranks.values()), np.int32), hex=[t.hex() for t in ranks])
        self.token = {rank: token for token, rank in ranks.items()}
        self.size = np.zeros(max(ranks.values(), default=0) + 1, np.int64)
        self.size[list(ranks.values())] = [len(t) for t in ranks]
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)

    def load(self, table: str, **columns) -> None:
        self.db.register("incoming", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TABLE {table} AS SELECT * FROM incoming")
        self.db.unregister("incoming")

    def rows(self, sql: str) -> dict[str, np.ndarray]:
        return self.db.execute(sql).fetchnumpy()

    def encode(self, pieces: list[bytes]) -> list[tuple[bytes, bytes]]:
        """For each piece its ids (little-endian unsigned 32 bits) and the bytes these decode to."""
        found: list = [(b"", b"")] * len(pieces)
        self._encode_all(pieces, [i for i, p in enumerate(pieces) if len(p) <= LONG], _STEP, found)
        wrong = self._encode_all(pieces, [i for i, p in enumerate(pieces) if LONG < len(p) <= WHOLE], _LONG_STEP, found)
        self._encode_all(pieces, wrong, _STEP, found)
        for i, p in enumerate(pieces):
            if len(p) > WHOLE:
                found[i] = self._in_parts(p)
        return found

    def _ids(self, parts: list[bytes]) -> list[np.ndarray]:
        found: list = [None] * len(parts)
        short = [i for i, p in enumerate(parts) if len(p) <= LONG]
        wrong = self._encode_all(parts, [i for i, p in enumerate(parts) if len(p) > LONG], _LONG_STEP, found)
        self._encode_all(parts, short + wrong, _STEP, found)
        return [np.frombuffer(ids, "<u4").astype(np.int64) for ids, _ in found]

    def _placed(self, ids: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Where each token begins, the tokens, and where the last one ends."""
        sizes = self.size[ids]
        ends = start + np.cumsum(sizes)
        return ends - sizes, ids, int(ends[-1])

    def _windows(self, piece: bytes):
        """The piece's windows in order, encoded a query's worth at a time."""
        starts = range(0, max(1, len(piece) - OVERLAP), WINDOW)
        at_once = max(1, QUERY_BYTES // (WINDOW + OVERLAP))
        for i in range(0, len(starts), at_once):
            some = starts[i : i + at_once]
            for start, ids in zip(some, self._ids([piece[a : a + WINDOW + OVERLAP] for a in some]), strict=True):
                yield self._placed(ids, start)

    def _in_parts(self, piece: bytes) -> tuple[bytes, bytes]:
        """The same for a piece of any length, in queries of bounded size."""
        windows, kept, grown = self._windows(piece), [], PART
        places, ids, end = next(windows)
        while end < len(piece):
            window = next((w for w in windows if w[2] > end), None)
            common = np.intersect1d(places, window[0], assume_unique=True) if window else ()
            if len(common):
                here, there = np.searchsorted(places, common), np.searchsorted(window[0], common)
                same = np.flatnonzero(ids[here] == window[1][there])
                if len(same):
                    kept.append(ids[: here[same[0]]])
                    places, ids, end = window[0][there[same[0]] :], window[1][there[same[0]] :], window[2]
                    grown = PART
                    continue
            back = min(GIVEN_BACK, len(ids) - 1)
            while True:  # a part anew from a border of this window
                cut = len(ids) - back
                (fresh,) = self._ids([piece[places[cut] : places[cut] + grown]])
                if cut == 0 or self.stay_apart(int(ids[cut - 1]), int(fresh[0])):
                    break
                back += 1
            if cut == 0 and kept and not self.stay_apart(int(kept[-1][-1]), int(fresh[0])):  # go back into what was kept
                ids = np.concatenate([kept.pop(), ids])
                places, _, end = self._placed(ids, end - int(self.size[ids].sum()))
                continue
            kept.append(ids[:cut])
            places, ids, end = self._placed(fresh, int(places[cut]))
            grown = min(2 * grown, QUERY_BYTES)
        kept.append(ids)
        whole = np.concatenate(kept)
        return whole.astype("<u4").tobytes(), self.decoded(whole)

    def decoded(self, ids: np.ndarray) -> bytes:
        """The bytes of ids, by ordered aggregation, a bounded number at a time."""
        out = []
        for i in range(0, len(ids), QUERY_BYTES):
            some = ids[i : i + QUERY_BYTES]
            self.load("ids", k=np.arange(len(some), dtype=np.int64), id=some.astype(np.int32))
            out.append(bytes.fromhex(self.rows(_DECODE)["hex"][0]))
        return b"".join(out)

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether two neighbouring tokens are the encoding of their bytes."""
        both = self.token[a] + self.token[b]
        return self._ids([both])[0].tolist() == [a, b]

    def _encode_all(self, pieces: list[bytes], chosen: list[int], step: str, found: list) -> list[int]:
        """Puts the results of the chosen pieces in ``found``, a bounded number of bytes at a time; gives the pieces that failed the step's check."""
        at, wrong = 0, []
        while at < len(chosen):
            end, size = at, 0
            while end < len(chosen) and (end == at or size + len(pieces[chosen[end]]) <= QUERY_BYTES):
                size += len(pieces[chosen[end]])
                end += 1
            part = chosen[at:end]
            results, failed = self._encode([pieces[i] for i in part], step)
            for i, result in zip(part, results, strict=True):
                found[i] = result
            wrong += [part[k] for k in failed]
            at = end
        return wrong

    def _encode(self, pieces: list[bytes], step: str) -> tuple[list[tuple[bytes, bytes]], list[int]]:
        sizes = np.array([len(p) for p in pieces], np.int64)
        number = np.repeat(np.arange(len(pieces), dtype=np.int64), sizes)
        position = np.arange(len(number)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.load("tokens", k=(number << POSITION_BITS) + position, id=self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)])
        done = self.rows(step)
        self.load("ids", k=done["k"], id=done["id"])
        text = self.rows(_DECODE)
        ids, ends = np.asarray(done["id"], "<u4").tobytes(), np.zeros(len(pieces) + 1, np.int64)
        decoded = [b""] * len(pieces)
        for piece, hexed, n in zip(text["piece"].tolist(), text["hex"].tolist(), text["n"].tolist(), strict=True):
            ends[piece + 1] = n
            decoded[piece] = bytes.fromhex(hexed)
        ends = (4 * np.cumsum(ends)).tolist()
        failed = np.unique(done["k"][done["wrong"].astype(bool)] >> POSITION_BITS).tolist() if "wrong" in done else []
        return [(ids[ends[i] : ends[i + 1]], decoded[i]) for i in range(len(pieces))], failed


_memories: dict[str, ChunkMemory] = {}


def memory_for(path: str, pattern: str) -> ChunkMemory:
    """The worker's memory of encoded chunks for a rank file."""
    if path not in _memories:
        import regex

        bpe, split, known = SqlBpe(path), regex.compile(pattern).findall, ChunkMemory(lambda pieces: bpe.encode([p.encode("utf-8", "replace") for p in pieces]))

        def encode(chunks: list[str]) -> list[tuple[bytes, bytes]]:
            cut = [split(c) for c in chunks]
            results = known.lookup(set().union(*cut))
            return [tuple(map(b"".join, zip(*map(results, pieces), strict=True))) if pieces else (b"", b"") for pieces in cut]

        _memories[path] = ChunkMemory(encode)
    return _memories[path]


def bpe_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of every whole text.

    Null and empty texts have no tokens (digests of no bytes). Pieces of any length are encoded,
    those of more than 2,000 bytes in windows. Null ids and repeated rows stay, other columns are left out, an empty table gives no rows.
    """
    ranks_path, pattern = _defaults(ranks_path, pattern)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, ids, decoded = [], [], []
        for parts in memory_for(ranks_path, pattern).results([t or "" for t in batch.column(1).to_pylist()]):
            joined = b"".join([p[0] for p in parts])
            n.append(len(joined) // 4)
            ids.append(hashlib.sha256(joined).hexdigest())
            decoded.append(hashlib.sha256(b"".join([p[1] for p in parts])).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_texts(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``(doc_id, ids array<int>, decoded string)`` of every whole text; empties as in :func:`bpe_digests`."""
    ranks_path, pattern = _defaults(ranks_path, pattern)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, decoded = [], []
        for parts in memory_for(ranks_path, pattern).results([t or "" for t in batch.column(1).to_pylist()]):
            ids.append(np.frombuffer(b"".join([p[0] for p in parts]), "<u4").astype(np.int32))
            decoded.append(b"".join([p[1] for p in parts]).decode("utf-8", "replace"))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    return map_texts(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, ids array<int>, decoded string")


def _defaults(ranks_path: str | None, pattern: str | None) -> tuple[str, str]:
    if ranks_path and pattern:
        return ranks_path, pattern
    import public_tokenizers

    return ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
