"""Vector bin packing of token sequences under limits on tokens, segments and loss-bearing tokens.

Each task packs the documents it reads; nothing is shuffled. Parts of a long document that fill a
sequence alone are cut off first. The remainders wait in a bounded pool, and one sequence at a
time is filled: of the examples that fit within all three limits it takes the one with the largest
dot product of demand and free space, each over its capacity. When none fits whole, the largest
is cut to fill the rest. A sequence that stays short is laid out as sequences whose lengths are
powers of two, which take no padding.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Sequence ids are the task's number in the upper bits and a count in the lower.
TASK_SHIFT = 36


class Packer:
    """Packs ``(key, ids, loss)`` examples; yields sequences as lists of ``(key, start, stop)`` pieces."""

    def __init__(self, max_tokens: int = 1024, max_segments: int = 64, max_loss: int = 1024, pool: int = 2048):
        if min(max_tokens, max_segments, max_loss, pool) < 1:
            raise ValueError("limits must be positive")
        self.limits = np.array([max_tokens, max_segments, max_loss], float)
        self.max_tokens, self.pool = max_tokens, pool
        self.key, self.start, self.demand = [], [], np.empty((0, 3))
        self.waiting: list[tuple] = []

    def add(self, key, n_tokens: int, n_loss: int) -> Iterator[list]:
        """``n_loss`` of the tokens, the first ones, bear loss."""
        start = 0
        step = int(min(self.max_tokens, self.limits[2]))
        while n_tokens - start >= step and min(step, n_loss - start) <= self.limits[2]:
            yield [(key, start, start + step)]
            start += step
        if start < n_tokens:
            self.waiting.append((key, start, n_tokens, n_loss))
            if len(self.waiting) >= self.pool:
                yield from self.fill(len(self.waiting) // 2)

    def fill(self, leave: int = 0) -> Iterator[list]:
        """Fills sequences until ``leave`` examples wait."""
        items = self.waiting
        keys, starts, stops, loss_ends = (list(x) for x in zip(*items, strict=True)) if items else ([], [], [], [])
        starts, stops, loss_ends = (np.array(x, np.int64) for x in (starts, stops, loss_ends))
        live = np.ones(len(keys), bool)
        demand = np.empty((len(keys), 3))
        demand[:, 0], demand[:, 1], demand[:, 2] = stops - starts, 1, np.maximum(loss_ends - starts, 0)
        left = len(keys)
        while left > leave:
            free, taken = self.limits.copy(), []
            while left and free[0] > 0 and free[1] > 0:
                fits = live & (demand <= free).all(axis=1)
                if fits.any():
                    score = np.where(fits, demand @ (free / self.limits**2), -1.0)
                    i = int(np.argmax(score))
                    taken.append((keys[i], int(starts[i]), int(stops[i])))
                    free -= demand[i]
                    live[i] = False
                    left -= 1
                    continue
                size = int(free[0]) if free[2] > 0 else 0
                size = min(size, int(free[2])) if size else 0
                if not size:
                    break
                i = int(np.argmax(np.where(live, demand[:, 0], -1)))
                size = min(size, int(demand[i, 0]))
                taken.append((keys[i], int(starts[i]), int(starts[i]) + size))
                free -= (size, 1, min(size, demand[i, 2]))
                starts[i] += size
                demand[i] = (stops[i] - starts[i], 1, max(loss_ends[i] - starts[i], 0))
                if not demand[i, 0]:
                    live[i] = False
                    left -= 1
            yield from powers(taken, self.max_tokens)
        self.waiting = [(keys[i], int(starts[i]), int(stops[i]), int(loss_ends[i])) for i in np.flatnonzero(live)]


def powers(pieces: list[tuple], full: int) -> Iterator[list]:
    """One sequence if it is full; else sequences of falling powers of two, cut where these end."""
    total = sum(stop - start for _, start, stop in pieces)
    if total == full:
        yield pieces
        return
    at, rest = 0, list(pieces)
    while total:
        size = 1 << (total.bit_length() - 1)
        total -= size
        sequence = []
        while size:
            key, start, stop = rest[at]
            n = min(size, stop - start)
            sequence.append((key, start, start + n))
            size -= n
            if start + n == stop:
                at += 1
            else:
                rest[at] = (key, start + n, stop)
        yield sequence


_encoders: dict[str, Callable[[str], list[int]]] = {}


def byte_ranks(path: str) -> dict[bytes, int] | None:
    """Ids by bytes, if the file is a byte-level BPE whose ids follow the order of its merges; else None.

    For such a file, merging by least id is merging by first rule, which a rank encoder does quicker.
    """
    spec = json.loads(Path(path).read_text())
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return None
    if any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256
    letter = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*shown}))}
    vocab, merges = model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    made = [vocab[a + b] for a, b in merges]
    if made != sorted(set(made)) or any(max(vocab[a], vocab[b]) >= new for (a, b), new in zip(merges, made, strict=True)):
        return None
    return {bytes(letter[c] for c in token): vocab[token] for token in [*letter, *(a + b for a, b in merges)]}


def encoder(path: str) -> Callable[[str], list[int]]:
    """The worker's encoder for the file at ``path``: ids of a whole text, no special tokens added."""
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        added = [t.content for t in model.get_added_tokens_decoder().values()]

        def exact(text: str) -> list[int]:
            return model.encode(text, add_special_tokens=False).ids

        if ranks := byte_ranks(path):
            import public_tokenizers
            import tiktoken

            quick = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            _encoders[path] = lambda text: exact(text) if any(a in text for a in added) else quick(text)
        else:
            _encoders[path] = exact
    return _encoders[path]


def token_ids(texts: list[str], path: str) -> list[bytes]:
    """Ids of whole texts as little-endian unsigned 32-bit integers."""
    encode = encoder(path)
    return [np.array(encode(t), "<u4").tobytes() for t in texts]


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, end_id: int = 0, max_tokens: int = 1024, max_segments: int = 64, max_loss: int = 1024) -> DataFrame:
    """One row per piece of a document's ids (its text's ids, then ``end_id``, which bears no loss).

    Null and empty texts are the end id alone. Null ids are kept, repeated rows are documents of
    their own, other columns are left out, an empty table gives no rows. Every id lies in exactly
    one piece; a sequence's offsets run from 0 without gaps.
    """
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("byte_bpe_50k.json")

    def run(batches):
        packer = Packer(max_tokens, max_segments, max_loss)
        task = TaskContext.get().partitionId() << TASK_SHIFT if TaskContext.get() else 0
        ids_of: dict[int, tuple] = {}
        placed: dict[int, int] = {}
        rows, n_docs, n_sequences = [], 0, 0

        def note(sequences) -> None:
            nonlocal n_sequences
            for pieces in sequences:
                offset = 0
                for key, start, stop in pieces:
                    doc, ids = ids_of[key]
                    n = stop - start
                    rows.append((doc, start, n, zlib.crc32(ids[4 * start : 4 * stop]), len(ids) // 4, task | n_sequences, offset))
                    offset += n
                    placed[key] = placed.get(key, 0) + n
                    if 4 * placed[key] == len(ids):
                        del ids_of[key], placed[key]
                n_sequences += 1

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for part in slices(batch, 4_000_000):
                for doc, ids in zip(part.column(0).to_pylist(), token_ids([t or "" for t in part.column(1).to_pylist()], tokenizer_path), strict=True):
                    ids_of[n_docs] = (doc, ids + end)
                    note(packer.add(n_docs, len(ids) // 4 + 1, len(ids) // 4))
                    n_docs += 1
                yield out()
        note(packer.fill())
        yield out()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)
