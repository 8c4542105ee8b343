"""Transcripts to chat turns: a hidden Markov model over line features, decoded by Viterbi.

A transcript is lines in an order. Hidden states are the roles, each as a turn's first line or a
later one. A line is observed through independent features: the speaker marker it starts with, its
length, how it starts and ends. The model is counted on transcripts whose roles are known.

Decoding is split so that no task holds a whole conversation: rows are dealt into blocks, each
block gives the best score from every state before it to every state at its end (a max-plus
matrix), a tree over the blocks of a conversation fixes the states at their borders, and each
block is then decoded between its borders. Turns that cross borders are put together again. The
result equals one Viterbi pass over all lines, whatever the size of a block.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import map_texts
from tidemark.tables import stored

ROLES = ("system", "user", "assistant")
#: States 0 to 2 are first lines of the roles, 3 to 5 their later lines.
STATES = 2 * len(ROLES)
MARKERS = {
    "system": "system|sys|instruction|instructions|context",
    "user": "user|human|question|q|customer|prompter|me",
    "assistant": "assistant|ai|bot|answer|a|response|gpt|model|agent",
}
_MARKED = re.compile(
    r"[ \t]*(?:#{1,4}[ \t]*|\*\*|\[|<\|?|\(|>[ \t]*)?(?:" + "|".join(f"(?P<{r}>{words})" for r, words in MARKERS.items()) + r")(?:\*\*:?|\]:?|\|?>:?|\):?|:\**)(?:[ \t]+|$)", re.I
)
_QUOTED = re.compile(r"[ \t]*>[ \t]?")
FEATURES = {"marker": 5, "length": 6, "start": 4, "end": 5}
#: Values of a conversation's order column that share a block; rows of blocks that make one task's group.
BLOCK, GROUP_ROWS = 256, 4000
#: Lines that a state's prior emissions count for.
PRIOR = 5.0
#: Successive blocks whose matrices one node of the tree puts together.
WIDE = 512


def strip_marker(line: str) -> tuple[int, str]:
    """Marker class (0 none, 1 to 3 the roles, 4 a quote sign) and the line without it."""
    if m := _MARKED.match(line):
        return 1 + ROLES.index(m.lastgroup), line[m.end() :]
    if m := _QUOTED.match(line):
        return 4, line[m.end() :]
    return 0, line


def observe(line: str) -> tuple[int, int, int, int]:
    """The line's feature values, in the order of FEATURES."""
    marker, body = strip_marker(line)
    body = body.strip()
    length = int(np.searchsorted((0, 40, 120, 300, 800), len(body), "left"))
    start = 0 if not body else 1 if body[0].isupper() else 2 if body[0].islower() else 3
    end = 0 if not body else 1 + ".?:".find(body[-1]) if body[-1] in ".?:" else 4
    return marker, length, start, end


class Hmm:
    """Log probabilities: of the first state, of moves, and of each feature's values by state."""

    def __init__(self, first: np.ndarray, moves: np.ndarray, emissions: list[np.ndarray]):
        log = lambda counts: np.log(counts / counts.sum(-1, keepdims=True))
        self.first, self.moves, self.emissions = log(first), log(moves), [log(e) for e in emissions]

    def line_scores(self, lines: list[str]) -> np.ndarray:
        seen = np.array([observe(x) for x in lines], np.int64).reshape(len(lines), len(FEATURES))
        return sum((e[:, seen[:, k]].T for k, e in enumerate(self.emissions)), np.zeros((len(lines), STATES)))


class Steps:
    """Sequences of lines, walked in step: at step t all that have more than t lines, the longest first."""

    def __init__(self, sizes: np.ndarray):
        self.order = np.argsort(-sizes, kind="stable")
        self.sizes = sizes[self.order]
        self.starts = (np.cumsum(sizes) - sizes)[self.order]

    def __iter__(self):
        for t in range(int(self.sizes.max(initial=0))):
            live = int(np.searchsorted(-self.sizes, -t, "left"))
            yield t, live, self.starts[:live] + t


def transfer(hmm: Hmm, scores: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each sequence (none is empty) the best score for each state before it (the last row: nothing is before) and at its end."""
    steps = Steps(sizes)
    value = np.empty((len(sizes), STATES + 1, STATES))
    for t, live, at in steps:
        if t:
            value[:live] = (value[:live, :, :, None] + hmm.moves).max(2) + scores[at][:, None]
        else:
            value[:] = np.vstack([hmm.moves, hmm.first]) + scores[at][:, None]
    out = np.empty_like(value)
    out[steps.order] = value
    return out


def decode(hmm: Hmm, scores: np.ndarray, sizes: np.ndarray, before: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The best states of each sequence between the state ``before`` (-1: none) and the state ``end``."""
    steps, back = Steps(sizes), []
    value = np.empty((len(sizes), STATES))
    for t, live, at in steps:
        if t:
            step = value[:live, :, None] + hmm.moves
            back.append(step.argmax(1))
            value[:live] = step.max(1) + scores[at]
        else:
            value[:] = np.vstack([hmm.moves, hmm.first])[before[steps.order]] + scores[at]  # -1 is the last row
    states, here = np.empty(len(scores), np.int64), end[steps.order].copy()
    for t, live, at in reversed(list(steps)):
        states[at] = here[:live]
        if t:
            here[:live] = back[t - 1][np.arange(live), here[:live]]
    return states


def joined(matrices: list[np.ndarray]) -> np.ndarray:
    """The matrix of successive blocks."""
    value = matrices[0]
    for m in matrices[1:]:
        value = (value[:, :, None] + m[:-1]).max(1)
    return value


def border_states(matrices: list[np.ndarray], before: int, end: int) -> list[int]:
    """The state at the end of each of successive blocks; an ``end`` of -1 is the best one."""
    value, back = matrices[0][before], []
    for m in matrices[1:]:
        step = value[:, None] + m[:-1]
        back.append(step.argmax(0))
        value = step.max(0)
    ends = [int(value.argmax()) if end < 0 else end]
    for b in reversed(back):
        ends.append(int(b[ends[-1]]))
    return ends[::-1]


def render(role: str, lines: list[str]) -> str:
    """A turn in canonical form."""
    return f"<|{role}|>\n" + "\n".join(lines).strip() + "\n<|end|>"


def as_transcripts(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, text, role)`` with speaker markers written into the texts, in a style that a hash of the conversation picks.

    A null role writes no marker; one style marks the first turn only, another quotes the user and
    leaves the assistant unmarked.
    """
    style = F.pmod(F.xxhash64("conv_id"), F.lit(7))
    role, lower = F.lower("role"), F.col("role").isNotNull()
    marked = {
        0: F.concat(F.initcap(role), F.lit(": ")),
        1: F.concat(F.lit("### "), F.when(role == "user", "Human").otherwise(F.initcap(role)), F.lit(":\n")),
        2: F.concat(F.lit("<|"), role, F.lit("|>\n")),
        3: F.when(role == "user", "Q: ").when(role == "assistant", "A: ").otherwise("[system] "),
        4: F.when(role == "user", "> ").when(role == "system", "[system] ").otherwise(""),
        5: F.when(F.col("turn") == 0, F.concat(F.lit("**"), F.initcap(role), F.lit("**: "))).otherwise(""),
        6: F.concat(F.upper(role), F.lit(": ")),
    }
    marker = F.lit("")
    for k, m in marked.items():
        marker = F.when(style == k, m).otherwise(marker)
    return conversations.select("conv_id", "turn", F.concat(F.when(lower, marker).otherwise(""), F.coalesce("text", F.lit(""))).alias("text"), "role")


def _priors(counts: list[np.ndarray]) -> list[np.ndarray]:
    """Each state's emissions before anything of it is seen: its own role's marker or none, otherwise those of all roles' first or later lines."""
    out = []
    for name, c in zip(FEATURES, counts, strict=True):
        pooled = c.reshape(2, len(ROLES), -1).sum(1) + 0.5
        p = np.repeat(pooled / pooled.sum(1, keepdims=True), len(ROLES), 0)
        if name == "marker":
            p = np.full(p.shape, 0.02)
            p[: len(ROLES), 0], p[len(ROLES) :, 0] = 0.5, 0.9
            p[np.arange(len(ROLES)), 1 + np.arange(len(ROLES))] = 0.44
        out.append(p)
    return out


def train(transcripts: DataFrame, sample: int = 2000) -> Hmm:
    """Counts over the known roles of at most ``sample`` conversations outside the held-out fold, chosen by a hash of their ids.

    What reaches the driver is a count for each distinct set of a line's features and state, and
    for each pair of roles that follow each other.
    """
    known = transcripts.where(F.col("conv_id").isNotNull() & ~held_out() & F.lower("role").isin(*ROLES))
    chosen = known.select("conv_id").distinct().orderBy(F.xxhash64("conv_id"), "conv_id").limit(sample)
    rows = known.join(F.broadcast(chosen), "conv_id").select("conv_id", "turn", F.lower("role").alias("role"), "text")

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        found: Counter = Counter()
        for role, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            state = ROLES.index(role)
            for k, line in enumerate(text.split("\n")):
                found[state + len(ROLES) * (k > 0), *observe(line)] += 1
        keys = list(found)
        return pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], pa.int32()) for i in range(5)), pa.array([found[k] for k in keys], pa.int64())], ["state", *FEATURES, "n"])

    rows = rows.fillna("", ["text"])
    seen = map_texts(rows.select("role", "text"), count, "state int, marker int, length int, start int, end int, n long").groupBy("state", *FEATURES).agg(F.sum("n").alias("n")).collect()
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    pairs = rows.withColumn("last", F.lag("role").over(order)).groupBy("last", "role").agg(F.count("*").alias("n")).collect()
    first, turns = np.full(STATES, 1e-3), np.full((len(ROLES), len(ROLES)), 0.05)
    first[: len(ROLES)] += 0.5
    for r in pairs:
        if r["last"] is None:
            first[ROLES.index(r["role"])] += r["n"]
        else:
            turns[ROLES.index(r["last"]), ROLES.index(r["role"])] += r["n"]
    emissions = [np.zeros((STATES, n)) for n in FEATURES.values()]
    by_state = np.full(STATES, 1.0)
    for r in seen:
        by_state[r["state"]] += r["n"]
        for e, name in zip(emissions, FEATURES, strict=True):
            e[r["state"], r[name]] += r["n"]
    emissions = [e + PRIOR * p for e, p in zip(emissions, _priors(emissions), strict=True)]
    moves = np.full((STATES, STATES), 1e-4)
    starts, later = by_state[: len(ROLES)], by_state[len(ROLES) :]
    for k in range(len(ROLES)):
        stays = later[k] / (starts[k] + later[k])  # chance that a line is followed by another of its turn
        for row in (k, len(ROLES) + k):
            moves[row, len(ROLES) + k] += stays
            moves[row, : len(ROLES)] += (1 - stays) * turns[k] / turns[k].sum()
    return Hmm(first, moves, emissions)


def body_of(role: str, lines: list[str]) -> list[str]:
    """A whole turn's lines; a user's turn that is quoted throughout loses its quote signs."""
    if role == "user" and all(not x or _QUOTED.match(x) for x in lines[1:]):
        return [lines[0], *(_QUOTED.sub("", x, count=1) for x in lines[1:])]
    return lines


class BlockLines:
    """The blocks of a group in order, and their lines; rows of one order value are read in order of their texts."""

    def __init__(self, table: pa.Table):
        table = table.sort_by([(c, "ascending") for c in ("own", "conv_id", "block", "turn", "text")])
        self.conv = table["conv_id"].to_pylist()
        own, block = table["own"].to_numpy(), table["block"].to_numpy()
        conv = table["conv_id"].fill_null(-1).to_numpy()
        self.first = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (conv[1:] != conv[:-1]) | (block[1:] != block[:-1])]) if len(own) else np.empty(0, np.int64)
        self.keys = [(self.conv[i], int(own[i]), int(block[i])) for i in self.first.tolist()]
        cut = [t.split("\n") for t in table["text"].to_pylist()]
        counts = np.array([len(c) for c in cut], np.int64)
        self.lines = [x for c in cut for x in c]
        self.turn = [t for t, c in zip(table["turn"].to_pylist(), cut, strict=True) for _ in c]
        self.number = [k for c in cut for k in range(len(c))]
        self.sizes = np.add.reduceat(counts, self.first) if len(counts) else counts


def parse(transcripts: DataFrame, hmm: Hmm, conv_col: str = "conv_id", order_col: str = "turn", text_col: str = "text") -> DataFrame:
    """``(conv_id, turn, line, role, text, rendered)``: the recovered turns of each transcript.

    ``turn`` and ``line`` are the order value and line number where the recovered turn starts,
    ``text`` has its lines without the marker, ``rendered`` is the canonical form. Rows are read in
    order, ties by text, so repeated rows follow each other; null texts are one empty line. Rows
    without a conversation id or without an order value are transcripts of their own. Other columns
    are left out, an empty table gives no rows.
    """
    known = transcripts.sparkSession.sparkContext.broadcast(hmm)
    order = F.col(order_col).cast("long")
    alone = F.col(conv_col).isNull() | order.isNull()
    rows = transcripts.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.when(alone, F.monotonically_increasing_id()).otherwise(-1).alias("own"),
        F.coalesce(F.floor(order / F.lit(BLOCK)), F.lit(0)).cast("long").alias("block"), order.alias("turn"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    rows = stored(rows, "chat-rows")
    groups = max(12, -(-rows.count() // GROUP_ROWS))

    def matrices(table: pa.Table) -> pa.Table:
        blocks = BlockLines(table)
        best = transfer(known.value, known.value.line_scores(blocks.lines), blocks.sizes)
        return _matrix_table(blocks.keys, best)

    def pieces(table: pa.Table, edges: pa.Table) -> pa.Table:
        blocks = BlockLines(table)
        known_edges = {(e["conv_id"], e["own"], e["block"]): (e["before"], e["ends"], e["last"]) for e in edges.to_pylist()}
        mine = [known_edges[k] for k in blocks.keys]
        states = decode(known.value, known.value.line_scores(blocks.lines), blocks.sizes, *(np.array([e[k] for e in mine], np.int64) for k in (0, 1)))
        out: dict[str, list] = {k: [] for k in ("conv_id", "own", "block", "head", "tail", "turn", "line", "role", "body")}
        at = 0
        for key, size, (before, _, last) in zip(blocks.keys, blocks.sizes.tolist(), mine, strict=True):
            found = states[at : at + size].tolist()
            was = [before, *found[:-1]]
            begun = [i for i, (s, w) in enumerate(zip(found, was, strict=True)) if w < 0 or s < len(ROLES) or s % len(ROLES) != w % len(ROLES)]
            starts = begun if begun[:1] == [0] else [0, *begun]
            for a, b in zip(starts, [*starts[1:], size], strict=True):
                head, lines = a == 0 and begun[:1] != [0], blocks.lines[at + a : at + b]
                body = lines if head else [strip_marker(lines[0])[1], *lines[1:]]
                values = (*key, head, b == size and not last, blocks.turn[at + a], blocks.number[at + a], ROLES[found[a] % len(ROLES)], "\n".join(body))
                for column, value in zip(out.values(), values, strict=True):
                    column.append(value)
            at += size
        kinds = {"conv_id": pa.int64(), "own": pa.int64(), "block": pa.int64(), "turn": pa.int64(), "line": pa.int32(), "head": pa.bool_(), "tail": pa.bool_()}
        return pa.table({n: pa.array(v, kinds.get(n, pa.string())) for n, v in out.items()})

    def rendered(batch: pa.RecordBatch) -> pa.RecordBatch:
        bodies = [body_of(role, body.split("\n")) for role, body in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
        texts = ["\n".join(b).strip() for b in bodies]
        shown = [render(role, b) for role, b in zip(batch.column(3).to_pylist(), bodies, strict=True)]
        return pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(texts, pa.string()), pa.array(shown, pa.string())], ["conv_id", "turn", "line", "role", "text", "rendered"])

    best = _dealt(rows, groups, *KEYS).applyInArrow(matrices, _MATRICES)
    edges = borders(best, groups)
    found = _dealt(rows, groups, *KEYS).cogroup(_dealt(edges, groups, *KEYS)).applyInArrow(pieces, "conv_id long, own long, block long, head boolean, tail boolean, turn long, line int, role string, body string")
    found = stored(found, "chat-pieces")
    cut = F.col("head") | F.col("tail")
    columns = ("conv_id", "turn", "line", "role", "body")
    whole = found.where(~cut).select(*columns).unionByName(put_together(found.where(cut)).select(*columns))
    return map_texts(whole, rendered, "conv_id long, turn long, line int, role string, text string, rendered string")


KEYS = ("conv_id", "own", "block")
_MATRICES = "conv_id long, own long, block long, best array<double>"
_EDGES = "conv_id long, own long, block long, before long, ends long, last boolean"


def _dealt(df: DataFrame, groups: int, *by):
    return df.groupBy(F.pmod(F.xxhash64(*by), F.lit(groups)).alias("_group"))


def _matrix_table(keys: list[tuple], best) -> pa.Table:
    columns = {k: pa.array([key[i] for key in keys], pa.int64()) for i, k in enumerate(KEYS)}
    return pa.table({**columns, "best": pa.array([np.asarray(m).ravel() for m in best], pa.list_(pa.float64()))})


def _by_node(table: pa.Table) -> dict[tuple, list]:
    """The blocks and matrices of each node of the tree, in order."""
    found: dict[tuple, list] = {}
    for r in table.to_pylist():
        found.setdefault((r["conv_id"], r["own"], r["node"]), []).append((r["block"], np.array(r["best"]).reshape(STATES + 1, STATES)))
    for blocks in found.values():
        blocks.sort(key=lambda b: b[0])
    return found


def borders(best: DataFrame, groups: int, wide: int | None = None) -> DataFrame:
    """The states before and at the end of each block, and whether it is its transcript's last.

    Up to WIDE successive blocks are one node, whose matrix they give; the nodes' borders are found
    the same way, and those inside a node between its own. So a transcript of any length is never
    one task's work.
    """
    wide = wide or WIDE
    best = stored(best.withColumn("node", F.floor(F.col("block") / F.lit(wide)).cast("long")), "chat-matrices")
    top = best.groupBy("conv_id", "own").agg(F.count_distinct("node").alias("n")).agg(F.max("n")).first()[0] or 1

    def solve(table: pa.Table, above: dict | None) -> pa.Table:
        out: list[tuple] = []
        for key, blocks in _by_node(table).items():
            before, end, last = above[key] if above is not None else (-1, -1, True)
            ends = border_states([m for _, m in blocks], before, end)
            out += [(*key[:2], b, w, e, last and b == blocks[-1][0]) for (b, _), w, e in zip(blocks, [before, *ends[:-1]], ends, strict=True)]
        names = [*KEYS, "before", "ends", "last"]
        return pa.table({n: pa.array([r[i] for r in out], pa.bool_() if n == "last" else pa.int64()) for i, n in enumerate(names)})

    def solve_top(table: pa.Table) -> pa.Table:
        return solve(table, None)

    node = ("conv_id", "own", "node")
    if top == 1:
        return _dealt(best, groups, *node).applyInArrow(solve_top, _EDGES)

    def combine(table: pa.Table) -> pa.Table:
        found = _by_node(table)
        return _matrix_table(list(found), [joined([m for _, m in blocks]) for blocks in found.values()])

    def solve_within(table: pa.Table, above: pa.Table) -> pa.Table:
        return solve(table, {(e["conv_id"], e["own"], e["node"]): (e["before"], e["ends"], e["last"]) for e in above.to_pylist()})

    up = borders(_dealt(best, groups, *node).applyInArrow(combine, _MATRICES), groups, wide).withColumnRenamed("block", "node")
    return _dealt(best, groups, *node).cogroup(_dealt(up, groups, *node)).applyInArrow(solve_within, _EDGES)


def put_together(cut: DataFrame) -> DataFrame:
    """The turns that cross borders: a piece that goes on joins the last one before it that begins a turn.

    Only block numbers meet by transcript, first within nodes of WIDE blocks, then one for each node.
    """
    keys = ("conv_id", "own")
    marked = cut.withColumn("node", F.floor(F.col("block") / F.lit(WIDE)).cast("long")).withColumn("begins", F.when(~F.col("head"), F.col("block")))
    within = Window.partitionBy(*keys, "node").orderBy("block", F.desc("head"))
    starts = marked.select(*keys, "node", "block", "head", F.last("begins", True).over(within.rowsBetween(Window.unboundedPreceding, 0)).alias("start"))
    nodes = marked.groupBy(*keys, "node").agg(F.max("begins").alias("last"))
    carry = nodes.select(*keys, "node", F.last("last", True).over(Window.partitionBy(*keys).orderBy("node").rowsBetween(Window.unboundedPreceding, -1)).alias("carry"))
    same = lambda a, b, names: [F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) for n in names]
    placed = starts.alias("s").join(carry.alias("c"), same("s", "c", (*keys, "node"))).select("s.*", F.coalesce("s.start", "c.carry").alias("chain"))
    pieces = marked.alias("m").join(placed.alias("p"), same("m", "p", (*keys, "block", "head"))).select("m.*", "p.chain")
    turn = F.sort_array(F.collect_list(F.struct("block", "turn", "line", "role", "body")))
    found = pieces.groupBy(*keys, "chain").agg(turn.alias("t"))
    return found.select("conv_id", *(F.col("t")[0][c].alias(c) for c in ("turn", "line", "role")), F.array_join(F.transform("t", lambda r: r["body"]), "\n").alias("body"))


def held_out(conv_col: str = "conv_id") -> Column:
    """The conversations that :func:`train` never sees: a fifth, by a checksum of the id."""
    return F.coalesce(F.crc32(F.col(conv_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def agreement(turns: DataFrame, transcripts: DataFrame) -> Column:
    """The share of rows with a known role at whose start a turn of that role was recovered."""
    known = transcripts.where(F.lower("role").isin(*ROLES)).select("conv_id", "turn", F.lower("role").alias("true"))
    hit = known.join(turns.where(F.col("line") == 0), ["conv_id", "turn"], "left")
    return hit.agg(F.avg(F.coalesce((F.col("true") == F.col("role")).cast("double"), F.lit(0.0))).alias("share"))
