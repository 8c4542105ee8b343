"""Near-duplicate documents: one-permutation hashing, banded buckets, star-shaped candidate edges.

Every text's distinct word shingles are hashed once; the top bits of a hash give its bin, the
least hash in a bin is the bin's value. Empty bins borrow the value of a full one along a fixed
random order of bins (optimal densification: each full bin is as likely). Rows of bins make bands,
a band's value is a bucket. Texts that agree in all their words are one class from the start, and
only the class's smallest id enters buckets.

In a bucket one member, the one that meets most others over all its buckets, is the centre, and
the others are candidates against it: a star, never all pairs. Candidates pass a size test and a
sketch test, then are confirmed on the full shingle sets. A bucket whose members the stars have
joined in one component is done. In the others the strays, which are outside the bucket's largest
component, meet the members of their own bucket in blocks of bounded size. There sketches are
compared first; only documents with a likely partner bring their full sets, and only a link for
each stray and component leaves a block. Components come from alternating large-star and small-star
steps. Buckets and centres that very many documents share are dealt to many tasks throughout.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import join_facts, map_texts
from tidemark.tables import discard, stored

WIDTH = 5
#: The sketch has all bins, the bands the first BANDS * ROWS of them.
BINS, ROWS, BANDS = 256, 4, 32
#: Deviations of the sketch's agreement below its mean at the threshold that still pass.
DEVIATIONS = 4.5
#: Sets up to this size skip the sketch test: shared bins would disturb it, and they are cheap to compare.
SMALL = 64
#: Documents, and shingles in all, of one side of a block of strays and members; shingles that make one task's group.
BLOCK, BLOCK_SHINGLES, GROUP_SHINGLES = 2048, 1_000_000, 2_000_000
#: Rows of blocks whose sketches make one task's group.
GROUP_ROWS = 20_000
#: Ids that may be broadcast.
BROADCAST_IDS = 1_000_000
#: Edges from which the nodes of very many edges are dealt to several tasks.
MANY_EDGES = 1_000_000

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.Generator(np.random.PCG64(20240229))
#: For each bin the order in which an empty one asks the others.
_ORDER = np.stack([_rng.permutation(BINS) for _ in range(BINS)]).astype(np.int16)
_FACTORS = _rng.integers(1 << 62, 1 << 63, WIDTH, np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    """Word to hash, filled as words are met."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        value = self[word] = xxh3_64_intdigest(word)
        return value


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space only


def shingles(words: list[bytes], hashes: dict) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles; fewer words than a shingle has are one."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    width = min(n, WIDTH)
    total = np.full(n - width + 1, width, np.uint64) * _GOLD
    for k in range(width):
        total += h[k : n - width + 1 + k] * _FACTORS[k]
    return np.unique(_mix(total))


def bins_of(distinct: np.ndarray) -> np.ndarray:
    """The least hash in each bin, empty bins densified. ``distinct`` is sorted and not empty."""
    bins = (distinct >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
    values, full = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    values[bins[first]], full[bins[first]] = distinct[first], True
    empty = np.flatnonzero(~full)
    if len(empty):
        order = _ORDER[empty]
        values[empty] = values[order[np.arange(len(empty)), full[order].argmax(1)]]
    return values


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, words_digest, bands, sketch)``; without words the last three are null."""
    from xxhash import xxh3_128_digest

    band_no = np.arange(1, BANDS + 1, dtype=np.uint64)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, n, digests, values = _Hashes(), [], [], []
        for text in batch.column(1).to_pylist():
            words = words_of(text)
            distinct = shingles(words, hashes)
            n.append(len(distinct))
            digests.append(xxh3_128_digest(b" ".join(words)) if words else None)
            if words:
                values.append(bins_of(distinct))
        bands, sketches = [None] * len(n), [None] * len(n)
        if values:
            table = np.stack(values)
            rows = table[:, : BANDS * ROWS].reshape(len(values), BANDS, ROWS)
            keys = np.zeros((len(values), BANDS), np.uint64) + band_no
            for k in range(ROWS):
                keys = _mix(keys * _GOLD + rows[:, :, k])
            keys = (keys & ~np.uint64(BANDS - 1)) | (band_no - np.uint64(1))  # a key tells its band
            keys, marks = keys.view(np.int64), _mix(table).astype(np.uint8)
            for at, (i, _) in enumerate((i, x) for i, x in enumerate(n) if x):
                bands[i], sketches[i] = keys[at], marks[at].tobytes()
        columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "words_digest", "bands", "sketch"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_texts(chosen, run, "doc_id long, n_shingles long, words_digest binary, bands array<long>, sketch binary")


def shingle_sets(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, words_digest, shingles)`` of the documents in ``ids``.

    Up to BROADCAST_IDS ids (8 bytes each) are counted and sent to every task, so that the texts
    stay where they are; more are joined by a shuffle.
    """
    from xxhash import xxh3_128_digest

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, words = _Hashes(), [words_of(t) for t in batch.column(1).to_pylist()]
        digests = [xxh3_128_digest(b" ".join(w)) if w else None for w in words]
        sets = [shingles(w, hashes).view(np.int64) for w in words]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], ["id", "words_digest", "shingles"])

    ids = stored(ids, "near-ids")
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(wanted, "id", "left_semi")
    return map_texts(chosen.select("id", "text"), run, "id long, words_digest binary, shingles array<long>")


def least_agree(percent: int) -> int:
    """Bins in which the sketches of a link agree, but for a chance of some millionths."""
    j = percent / 100
    return int(BINS * j - DEVIATIONS * (BINS * j * (1 - j)) ** 0.5)


def _sketches_agree(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(centre, doc_id, sketch_c, sketch_d, small)`` that are small or whose sketches agree in enough bins."""
    least = least_agree(percent)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, BINS) for k in (2, 3))
                small = batch.column(4).to_numpy(zero_copy_only=False).astype(bool)
                batch = batch.filter(pa.array(small | ((a == b).sum(1) >= least)))
            yield batch.select(["centre", "doc_id"])

    return pairs.mapInArrow(run, "centre long, doc_id long")


def _with_centres(pairs: DataFrame, about: DataFrame) -> DataFrame:
    """Pairs ``(centre, doc_id, ...)`` with what ``about`` says of their centres, of which some have very many pairs."""
    counts = stored(pairs.groupBy("centre").agg(F.count("*").alias("_n")), "near-counts")
    return join_facts(pairs, about, "centre", "_n", "doc_id", counts)


def likely_stars(stars: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Of the distinct pairs ``(centre, doc_id)`` those that pass the size and sketch tests."""
    side = lambda key, mark: known.select(F.col("doc_id").alias(key), F.col("n_shingles").alias(f"n_{mark}"), F.col("sketch").alias(f"sketch_{mark}"))
    sized = _with_centres(stars, side("centre", "c")).join(side("doc_id", "d"), "doc_id").where(100 * F.least("n_c", "n_d") >= percent * F.greatest("n_c", "n_d"))
    return _sketches_agree(sized.select("centre", "doc_id", "sketch_c", "sketch_d", (F.greatest("n_c", "n_d") <= SMALL).alias("small")), percent)


def confirmed(likely: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Links ``(a, b)``, a < b: the pairs ``(centre, doc_id)`` that share enough of their full shingle sets. A stored table."""
    likely = stored(likely.distinct(), "near-likely")
    ids = likely.select(F.explode(F.array("centre", "doc_id")).alias("id")).distinct()
    sets = stored(shingle_sets(docs, ids), "near-sets")
    both = _with_centres(likely, sets.select(F.col("id").alias("centre"), F.col("shingles").alias("set_c")))
    both = both.join(sets.select(F.col("id").alias("doc_id"), F.col("shingles").alias("set_d")), "doc_id")
    shared = F.size(F.array_intersect("set_c", "set_d"))
    fits = 100 * shared >= percent * (F.size("set_c") + F.size("set_d") - shared)
    links = stored(both.where(fits).select(F.least("centre", "doc_id").alias("a"), F.greatest("centre", "doc_id").alias("b")).distinct(), "near-links")
    discard(sets)
    return links


class Cells:
    """The cells of a group of ``(bucket, s, m)`` rows, members before strays in each."""

    def __init__(self, table: pa.Table):
        self.table = table = table.sort_by([(c, "ascending") for c in ("bucket", "s", "m", "stray")]).combine_chunks()
        self.doc, self.root, self.n, self.stray, bucket, s, m = (table[c].to_numpy() for c in ("doc_id", "root", "n_shingles", "stray", "bucket", "s", "m"))
        self.band = bucket & (BANDS - 1)
        self.sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(-1, BINS)
        edges = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (s[1:] != s[:-1]) | (m[1:] != m[:-1]), True]) if len(bucket) else [0]
        self.cells = [(a, a + int(np.searchsorted(self.stray[a:b], True)), b) for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def likely(self, percent: int):
        """For each stray that has some, its likely partners of other components, and in how many bins they agree.

        Two documents that share several buckets are partners in the one of the least band: bands
        whose rows agree in the sketch are taken as shared, which is wrong once in 2^32.
        """
        least = least_agree(percent)
        for a, cut, b in self.cells:
            root, n, sketch = self.root[a:cut], self.n[a:cut], self.sketch[a:cut]
            for i in range(cut, b):
                at = np.flatnonzero((root != self.root[i]) & (100 * np.minimum(n, self.n[i]) >= percent * np.maximum(n, self.n[i])))
                agree = (sketch[at] == self.sketch[i]).sum(1)
                fits = np.flatnonzero((agree >= least) | (np.maximum(n[at], self.n[i]) <= SMALL))
                at, agree = at[fits], agree[fits]
                shared = (sketch[at, : BANDS * ROWS] == self.sketch[i, : BANDS * ROWS]).reshape(-1, BANDS, ROWS).all(2)
                here = np.flatnonzero(shared.argmax(1) == self.band[i])
                if len(here):
                    yield i, a + at[here], agree[here]


def stray_links(pool: DataFrame, links: DataFrame, known: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Confirmed links ``(a, b)`` between different components that share a bucket; ``pool`` is ``(bucket, doc_id)``.

    Of the links between a stray and one component, which all join the same, one is given for each block.
    """
    roots = components(links).withColumnRenamed("node", "doc_id")
    pool = stored(pool.join(roots, "doc_id", "left").select("bucket", "doc_id", F.coalesce("root", "doc_id").alias("root")), "near-rooted")
    by_root = pool.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    open_ = by_root.groupBy("bucket").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("roots"), F.sum("n").alias("n"))
    met = join_facts(pool, open_.where("roots > 1").drop("roots"), "bucket", "n", "doc_id")
    met = stored(met.join(known.select("doc_id", "words_digest", "n_shingles"), "doc_id").withColumn("stray", F.col("root") != F.col("main")).drop("main"), "near-met")
    blocks = lambda n, size: F.greatest(F.ceil(n / F.lit(BLOCK)), F.ceil(size / F.lit(BLOCK_SHINGLES)), F.lit(1)).cast("int")
    sizes = met.groupBy("bucket").agg(
        blocks(F.count("*"), F.sum("n_shingles")).alias("n_m"), blocks(F.count_if("stray"), F.sum(F.when(F.col("stray"), F.col("n_shingles")))).alias("n_s"), F.count("*").alias("n"), F.count_if("stray").alias("k")
    )
    sizes = stored(sizes, "near-sizes")
    total = sizes.agg(F.sum(F.col("n") * F.col("n_s") + F.col("k") * F.col("n_m"))).first()[0] or 0
    rows = join_facts(met, sizes.drop("k"), "bucket", "n", "doc_id")
    own = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    strays = rows.where("stray").withColumn("s", own("n_s")).withColumn("m", each("n_m"))
    members = rows.withColumn("m", own("n_m")).withColumn("s", each("n_s")).withColumn("stray", F.lit(False))
    columns = ["bucket", "s", "m", "stray", "doc_id", "words_digest", "root", "n_shingles"]
    cells = strays.select(columns).unionByName(members.select(columns)).join(known.select("doc_id", "words_digest", "sketch"), ["doc_id", "words_digest"])
    dealt = lambda df, n: df.groupBy(F.pmod(F.xxhash64("bucket", "s", "m"), F.lit(max(12, n))).alias("_group"))

    def with_partners(table: pa.Table) -> pa.Table:
        found = Cells(table)
        some = np.zeros(len(found.doc), bool)
        for i, at, _ in found.likely(percent):
            some[i], some[at] = True, True
        return found.table.select([*columns, "sketch"]).filter(pa.array(some))

    kinds = "bucket long, s int, m int, stray boolean, doc_id long, words_digest binary, root long, n_shingles long, sketch binary"
    hits = stored(dealt(cells, -(-total // GROUP_ROWS)).applyInArrow(with_partners, kinds), "near-hits")
    weight = hits.agg(F.sum("n_shingles")).first()[0] or 0
    sets = shingle_sets(docs, hits.select(F.col("doc_id").alias("id")).distinct()).withColumnRenamed("id", "doc_id").dropDuplicates(["doc_id", "words_digest"])
    full = hits.join(sets, ["doc_id", "words_digest"])

    def meet(table: pa.Table) -> pa.Table:
        cells, found = Cells(table), []
        lists = cells.table["shingles"].chunk(0) if table.num_rows else pa.array([], pa.list_(pa.int64()))
        values, starts = lists.values.to_numpy(), lists.offsets.to_numpy()
        sets: dict[int, frozenset] = {}

        def set_of(i: int) -> frozenset:
            if i not in sets:
                sets[i] = frozenset(values[starts[i] : starts[i + 1]].tolist())
            return sets[i]

        cell = 0
        for i, at, agree in cells.likely(percent):
            while i >= cells.cells[cell][2]:
                cell += 1
                sets.clear()
            joined: set[int] = set()
            for j in at[np.argsort(-agree, kind="stable")].tolist():
                if cells.root[j] not in joined:
                    shared = len(set_of(i) & set_of(j))
                    if 100 * shared >= percent * (len(set_of(i)) + len(set_of(j)) - shared):
                        joined.add(cells.root[j])
                        found.append((min(cells.doc[i], cells.doc[j]), max(cells.doc[i], cells.doc[j])))
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    found = stored(dealt(full, -(-weight // GROUP_SHINGLES)).applyInArrow(meet, "a long, b long").distinct(), "near-links")
    for table in (hits, met, pool):
        discard(table)
    return found


def star_links(reps: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Confirmed links ``(a, b)``, a < b, that join the documents of ``reps`` (rows of :func:`signatures`)."""
    known = reps.select("doc_id", "words_digest", "n_shingles", "sketch")
    buckets = reps.select(F.explode("bands").alias("bucket"), "doc_id")
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    pool = stored(join_facts(buckets, shared.withColumn("size", F.col("n")), "bucket", "n", "doc_id"), "near-pool")
    popular = pool.groupBy("doc_id").agg(F.sum("size").alias("met"))
    first = F.max(F.struct("met", (-F.col("doc_id")).alias("id"), "size")).alias("c")
    centre = pool.join(popular, "doc_id").groupBy("bucket").agg(first).select("bucket", (-F.col("c.id")).alias("centre"), F.col("c.size").alias("n"))
    stars = join_facts(pool.select("bucket", "doc_id"), centre, "bucket", "n", "doc_id").where("doc_id != centre").select("centre", "doc_id").distinct()
    stars = stored(stars, "near-stars")
    links = confirmed(likely_stars(stars, known, percent), docs, percent)
    discard(stars)
    return links.union(stray_links(pool.select("bucket", "doc_id"), links, known, docs, percent)).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node that isn't its component's smallest; edges are ``(a, b)``.

    Every step's table replaces the one before, which is deleted. From MANY_EDGES on, nodes with
    very many edges are dealt to several tasks; the rows are the same.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "near-edges")
    mark = lambda e: e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    seen = mark(now)
    while seen["n"]:

        def with_least(pairs: DataFrame, many: bool = seen["n"] > MANY_EDGES) -> DataFrame:
            """Each pair ``(u, v)`` with ``m``, the least of ``u``'s neighbours."""
            least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
            return join_facts(pairs, least, "u", "n", "v") if many else pairs.join(least.drop("n"), "u")

        both = with_least(now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        large = both.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        small = with_least(large).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        last, now = now, stored(small.where("u != v").distinct(), "near-edges")
        discard(last)
        was, seen = seen, mark(now)
        if was == seen:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` of every document.

    Null and empty texts have no shingles and are linked with nothing. A null id is in no component
    and is kept. Rows that repeat an id are one document to the components, linked with whatever one
    of its texts is linked with; each row keeps its own ``n_shingles``. Texts of any length are
    taken whole, other columns are left out, an empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = stored(signatures(docs), "near-signatures")
    worded = F.col("doc_id").isNotNull() & F.col("words_digest").isNotNull()
    able = signed.where(worded)
    classes = stored(able.groupBy("words_digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "near-classes")
    firsts = able.join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    reps = stored(firsts.dropDuplicates(["doc_id", "words_digest"]).select("doc_id", "words_digest", "n_shingles", "bands", "sketch"), "near-reps")
    worded_ids = stored(signed.select("doc_id", "n_shingles", "words_digest"), "near-digests")
    discard(signed)
    links = stored(star_links(reps, docs, percent), "near-links")
    # an id whose rows have different texts joins their classes
    torn = reps.select("doc_id", "words_digest").join(classes, "words_digest").where("doc_id != rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    roots = stored(components(links.union(torn)), "near-roots")
    placed = classes.join(roots, F.col("rep") == F.col("node"), "left").select("words_digest", F.coalesce("root", "rep").alias("component_id"), "n")
    columns = ["doc_id", "n_shingles", "component_id"]
    joined = join_facts(worded_ids.where(worded), placed, "words_digest", "n", "doc_id").select(columns)
    alone = worded_ids.where(~worded).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
