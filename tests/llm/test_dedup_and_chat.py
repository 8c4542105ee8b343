"""Line dedup, near-duplicates, chat parsing and the pipeline against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, line_dedup, near_dedup

SPACE = " \t\n\x0b\x0c\r"


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, n_lines string")


# ---- line dedup ----------------------------------------------------------------------------


def key_of(line):
    k = line.strip(SPACE)
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in k) if len(k) >= 10 else None


def brute_lines(rows, among=None):
    holders = {}
    for doc, text in among or rows:
        for line in (text or "").split("\n"):
            if doc is not None and key_of(line):
                holders.setdefault(key_of(line), set()).add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc is None or not key_of(x) or len(holders[key_of(x)]) < 2 or doc == min(holders[key_of(x)])]
        out.append((doc, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def corpus(seed, ids):
    rng = random.Random(seed)
    pool = [f"Shared line number {i} é" for i in range(12)] + ["short", "", "  SHARED LINE NUMBER 3 é\t", "Ünïcode LINE of its own"]
    return [(i, "\n".join([*rng.choices(pool, k=rng.randint(0, 6)), f"only in document {i}"])) for i in ids]


def cleaned(spark, index, rows):
    frame = docs(spark, [(*r, "clash") for r in rows])
    found = line_dedup.clean(index, frame).collect()
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in found), key=repr)


def test_lines_are_dropped_and_come_back(spark):
    first, second = corpus(1, range(50, 80)), corpus(2, range(0, 30))
    odd = [(200, None), (201, ""), (None, "Shared line number 1 é"), (60, dict(first)[60])]
    index = line_dedup.insert(line_dedup.LineIndex(spark), docs(spark, [(*r, "x") for r in first + odd]))
    assert cleaned(spark, index, first + odd) == brute_lines(first + odd)
    index = line_dedup.insert(index, docs(spark, [(*r, "x") for r in second]))
    both = first + odd + second
    assert cleaned(spark, index, both) == brute_lines(both)
    gone = [r for r in both if r[0] is not None and r[0] % 3 == 0]
    index = line_dedup.delete(index, spark.createDataFrame([(r[0],) for r in gone] + [(9999,), (None,)], "doc_id long"))
    left = [r for r in both if r not in gone]
    assert cleaned(spark, index, left) == brute_lines(left)
    index = line_dedup.insert(index, docs(spark, [(*r, "x") for r in gone]))  # and back again
    assert cleaned(spark, index, both) == brute_lines(both)


def test_lines_survive_colliding_fingerprints(spark):
    rng = random.Random(5)
    rows = [(i, "\n".join(f"line of the pool {k}" for k in rng.sample(range(900), 12))) for i in range(160)]
    frame = lambda some: docs(spark, [(*r, "x") for r in some])
    index = line_dedup.insert(line_dedup.LineIndex(spark, bits=3), frame(rows[:80]))  # seven fingerprints: most keys collide
    index = line_dedup.insert(index, frame(rows[80:]))
    gone = [r for r in rows if r[0] % 2]
    index = line_dedup.delete(index, spark.createDataFrame([(r[0],) for r in gone], "doc_id long"))
    keys = index.latest_counts().where("n_lines > 0").select("key")
    assert index.filters.agg(F.sum("n")).first()[0] == keys.count()  # one fingerprint for each live key
    assert line_dedup._by_shard(index, keys, line_dedup.known_keys, "key binary").count() == keys.count()
    index = line_dedup.insert(index, frame(gone))
    assert cleaned(spark, index, rows) == brute_lines(rows)


def test_deletion_and_growth_with_many_keys(spark):
    """150,000 lines in, as many others in, the first out, and a copy of the second must be caught whole."""
    text = lambda name: "\n".join(f"{name} line number {i}" for i in range(150_000))
    one, two = (1, text("first")), (2, text("second"))
    index = line_dedup.insert(line_dedup.LineIndex(spark), docs(spark, [(*one, "x")]), shard_keys=5000)
    assert index.shards == 32 and index.keys == 150_000
    index = line_dedup.insert(index, docs(spark, [(*two, "x")]), shard_keys=5000)
    assert index.shards == 64 and index.keys == 300_000  # shards have grown
    index = line_dedup.delete(index, spark.createDataFrame([(1,)], "doc_id long"))
    live = index.latest_counts().where("n_lines > 0").select("key")
    assert index.keys == live.count() == index.filters.agg(F.sum("n")).first()[0] == 150_000
    assert line_dedup._by_shard(index, live, line_dedup.known_keys, "key binary").count() == 150_000
    three = (3, two[1] + "\n" + one[1])
    index = line_dedup.insert(index, docs(spark, [(*three, "x")]), shard_keys=5000)
    (found,) = line_dedup.clean(index, docs(spark, [(*three, "x")])).collect()
    assert (found.n_lines, found.n_dropped) == (300_000, 150_000) and found.text == one[1]


def test_build_asks_the_filters_and_equals_brute_force(spark, monkeypatch):
    rows = corpus(3, range(60)) + [(70, None), (None, "Shared line number 2 é"), (71, "\n".join(["Shared line number 1 é"] * 3))]
    frame = docs(spark, [(*r, "clash") for r in rows])
    for insertions in (1, 2, 5):
        assert cleaned(spark, line_dedup.build(spark, frame, insertions), rows) == brute_lines(rows)
    monkeypatch.setattr(line_dedup, "known_keys", lambda keys, filters, bits: keys.select(["key"]).slice(0, 0))  # filters that know nothing
    assert cleaned(spark, line_dedup.build(spark, frame, 3), rows) != brute_lines(rows)


def test_hot_keys_are_joined_apart(spark):
    from tidemark.llm.common import join_facts

    rows = spark.range(3000).select(F.when(F.col("id") < 2500, 7).otherwise(F.col("id")).alias("key"), "id")
    facts = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    found = join_facts(rows, facts, "key", "n", "id")
    assert found.columns == ["key", "id", "least"] and found.count() == 3000 and found.where("key = 7 AND least = 0").count() == 2500
    assert join_facts(rows.limit(0), facts.limit(0), "key", "n", "id").count() == 0


def test_an_index_goes_on_after_saving_and_opening(spark, tmp_path):
    rng = random.Random(61)
    rows = [(i, "\n".join(f"a line of number {rng.randint(0, 40)}" for _ in range(rng.randint(1, 5)))) for i in range(120)]
    frame = lambda some: docs(spark, [(*r, "x") for r in some])
    index = line_dedup.insert(line_dedup.insert(line_dedup.LineIndex(spark, bits=6), frame(rows[:50])), frame(rows[50:90]))
    index = line_dedup.delete(index, spark.createDataFrame([(r[0],) for r in rows[20:40]], "doc_id long"))
    line_dedup.save(index, f"{tmp_path}/one")
    again = line_dedup.opened(spark, f"{tmp_path}/one")
    held = rows[:20] + rows[40:90]
    assert cleaned(spark, again, held) == brute_lines(held) and again.refs.select("doc_id").distinct().count() == len(held) and again.keys == index.keys
    again = line_dedup.insert(again, frame(rows[90:] + rows[20:30]))
    again = line_dedup.delete(again, spark.createDataFrame([(r[0],) for r in rows[:10]], "doc_id long"))
    line_dedup.save(again, f"{tmp_path}/two")
    held = rows[10:30] + rows[40:]
    assert cleaned(spark, line_dedup.opened(spark, f"{tmp_path}/two"), held) == brute_lines(held)
    line_dedup.save(line_dedup.LineIndex(spark), f"{tmp_path}/none")
    assert line_dedup.opened(spark, f"{tmp_path}/none").version == 0


def test_lines_of_an_empty_table(spark):
    index = line_dedup.insert(line_dedup.LineIndex(spark), docs(spark, []))
    assert line_dedup.clean(index, docs(spark, [])).count() == 0


def test_cuckoo_filter_inserts_and_deletes():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)
    f = line_dedup.CuckooFilter.sized(len(keys))
    assert f.insert(keys[:10_000]) and f.insert(keys[10_000:]) and f.contains(keys).all() and f.n == 20_000
    assert f.contains(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)).mean() < 0.002
    assert f.delete(keys[:10_000]).all() and f.contains(keys[10_000:]).all() and f.contains(keys[:10_000]).mean() < 0.01
    small = line_dedup.CuckooFilter(16)
    before = small.slots.copy()
    assert not small.insert(keys[:200]) and (small.slots == before).all()


# ---- near-duplicates -----------------------------------------------------------------------


def shingle_set(text):
    words = near_dedup.words_of(text)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_components(rows, percent=75):
    sets = {i: shingle_set(t) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    out = [(i, len(shingle_set(t)), find(i) if i is not None else None, i is None or find(i) == i) for i, t in rows]
    return sorted(out, key=repr)


def near(spark, rows):
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_shingles int")
    return sorted((tuple(r) for r in near_dedup.near_duplicates(frame).collect()), key=repr)


def mutated(rng, words, share):
    return [rng.choice("abcdefgh") * 3 + str(rng.randint(0, 999)) if rng.random() < share else w for w in words]


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(7)
    word = lambda: f"w{rng.randint(0, 400)}"
    rows, n = [], 0
    for base in range(6):
        words = [word() for _ in range(rng.choice((8, 40, 150, 600)))]
        for _ in range(30):
            rows.append((n * 7 % 1009, " ".join(mutated(rng, words, rng.choice((0, 0.01, 0.03, 0.06))))))
            n += 1
    passage = " ".join(word() for _ in range(60))
    rows += [(2000 + i, passage + " " + " ".join(word() for _ in range(rng.randint(5, 120)))) for i in range(40)]
    rows += [(3000, None), (3001, ""), (3002, "one two"), (3003, "One  TWO"), (3004, "two one"), (None, "one two"), (3005, " \t\n"), (3002, "one two")]
    assert near(spark, rows) == brute_components(rows)


def test_a_popular_passage_and_small_blocks_lose_no_link(spark, monkeypatch):
    """Many documents share a passage, and so buckets, without being linked; some have a twin among them."""
    rng = random.Random(17)
    word = lambda: f"v{rng.randint(0, 5000)}"
    passage = [word() for _ in range(60)]
    rows = []
    for i in range(120):
        words = passage + [word() for _ in range(50)]
        rows.append((i, " ".join(words)))
        if i % 3 == 0:
            rows.append((1000 + i, " ".join(mutated(rng, words, 0.01))))
    rows += [(5, "another text of the same id, which nothing else has"), (5000, rows[7][1]), (5000, "one id and two texts, this is the second one")]
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    monkeypatch.setattr(near_dedup, "GROUP_ROWS", 100)
    monkeypatch.setattr(near_dedup, "MANY_EDGES", 10)
    want = brute_components([r for r in rows if r not in rows[-3:]])
    found = near(spark, [r for r in rows if r not in rows[-3:]])
    assert found == want and sum(not k for *_, k in found) > 20
    torn = {(r[0], r[1]): r[2] for r in near(spark, rows)}
    assert torn[5000, len(shingle_set(rows[7][1]))] == torn[5000, 6] == rows[7][0] and torn[5, 6] == 5


def test_near_duplicates_of_very_long_texts(spark):
    rng = random.Random(2)
    words = [f"z{rng.randint(0, 10**6)}" for _ in range(120_000)]
    other = words[:60_000] + [f"y{i}" for i in range(60_000)]
    rows = [(3, " ".join(words)), (4, " ".join(mutated(rng, words, 0.01))), (5, " ".join(other)), (6, "a " * 200_000)]
    assert [(i, c) for i, _, c, _ in near(spark, rows)] == [(3, 3), (4, 3), (5, 5), (6, 6)]


def test_near_duplicates_of_an_empty_table(spark):
    assert near(spark, []) == []


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 99), (99, 98), (70, 70)]
    found = dict(map(tuple, near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert found == {**{i: 0 for i in range(1, 41)}, 99: 98, 100: 98}


# ---- chat ----------------------------------------------------------------------------------


def conversations(spark, n=80, seed=4):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randint(2, 7)):
            role = "user" if t % 2 == 0 else "assistant"
            text = "How do I do this thing?" if role == "user" else "\n".join("This is a longer line of an answer that explains it in detail, with many words." for _ in range(rng.randint(2, 5)))
            rows.append((c, t, role, text))
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_roles_are_recovered(spark):
    transcripts = chat.as_transcripts(conversations(spark)).cache()
    turns = chat.parse(transcripts.withColumn("rendered", F.lit(1)), chat.train(transcripts)).cache()
    assert chat.agreement(turns, transcripts).first().share > 0.9
    row = turns.where("conv_id = 0 AND turn = 0 AND line = 0").first()
    assert row.rendered == f"<|{row.role}|>\n{row.text}\n<|end|>" and row.text == "How do I do this thing?"


def plain_turns(rows, hmm):
    """Turns of one transcript's ``(turn, text)`` rows by one Viterbi pass, a line at a time."""
    lines = [(t, k, x) for t, text in sorted(rows) for k, x in enumerate(text.split("\n"))]
    scores = [sum(e[:, v] for e, v in zip(hmm.emissions, chat.observe(x))) for _, _, x in lines]
    value, back = hmm.first + scores[0], []
    for s in scores[1:]:
        back.append([max(range(6), key=lambda a: value[a] + hmm.moves[a, b]) for b in range(6)])  # noqa: B023
        value = np.array([value[back[-1][b]] + hmm.moves[back[-1][b], b] for b in range(6)]) + s
    states = [int(np.argmax(value))]
    for b in reversed(back):
        states.append(b[states[-1]])
    states.reverse()
    out = []
    for i, (state, (t, k, x)) in enumerate(zip(states, lines)):
        if i == 0 or state < 3 or state % 3 != states[i - 1] % 3:
            out.append([t, k, chat.ROLES[state % 3], [chat.strip_marker(x)[1]]])
        else:
            out[-1][3].append(x)
    return [(t, k, role, "\n".join(chat.body_of(role, body)).strip()) for t, k, role, body in out]


def test_turns_equal_one_plain_pass_whatever_the_blocks(spark, monkeypatch):
    rng = random.Random(21)
    base = conversations(spark, 15)
    # long turns without a marker cross many blocks, some with quotes
    lines = ["> and words that go on in lower case"] * 40 + ["> quoted words", "", "Short?", "User: hello", "### Assistant:"]
    long = spark.createDataFrame([(100 + c, t, None, rng.choice(lines)) for c in range(3) for t in range(0, 900, c + 1)], "conv_id long, turn long, role string, text string")
    transcripts = chat.as_transcripts(base.unionByName(long)).cache()
    hmm = chat.train(transcripts)
    hmm.moves[:, 3:] += 4.0  # long turns are likely
    by_conversation = {}
    for r in transcripts.collect():
        by_conversation.setdefault(r.conv_id, []).append((r.turn, r.text))
    want = sorted((c, *t) for c, rows in by_conversation.items() for t in plain_turns(rows, hmm))
    assert any(text.count("\n") > 20 for *_, text in want)
    for block, wide in ((256, 512), (2, 4), (5, 3)):
        monkeypatch.setattr(chat, "BLOCK", block)
        monkeypatch.setattr(chat, "WIDE", wide)
        found = chat.parse(transcripts, hmm).collect()
        assert sorted((r.conv_id, r.turn, r.line, r.role, r.text) for r in found) == want


def test_viterbi_equals_brute_force():
    from itertools import product

    rng = np.random.default_rng(8)
    hmm = chat.Hmm(rng.random(6), rng.random((6, 6)), [rng.random((6, n)) for n in chat.FEATURES.values()])
    sizes = np.array([2, 4, 1])
    scores = rng.normal(size=(7, 6)) * 2
    moved, at = chat.transfer(hmm, scores, sizes), 0
    bests = []
    for k, n in enumerate(sizes):
        s = scores[at : at + n]
        at += n
        value = lambda p: hmm.first[p[0]] + sum(s[i, x] for i, x in enumerate(p)) + sum(hmm.moves[a, b] for a, b in zip(p, p[1:]))  # noqa: B023, E731
        bests.append(max(product(range(6), repeat=n), key=value))
        assert moved[k, -1].max() == pytest.approx(value(bests[-1]))
    found = chat.decode(hmm, scores, sizes, np.array([-1, -1, -1]), np.array([b[-1] for b in bests]))
    assert tuple(found) == tuple(x for b in bests for x in b)


def test_roles_of_a_very_long_conversation(spark):
    """20,000 turns are 79 blocks; nothing is lost or cut at their borders."""
    rows = spark.range(20_000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "User: what is this?").otherwise("Assistant: a thing.").alias("text"))
    hmm = chat.train(chat.as_transcripts(conversations(spark)))
    found = chat.parse(rows, hmm)
    assert found.count() == 20_000 and found.where("(turn % 2 = 0) != (role = 'user') OR line != 0").count() == 0


def test_odd_transcripts(spark):
    transcripts = chat.as_transcripts(conversations(spark, 20))
    hmm = chat.train(transcripts)
    odd = spark.createDataFrame([(1, 0, None), (1, 1, ""), (None, 0, "User: hi"), (None, 0, "User: ho"), (2, None, "Assistant: yes"), (2, None, "Assistant: yes")], "conv_id long, turn long, text string")
    found = chat.parse(odd, hmm).collect()
    assert {r.text for r in found if r.conv_id is None} == {"hi", "ho"} and any("yes" in r.text for r in found if r.conv_id == 2)
    assert chat.parse(odd.limit(0), hmm).count() == 0
    assert chat.parse(odd, chat.train(transcripts.limit(0))).count() > 0


def test_equal_rows_without_an_id_are_transcripts_of_their_own(spark):
    hmm = chat.train(chat.as_transcripts(conversations(spark, 20)))
    alone = spark.createDataFrame([(None, 0, "plain words without a marker")] * 4 + [(None, None, None)] * 3, "conv_id long, turn long, text string")
    found = chat.parse(alone, hmm).collect()
    assert sorted(r.text for r in found) == [""] * 3 + ["plain words without a marker"] * 4


# ---- pipeline ------------------------------------------------------------------------------


def test_pipeline_stages_keep_the_columns_and_take_effect(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    good = lambda n: " ".join(rng.choices(vocabulary, k=n)).capitalize() + "."
    rows = []
    for i in range(0, 200):
        text = "BUY!! *** $$$ NOW!! &&& !!!" * 3 if i % 10 == 3 else good(60) + "\n" + good(30) + ("\nThis boilerplate line is everywhere." if i % 2 else "")
        rows.append((i, text, "xx", "s", len(text)))
    rows += [(500 + k, rows[k][1] + " tail", "xx", "s", 1) for k in (0, 2, 4)] + [(900, "12345 67890", "xx", "s", 11), (901, None, None, None, None)]
    path = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 0 if i % 10 == 3 else 1, 0) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    frame = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = f"{path}/{name}"
        stage(spark, frame, path).write.parquet(out)
        after = spark.read.parquet(out)
        assert after.columns == frame.columns
        ids, was = ({r.doc_id for r in f.select("doc_id").collect()} for f in (after, frame))
        gone = was - ids
        if name == "quality":
            assert {i for i in gone if i < 500} == {i for i in range(200) if i % 10 == 3}
        if name == "language":
            assert gone <= {900, 901}
        if name == "lines":
            assert not gone
            want = {d: t for d, t, *_ in brute_lines([(r.doc_id, r.text) for r in frame.collect()])}
            assert {r.doc_id: r.text for r in after.collect()} == want
        if name == "near copies":
            kept = {i for i, _, _, k in brute_components([(r.doc_id, r.text) for r in frame.collect()]) if k}
            assert ids == kept
        frame = after
    packed = corpus_pipeline.STAGES[-1][1](spark, frame, path)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in frame.select("doc_id").collect()}


def test_near_copies_stage_drops_copies_alone(spark, tmp_path):
    """Rows that share an id but not their text are documents of their own; null ids stay; odd column names and empty tables pass."""
    import corpus_pipeline

    rng = random.Random(31)
    text = lambda: " ".join(rng.choices(["red", "blue", "oak", "elm", "fox", "owl", "sky", "sea", "ice", "sun"], k=40))
    a, b, c, d = (text() for _ in range(4))
    rows = [(7, a, 1, "x"), (7, b, 2, "x"), (7, b, 1, "y"), (9, b + " end", 1, "x"), (3, c, 1, "x"), (12, a, 1, "x"), (None, c, 1, "x"), (None, None, 1, "x"), (5, None, 2, "x"), (5, "", 2, "x"), (5, None, 1, "x"), (20, d, 1, "x"), (21, d, 1, "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _number int, n string").repartition(3)
    kept = sorted((tuple(r) for r in corpus_pipeline.drop_near_copies(spark, frame, "").collect()), key=repr)
    # 7 has three texts' worth of rows: its rows of a and b come after 12 and 9, which stay for them
    assert kept == sorted([(12, a, 1, "x"), (9, b + " end", 1, "x"), (3, c, 1, "x"), (None, c, 1, "x"), (None, None, 1, "x"), (5, None, 1, "x"), (20, d, 1, "x")], key=repr)
    alone = spark.createDataFrame([(7, a, 1, "x"), (7, c, 2, "x")], frame.schema)
    assert corpus_pipeline.drop_near_copies(spark, alone, "").count() == 2
    assert corpus_pipeline.drop_near_copies(spark, frame.limit(0), "").count() == 0


def test_pipeline_passes_an_empty_table_and_odd_rows(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, rows in (("none", []), ("odd", [(None, None, None, None, None), (1, "good words " * 30, "en", "s", 1), (1, "good words " * 30, "en", "s", 1), (2, "", "en", "s", 0)])):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        frame = spark.read.parquet(f"{tmp_path}/{name}.parquet")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = f"{tmp_path}/{name}-{k}"
            stage(spark, frame, str(tmp_path)).write.parquet(out)
            frame = spark.read.parquet(out)
        assert name == "odd" or frame.count() == 0
