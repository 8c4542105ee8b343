"""Whitening, importance resampling and personal data against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import pii, pii_examples, resampling, whitening

VECTORS = "vec_id long, embedding array<float>, component int, n string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 7, "x") for i, v in rows], VECTORS)


def plain_whitening(rows, components=16):
    """``{(vec_id, component): (n, deviation, whitened, explained)}`` in Python integers and one covariance."""
    kept = [(i, [int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    listed = sorted({tuple(x) for _, x in kept})
    n, sums = len(listed), [sum(c) for c in zip(*listed, strict=True)]
    centred = lambda x: np.array([(n * a - s) / n for a, s in zip(x, sums, strict=True)])
    c = np.array([centred(x) for x in listed])
    e, axes = np.linalg.eigh(c.T @ c / n)
    e, axes = e[::-1][:components], axes[:, ::-1][:, :components]
    out = []
    for i, x in kept:
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
        out += [(i, k + 1, n, deviation, float(centred(x) @ axes[:, k] / np.sqrt(e[k])), e[k] / np.trace(c.T @ c / n)) for k in range(len(e)) if e[k] > 1e-9]
    return out


def test_whitening_equals_a_plain_covariance(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 1, 20) * np.linspace(1, 3, 20)]) for i in range(300)]
    rows += [(7, rows[7][1]), (None, rows[8][1]), (400, rows[9][1]), (401, None), (402, [1.0, None]), (403, [float("nan")] * 20), (404, [float("inf")] * 20), (405, [])]
    rows += [(500 + i, rows[3][1]) for i in range(150)]  # a third of all rows
    found = whitening.whiten(vectors(spark, rows).repartition(5)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], abs(r[4]))
    expected = sorted(plain_whitening(rows), key=key)
    found = sorted((tuple(r) for r in found), key=key)
    assert len(found) == 16 * 453 and [r[:4] for r in found] == [r[:4] for r in expected]
    sign = {}
    for f, p in zip(found, expected, strict=True):
        s = sign.setdefault(f[1], np.sign(f[4]) * np.sign(p[4]))
        assert f[4] == pytest.approx(s * p[4], abs=1e-9) and f[5] == pytest.approx(p[5], rel=1e-9) and f[6] < 1e-9


def test_whitening_of_few_of_equal_and_of_huge_vectors(spark):
    assert whitening.whiten(vectors(spark, [])).collect() == []
    assert whitening.whiten(vectors(spark, [(1, None), (2, [])])).collect() == []
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []  # no axis has variance
    two = sorted(tuple(r) for r in whitening.whiten(vectors(spark, [(1, [0.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0])])).collect())
    assert [r[:4] for r in two] == [(1, 1, 2, 64**2), (2, 1, 2, 64**2)] and {abs(r[4]) for r in two} == {1.0}
    huge = sorted(tuple(r) for r in whitening.whiten(vectors(spark, [(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 2.0])])).collect())
    assert {r[3] for r in huge} == {None} | {r[3] for r in huge if r[0] == 3} and all(np.isfinite(r[4]) for r in huge)


def test_exact_sums_hold_beyond_64_bits():
    x = np.array([[(1 << 62) + 5, -(1 << 62)], [(1 << 62) + 7, -(1 << 62) - 1]] * 4, np.int64)
    assert list(whitening._exact_sums(x)) == [8, 4 * ((1 << 63) + 12), 4 * (-(1 << 63) - 1)]


# ---- importance resampling -----------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_features(text):
    words = WORD.findall((text or "").translate(LOWER))
    runs = [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]
    return len(words), [zlib.crc32(r.encode()) % 10000 for r in runs]


def plain_resample(rows, target):
    source, wanted = Counter(), Counter()
    for _, t in rows:
        source.update(plain_features(t)[1])
    for t in target:
        wanted.update(plain_features(t)[1])
    s_all, t_all = sum(source.values()), sum(wanted.values())
    gain = [math.floor(1000 * math.log((wanted[b] + 1) * (s_all + 10000) / ((source[b] + 1) * (t_all + 10000)))) for b in range(10000)]
    out = []
    for i, t in rows:
        n, f = plain_features(t)
        weight, score = sum(gain[b] for b in f), None
        if i is not None:
            h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(f), weight, score, None, n])
    able = sorted((r for r in out if r[3] is not None and r[5] >= 20), key=lambda r: (-r[3], r[0], -r[1], -r[2]))
    for place, r in enumerate(able[: 5 * len(able) // 100]):
        r[4] = place + 1
    return sorted(map(tuple, out), key=repr)


def resampled(spark, rows, target):
    docs = spark.createDataFrame([(i, t, 1, 2, "k") for i, t in rows], "doc_id long, text string, n long, weight int, key string")
    return sorted((tuple(r) for r in resampling.resample(docs.repartition(3), spark.createDataFrame([(t,) for t in target], "text string")).collect()), key=repr)


def test_resampling_equals_plain_counts(spark, monkeypatch):
    rng = random.Random(5)
    vocabulary = ["Apple", "pear,", "plum", "straße", "naïve", "日本", "x" * 70, "y" * 300, "R2D2", "a_b", "\U0001f600", "don't"] + [f"w{i}" for i in range(200)]
    some = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = [(i, some(rng.choice([0, 1, 2, 3, 25, 60]))) for i in range(160)]
    rows += [(1000 + i, rows[4][1] + " tail " * 30) for i in range(90)]  # a third of all rows
    rows += [(7, rows[7][1]), (7, some(40)), (None, some(40)), (2000, None), (2001, ""), (2002, "\0 \x7f!"), (2003, some(3000)), (2004, "one"), (2005, "Two words")]
    target = [some(30) for _ in range(9)] + [None, "", "plum plum plum"]
    expected = plain_resample(rows, target)
    assert resampled(spark, rows, target) == expected
    for name, value in (("TEXT_BYTES", 97), ("RANK_ROWS", 7), ("KNOWN_WORDS", 20)):  # long texts in blocks, many ranges, a memory that overflows
        monkeypatch.setattr(resampling, name, value)
    assert resampled(spark, rows, target) == expected


def test_blocks_of_a_long_text_give_its_features(monkeypatch):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["ab", "c", "Def9", "é" * 40, "-", ""]) for _ in range(n)) for n in (0, 1, 2, 3, 500)]
    for size in (1, 3, 10, 64, 10**6):
        monkeypatch.setattr(resampling, "TEXT_BYTES", size)
        found, words = [Counter() for _ in texts], np.zeros(len(texts), int)
        for n, buckets, owners in resampling.features(texts):
            words += n
            for b, o in zip(buckets.tolist(), owners.tolist(), strict=True):
                found[o][b] += 1
        assert [(int(w), f) for w, f in zip(words, found, strict=True)] == [(n, Counter(f)) for n, f in map(plain_features, texts)]


def test_resampling_of_none_and_of_copies(spark):
    assert resampled(spark, [], ["a b c"]) == []
    assert resampled(spark, [(1, "a")], []) == plain_resample([(1, "a")], [])
    copies = [(i, "w " * 25) for i in range(60)]
    assert resampled(spark, copies, ["w"]) == plain_resample(copies, ["w"])


# ---- personal data -------------------------------------------------------------------------

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_counts(kind, span):
    digits = [int(c) for c in span if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in span.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def plain_base(text):
    return [(kind, m.start(), m.end()) for kind, p in PLAIN.items() for m in p.finditer(text or "") if plain_counts(kind, m.group())]


@pytest.fixture(scope="module")
def pii_model(spark):
    return pii.train(spark)


def found_pii(spark, model, rows):
    docs = spark.createDataFrame([(i, t, 3, "x") for i, t in rows], "doc_id long, text string, uid int, start string")
    return sorted((tuple(r) for r in pii.find_pii(docs.repartition(3), model).collect()), key=repr)


def test_base_spans_equal_plain_patterns(spark, pii_model):
    rng = random.Random(9)
    bits = ["a@b.c", "@", ".", "_", "d@e", " ", "-", "+", "1", "22", "333", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (017) 555-7713", "1.2.3.4", "256.1.1.1", "0001.02.3.255", "é", "\U0001f600", "\n", "(", ")", "x.y@z.com_q@r.s", "\0", "日"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))) for i in range(400)]
    rows += [(500, None), (501, ""), (None, "a@b.c"), (3, rows[3][1]), (502, "a@b.c_d@e.f@g.h"), (503, "1.2.3.4.5.6.7.8.9"), (504, "+12345678 9+123456789012345 +1234567890123456"), (505, "a@b-.c..d@e.f")]
    rows += [(600 + i, "mail me: q@w.er 4111111111111111") for i in range(200)]  # a third of all rows
    expected = []
    for i, t in rows:
        base = plain_base(t)
        expected.append((i, *(sum(k == kind for k, _, _ in base) for kind in pii.KINDS), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()))
    found = found_pii(spark, pii_model, rows)
    assert [r[:6] for r in found] == sorted(expected, key=repr)
    text = {(i, t) for i, t in rows}
    for doc, *_, spans, added in found:
        listed = [tuple(s.split(":")) for s in spans.split(",") if s]
        keys = [(pii.KINDS.index(k), int(a)) for k, a, b in listed]
        assert keys == sorted(keys) and added >= 0
        if doc is not None and doc != 3:
            base = plain_base(dict(text)[doc])
            assert {(k, str(a), str(b)) for k, a, b in base} <= set(listed) and len(listed) == len(base) + added


def test_long_runs_take_time_in_proportion(spark, pii_model):
    """Runs that a pattern entered at each place would take hours for, and that recursion would overflow on."""
    n = 300_000
    rows = [(1, "a" * n), (2, "1 " * n), (3, "1" * n), (4, "a." * n + "@"), (5, "x at " * n), (6, "1.2.3." * n), (7, "+1 " + " " * n), (8, "ab:" * n), (9, "w " * n + "me@here.org"), (10, "(" * n), (11, "a@b.c " * 20_000)]
    found = {r[0]: r for r in found_pii(spark, pii_model, rows)}
    assert found[9][6] == f"email:{2 * n}:{2 * n + 11}" and found[11][1] == 20_000 and found[11][6].endswith(f"email:{6 * 19_999}:{6 * 19_999 + 5}")
    assert [found[i][1] for i in (1, 3, 4, 10)] == [0] * 4


def test_trees_add_what_the_patterns_miss_and_leave_the_rest(spark, pii_model):
    held_out = pii_examples.examples(600, seed=77)
    found = {r[0]: r[6] for r in found_pii(spark, pii_model, list(enumerate(e["text"] for e in held_out)))}
    hits = wrong = missed = 0
    for i, e in enumerate(held_out):
        base = {f"{k}:{a}:{b}" for k, a, b in plain_base(e["text"])}
        added = {s for s in found[i].split(",") if s} - base
        label = {f"{e['kind']}:{e['start']}:{e['end']}"} - base if e["kind"] else set()
        hits, wrong, missed = hits + len(added & label), wrong + len(added - label), missed + len(label - added)
    assert hits > 150 and wrong <= 0.04 * hits and missed <= 0.15 * (hits + missed), (hits, wrong, missed)


def test_clean_texts_have_no_spans_and_forms_are_found(spark, pii_model):
    clean = ["The order 555123456 of 2024-05-06 came at noon.Then we left.", "Version 1.2.3 costs 1 234 567 or 12.50, pages 10-12.", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "2669109448945251 on re", "std::vector at 12:30:45", "1 2 3 4 5 6 7 8 9 10", "w" * 50_000]
    personal = [("Call (017) 555-7713 now", "phone:5:19"), ("write to jane.roe [at] mail [dot] com please", "email:9:37"), ("my card 4111.1111.1111.1111 ok", "card:8:27"), ("host 10[.]20[.]3[.]4 down", "ip:5:20"), ("phone: 017 555 7713.", "phone:7:19")]
    found = found_pii(spark, pii_model, [*enumerate(clean), *((100 + i, t) for i, (t, _) in enumerate(personal))])
    assert {r[0]: r[6] for r in found} == {**dict.fromkeys(range(len(clean)), ""), **{100 + i: s for i, (_, s) in enumerate(personal)}}


def test_redaction_replaces_clusters(spark, pii_model):
    rows = [(1, "é a@b.c, +41 11 11 11 11 11 11 11 end"), (2, None), (3, ""), (4, "plain"), (5, "1.2.3.4"), (None, "x y@z.de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.redacted for r in pii.redact(docs, pii_model).collect()}
    assert found[2] is None and found[3] == "" and found[4] == "plain" and found[5] == "[ip]" and found[None] == "x [email]" and found[1].startswith("é [email], ")


def test_plan_is_native_and_empty_tables_give_none(spark, pii_model):
    assert found_pii(spark, pii_model, []) == []
    plan = pii.find_pii(spark.createDataFrame([(1, "a@b.c")], "doc_id long, text string"), pii_model)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
