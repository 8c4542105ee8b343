"""Top-k search, repetition rules, HTML extraction, quality, BPE and language against plain versions."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tidemark.tables import stored
from tidemark.llm import bpe_sql, html_extract, langid, packing, quality, repetition, topk_search

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


# ---- top-k ---------------------------------------------------------------------------------


def brute_top(vectors, k):
    """Every row is a vector of its own."""
    rows = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for at, (q, v) in enumerate(rows):
        if q % 20 == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w)), c) for other, (c, w) in enumerate(rows) if other != at)[:k]
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(found)]
    return sorted(out)


def top(spark, vectors, k=20, **blocks):
    frame = spark.createDataFrame([(*v, 1, "x") for v in vectors], "vec_id long, embedding array<float>, row int, v string")
    v = stored(topk_search.quantized(frame), "test-vectors")
    return sorted(tuple(r) for r in topk_search.top_k(v.where("vec_id % 20 = 0"), v, k, **blocks).collect())


def test_top_k_equals_brute_force_over_blocks(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.1, 8)]) for i in range(90)]
    vectors += [(200 + i, vectors[0][1]) for i in range(30)]  # ties
    vectors += [(5, vectors[5][1]), (40, vectors[3][1]), (40, vectors[40][1]), (None, [0.1]), (400, None), (401, [0.1, None]), (402, [float("nan")]), (403, [float("inf")]), (404, []), (405, [0.5] * 12)]
    assert top(spark, vectors, 7, query_block=3, candidate_block=16) == brute_top(vectors, 7)


def test_blocks_grow_before_cells_become_many(spark, monkeypatch):
    assert topk_search._block_count(100_000_000, 528, 8192, 64) < 1000 and topk_search._block_count(51_282, 528, 8192, 64) == 7
    rng = np.random.default_rng(2)
    vectors = [(i, rng.normal(0, 0.3, 4).astype(np.float32).tolist()) for i in range(200)]
    for name, value in (("QUERY_BLOCKS", 2), ("CANDIDATE_BLOCKS", 3), ("BLOCK_BYTES", 2000)):
        monkeypatch.setattr(topk_search, name, value)
    assert top(spark, vectors, 5, query_block=2, candidate_block=4) == brute_top(vectors, 5)


def test_top_k_of_few_and_of_none(spark):
    assert top(spark, [(0, [1.0]), (1, [2.0])]) == [(0, 1, 1, 64 * 128)]
    assert top(spark, []) == []
    assert top(spark, [(0, [1e6] * 4), (20, [-1e6] * 4)])[0] == (0, 1, 20, -4 * (64 * 10**6) ** 2)


# ---- repetition ----------------------------------------------------------------------------


def brute_longest(words):
    n = len(words)
    out = [0] * n
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and i + k < n and j + k < n and words[i + k] == words[j + k]:
                k += 1
            out[i] = max(out[i], k)
    return out


def test_suffix_repeats_equal_brute_force():
    rng = random.Random(1)
    for _ in range(150):
        texts = [[rng.choice("ab" if rng.random() < 0.5 else "abcd") for _ in range(rng.randint(0, 30))] for _ in range(rng.randint(1, 4))]
        codes = [c for d, ws in enumerate(texts) for c in [*(d * 200 + ord(w) for w in ws), -1 - d]]
        assert repetition.longest_of(repetition.suffix_array(np.array(codes))).tolist() == [x for ws in texts for x in [*brute_longest(ws), 0]]


def brute_maximal(words, least):
    """Spans of maximal repeats of at least ``least`` words: runs that occur twice or more and can't be extended to either side everywhere."""
    at = {}
    for i in range(len(words)):
        for n in range(least, len(words) - i + 1):
            at.setdefault(tuple(words[i : i + n]), []).append(i)
    reach, longest = [0] * len(words), 0
    for run, places in at.items():
        if len(places) < 2:
            continue
        before = {words[i - 1] if i else None for i in places} if all(places) else {0, 1}
        after = {words[i + len(run)] if i + len(run) < len(words) else (i,) for i in places}
        if len(before) > 1 and len(after) > 1:
            longest = max(longest, len(run))
            for i in places:
                for j in range(i, i + len(run)):
                    reach[j] = 1
    return sum(reach), longest


def test_maximal_repeats_and_the_verdict_equal_brute_force(spark):
    rng = random.Random(13)
    rows = []
    for i in range(60):
        base = [rng.choice("abcdefghij") + str(rng.randint(0, 3)) for _ in range(rng.randint(40, 90))]
        for _ in range(rng.randint(0, 3)):
            a, n, to = rng.randint(0, 30), rng.randint(5, 30), rng.randint(0, len(base))
            base[to:to] = base[a : a + n]
        rows.append((i, " ".join(base)))
    rows += [(100, "x y " * 60), (101, "z " * 80), (102, " ".join(f"u{i}" for i in range(70)))]
    found = {r.doc_id: r for r in repetition.repetition_rules(docs(spark, rows)).collect()}
    for i, text in rows:
        words = text.split()
        n, r = len(words), found[i]
        n_covered, longest = brute_maximal(words, 8)
        windows = {}
        for k in range(n - 2):
            windows.setdefault(tuple(words[k : k + 3]), []).append(k)
        repeated = {k + j for places in windows.values() if len(places) > 1 for k in places for j in range(3)}
        failed = n < 50 or 100 * len(repeated) > 50 * n
        assert (r.n_covered_words, r.longest_repeat, r.n_repeat_words, r.base_failed) == (n_covered, longest, len(repeated), failed)
        assert r.kept == (not failed and n_covered <= 0.3 * n and (longest <= 50 or longest <= 0.2 * n))


def test_rules_of_clashing_columns_and_of_an_empty_table(spark):
    frame = spark.createDataFrame([(1, "a b c", 5, "x")], "doc_id long, text string, n_words int, kept string")
    assert repetition.repetition_rules(frame).first().n_words == 3 and repetition.repetition_rules(frame.limit(0)).count() == 0


def test_rules_of_odd_texts(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(0, None), (1, ""), (2, long), (3, "a b c " * 40), (4, long + "\n" + long), (2, long), (None, "x y # <"), (6, "l one\n\nl one\n l one\n" + long)]
    found = {(r.doc_id, i): r for i, r in enumerate(repetition.repetition_rules(docs(spark, rows).coalesce(1)).collect())}
    assert found[0, 0].n_words == 0 and found[0, 0].base_failed and not found[0, 0].kept
    assert found[2, 2].kept and found[2, 2].n_repeat_words == 0 and found[2, 5].kept
    assert found[3, 3].n_repeat_words == 120 and found[3, 3].base_failed
    assert found[4, 4].longest_repeat == 60 and not found[4, 4].kept and found[4, 4].n_dup_lines == 1
    assert (found[None, 6].n_words, found[None, 6].word_chars, found[None, 6].n_symbols) == (3, 5, 2)
    assert found[6, 7].n_dup_lines == 1


def test_rules_of_a_very_long_text(spark):
    (r,) = repetition.repetition_rules(docs(spark, [(1, "same " * 200_000)])).collect()
    assert r.n_words == 200_000 and r.n_repeat_words == 200_000 and r.longest_repeat == 199_999


# ---- html ----------------------------------------------------------------------------------

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header class="site"><h1>Site</h1><a href="/">Home</a></header>
<nav><ul><li><a href=a>One</a></li></ul></nav><div class="cookie-notice">We use cookies here to make this site better for you all.</div>
<main><article><header><h1>The &amp; title</h1></header><p>First  paragraph<br>with <b>bold</b> text &lt;here&gt;.</p><div class="ad">Buy this now</div><p>Short.</p><ul><li>One<li>Two</ul></article>
<section id="comments"><p>I disagree with all of this, and I have many words to say about it here.</p></section></main>
<aside><p>Related words that are many and look like an article but are not one.</p></aside><form><label>Name</label><input></form><script>var t="</p>";</script><footer>Copyright</footer></body></html>"""


def test_extracts_the_article(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "v", ""), (4, "w", "<p>" + "word " * 30 + "</p><ul><li><a href=x>link</a></ul>"), (None, "x", "<article><p>a 5 < 6 b"), (1, "u", PAGE)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", html_none())
    found = html_extract.extract_pages(frame.coalesce(1)).collect()
    assert found[0].text == "The & title\n\nFirst paragraph with bold text <here>.\n\nShort.\n\nOne\n\nTwo" and found[0].n_chars == len(found[0].text)
    assert (found[1].text, found[1].n_chars, found[2].text) == ("", 0, "")
    assert found[3].text == ("word " * 30).strip() and found[4].text == "a 5 < 6 b" and found[5] == found[0]


def html_none():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_every_prefix_of_a_page_is_safe():
    for i in range(0, len(PAGE), 7):
        html_extract.extract([PAGE[:i]])


def test_names_alone_do_not_settle_a_block():
    text = lambda page: html_extract.extract([page])[0]
    assert text('<main><h2 class="section-header">Head</h2><div class="story-notice-body"><p>Words of the story here, and more of them.</p></div></main>') == "Head\n\nWords of the story here, and more of them."
    warned = '<article><p>Intro words are here for you.</p><section class="warning"><p>Do not touch the plate while the machine is on.</p></section></article>'
    assert text(warned) == "Intro words are here for you.\n\nDo not touch the plate while the machine is on."
    assert text('<article><p>A text <span class="ad">Buy <span>this</span> now</span> goes on for a while here.</p></article>') == "A text goes on for a while here."
    assert text('<article><p class="a"">no leak of markup</p></article>') == "no leak of markup"
    assert text('<article><p>seen <i hidden>gone <i>too</i></i> again and again</p></article>') == "seen again and again"


def test_long_and_malformed_pages_take_linear_time():
    import time

    start = time.perf_counter()
    deep = "<article>" + "<div>" * 20_000 + "words at the bottom" + "</div>" * 20_000 + "</article>"
    assert html_extract.extract([deep]) == ["words at the bottom"]
    html_extract.extract(['<p a="' * 50_000, "<p a=" * 50_000, "<" * 50_000, "<!-" * 50_000, "</b>" * 50_000, "<p><b class=ad>" * 20_000])
    long = "<article>" + "<p>Some words in a row.</p>" * 40_000 + "</article>"
    assert html_extract.extract([long])[0].count("\n\n") == 39_999
    assert time.perf_counter() - start < 20


class PlainBlocks:
    """Blocks of a well-formed page by the standard library's parser: text, words, words in links, ancestors."""

    def __new__(cls, page):
        from html.parser import HTMLParser

        class Parser(HTMLParser):
            def __init__(self):
                super().__init__(convert_charrefs=True)
                self.open, self.out, self.text, self.linked = [], [], "", ""

            def cut(self):
                if self.text.split():
                    self.out.append((" ".join(self.text.split()), len(self.text.split()), len(self.linked.split()), tuple(t for t in self.open if t not in html_extract.INLINE)))
                self.text = self.linked = ""

            def handle_starttag(self, tag, attrs):
                if tag == "br":
                    self.text += " "
                elif tag not in html_extract.VOID:
                    if tag not in html_extract.INLINE:
                        self.cut()
                        while tag in html_extract.ENDS_P and "p" in self.open:
                            self.open.pop()
                    self.open.append(tag)

            def handle_endtag(self, tag):
                if tag not in html_extract.INLINE:
                    self.cut()
                if tag in self.open:
                    while self.open.pop() != tag:
                        pass

            def handle_data(self, data):
                if not set(self.open) & html_extract.HIDDEN:
                    self.text += data
                    if "a" in self.open:
                        self.linked += data

        parser = Parser()
        parser.feed(page)
        parser.close()
        parser.cut()
        return parser.out


def plain_extract(page):
    """The page by a plain parse and a walk of the tree for one block at a time."""
    found, tree, out = PlainBlocks(page), html_extract.model(), []
    main = ["article" in b[3] for b in found]
    for i, (text, words, linked, over) in enumerate(found):
        near = [(found[j][1], found[j][2] / found[j][1]) if 0 <= j < len(found) else (0, 0) for j in (i - 1, i + 1)]
        named = 1.0 if over[-1] == "div" else 0.0  # on these pages every div is an advert
        x = [words, linked / words, *near[0], *near[1], bool({"nav", "footer"} & set(over)), named, 1 if main[i] else -1 if any(main) else 0, over[-1] == "h1", 0]
        node = 0
        while tree.feature[node] >= 0:
            node = tree.left[node] if x[tree.feature[node]] <= tree.threshold[node] else tree.right[node]
        if tree.value[node] >= 0.5:
            out.append(text)
    return "\n\n".join(out), [t for (t, *_), m in zip(found, main) if m]


def test_whole_pages_equal_a_plain_version_and_the_article():
    import pyarrow.parquet as pq

    pages = [r["html"] for r in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist() if r["html"]]
    found = html_extract.extract(pages)
    want = [plain_extract(p) for p in pages]
    assert found == [w for w, _ in want]
    assert sum(f == "\n\n".join(a) for f, (_, a) in zip(found, want)) >= 0.99 * len(pages)  # held out: the tree never saw these


def test_the_labelled_table_is_learnt():
    x, y = html_extract.labelled()
    assert len(y) > 200 and set(y) == {0, 1} and ((html_extract.model().predict(x) >= 0.5) == (y == 1)).mean() > 0.97


def test_wrappers_and_odd_names_leave_the_article():
    """Marked elements around a page, names whose last word isn't the marked one, and notices without a name."""
    t = "The council voted late on Monday to repair the old bridge, after two years in which engineers had warned that its northern arch would not stand."
    for page, want in (
        (f'<form id="aspnetForm"><div id="content"><h1>Bridge</h1><p>{t}</p><p>{t}</p></div></form>', ["Bridge", t, t]),
        (f"<form><p>{t}</p><p>{t}</p></form>", [t, t]),
        (f'<div class="ad-free"><article><h1>Bridge</h1><p>{t}</p></article></div>', ["Bridge", t]),
        (f'<article><p>{t}</p><section id="related-work"><p>{t}</p></section><div class="comment-on-law"><p>{t}</p></div></article>', [t] * 3),
        (f"<main><p>{t}</p><div>We use cookies. <a>Accept</a></div></main>", [t]),
        (f'<div><p>{t}</p><p>{t}</p></div><div class="rail"><a href=/>More stories here</a> <a>Less</a></div>', [t, t]),
        (f'<article><p>{t}</p></article><div class="comments"><article><p>{t} {t}</p></article></div>', [t]),
        (f'<article><p>{t}</p></article><div class="ad-slot-2"><p>{t}</p></div>', [t]),
    ):
        assert html_extract.extract([page])[0].split("\n\n") == want, page


def test_words_links_and_neighbours_take_part_in_every_decision():
    import pyarrow.parquet as pq

    tree, marks = html_extract.model(), {html_extract.FEATURES.index(f) for f in ("tag_mark", "name_mark", "region", "heading", "inline")}
    assert tree.feature[0] not in marks
    pages = [r["html"] for r in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist() if r["html"]]
    for row in np.concatenate([html_extract.features(html_extract.blocks(p)) for p in pages]):
        node, seen = 0, set()
        while tree.feature[node] >= 0:
            seen.add(int(tree.feature[node]))
            node = tree.left[node] if row[tree.feature[node]] <= tree.threshold[node] else tree.right[node]
        assert seen - marks


def test_extraction_of_an_empty_table(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_extract.extract_pages(none).count() == 0


# ---- quality -------------------------------------------------------------------------------


def test_boosted_trees_learn_and_flatten():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] < -0.2)).astype(float)
    model = quality.boost(x[:1500], y[:1500])
    assert ((model.predict(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95
    one = quality.BoostedTrees(model.base, model.feature, model.cut, model.value)

    def walk(row):
        total = one.base
        for f, c, v in zip(one.feature, one.cut, one.value):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + (row[f[node]] > c[node])
            total += v[node - len(f)]
        return 1 / (1 + np.exp(-total))

    assert np.allclose([walk(r) for r in x[:50]], one.predict(x[:50]))


def plain_boost(x, y, trees, depth, rate, bins=64, ridge=1.0, least=1.0):
    """Boosting one node at a time over raw values; gives the training rows' probabilities."""
    p0 = np.clip(y.mean(), 0.01, 0.99)
    total = np.full(len(y), np.log(p0 / (1 - p0)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]

    def grow(rows, g, h, left):
        best = (1e-9, None, None)
        G, H = g[rows].sum(), h[rows].sum()
        for f in range(x.shape[1]) if left else ():
            for c in cuts[f]:
                side = rows[x[rows, f] <= c]
                gl, hl = g[side].sum(), h[side].sum()
                if hl < least or H - hl < least:
                    continue
                gain = gl**2 / (hl + ridge) + (G - gl) ** 2 / (H - hl + ridge) - G**2 / (H + ridge)
                if gain > best[0] + 1e-9:
                    best = (gain, f, c)
        if best[1] is None:
            step[rows] = rate * G / (H + ridge)
        else:
            under = x[rows, best[1]] <= best[2]
            grow(rows[under], g, h, left - 1)
            grow(rows[~under], g, h, left - 1)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        step = np.zeros(len(y))
        grow(np.arange(len(y)), y - p, p * (1 - p), depth)
        total = total + step
    return 1 / (1 + np.exp(-total))


def test_boosting_equals_a_plain_version():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(150, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] > 0.2).astype(float)
    found = quality.boost(x, y, trees=5, depth=3, bins=16).predict(x)
    assert np.allclose(found, plain_boost(x, y, 5, 3, 0.15, 16), atol=1e-6)


def test_statistics_equal_a_plain_version():
    import re

    rng = random.Random(8)
    for _ in range(60):
        text = "".join(rng.choice("aB é7.,!?#|-\n \t'") for _ in range(rng.randint(1, 120))) + "\nEnd."
        words, lines = re.findall(r"[^ \t\n\x0b\x0c\r]+", text), [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        s = dict(zip(quality.FEATURES, quality.statistics(text), strict=True))
        n = len(words)
        want = {
            "log_words": np.log1p(n), "mean_word": np.mean([len(w.encode()) for w in words]), "longest_word": max(len(w.encode()) for w in words), "digit_share": text.count("7") / len(text),
            "symbol_share": text.count("#") / n, "bang_share": text.count("!") / n, "pipe_share": text.count("|") / n, "stop_share": (text.count(".") + text.count("?")) / n, "comma_share": text.count(",") / n,
            "type_token": len(set(words)) / n, "top_word": max(map(words.count, words)) / n, "log_lines": np.log1p(len(lines)), "dup_lines": 1 - len(set(lines)) / len(lines), "ends_well": 1.0,
            "upper_share": sum(c in "BE" for c in text) / max(1, sum(map(str.isalpha, text))), "adjacent_repeats": sum(a == b for a, b in zip(words, words[1:])) / n,
        }
        assert {k: s[k] for k in want} == pytest.approx(want)


def test_quality_of_long_texts_and_clashing_columns(spark):
    frame = spark.createDataFrame([(i, "Some words that read well. " * (20_000 if i == 3 else 2), 7, "x") for i in range(10)], "doc_id long, text string, _score int, _predicted string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(10)], "doc_id long, quality int, toxic int")
    found = quality.score(frame, quality.train(frame, labels), keep=True)
    assert found.columns == ["doc_id", "_score", "_predicted", "text", "_score_", "_predicted_"] and {(r._score, r._predicted) for r in found.collect()} == {(7, "x")}


def test_quality_held_out_and_odd_rows(spark):
    good = [(i, f"Some plain words that read well, number {i}. And then a second sentence follows here.") for i in range(0, 300, 2)]
    bad = [(i, f"BUY!! NOW!! $$$ {i} *** CHEAP!! *** !!!") for i in range(1, 300, 2)]
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(300)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    frame = docs(spark, good + bad + [(1000, None), (1001, ""), (None, "Some words."), (0, good[0][1])])
    found = quality.score(frame, quality.train(frame, labels)).collect()
    assert len(found) == 304 and {(r.doc_id, r.held_out) for r in found} >= {(i, zlib.crc32(str(i).encode()) % 5 == 0) for i in range(300)}
    assert all(r.predicted == 1 - r.doc_id % 2 for r in found if r.held_out and r.doc_id < 300)
    assert all(0 <= r.score <= 1 for r in found) and [r.held_out for r in found if r.doc_id is None] == [False]
    none = quality.train(frame, labels.limit(0))
    assert {r.score for r in quality.score(frame, none).collect()} == {0.5}
    assert quality.score(frame.limit(0), none).count() == 0


# ---- BPE -----------------------------------------------------------------------------------

ODD = ["", "a  b", " a", "a ", "  a\n b", "x\n\n y", "a\0b <|endoftext|> c", "tab\t x", "don't  'll", "é  ü\r\n z", "   ", "a" * 1000, "ab" * 300, "=" * 501, "中文" * 50, " " * 300 + "x", "日本語 🎉🎉🎉 end", "0" * 777, "Plain words, here."]


def reference_encoding():
    import public_tokenizers as P
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe_sql.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})


def test_sql_bpe_equals_the_library_and_round_trips(spark):
    own = reference_encoding()
    rows = [*enumerate(ODD), (None, None), (0, "")]
    found = bpe_sql.bpe_digests(docs(spark, rows).coalesce(1)).collect()
    for (i, text), r in zip(rows, found, strict=True):
        ids = own.encode_ordinary(text or "")
        assert (r.doc_id, r.n_tokens) == (i, len(ids)) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe_sql.encode_texts(docs(spark, [(1, "Plain words, here.")])).first().ids == own.encode_ordinary("Plain words, here.")


def test_all_tokens_and_long_pieces_encode_as_they_should():
    import public_tokenizers as P

    path, own, rng = P.path("byte_bpe_50k.tiktoken"), reference_encoding(), random.Random(9)
    ranks = bpe_sql.read_ranks(path)
    bpe, tokens = bpe_sql.SqlBpe(path), list(ranks)
    assert all(np.frombuffer(ids, "<u4").tolist() == [ranks[t]] and text == t for t, (ids, text) in zip(tokens, bpe.encode(tokens), strict=True))
    long = ["".join(rng.choices(rng.choice(("ab", "etaoinshr", "0=-", "aé中 ")), k=rng.randint(97, 400))).encode() for _ in range(200)]
    long += [b"".join(rng.choices(tokens, k=rng.randint(97, 120))) for _ in range(100)]
    assert [np.frombuffer(ids, "<u4").tolist() for ids, _ in bpe.encode(long)] == [own._encode_single_piece(x) for x in long]


def test_pieces_beyond_a_query_are_encoded_in_parts(monkeypatch):
    import public_tokenizers as P

    own, rng = reference_encoding(), random.Random(21)
    bpe = bpe_sql.SqlBpe(P.path("byte_bpe_50k.tiktoken"))
    letters = lambda n, some="abcdefghijklmnopqrstuvwxyz": "".join(rng.choices(some, k=n))
    pieces = [letters(6000), "a" * 5003, "ab" * 3001 + "c", letters(4000, "é日ab"), letters(5000, "ETAOIN"), letters(7000, "aehnrt"), "0123456789" * 500]
    want = [np.array(own._encode_single_piece(p.encode()), "<u4").tobytes() for p in pieces]
    for most, window, overlap, back, part in ((3000, 240, 80, 16, 400), (500, 45, 7, 1, 60)):  # the second so narrow that windows often disagree
        for name, value in (("QUERY_BYTES", most), ("WINDOW", window), ("OVERLAP", overlap), ("GIVEN_BACK", back), ("PART", part)):
            monkeypatch.setattr(bpe_sql, name, value)
        found = bpe.encode([p.encode() for p in pieces])
        assert [f[0] for f in found] == want and [f[1].decode() for f in found] == pieces


def test_pieces_far_beyond_a_query_stay_within_its_memory():
    import public_tokenizers as P

    bpe = bpe_sql.SqlBpe(P.path("byte_bpe_50k.tiktoken"), memory="300MB")
    for text in ("".join(random.Random(22).choices("abcdefghijklmnopqrstuvwxyz", k=500_000)), "a" * 3_000_000):
        ((ids, decoded),) = bpe.encode([text.encode()])
        assert ids == np.array(reference_encoding()._encode_single_piece(text.encode()), "<u4").tobytes() and decoded == text.encode()


def test_long_pieces_of_a_vocabulary_where_merges_make_lower_ranks(tmp_path):
    """Here all places at once would be wrong: ``bc`` makes ``bcb``, which has a lower rank."""
    import base64

    import tiktoken

    ranks = {bytes([b]): b for b in range(256)} | {b"bcb": 260, b"xbc": 261, b"cc": 270, b"ccd": 265, b"bc": 300, b"bcbc": 310, b"ab": 320, b"abab": 290}
    path = tmp_path / "own.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % r for t, r in ranks.items()))
    own, bpe, rng = tiktoken.Encoding("low", pat_str=".+", mergeable_ranks=ranks, special_tokens={}), bpe_sql.SqlBpe(str(path)), random.Random(5)
    pieces = [b"bcbc" * 40, b"abab" * 30, b"ccd" * 40, *("".join(rng.choices("abcdx", k=rng.randint(97, 300))).encode() for _ in range(40))]
    assert len(bpe._encode(pieces, bpe_sql._LONG_STEP)[1]) > 20  # the check finds them
    assert [np.frombuffer(ids, "<u4").tolist() for ids, _ in bpe.encode(pieces)] == [own._encode_single_piece(x) for x in pieces]
    assert [text for _, text in bpe.encode(pieces)] == pieces


def test_bpe_of_very_long_texts_clashing_columns_and_an_empty_table(spark):
    own, rng = reference_encoding(), random.Random(12)
    texts = ["a" * 60_000, "".join(rng.choices("abcdefgh", k=30_000)), "word " * 50_000, "\n" * 20_000]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, ids_sha256 string, n_tokens int")
    found = {r.doc_id: r.ids_sha256 for r in bpe_sql.bpe_digests(frame).collect()}
    assert found == {i: hashlib.sha256(np.array(own.encode_ordinary(t), "<u4").tobytes()).hexdigest() for i, t in enumerate(texts)}
    assert bpe_sql.bpe_digests(frame.limit(0)).count() == 0


# ---- language ------------------------------------------------------------------------------

TEXTS = {"en": "the and of with this that from which there when people water house garden", "de": "der die und nicht mit eine ist auch wenn über straße häuser garten wasser", "ru": "это был когда потому что человек вода дом сад город большой"}


def test_language_of_mixed_and_odd_texts(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(TEXTS[lang].split(), k=40)), lang) for i, lang in enumerate(list(TEXTS) * 60)]
    frame = spark.createDataFrame(rows + [(900, "untold words", None), (901, None, "en")], "doc_id long, text string, lang string")
    model = langid.train(frame)
    assert model.langs == sorted(TEXTS)
    mixed = " ".join(TEXTS["en"].split() * 3 + TEXTS["ru"].split() * 9)
    odd = [(1, None), (2, ""), (3, "123 ²!"), (4, mixed), (5, "漢字かな"), (None, TEXTS["de"]), (7, TEXTS["en"] + " " + TEXTS["de"] * 4)]
    found = langid.predict(docs(spark, odd).coalesce(1), model, spans=True).collect()
    assert [r.lang_pred for r in found][:4] == ["und", "und", "und", "ru"] and [r.score for r in found][:3] == [0, 0, 0]
    assert [s.lang for s in found[3].spans] == ["en", "ru"] and found[4].score == 0 and found[5].lang_pred == "de" and found[5].held_out is False
    assert [s.lang for s in found[6].spans] == ["en", "de"]
    truth = {r[0]: r[2] for r in rows}
    held = [r for r in langid.predict(frame, model).collect() if r.held_out and r.doc_id in truth]
    assert held and all(r.lang_pred == truth[r.doc_id] for r in held) and all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in held)
    assert langid.predict(frame, langid.train(frame.limit(0))).first().lang_pred == "und"


def test_viterbi_equals_brute_force():
    from itertools import product

    rng = np.random.default_rng(5)
    for _ in range(30):
        scores = rng.normal(size=(6, 3)) * 3
        codes = [rng.integers(0, 6, n) for n in (0, 1, 5, 7)]
        for c, got in zip(codes, langid.label_words(codes, scores, 2.0), strict=True):
            value = lambda p: sum(scores[w, k] for w, k in zip(c, p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: B023, E731
            best = max((value(p) for p in product(range(3), repeat=len(c))), default=0)
            assert value(got.tolist()) == pytest.approx(best)


def test_long_texts_are_labelled_as_in_one_pass():
    rng = np.random.default_rng(6)
    scores = np.minimum(rng.normal(-1, 1.5, (60, 4)), 0.0)
    codes = [rng.integers(0, 60, n) for n in (20_000, 3, 0, 4096, 4097, 9_000)]
    total = lambda c, labels: scores[c, labels].sum() - 3.0 * (labels[1:] != labels[:-1]).sum()
    whole = langid.label_words(codes, scores, 3.0, block=10**6)
    for block in (7, 1000, 4096):
        for c, one, cut in zip(codes, whole, langid.label_words(codes, scores, 3.0, block), strict=True):
            assert total(c, cut) == pytest.approx(total(c, one)) and (one != cut).mean() < 1e-3 if len(c) else not len(cut)


def test_script_of_a_word_is_that_of_most_letters():
    assert [langid.SCRIPTS[k] for k in langid.Words(["aбвг дом garden ж"]).scripts] == ["cyrillic", "cyrillic", "latin", "cyrillic"]


def test_language_of_clashing_columns_and_of_an_empty_table(spark):
    frame = spark.createDataFrame([(i, TEXTS["de"], "de", 1, "x") for i in range(20)], "doc_id long, text string, lang string, _score int, _lang_pred string")
    model = langid.train(frame)
    found = langid.predict(frame, model, keep=True)
    assert found.columns == ["doc_id", "lang", "_score", "_lang_pred", "text", "_lang_pred_", "_score_"]
    assert {(r._score, r._lang_pred, r._lang_pred_) for r in found.collect()} == {(1, "x", "de")}
    assert langid.predict(frame.limit(0), model).count() == 0


# ---- packing -------------------------------------------------------------------------------


def test_packing_places_every_id_once(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices("alpha beta gamma delta thblean onwhst".split(), k=rng.randint(0, 900)))) for i in range(60)] + [(100, None), (101, ""), (None, "x <|endoftext|> y"), (5, "again")]
    pieces = packing.pack_documents(docs(spark, rows).coalesce(2)).collect()
    by_sequence, by_doc = {}, {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
        by_doc.setdefault((p.doc_id, p.doc_tokens), []).append(p)
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 1024 and (end == 1024 or end & (end - 1) == 0) and len(parts) <= 64
    for doc, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        found = sorted(by_doc[doc, len(ids)], key=lambda p: p.start)
        at = 0
        for p in found:
            assert p.start == at and p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    assert packing.pack_documents(docs(spark, []), "doc_id", "text").count() == 0


def test_packing_keeps_all_three_limits():
    packer = packing.Packer(max_tokens=100, max_segments=3, max_loss=60, pool=8)
    rng, sizes, sequences = random.Random(2), {}, []
    for k in range(80):
        n = rng.randint(1, 150)
        sizes[k] = (n, rng.randint(0, n))
        sequences += packer.add(k, *sizes[k])
    sequences += packer.fill()
    seen = dict.fromkeys(sizes, 0)
    for pieces in sequences:
        assert sum(b - a for _, a, b in pieces) <= 100 and len(pieces) <= 3
        assert sum(max(0, min(b, sizes[k][1]) - a) for k, a, b in pieces) <= 60
        for k, a, b in pieces:
            seen[k] += b - a
    assert seen == {k: n for k, (n, _) in sizes.items()}
