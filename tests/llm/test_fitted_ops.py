"""Operators that are fitted or searched: against brute force, planted cases and held-out rows."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tarnwatch.llm import decontaminate as leaks, neighbours, quality, stages, textkit as tk, workload, wrappers

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, n, kinds=400):
    return " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))


# --- words and shingles --------------------------------------------------------------------------------------------------

def test_words_of_blocks():
    rng = random.Random(1)
    texts = ["", None, "a", " a ", "A b\tc\nd\x0be\x0cf\rg", "é é  x", "\x1c\x85 y", "x" * 3000] + [sentence(rng, 50) for _ in range(20)]
    column = pa.array(["skip", *texts]).slice(1)
    seen, names = [], {}
    for start, stop, data, offsets in tk.blocks(column, 200):
        hashes, firsts = tk.words(data, offsets)
        for k in range(start, stop):
            own = [w.lower() for w in re.findall(rb"[^\x20\x09-\x0d]+", (texts[k] or "").encode())]
            got = hashes[firsts[k - start]:firsts[k - start + 1]].tolist()
            assert len(own) == len(got)
            for w, h in zip(own, got):
                assert names.setdefault(w, h) == h
            seen.append(k)
    assert seen == list(range(len(texts))) and len(set(names.values())) == len(names)


# --- op4 ---------------------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def items():
    rng = random.Random(11)
    out = [(k, f"{sentence(rng, rng.randrange(8, 30), 3000)}? {sentence(rng, rng.randrange(4, 30), 3000)}.") for k in range(37)]
    return out + [(100, None), (101, ""), (102, " .!"), (103, "tiny"), (104, out[3][1]), (105, "one two three four five six seven eight")]


def test_retrieval_matches_bm25_of_every_item(items, monkeypatch):
    rng = random.Random(12)
    for least, table in ((0.3, leaks.TABLE), (0.5, leaks.TABLE), (0.4, 0)):
        monkeypatch.setattr(leaks, "TABLE", table)
        index = leaks.build_index(items, least)
        kept = [t for _, t in items if t and re.search(r"\w", t)]
        bags = [re.findall(r"\w+", t.lower()) for t in kept]
        size = sum(map(len, bags)) / len(bags)
        df = {w: sum(w in b for b in bags) for b in bags for w in b}

        def score(bag, words):
            return sum(np.log(1 + (len(bags) - df[w] + 0.5) / (df[w] + 0.5)) * bag.count(w) * 2.2 / (bag.count(w) + 1.2 * (0.25 + 0.75 * len(bag) / size))
                       for w in set(bag) & set(words))

        docs = [sentence(rng, 300, 3000), " ".join(kept[:4]), sentence(rng, 61, 3000) + " " + kept[5][:90] + " " + sentence(rng, 50, 3000), "tiny", ""]
        got, expected = {}, {}
        for start, _, data, offsets in tk.blocks(pa.array(docs)):
            hashes, firsts = tk.words(data, offsets, tk.PUNCTUATION)
            got = {(d + start, f, i): s for d, f, i, s in leaks.retrieve(index, hashes, firsts, least)}
        step = index.longest
        for d, text in enumerate(docs):
            words = re.findall(r"\w+", text.lower())
            for first in range(0, len(words), step):
                for i, bag in enumerate(bags):
                    s = score(bag, words[first:first + 2 * step])
                    if s >= least * score(bag, bag) - 1e-9 and s:
                        expected[d, first, i] = s
        assert got.keys() == expected.keys()
        assert all(got[k] == pytest.approx(expected[k]) for k in got)


def test_leaks(spark, items):
    rng = random.Random(13)
    rows = [(k, sentence(rng, rng.randrange(0, 400))) for k in range(50)]
    for k in range(0, 36, 2):                           # whole items anywhere in long texts, in another case and punctuation
        rows.append((100 + k, f"{sentence(rng, rng.randrange(0, 2000))} {items[k][1].upper().replace(' ', ', ')} {sentence(rng, 100)}"))
    words = items[1][1].split()
    rows += [(500, " ".join(words[:len(words) // 3])), (501, None), (502, ""), (503, "a tiny thing"), (None, items[7][1]), (504, items[9][1]), (504, items[9][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = {(100 + k, k) for k in range(0, 36, 2)} | {(None, 7), (504, 9), (503, 103)} | {(103 - 1, 2)} - {(102, 2)}
    expected |= {(i, 104) for i, k in expected if k == 3} | {(102, 2)}
    for size in (32 << 20, 700):                        # one index, and several passes
        got = [(r.doc_id, r.item_id) for r in leaks.leaks(docs, bench, index_bytes=size).collect()]
        assert len(got) == len(set(got)) and set(got) == expected
    assert leaks.leaks(docs.limit(0), bench).count() == 0
    assert leaks.leaks(docs, bench.limit(0)).count() == 0


def test_every_planted_benchmark_passage_is_found(spark):
    got = {(r.doc_id, r.item_id) for r in workload.QUERIES["op4_decontamination"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    assert {(d.doc_id, b.item_id) for d in docs for b in bench if b.text in d.text} <= got


# --- op6 ---------------------------------------------------------------------------------------------------------------

def brute_nearest(rows, k, is_query):
    rows = [(i, np.array(v, np.float32)) for i, v in rows]
    out = {}
    for q, x in rows:
        if is_query(q):
            near = sorted({(-float(x.astype(float) @ y.astype(float)), i) for i, y in rows if i != q})
            out[q] = [(i, -s) for s, i in near[:k]]
    return out


def test_small_tables_are_searched_whole(spark):
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=6).tolist()) for k in range(60)]
    rows += [(100 + k, rows[4][1]) for k in range(40)] + [(20, rows[20][1])]
    bad = [(200, None), (201, [0.0] * 6), (202, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (203, [float("nan")] * 6), (204, [float("inf")] + [0.0] * 5), (205, [1.0]), (220, []), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").repartition(4)
    got = {}
    for r in neighbours.search(df, F.col("vec_id") % 20 == 0, k=20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    expected = brute_nearest({tuple([i, *v]): (i, v) for i, v in rows}.values(), 20, lambda i: i % 20 == 0)
    assert got.keys() == expected.keys()
    for q, near in expected.items():
        assert [r for r, _, _ in got[q]] == list(range(1, 21))
        assert [i for _, i, _ in got[q]] == [i for i, _ in near]
        assert [s for _, _, s in got[q]] == pytest.approx([s for _, s in near], abs=1e-12)
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>")
    assert [(r.rank, r.query_id) for r in neighbours.search(few, F.col("vec_id") == 0).orderBy("rank").collect()] == [(1, 0), (2, 0)]
    assert neighbours.search(few.limit(0), F.col("vec_id") == 0).count() == 0


def test_recall_of_many_lists(spark):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(30, 24)) * 2
    rows = [(k, (centers[k % 30] + rng.normal(size=24)).astype(np.float32).tolist()) for k in range(6000)]
    rows += [(10000 + k, rows[7][1]) for k in range(3000)]          # a third are copies
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in neighbours.search(df, F.col("vec_id") % 50 == 0, list_size=60, sample=3000).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    hits = total = 0
    for q in got:
        s = x @ x[np.flatnonzero(ids == q)[0]]
        best = [i for i in ids[np.lexsort((ids, -s))] if i != q][:20]
        hits, total = hits + len(got[q] & set(best)), total + 20
    assert len(got) == sum(i % 50 == 0 for i, _ in rows) and hits / total >= 0.9


def test_bounds_and_groups_lose_nothing(spark, monkeypatch):
    """With all lists read, every result is that of brute force, ties included: small whole numbers give many equal scores."""
    def all_lists(found, asked, near, recall, replicas, spread):
        found.beam, found.ratio = len(found.points), 1e9

    monkeypatch.setattr(neighbours, "tune", all_lists)
    monkeypatch.setattr(neighbours, "GROUP", 8)
    monkeypatch.setattr(neighbours, "PIECE", 300)
    monkeypatch.setattr(neighbours, "QUERIES", 20)
    rng = np.random.default_rng(5)
    x = rng.integers(-3, 4, (2500, 7)).astype(float)
    x[x.any(1) == 0, 0] = 1
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    got = {}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    for r in neighbours.search(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    for q, near in brute_nearest(rows, 20, lambda i: i % 50 == 0).items():
        assert got[q] == [i for i, _ in near]


def test_doubles_are_not_rounded(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0 + 1e-12, 0.5]), (2, [1.0, 0.5]), (3, [1e39, 1.0]), (4, [1.0 - 1e-12, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.search(df, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(3, 1e39), (1, 1.0 + 1e-12), (2, 1.0), (4, 1.0 - 1e-12)]


def test_graph_leads_to_nearest_centroids():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(6000, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    found = neighbours.fit(x, 1.0, 600)
    at = neighbours.lifted(x[:500], 1.0)
    order, far = found.nearest(at, 48)
    exact = neighbours._distances(at, found.points)
    assert (np.diff(far, axis=1) >= 0).all() and np.allclose(np.take_along_axis(exact, order, 1), far)
    assert (order[:, 0] == exact.argmin(1)).mean() > 0.85


# --- op7 ---------------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{}}</style><script>var a="<p>no</p>";</script></head><body>
<header><h1>Site {n}</h1></header><nav><ul><li><a href="/">Home {n}</a><li>More</ul></nav><div class="cookie-notice">We use cookies {n}</div>
<div class="ad">Buy {n}</div><article><h1>Title {n}</h1><p>First   <b>bold</b>&nbsp;text &lt;{n}&gt;.<p>Second<br>line &#233;{n}
and more</p><ul><li>One<li>Two</ul>{extra}<div class="comments"><p>Nice {n}!</p></div></article><aside>Side</aside>
<form><p>Search</p><input></form><!-- <p>gone</p> --><footer>Foot &copy; {n}</footer></body></html>"""
TEXT = "Title {n}\nFirst bold text <{n}>.\nSecond\nline é{n} and more\nOne\nTwo"


def test_main_text(spark):
    rows = [(k, f"http://a.example/{k}", PAGE.format(n=k, extra="")) for k in range(12)]
    rows += [(20, "http://a.example/x", PAGE.format(n=20, extra="<h2>Extra</h2><pre>code  here</pre>")), (21, "http://a.example/y", None), (22, None, ""),
             (23, None, "just text <b>here"), (24, "http://b.example", PAGE.format(n=24, extra="")[:700].split("Second")[0]), (0, "http://a.example/0", rows[0][2])]
    # A host without an article element: the group that holds what varies.
    rows += [(30 + k, f"http://c.example/{k}", f"<body><div class=top><p>Same words on every page of the site</p></div><div class=x><div><p>Body {k} {'long ' * 20}</p>"
              f"<p>End {k}</p></div></div><div class=bottom>Same again</div></body>") for k in range(5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: (r.text, r.n_chars) for r in wrappers.main_text(df).collect()}
    assert wrappers.main_text(df).count() == len(rows)
    for k in range(12):
        assert got[k][0] == TEXT.format(n=k) and got[k][1] == len(got[k][0])
    assert got[20][0] == TEXT.format(n=20) + "\nExtra\ncode here"
    assert got[21] == ("", 0) == got[22] and got[23][0] == "just text here"
    assert got[24][0] == "Title 24\nFirst bold text <24>."
    for k in range(5):
        assert got[30 + k][0] == f"Body {k} {('long ' * 20).strip()}\nEnd {k}"
    found = {r.host: r for r in wrappers.infer(df).collect()}
    assert found["a.example"].pages == 15 and "(<h2> # </>)?" in found["a.example"].expression and "(<p> # </>)" in found["a.example"].expression
    assert wrappers.main_text(df.limit(0)).count() == 0


def test_alignment_finds_repeats_and_options():
    def page(html):
        return wrappers.wrapped(wrappers.read(html)[0])

    both = wrappers.align(page("<div><p>a</p><p>b</p></div>"), page("<div><h2>x</h2><p>a</p></div>"))
    assert wrappers.expression(both) == "<> <div> (<h2> # </>)? (<p> # </>)+ </> </>"
    again = wrappers.align(both, page("<div><h2>x</h2><p>a</p><p></p></div>"))
    assert wrappers.expression(again) == "<> <div> (<h2> # </>)? (<p> #? </>)+ </> </>"


def test_cut_and_odd_pages_do_not_fail():
    rng = random.Random(6)
    html = PAGE.format(n=1, extra="<table><tr><td>a<td>b<tr><td>c</table>")
    for _ in range(300):
        cut = html[rng.randrange(len(html)):][:rng.randrange(len(html))]
        wrappers.page_text(wrappers.read(cut)[1], None)
    deep = "<div>" * 3000 + "x"
    assert wrappers.page_text(wrappers.read(deep)[1], None) == "x"


def test_deep_pages_take_part_in_their_host(spark):
    deep = "<div>" * 3000 + "x"
    rows = [(1, "http://d.example/1", deep), (2, "http://d.example/2", "<ul><li>" * 1200 + "y"), (3, "http://d.example/3", "<div>" * 2000 + "z"),
            (4, "http://e.example/4", PAGE.format(n=4, extra=""))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    got = {r.page_id: r.text for r in wrappers.main_text(df).collect()}
    assert got == {1: "x", 2: "y", 3: "z", 4: TEXT.format(n=4)}
    page = wrappers.align(wrappers.wrapped(wrappers.read(deep)[0]), wrappers.wrapped(wrappers.read(deep[5:])[0]))
    assert wrappers.packed(wrappers.unpacked(wrappers.packed(page))) == wrappers.packed(page)
    assert wrappers.expression(page).count("<div>") == 3000


def test_pages_of_the_table_give_their_article(spark):
    pages = {p.page_id: p.html for p in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in workload.QUERIES["op7_main_text"](spark, SF).collect():
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", pages[r.page_id], re.S)[1]
        import html as h
        plain = [re.sub(r"\s+", " ", h.unescape(x)).strip() for x in re.sub(r"</?b>", "", inner).replace("<br>", "<p>").replace("</p>", "<p>").replace("h1>", "p>").replace("</p>", "<p>").split("<p>")]
        assert r.text == "\n".join(x for x in plain if x)


# --- op10 --------------------------------------------------------------------------------------------------------------

def labelled(rng, n):
    rows, labels = [], []
    for k in range(n):
        text, good, toxic = sentence(rng, rng.randrange(20, 120)), 1, 0
        kind = rng.random()
        if kind < 0.2:
            text, good = " ".join(w + "$$$" for w in text.split()), 0
        elif kind < 0.35:
            text, good = text.upper() + "!!", 0
        elif kind < 0.5:
            own = text.split()
            for _ in range(rng.randrange(2, 5)):
                own.insert(rng.randrange(len(own)), rng.choice(["vilestuff", "nastything", "awfulword"]))
            text, toxic = " ".join(own), 1
        rows.append((k, text, "en", f"s{k % 4}", len(text)))
        labels.append((k, good, toxic))
    return rows, labels


def test_classifier_on_held_out_rows(spark):
    rows, labels = labelled(random.Random(21), 1500)
    rows += [(9000, None, None, None, None), (9001, "", "en", "s1", 0), (9002, "word " * 30000, "en", "s1", 150000), (None, rows[0][1], "en", "s0", 5), (0, rows[0][1], "en", "s0", 5)]
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    some = [x for x in labels if x[0] % 2] + [(None, 1, 0), (1, None, None), (5, 1, 0), (5, 0, 1), (7, 3, 0)]
    judged = quality.judge(docs, spark.createDataFrame(some, "doc_id long, quality int, toxic int"))
    got = judged.collect()
    assert len(got) == len(rows) and set(docs.columns) < set(judged.columns)
    truth = {i: q == 1 and t == 0 for i, q, t in labels if i % 2 == 0}
    right = [r.keep == truth[r.doc_id] for r in got if r.doc_id in truth]
    assert np.mean(right) > 0.95
    assert len({r.score for r in got if r.text == rows[0][1] and r.source == "s0"}) == 1
    assert quality.judge(docs.limit(0), spark.createDataFrame(some, "doc_id long, quality int, toxic int")).count() == 0


def test_without_labels_all_is_kept(spark):
    rows, _ = labelled(random.Random(22), 30)
    docs = spark.createDataFrame(rows, DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.keep for r in quality.judge(docs, none).collect())
    one_kind = spark.createDataFrame([(k, 1, 0) for k in range(30)], "doc_id long, quality int, toxic int")
    assert all(r.keep for r in quality.judge(docs, one_kind).collect())


# --- pipeline ----------------------------------------------------------------------------------------------------------

def test_stages_keep_their_columns_and_take_odd_rows(spark):
    rng = random.Random(31)
    line = "a line that is repeated in many of the documents"
    rows = [(k, "\n".join([sentence(rng, 60, 5000), line]), "en", f"s{k % 3}", 1) for k in range(30)]
    rows += [(50, rows[3][1], "en", "s0", 1), (51, None, None, None, None), (52, "", "en", "s1", 0), (3, rows[3][1], "en", "s0", 1)]
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").first()
    rows += [(60, f"{sentence(rng, 90)} {bench.text} {sentence(rng, 40)}", "en", "s2", 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("component_id", F.lit(1))
    once = stages.dedup_lines(spark, docs, SF)
    assert once.columns == list(stages.COLUMNS) and once.count() == len(rows)
    assert sum(line in r.text for r in once.collect()) == 1
    first = stages.one_of_each_group(spark, docs, SF)
    assert sorted(r.doc_id for r in first.collect()) == sorted({i for i, *_ in rows} - {50}) and first.columns == list(stages.COLUMNS)
    clean = stages.decontaminate(spark, docs, SF)
    assert clean.count() == len(rows) - 1 and clean.columns == list(stages.COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_stages_keep_rows_without_or_with_repeated_ids(spark):
    rng = random.Random(32)
    text = [sentence(rng, 60, 5000) for _ in range(8)]
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").first()
    leak = f"{sentence(rng, 90)} {bench.text} {sentence(rng, 40)}"
    rows = [(None, text[0]), (None, text[1]), (7, text[1] + " more"), (5, text[1]), (None, text[2]), (None, text[2] + " more"), (None, text[2]),
            (9, text[3]), (9, text[4]), (9, text[4]), (2, text[5]), (2, text[6]), (3, text[5] + " more"), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s0", 1) for i, t in rows], DOCS).repartition(4)
    got = [(r.doc_id, r.text) for r in stages.one_of_each_group(spark, docs, SF).collect()]
    kept = [(None, text[0]), (5, text[1]), (9, text[3]), (9, text[4]), (2, text[5]), (2, text[6]), (None, None), (None, "")]
    without = [r for r in got if r in ((None, text[2]), (None, text[2] + " more"))]
    assert len(without) == 1 and sorted(map(str, got)) == sorted(map(str, kept + without))
    rows = [(None, leak), (None, text[0]), (4, leak), (4, text[1]), (5, text[2]), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s0", 1) for i, t in rows], DOCS).repartition(3)
    got = [(r.doc_id, r.text) for r in stages.decontaminate(spark, docs, SF).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(None, text[0]), (4, text[1]), (5, text[2]), (None, None)]))


def test_pipeline_is_its_stages(spark):
    from tests.llm.test_exact_ops import brute_classes, brute_lines, words

    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination",
                                                      "mixing sources to target weights"]
    got = corpus_pipeline.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    kept = stages.keep_good(spark, docs, SF).cache()
    assert 0.5 * docs.count() < kept.count() < docs.count()
    lined = {r.doc_id: r.text for r in stages.dedup_lines(spark, kept, SF).collect()}
    import hashlib
    assert {(i, hashlib.sha256(t.encode()).hexdigest()) for i, t in lined.items()} == {(i, s) for i, _, _, s in brute_lines([(r.doc_id, r.text) for r in kept.collect()])}
    reps = {i for i, n, c in brute_classes(sorted(lined.items())) if i == c}
    bench = [b.text for b in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    final = {i for i in reps if not any(b in lined[i] for b in bench)}
    ids = {r.doc_id for r in got}
    assert ids <= reps and final >= ids and len(final - ids) <= 0.02 * len(final)
    assert {r.doc_id: r.size for r in got} == {i: len(words(lined[i])) for i in ids}
    assert all(r.taken <= 2 * r.size for r in got)
