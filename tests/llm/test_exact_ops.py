"""Operators whose results are fixed, against brute force on small tables with nulls, empty and long texts, ties and repeats."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from tarnwatch.llm import exprs, lattice, lines, mixing, neardup, suffixes, urls

WORD = re.compile(rb"[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return [w.lower() for w in WORD.findall((text or "").encode())]


def sentence(rng, n, kinds=40):
    return " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [sentence(rng, rng.randrange(3, 120), 4000) for _ in range(40)]
    out = list(base)
    for k in range(60):                             # near copies around the threshold, some chained
        near = rng.choice(out).split()
        for _ in range(rng.randrange(0, 4)):
            near[rng.randrange(len(near))] = f"x{rng.randrange(10000)}"
        out.append(" ".join(near))
    out += [None, "", " \t\n\x0b ", "one", "one", "One", "two words", "two  words", "a b c d", "a b c d e", "é É é É é", "same " * 5000, "same " * 4000]
    out += [base[0], base[0].upper(), base[1] + "\n" + base[2], "\n".join(base[:6]), base[5] * 3]
    out += [sentence(rng, 12000, 100000)]
    out.append(out[-1].replace(" w1", " y1", 2))
    return out


def frame(spark, texts, ids=None, **more):
    ids = ids or list(range(len(texts)))
    rows = [(i, t, "en", f"s{i % 3}" if i is not None and i % 7 else None, len(t or "")) for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, DOCS).withColumns(more).repartition(5)


# --- op1 ---------------------------------------------------------------------------------------------------------------

def strip(rows, least=50):
    """rows: (doc_id, text). Same order of rows as given."""
    first = defaultdict(lambda: math.inf)
    data = [(math.inf if i is None else i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for k in range(len(b) - least + 1):
            first[b[k:k + least]] = min(first[b[k:k + least]], i)
    out = []
    for (given, _), (i, b) in zip(rows, data):
        gone = bytearray(len(b))
        for k in range(len(b) - least + 1):
            if first[b[k:k + least]] < i:
                gone[k:k + least] = b"\x01" * least
        spans = len(re.findall(b"\x01+", bytes(gone)))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((given, len(b), sum(gone), spans, kept))
    return out


def same_rows(a, b):
    assert Counter(a) == Counter(b)


def run_strip(spark, rows, least=50):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = suffixes.dedup(df, least).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept")
    return [(r[0], r[1], r[2], r[3], bytes(r[4])) for r in got.collect()]


def test_suffix_dedup_matches_brute_force(spark, texts):
    rng = random.Random(9)
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    rows += [(7, texts[7]), (7, texts[8]), (None, texts[3]), (-4, texts[4] + " tail"), (1000, "ab" * 400), (1001, "ab" * 300 + "c" + "ab" * 90)]
    rows += [(2000 + k, "".join(rng.choice("ab") for _ in range(600))) for k in range(8)]
    rows += [(3000, "ü" * 100), (3001, "xü" + "ü" * 60), (3002, "0" * 49), (3003, "0" * 50), (3004, "0" * 51), (3005, "\x00" * 120), (3006, "\x00" * 60)]
    same_rows(run_strip(spark, rows), strip(rows))
    same_rows(run_strip(spark, rows[:60], 30), strip(rows[:60], 30))


def test_suffix_dedup_of_many_rows_of_one_id_and_without(spark):
    rng = random.Random(17)
    shared = ["".join(rng.choice("abcdef ") for _ in range(70)) for _ in range(6)]
    rows = [(1, " | ".join(shared))]
    for doc_id in (5, None):
        rows += [(doc_id, f"{rng.random()} {rng.choice(shared)[rng.randrange(9):]} {rng.random()}") for _ in range(5000)]
    same_rows(run_strip(spark, rows), strip(rows))


def test_suffix_dedup_of_nothing(spark):
    assert run_strip(spark, []) == []
    same_rows(run_strip(spark, [(1, None), (2, "")]), [(1, 0, 0, 0, b""), (2, 0, 0, 0, b"")])


def test_suffix_array_and_intervals():
    rng = random.Random(2)
    body = np.frombuffer("".join(rng.choice("ab") for _ in range(700)).encode(), np.uint8)
    at = np.arange(600)
    end = np.minimum(at + 70, 700)
    found, common = suffixes.suffix_array(body, at, end, 6)
    suffix = [bytes(body[at[k]:end[k]]) for k in found]
    for a, b, c in zip(suffix, suffix[1:], common[1:]):
        prefix = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        assert (prefix == c) if prefix >= 6 else (c == 0)
    groups = list(suffixes.maximal_repeats(common, np.full(len(found), -1), np.arange(len(found)), 6))
    for first, last, length, lowest in groups:
        assert len({s[:length] for s in suffix[first:last]}) == 1 and lowest == first
        assert length == min(common[first + 1:last])
        assert common[first] < length and (last == len(common) or common[last] < length)


# --- op2 ---------------------------------------------------------------------------------------------------------------

def test_apportionment_is_by_highest_quotients(spark):
    rng = random.Random(1)
    rows = [(g, k, rng.choice([0.0, 1.0, 3.0, 7.5, rng.random() * 1000]), seats) for g, seats in ((1, 100), (2, 7), (3, 0), (4, 1234)) for k in range(12)]
    df = spark.createDataFrame(rows, "g int, k int, votes double, seats long")
    got = {(r["g"], r["k"]): r["quota"] for r in mixing.apportion(df, ["g"], [df["k"]]).collect()}
    for g, seats in ((1, 100), (2, 7), (3, 0), (4, 1234)):
        own = {k: v for gg, k, v, _ in rows if gg == g}
        have = dict.fromkeys(own, 0)
        for _ in range(seats):
            k = max(own, key=lambda k: (Fraction(own[k]) / (2 * have[k] + 1), -k))
            have[k] += 1
        assert have == {k: got[g, k] for k in own}


def test_mix(spark, texts):
    rows = [(k, texts[k % len(texts)], None if k % 9 == 0 else f"s{(k * k) % 5}") for k in range(600)] + [(5, "a b", "empty"), (6, None, "none"), (6, None, "none")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, shard_docs=50).collect()
    assert len(got) == len(rows)
    assert sorted(r.size for r in got) == sorted(len(words(t)) for _, t, _ in rows)
    total, by = sum(r.size for r in got), defaultdict(list)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        by[r.source_size, r.target].append(r)
    assert sum(t for _, t in by) == pytest.approx(1.5 * total)
    for (size, target), own in by.items():
        assert target <= 2 * size + 1e-6
        assert sum(r.taken for r in own) == pytest.approx(target, abs=64 * (len(own) / 50 + 2))
    again = mixing.mix(df.repartition(7), shard_docs=50).collect()
    same_rows([tuple(r) for r in got], [tuple(r) for r in again])
    assert mixing.mix(df.limit(0)).count() == 0


# --- op3 ---------------------------------------------------------------------------------------------------------------

def shingle_set(text):
    w = words(text)
    return frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_classes(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            both = len(x & y)
            if both and 100 * both >= 75 * (len(x) + len(y) - both):
                lo, hi = sorted((root(i), root(j)))
                parent[hi] = lo
    return Counter((i, len(s), root(i)) for i, s in sets)


@pytest.mark.parametrize("hot", [32, 2])
def test_near_duplicate_classes(spark, texts, monkeypatch, hot):
    monkeypatch.setattr(neardup, "LEAST_HOT", hot)
    monkeypatch.setattr(neardup, "CHUNK", 500)
    rng = random.Random(3)
    rows = [(k * 3 + 1, t) for k, t in enumerate(texts)]
    shared = sentence(rng, 30, 3000)
    rows += [(5000 + k, sentence(rng, rng.randrange(10, 40), 3000) + " " + shared) for k in range(60)]
    rows += [(1, texts[0]), (900, texts[9]), (901, texts[9])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = neardup.classes(df).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(tuple(r) for r in got) == brute_classes(rows)


def test_shingles_of_a_few_copies_stay_in_the_sketches_of_a_large_table(spark):
    """Else small tables leave out what large ones cannot list, and buckets grow faster than the rows."""
    rows = [(0, 1, 10_000_000, 0, 0), (1, 7, 39, 0, 0), (1, 9, 40, 0, 0)]
    described = spark.createDataFrame(rows, neardup.FIRST_SCHEMA)
    assert neardup._hot(described).tolist() == [9]
    assert neardup._hot(described.where("kind = 1")).tolist() == [7, 9]


def test_a_bucket_of_many_components_adds_as_many_rows_as_it_has_members(spark):
    """Not its pairs: 40 unlike documents meet in a bucket. Two of them have a rarer one in common, which the others drop for."""
    sizes = [(k, k, 64) for k in range(40)]                     # 3 spare cells each: 4 are common to two similar documents
    reps = spark.createDataFrame(sizes, "id long, rep long, n long")
    label = spark.createDataFrame([], "node long, component long")
    rows = [(1, 7, k, 5, 0) for k in range(40)]
    met = spark.createDataFrame(rows, neardup.FIRST_SCHEMA)
    edges = [tuple(r) for r in neardup._across(met, reps, label).collect()]
    assert sorted(edges) == [(0, k) for k in range(1, 40)]
    rows = [(1, 7, k, 3, 0) for k in range(40)] + [(1, 8, k, 1, 5) for k in (5, 6, 9)]
    met = spark.createDataFrame(rows, neardup.FIRST_SCHEMA)
    assert sorted(map(tuple, neardup._across(met, reps, label).collect())) == [(5, 6), (5, 9)]


def test_near_duplicates_of_null_ids_and_of_nothing(spark):
    df = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (3, "a b c"), (4, None)], "doc_id long, text string")
    got = {tuple(r) for r in neardup.classes(df).select("doc_id", "n_shingles", "component_id").collect()}
    assert got == {(None, 1, 3), (3, 1, 3), (4, 0, 4)}
    assert neardup.classes(df.limit(0)).count() == 0


def test_edges_become_stars_under_the_least_id():
    rng = np.random.default_rng(5)
    for size in (0, 1, 30, 400):
        a, b = rng.integers(-60, 300, size), rng.integers(-60, 300, size)
        least = {int(x): int(x) for x in np.concatenate([a, b])}
        for _ in range(size):
            for x, y in zip(a.tolist(), b.tolist()):
                least[x] = least[y] = min(least[x], least[y])
        got = neardup._under_least(a, b)
        assert sorted(zip(*(x.tolist() for x in got))) == sorted((y, x) for x, y in least.items() if x != y)


def test_rows_without_id_connect_nothing_by_that(spark, texts):
    a, b, c = (next(t for t in texts[k:] if t and len(t.split()) > 40) for k in (0, 7, 14))
    rows = [(1, a), (None, a + " more"), (2, b), (None, b + " more"), (None, c), (None, c + " more"), (None, "alone at last"),
            (7, c[::-1]), (7, "two texts of one id"), (8, "two texts of one id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = Counter(tuple(r) for r in neardup.classes(df).select("doc_id", "component_id").collect())
    assert got == Counter([(1, 1), (None, 1), (2, 2), (None, 2), (None, None), (None, None), (None, None), (7, 7), (7, 7), (8, 7)])


def test_components(spark):
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(0, 300)] + [(rng.randrange(1000, 3000), rng.randrange(1000, 3000)) for _ in range(1500)]
    edges += [(5, 5), (None, 3), (9000, 9001), (9001, 9000)]
    got = dict(exprs.components(spark.createDataFrame(edges, "a long, b long")).collect())
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            lo, hi = sorted((root(a), root(b)))
            parent[hi] = lo
    assert got == {x: root(x) for x in list(parent)}
    assert exprs.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- op5 ---------------------------------------------------------------------------------------------------------------

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def test_lattice_sums_all_segmentations():
    v = lattice.load_vocabulary(MODEL)
    pieces = {int(h): p for h, p in zip(v.hashes, v.logp)}

    def brute(s):
        if not s:
            return 1.0
        return sum(math.exp(pieces[h]) * brute(s[k:]) for k in range(1, min(len(s), 16) + 1) if (h := lattice._hash(s[:k])) in pieces)

    own = [b"the", b"qx", "été".encode(), b"a", b"the", b"theantion"]
    got = lattice.log_lattice(v, np.frombuffer(b"".join(own), np.uint8), np.array([len(w) for w in own], np.int32))
    assert got == pytest.approx([math.log(brute(b" " + w)) + v.logp[-1] for w in own])
    long = np.full(5000, 97, np.uint8)
    assert np.isfinite(lattice.log_lattice(v, long, np.array([5000], np.int32)))[0]
    assert np.exp(v.logp[:-1][v.start]).sum() == pytest.approx(1)
    assert np.exp(v.logp[:-1][~v.start]).sum() + np.exp(v.logp[-1]) == pytest.approx(1)
    counts = lattice.expected_counts(v, np.frombuffer(b"the", np.uint8), np.array([3], np.int32), np.ones(1))
    assert counts[:-1][v.start].sum() == pytest.approx(1) and counts[-1] == 1


def test_scores(spark, texts):
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, texts[3]), (None, "a b"), (-7, "b a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = lattice.score_texts(df, MODEL).collect()
    held = {i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1 for i, _ in rows}
    counts = Counter()
    for i, t in rows:
        if not held[i]:
            counts.update([*words(t), "end"])
    n, v = sum(counts.values()), len(counts)
    expected = Counter()
    for i, t in rows:
        tokens = [*words(t), "end"]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        expected[i, held[i], len(tokens), sum(counts[w] > 0 for w in tokens), n, round(base, 5)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == expected
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert lattice.score_texts(df.limit(0), MODEL).count() == 0
    alone = lattice.score_texts(spark.createDataFrame([(0, "a b")], "doc_id long, text string"), MODEL).collect()
    assert len(alone) == 1


def test_training_raises_the_likelihood_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sums = [sum(r.score for r in lattice.score_texts(docs, MODEL, rounds=k).collect() if r.held_out) for k in (0, 1, 3)]
    assert sums == sorted(sums) and sums[2] > 0.9 * sums[0]


def test_urn_is_a_distribution():
    p = np.array([0.2, 0.5])                            # and 0.3 for the end
    for k in range(len(lattice.STRENGTHS)):
        total = 0.0
        for a in range(3):
            for b in range(3 - a):                      # texts of two words, any order
                if a + b == 2:
                    times = np.array([x for x in (a, b) if x])
                    word = np.array([i for i, x in enumerate((a, b)) if x])
                    one = lattice.urn_scores(np.zeros(len(word), int), 1, np.log10(p)[word], times, 0.3)[0, k]
                    total += math.comb(2, a) * 10 ** one
        assert total == pytest.approx(0.7 ** 2)
    x = np.array([1.0, 1.5, 2, 7.25, 300])
    assert lattice.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], abs=1e-9)


def test_word_scores_are_a_distribution():
    counts, tokens = np.array([5, 1, 0, 2]), 10        # 8 words and 2 ends
    lattice_p = np.array([0.1, 0.2, 0.3, 0.4])
    p = 10 ** lattice.word_score(np.log(lattice_p), counts, tokens, 3)
    assert p.sum() + 2 / tokens == pytest.approx(1)


# --- op8 ---------------------------------------------------------------------------------------------------------------

def brute_lines(rows):
    key = lambda x: re.sub(r"[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\f\r"))
    where = defaultdict(set)
    first = -math.inf
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                where[key(line)].add(first if i is None else i)
    out = Counter()
    for i, t in rows:
        own, kept = (t or "").split("\n"), []
        for line in own:
            docs = where.get(key(line), ())
            if len(docs) < 3 or max(docs) == (first if i is None else i):
                kept.append(line)
        out[i, len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()] += 1
    return out


def test_line_dedup(spark):
    rng = random.Random(8)
    pool = [f"Line number {k} of the pool, ÉCOLE {'x' * (k % 9)}" for k in range(30)] + ["short", "", "   ", "exactly twenty chars"[:20], "nineteen characters"]
    rows = [(k, "\n".join(rng.choice(["{}", " {}\t", "{}\r"]).format(rng.choice([str.upper, str])(rng.choice(pool))) for _ in range(rng.randrange(0, 9)))) for k in range(80)]
    rows += [(None, pool[0]), (None, None), (90, None), (91, ""), (92, "\n"), (93, "\n\n" + pool[3]), (5, rows[5][1]), (6, pool[1] + "\n" + pool[1])]
    rows += [(200, "\n".join(f"unique line of the long text {k}" for k in range(20000)) + "\n" + pool[4])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for batches, fanout in ((4, 2), (1, 3)):
        got = lines.dedup_lines(df, batches=batches, fanout=fanout).collect()
        assert Counter((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in got) == brute_lines(rows)
    assert lines.dedup_lines(df.limit(0)).count() == 0
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


# --- op9 ---------------------------------------------------------------------------------------------------------------

def test_url_filter(spark):
    def canonical(href):
        return f"<html><LINK href='{href}' rel=\"canonical\"></html>"

    rows = [
        (1, "https://A.example.ORG/es/5?x#y", None), (2, "https://example.org/en/17", ""), (3, "http://www.example.org/fr/1", None),
        (4, "http://x.com/fr/2", None), (5, "http://x.com/de/2", None), (6, "http://x.com/nl/2", None), (7, None, None), (8, "nothing", None),
        (9, "http://a.net/1", canonical("http://x.com/de/9")), (10, "http://a.net/2", canonical("/1")),
        (11, "http://a.net/2#f", None), (12, "http://b.net/1", canonical("http://example.org/es/1")),
        (13, "http://b.net/2", canonical("//b.net/1")), (14, "http://b.net/3", '<meta http-equiv=refresh content="0; url=http://b.net/2">'),
        (15, "http://b.net/3", canonical("http://x.com/fr/")), (16, "http://c.net/", canonical("mailto:x@y")), (17, "http://notexample.org", None),
        (18, "http://d.net", canonical("http://d.net/")), (19, "http://a.net/2", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(df).collect()}
    assert got[1] == ("a.example.org", "/es/5", "example.org/es/", "block")
    assert got[2] == ("example.org", "/en/17", "example.org/en/1", "block")
    assert got[3] == ("www.example.org", "/fr/1", "org/", "allow")
    assert got[4][2:] == ("com/fr/", "allow") and got[5][2:] == ("com/de/", "block") and got[6][2:] == (None, "allow")
    assert got[7] == ("", "", None, "allow") == got[8]
    assert [got[k][3] for k in (9, 10, 11, 19)] == ["block"] * 4
    assert [got[k][2:] for k in (12, 13, 14, 15)] == [(None, "allow")] * 4      # an allowed alias goes before a blocked one
    assert got[16][3] == "allow" and got[17] == ("notexample.org", "", None, "allow") and got[18][3] == "allow"
    log = spark.createDataFrame([("http://c.net/", "http://x.com/de/1"), (None, "x"), ("", "")], "source string, target string")
    assert {r.page_id: r.verdict for r in urls.filter_urls(df, redirects=log).collect()}[16] == "block"
    assert urls.filter_urls(df.limit(0)).count() == 0


def test_foreign_columns_with_names_of_the_line_operator(spark):
    line = "a line of more than twenty characters"
    rows = [(k, f"{line}\nown {k}", k * 10, f"d{k}", [k], True, 7) for k in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _doc long, _lines string, _gone array<long>, n_lines boolean, extra int")
    from tarnwatch.llm import lines
    out = lines.dedup_lines(df)
    assert sorted(out.columns) == sorted(["doc_id", "_doc", "_lines", "_gone", "extra", "text", "n_lines", "n_dropped"])
    for r in out.collect():
        assert (r["_doc"], r["_lines"], r["_gone"], r["extra"]) == (r.doc_id * 10, f"d{r.doc_id}", [r.doc_id], 7)
        assert (r.n_lines, r.n_dropped) == (2, int(r.doc_id < 3))
        assert r.text == (f"own {r.doc_id}" if r.doc_id < 3 else f"{line}\nown 3")


def test_foreign_columns_with_names_of_the_classifier(spark):
    from tarnwatch.llm import quality
    docs = spark.createDataFrame([(1, "some text", "en", "s", "mine", "own", 5, 1)],
                                 "doc_id long, text string, lang string, source string, p_quality string, keep string, score int, quality int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality.judge(docs, labels)
    assert sorted(out.columns) == sorted(["doc_id", "text", "lang", "source", "quality", *quality.SCORES, "score", "keep"])
    row = out.first()
    assert row.quality == 1 and row.keep is True and isinstance(row.p_quality, float)
