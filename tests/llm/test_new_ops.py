"""Tokenizer alignment, near vectors and spelling variants against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwatch.llm import alignment, nearvectors, spelling

A, B = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
DOCS = "doc_id long, text string, n int, links string"


# --- alignment -------------------------------------------------------------------------------------------------------

def plain_tokens(text):
    """Ids and byte ranges of both tokenizers, through their own interfaces."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer
    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    sign = {c: bytes([n]) for c, n in alignment.byte_of_sign().items()}
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    ids_b = b.encode(text)
    bytes_a = [b"".join(sign[c] for c in a.id_to_token(k)) for k in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in ids_b]
    whole = (" " + text).encode()
    if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
        return [], []

    def ranges(ids, parts):
        at, out = 0, []
        for k, part in zip(ids, parts):
            out.append((k, at, at + len(part)))
            at += len(part)
        return out
    return ranges(ids_a, bytes_a), ranges(ids_b, bytes_b)


def plain_alignment(rows):
    tokens = [plain_tokens(text or "") for _, text in rows]
    pairs = [[(x[0], y[0]) for x in a for y in b if x[2] == y[2]] for a, b in tokens]
    counted = collections.Counter(p for found in pairs for p in found)
    top = collections.defaultdict(int)
    for (_, y), n in counted.items():
        top[y] = max(top[y], n)
    out = []
    for (doc_id, _), (a, b), found in zip(rows, tokens, pairs):
        groups, low = [], 0
        for cut in sorted({x[2] for x in a} & {y[2] for y in b}):
            side = [",".join(str(k) for k, _, end in ids if low < end <= cut) for ids in (a, b)]
            groups.append("|".join(side))
            low = cut
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((doc_id, len(a), len(b), len(groups), len(found), sum(counted[p] == top[p[1]] for p in found),
                    sum(counted[p] for p in found), digest))
    return out


def test_alignment_equals_brute_force(spark):
    rows = [(1, "The newest tokenizers don't agree.\n\nTwo  spaces,  tabs\t and naïve œuvre"), (2, None), (3, ""), (None, "the end"),
            (4, "a ▁ lower block"), (5, "<|endoftext|> and <s> </s> are text"), (5, "日本語 и русский 🙂"), (6, "the end"), (7, " "),
            (8, "x" * 3000), (9, "one\x00two"), (10, "\u0085 odd breaks  "), (-1, "the the the THE"), (11, "\n\n")]
    docs = spark.createDataFrame([(*row, 7, "x") for row in rows], DOCS)
    found = [tuple(r) for r in alignment.alignment_summary(docs, A, B).collect()]
    assert sorted(found, key=str) == sorted(plain_alignment(rows), key=str)
    assert [r for r in found if r[0] == 4][0][1:] == (0, 0, 0, 0, 0, 0, "")


def test_alignment_keeps_groups_and_handles_no_rows(spark):
    docs = spark.createDataFrame([(1, "alignment of unalike tokenizers")], "doc_id long, text string")
    row = alignment.align(docs, A, B).first()
    assert sum(row.a_sizes) == len(row.a_ids) and sum(row.b_sizes) == len(row.b_ids) and len(row.a_sizes) == len(row.b_sizes)
    assert alignment.alignment_summary(docs.limit(0), A, B).collect() == []


def test_common_ends_do_not_depend_on_windows():
    draw = np.random.default_rng(5)
    ends = [np.unique(draw.integers(1, 5000, 900)) for _ in range(2)]
    ends = [[*e[e < 5000].tolist(), 5000] for e in ends]
    whole = alignment.common_ends(*ends)
    for window in (1, 7, 1000):
        assert whole == alignment.common_ends(*ends, window)
    assert [ends[0][k - 1] for k in whole[0]] == sorted(set(ends[0]) & set(ends[1]))


def test_units_give_the_ids_of_whole_texts():
    files = [open(path, "rb").read() for path in (A, B)]
    found, draw = alignment.Aligner(*files), random.Random(4)
    a, b = found.sides[0].tokenizer, found.sides[1].model
    assert found.cuts
    for pool in ("abst'mrelvdn 019.,-!éßœĀ\n\t\r ÀŸ÷«", "ab  \n\u00a0\u0085\x1c.", "語 и🙂a \u3000\u200b़े"):
        for _ in range(3000):
            text = "".join(draw.choice(pool) for _ in range(draw.randint(1, 25)))
            parts = found.texts([text])[0]
            whole = (found._aligned([f" {text}".encode()], [a.encode(f" {text}", add_special_tokens=False).ids], [b.encode(text)]) or [None])[0]
            assert "".join(alignment.units(f" {text}")) == f" {text}"
            if whole is None:
                assert parts is None
                continue
            assert alignment.group_lists(parts) == alignment.group_lists([whole])
            assert ";".join(x.groups for x in parts) == whole.groups
            assert [k for x in parts for k in x.links] == list(whole.links)
            assert (sum(x.n_a for x in parts), sum(x.n_b for x in parts)) == whole[:2]


# --- near vectors ----------------------------------------------------------------------------------------------------

def plain_links(rows, least=0.95):
    """(n_links, component) of every row, by comparing all of them."""
    def unit(v):
        if v is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v) / np.abs(v).max()
        return v / np.linalg.norm(v)
    units = [unit(v) for _, v in rows]
    n = len(rows)
    near = [[j for j in range(n) if j != i and units[i] is not None and units[j] is not None and len(units[i]) == len(units[j])
             and float(units[i] @ units[j]) >= least] for i in range(n)]
    label = list(range(n))
    for _ in range(n):
        label = [min([label[i], *(label[j] for j in near[i])]) for i in range(n)]
    out = []
    for i in range(n):
        ids = [rows[j][0] for j in range(n) if label[j] == label[i] and rows[j][0] is not None]
        component = min(ids) if ids else None
        out.append((rows[i][0], len(near[i]), component, rows[i][0] == component))
    return out


def vectors_near_some(seed, groups=12, size=9, dims=16, noise=0.05):
    draw = np.random.default_rng(seed)
    out = []
    for g in range(groups):
        center = draw.standard_normal(dims)
        out += [list(map(float, (center + noise * draw.standard_normal(dims)) * draw.uniform(0.1, 9))) for _ in range(size)]
    return out


@pytest.mark.parametrize("block", [1024, 4])
def test_near_vectors_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(nearvectors, "BLOCK", block)
    vectors = vectors_near_some(3)
    rows = [(100 - k, v) for k, v in enumerate(vectors)]
    rows += [(500 + k, vectors[0]) for k in range(40)] + [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16),
            (904, [None, 1.0]), (905, [1.0, 2.0]), (906, [2.0, 4.0]), (907, [float("inf")] + [0.0] * 15), (908, [1e300] * 16),
            (909, [1e-300] * 16), (None, vectors[20]), (None, [-x for x in vectors[1]]), (None, [-2 * x for x in vectors[1]]), (100, vectors[30]),
            (None, None)]
    table = spark.createDataFrame([(*row, 1, "x") for row in rows], "vec_id long, embedding array<double>, n_links int, vector string")
    found = [tuple(r) for r in nearvectors.near_duplicates(table, recall=0.9999).collect()]
    expected = [(i, n, c, k if c is not None else i is None) for i, n, c, k in plain_links(rows)]
    assert sorted(found, key=str) == sorted(expected, key=str)


def test_near_vectors_of_no_rows_and_of_floats(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert nearvectors.near_duplicates(spark.createDataFrame([], schema)).collect() == []
    only = spark.createDataFrame([(4, [1.0, 0.0], 1), (2, [1.0, 0.1], 1), (3, [0.0, 1.0], 0)], schema)
    assert sorted(tuple(r) for r in nearvectors.near_duplicates(only).collect()) == [(2, 1, 2, True), (3, 0, 3, True), (4, 1, 2, False)]


def test_p_stable_hashes_agree_as_often_as_said():
    draw, least = np.random.default_rng(11), 0.95
    step = nearvectors.STEP * np.sqrt(2 - 2 * least)
    a = nearvectors.normalised(draw.standard_normal((4000, 64)))
    across = draw.standard_normal((4000, 64))
    across = nearvectors.normalised(across - (across * a).sum(1, keepdims=True) * a)
    b = least * a + np.sqrt(1 - least**2) * across
    width, tables = 6, 10
    same = (nearvectors.bucket_keys(a, width, tables, step) == nearvectors.bucket_keys(b, width, tables, step)).mean()
    assert abs(same - nearvectors.agreement(np.sqrt(2 - 2 * least), step) ** width) < 0.02
    whole = nearvectors.bucket_keys(a, width, tables, step)
    assert (whole[1234:1240] == nearvectors.bucket_keys(a[1234:1240], width, tables, step)).all()


# --- spelling --------------------------------------------------------------------------------------------------------

def plain_variants(rows):
    counted = collections.Counter()
    for doc_id, text in rows:
        for word in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), word)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 199 == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            counted[word] += len(word) >= 6
    counted = {w: n for w, n in counted.items() if n >= 5}
    return plain_forms(counted)


def plain_forms(counted):
    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))
    form, n_near = {}, {}
    for w, n in counted.items():
        others = [v for v in counted if v != w and near(v, w)]
        n_near[w] = len(others)
        best = min(others, key=lambda v: (-counted[v], v), default=None)
        form[w] = best if best and counted[best] >= 5 * n else None
    out = []
    for w, n in counted.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, n_near[w], counted[form[w]] if form[w] else None))
    return sorted(out, key=str)


def some_words(draw, number, alphabet="abcé", least=6, most=9):
    return ["".join(draw.choice(alphabet) for _ in range(draw.randint(least, most))) for _ in range(number)]


def test_variants_of_texts_equal_brute_force(spark):
    draw = random.Random(8)
    known = some_words(draw, 60) + ["ÀÉÎÕÜ×÷", "shorts", "Shorts", "zzzzzz"]
    rows = [(k, " ".join(draw.choices(known, [1 / (1 + j) for j in range(len(known))], k=200)) + "-x_" + draw.choice(known)) for k in range(60)]
    rows += [(None, "shorts " * 9), (None, None), (3, ""), (3, "a b c"), (4, "y" * 5000 + " " + "y" * 4999), rows[5]]
    docs = spark.createDataFrame([(*row, 2, "x") for row in rows], "doc_id long, text string, n int, word string")
    found = [tuple(r) for r in spelling.variants(spelling.frequent_words(docs)).collect()]
    assert sorted(found, key=str) == plain_variants(rows)
    assert any(r[1] for r in found)


@pytest.mark.parametrize("sample, cell", [(50_000, 20_000), (200, 20), (30, 4)])
def test_variants_do_not_depend_on_the_cells(spark, sample, cell):
    draw = random.Random(9)
    counted = {w: draw.choice((5, 5, 6, 30, 200, 5000)) for w in some_words(draw, 300, "abc") + ["b" * 300, "b" * 301, "b" * 299 + "c", "😀" * 7, "😀" * 6]}
    words = spark.createDataFrame(list(counted.items()), "word string, n long")
    found = [tuple(r) for r in spelling.variants(words, sample=sample, cell=cell).collect()]
    assert sorted(found, key=str) == plain_forms(counted)
    assert any(r[1] and r[2] != r[1] for r in found)


def test_variants_of_no_words(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(spelling.frequent_words(docs)).collect() == []


def test_tree_search_reaches_all_vectors_within_the_distance():
    draw = np.random.default_rng(2)
    vectors = draw.integers(0, 4, (500, spelling.PLACES)).astype(np.uint8) * (np.arange(spelling.PLACES) < 10)
    tree = spelling.Tree(vectors, 16)
    asked = np.clip(vectors.astype(int) + (draw.random(vectors.shape) < 0.01), 0, 255).astype(np.uint8)
    seen = collections.defaultdict(set)
    for leaf, rows in tree.search(asked, 2):
        for row in rows:
            seen[row].update(tree.leaves[leaf].tolist())
    away = np.abs(asked[:, None].astype(int) - vectors[None]).sum(2)
    for row in range(500):
        assert set(np.flatnonzero(away[row] <= 2)) <= seen[row]
    assert sum(map(len, seen.values())) < 500 * 500 / 2
    bits = spelling.parities(vectors)
    differ = sum(np.bitwise_count(bits[:, None, k] ^ bits[None, :, k]).astype(int) for k in range(2))
    assert (differ <= np.abs(vectors[:, None].astype(int) - vectors[None]).sum(2)).all()
