"""Components against all pairs compared in full."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from termtrail.llm import near_duplicates as nd
from tests.conftest import SMALL

SCHEMA = "doc_id long, text string, n int, component long"


def shingles(text, size):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    ws = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(ws[i:i + size]) for i in range(max(1, len(ws) - size + 1))} if ws else set()


def plain(rows, size):
    """Every pair of different sets compared; smallest reachable id."""
    sets, classes = {i: frozenset(shingles(t, size)) for i, t in rows}, {}
    for i, s in sorted(sets.items()):
        classes.setdefault(s, i)
    up = {i: classes[s] if s else i for i, s in sets.items()}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    items = [(s, i) for s, i in classes.items() if s]
    for k, (s, i) in enumerate(items):
        for t, j in items[:k]:
            if 5 * min(len(s), len(t)) >= 4 * max(len(s), len(t)) and 100 * len(s & t) >= 80 * len(s | t):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: (len(sets[i]), top(i)) for i in sets}


def family(rnd, base, copies, edits):
    out = []
    for _ in range(copies):
        ws = list(base)
        for _ in range(rnd.randrange(0, edits)):
            ws[rnd.randrange(len(ws))] = f"e{rnd.randrange(10 ** 6)}"
        out.append(" ".join(ws))
    return out


def corpus(seed):
    rnd = random.Random(seed)
    words = lambda n: [rnd.choice("abcdefgh") + str(rnd.randrange(30)) for _ in range(n)]
    texts = []
    for n, copies, edits in ((60, 40, 9), (12, 15, 3), (200, 30, 25), (2500, 8, 300), (1000, 8, 120), (1060, 6, 100)):
        texts += family(rnd, words(n), copies, edits)
    texts += [" ".join(words(rnd.randrange(1, 40))) for _ in range(60)]
    texts += ["One", "one", "one\n", "two words", "Two  Words", "", None, " \t", "x " * 500, "x x", texts[0].upper()]
    rnd.shuffle(texts)
    return list(enumerate(texts, 100))


@pytest.mark.parametrize("block", [8, nd.BLOCK])
@pytest.mark.parametrize("size", [2, 5])
def test_matches_all_pairs(spark, monkeypatch, block, size):
    monkeypatch.setattr(nd, "BLOCK", block)
    rows = corpus(size)
    got = nd.near_duplicates(spark.createDataFrame([(i, t, 1, 2) for i, t in rows], SCHEMA), shingle=size).collect()
    want = plain(rows, size)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(rows)


def test_matches_all_pairs_on_the_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nd.near_duplicates(docs).collect()}
    assert got == plain(rows, 2)


def test_sketches_never_reject_small_links_and_rarely_large_ones():
    rng = np.random.default_rng(4)
    for n in (5, 40, 300, 900, 1100, 6000):
        for _ in range(20):
            d = int(n * 0.2 / 1.8 * rng.uniform(0.5, 0.999))  # both differ in d: similarity of 0.8 or more
            core = [f"s{x}" for x in rng.integers(0, 1 << 40, n - d)]
            texts = [" ".join(core + [f"{c}{k}" for k in range(d)]) for c in "ab"]
            sets, at = nd.shingle_sets(pa.array(texts), 1)
            keys, sketch = nd.signatures(sets, at)
            assert nd.may_link(at[1], at[2] - at[1], *sketch.view(np.uint64)[:, None])[0]
            assert (keys[0] == keys[1]).any()


def test_missing_ids_repeated_rows_and_empty_table(spark):
    text = "some words that repeat here and there"
    docs = spark.createDataFrame([(None, text, 0, 0), (4, text, 0, 0), (4, text, 0, 0), (2, text + ".", 0, 0), (9, text, 0, 0)], SCHEMA)
    got = sorted(map(tuple, nd.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(None, 6, None, True), (4, 6, 4, True), (4, 6, 4, True), (2, 6, 2, True), (9, 6, 4, False)], key=str)
    assert nd.near_duplicates(docs.limit(0)).count() == 0


def plain_rows(rows, size):
    """As ``plain``, for rows of which several may have one id: texts compared one by one, ids join."""
    sets = [frozenset(shingles(t, size)) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is None or rows[j][0] is None or not sets[i] or not sets[j]:
                continue
            if rows[i][0] == rows[j][0] or 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None and sets[i]:
            least[top(i)] = min(doc_id, least.get(top(i), doc_id))
    out = []
    for i, (doc_id, _) in enumerate(rows):
        component = None if doc_id is None else least.get(top(i), doc_id) if sets[i] else doc_id
        out.append((doc_id, len(sets[i]), component, doc_id is None or doc_id == component))
    return sorted(out, key=repr)


def test_several_texts_of_one_id(spark):
    rnd = random.Random(11)
    word = lambda: f"w{rnd.randrange(4000)}"
    base = [[word() for _ in range(60)] for _ in range(12)]
    near = lambda w: [*w[:-3], word(), word(), word()]
    rows = [(1, base[0]), (5, base[1]), (5, [*base[0], word()]), (7, [*base[1], word()])]
    rows += [(rnd.randrange(20, 60), near(rnd.choice(base))) for _ in range(60)]
    rows = [(i, " ".join(w)) for i, w in rows] + [(5, ""), (5, None), (7, " ".join(base[1])), (7, " ".join(base[1])), (None, " ".join(base[0])),
                                                   (80, "one"), (81, "ONE"), (81, "one two")]
    docs = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], SCHEMA).repartition(4)
    got = sorted((tuple(r) for r in nd.near_duplicates(docs).collect()), key=repr)
    assert got == plain_rows(rows, 2)
    assert (7, 59, 1, False) in got


def test_very_long_text_and_its_near_copy(spark):
    rnd = random.Random(12)
    long = [f"w{rnd.randrange(10 ** 6)}" for _ in range(150_000)]
    rows = [(1, " ".join(long)), (2, " ".join([*long[:-900], "cut"])), (3, " ".join(long[:75_000])), (4, "short text")]
    got = {r.doc_id: r.component_id for r in nd.near_duplicates(spark.createDataFrame([(i, t, 0, 0) for i, t in rows], SCHEMA)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_sets_sort_row_by_row(monkeypatch):
    """A row is sorted alone, and rows of no or of too few words keep their place."""
    monkeypatch.setattr(np, "lexsort", None)
    texts = ["b a b a b", "", "one", None, " two  three ", "x y z x y", "one two"]
    sets, at = nd.shingle_sets(pa.array(texts), 2)
    assert np.diff(at).tolist() == [2, 0, 1, 0, 1, 3, 1]
    for i, text in enumerate(texts):
        own, _ = nd.shingle_sets(pa.array([text], pa.string()), 2)
        assert sets[at[i]:at[i + 1]].tolist() == own.tolist() == sorted(own.tolist())
