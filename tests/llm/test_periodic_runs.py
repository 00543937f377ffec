"""Runs against a comparison of every word with every later one."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from termtrail.llm import periodic_runs as pr
from termtrail.llm import words

SCHEMA = "doc_id long, text string, id int, runs string"


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain(w):
    """All runs of a list of words, by trying every period."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_text(doc_id, text):
    w = split(text)
    if doc_id is None or not w:
        return w
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return w
    g = h // 10
    a = g % len(w)
    p = 1 + (len(w) - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]


def plain_row(doc_id, text):
    w = plain_text(doc_id, text)
    runs = plain(w)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in dropped)))


def found(lists):
    ids = {x: i for i, x in enumerate(sorted({x for w in lists for x in w}))}
    h = words.mix(np.array([ids[x] + 1 for w in lists for x in w], dtype=np.uint64))
    before = np.concatenate(([0], np.cumsum([len(w) for w in lists]))).astype(np.int64)
    out = [[] for _ in lists]
    for row, s, n, q in pr.find_runs(h, before).tolist():
        out[row].append((s, n, q))
    return out


def samples(rnd):
    noise = lambda letters, n: [rnd.choice(letters) for _ in range(n)]
    root = noise("abcdefghijklm", rnd.randrange(1, 160))
    i = rnd.randrange(1, 70)
    fib, last = ["a"], ["a", "b"]
    while len(last) < 300:
        fib, last = last, last + fib
    thue = "a"
    while len(thue) < 300:
        thue = thue.translate({97: "ab", 98: "ba"})
    nested = [x for _ in range(4) for x in noise("abcd", rnd.randrange(1, 50)) * rnd.randrange(1, 5) + ["x"] * rnd.randrange(25)]
    return [noise("ab", rnd.randrange(400)), (root * 6)[rnd.randrange(40):], (["a", "b"] * i + ["a"]) * rnd.randrange(1, 5),
            (["a"] * i + ["b"]) * rnd.randrange(1, 6) + ["a"] * rnd.randrange(90), last, list(thue), nested * 2, [], ["a"] * 11, ["a"] * 12]


@pytest.mark.parametrize("seed", range(12))
def test_all_runs_are_found(seed):
    lists = samples(random.Random(seed))
    for w, got in zip(lists, found(lists), strict=True):
        assert got == plain(w)


def test_random_words_with_planted_squares_at_every_scale():
    rnd = random.Random(5)
    lists = []
    for q in [*range(1, 40), 63, 64, 65, 127, 128, 129, 255, 256, 257, 500, 700]:
        root = [f"w{rnd.randrange(5000)}" for _ in range(q)]
        before = [f"x{rnd.randrange(9)}" for _ in range(rnd.randrange(50))]
        lists.append(before + root * 2 + root[:rnd.randrange(q)] + ["end"])
        lists.append(root * 2 if q > 5 else root * 12)
    got = found(lists)
    for w, runs in zip(lists, got, strict=True):
        assert runs == plain(w)
    assert sum(map(len, got)) == 96  # squares of fewer than 12 words are no runs


def test_long_texts_of_few_words_stay_cheap():
    got = found([["a"] * 60000, (["a", "b"] * 50 + ["a"]) * 300])
    assert got[0] == [(0, 60000, 1)]
    assert (0, 30300, 101) in got[1]


ROWS = [(i, t, 1, "x") for i, t in [
    (1, None), (2, ""), (3, " \t\n\x0b"), (4, "one"), (5, "la " * 40), (6, "a b\tc\nd " * 9), (7, "Na na NA " * 8),
    (8, " ".join(["é", " b", "😀"] * 7)), (9, "p q r s t " * 3 + "p q r s t u " * 4), (9, "p q r s t " * 3 + "p q r s t u " * 4)]]


def test_query_against_plain_reading(spark, tmp_path):
    rnd = random.Random(2)
    rows = [*ROWS, (None, "z " * 30, 2, None), (None, None, None, None)]
    for i in range(100, 260):
        n = rnd.choice([0, 3, 30, 200, 900])
        rows.append((i, rnd.choice([" ", "  ", "\n"]).join(f"w{rnd.randrange(rnd.choice([2, 30, 900]))}" for _ in range(n)), 0, ""))
    far = next(i for i in range(10 ** 12, 10 ** 12 + 99) if zlib.crc32(str(i).encode()) % 10)
    rows.append((far, " ".join(f"w{i % 9000}" for i in range(40000)), 0, ""))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = pr.query(spark, str(tmp_path))
    key = lambda r: tuple((x is not None, x) for x in r)
    assert got.columns[1:5] == ["n_runs", "start", "length", "period"]
    rows_ = [tuple(r) for r in got.collect()]
    small = [r for r in rows if r[0] != far]
    assert sorted((r for r in rows_ if r[0] != far), key=key) == sorted((plain_row(*r[:2]) for r in small), key=key)
    long = next(r for r in rows_ if r[0] == far)
    assert long[1:6] == (1, 0, 40000, 9000, 4444)
    assert sum(r[1] > 0 for r in rows_) > 10
    assert any(r[0] and r[0] >= 100 and zlib.crc32(str(r[0]).encode()) % 10 == 0 and r[1] for r in rows_)


def test_operator_keeps_spans_and_text(spark):
    got = {r.doc_id: r for r in pr.periodic_runs(spark.createDataFrame(ROWS, SCHEMA)).collect()}
    assert got[1].n_words == 0 and got[1].runs == [] and got[1].collapsed == ""
    assert got[5].runs[0].asDict() == {"start": 0, "length": 40, "period": 1} and got[5].collapsed == "la"
    assert got[6].collapsed == "a b c d"
    assert pr.periodic_runs(spark.createDataFrame([], SCHEMA)).count() == 0
