"""Winnowing against a direct reading of its rules."""

import base64
import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from termtrail.llm import winnow, words

SCHEMA = "doc_id long, text string, shard int, source string"


def plain(text, gram=winnow.GRAM, window=winnow.WINDOW):
    size = min(gram, len(text))
    h = [int(words.mix(words.grams(np.array([ord(c) + 1 for c in text[i:i + size]], dtype=np.uint64), size)
                       + words.U(size))[0]) >> 24 for i in range(len(text) - size + 1)] if text else []
    span = min(window, len(h))
    return sorted({max((i for i in range(w, w + span)), key=lambda i: (-h[i], i))
                   for w in range(len(h) - span + 1)} if h else []), h


def test_selects_rightmost_minimum_of_each_window():
    rnd = random.Random(3)
    for n in (0, 1, 5, 11, 12, 13, 30, 31, 32, 200):
        for alphabet in ("ab", "abcdé😀 "):
            text = "".join(rnd.choice(alphabet) for _ in range(n))
            hashes, at = winnow.winnow(text)
            want, h = plain(text)
            assert at.tolist() == want
            assert [int(x) for x in hashes] == [h[i] for i in want]


def test_blocks_do_not_change_the_selection(monkeypatch):
    text = "".join(random.Random(5).choice("abcd") for _ in range(3000))
    whole = winnow.winnow(text)[1].tolist()
    monkeypatch.setattr(winnow, "_BLOCK", 64)
    assert winnow.winnow(text)[1].tolist() == whole


def test_shared_passage_is_found():
    rnd = random.Random(7)
    noise = lambda n: "".join(rnd.choice("abcdefghij") for _ in range(n))
    for _ in range(50):
        shared = noise(winnow.GRAM + winnow.WINDOW - 1)
        a, b = winnow.signature(noise(40) + shared + noise(33)), winnow.signature(noise(77) + shared)
        assert len(np.intersect1d(a, b))


def test_successors_across_shards(spark, monkeypatch):
    monkeypatch.setattr(winnow.common, "shard_bounds",
                        lambda d, c, real=winnow.common.shard_bounds: real(d, c, rows_per_shard=3))
    rnd = random.Random(1)
    rows = [(i * 7, "".join(rnd.choice("abc é") for _ in range(rnd.randrange(0, 90))), 1, None) for i in range(40)]
    rows[5] = (35, None, None, "x")
    rows += [(None, "no id", 2, "y"), (14, rows[2][1], 1, None), (14, "another", 1, None)]
    got = winnow.likeness_to_next(spark.createDataFrame(rows, SCHEMA)).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    want = []
    for i, r in enumerate(order):
        own, after = r[1] or "", order[(i + 1) % len(order)][1] or ""
        edited = own[:len(own) - len(own) // 2] + after[:len(own) // 2]
        s = [winnow.signature(x) for x in (own, edited, after)]
        want.append((r[0], len(own), hashlib.sha256(edited.encode()).hexdigest(), base64.b64encode(s[0].tobytes()).decode(),
                     base64.b64encode(s[1].tobytes()).decode(), winnow.likeness(s[0], s[1]), winnow.likeness(s[0], s[2])))
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


def test_single_row_empty_table_and_positions(spark):
    one = spark.createDataFrame([(1, "abcdef", 0, "s")], SCHEMA)
    assert winnow.likeness_to_next(one).collect()[0].near_next == 1.0
    assert winnow.likeness_to_next(one.limit(0)).count() == 0
    got = winnow.fingerprints(one.union(spark.createDataFrame([(2, None, 0, "s")], SCHEMA)))
    assert {r.doc_id: list(r.positions) for r in got.collect()} == {1: [0], 2: []}
    assert got.where(F.size("hashes") != F.size("positions")).count() == 0


def test_query_carries_positions(spark, tmp_path):
    rows = [(1, "abcabd" * 30, 0, "s"), (2, "short", 0, "s"), (3, None, 0, "s")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in winnow.query(spark, str(tmp_path)).collect()}
    for doc_id, text, *_ in rows:
        pairs = np.frombuffer(base64.b64decode(got[doc_id].selected), dtype="<u8").reshape(-1, 2)
        hashes, at = winnow.winnow(text or "")
        assert pairs[:, 1].tolist() == at.tolist() and pairs[:, 0].tolist() == (hashes >> words.U(8)).tolist()
        assert np.unique(pairs[:, 0].astype("<u4")).tobytes() == base64.b64decode(got[doc_id].fingerprint)
