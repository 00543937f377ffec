"""Removed passages against a brute-force version."""

import random
import re

import pytest
from pyspark.sql import functions as F

from termtrail.llm import packs, substring

SCHEMA = "doc_id long, text string, bucket int, source string"


def plain(rows, window):
    """Rows in judging order; returns the kept words of each."""
    seen, out = set(), []
    for _, text in rows:
        ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = set()
        for i in range(len(ws) - window + 1):
            key = tuple(ws[i:i + window])
            if key in seen:
                gone |= set(range(i, i + window))
            seen.add(key)
        out.append([w for i, w in enumerate(ws) if i not in gone])
    return out


def corpus(seed, n=60):
    rnd = random.Random(seed)
    words = lambda k: [rnd.choice("abcdefghijklmnop") * rnd.randrange(1, 4) for _ in range(k)]
    passages = [words(k) for k in (8, 20, 21, 33, 60)]
    rows = []
    for i in range(n):
        parts = words(rnd.randrange(0, 30))
        for _ in range(rnd.randrange(0, 3)):
            p = rnd.choice(passages)
            cut = rnd.randrange(0, 6)
            parts += p[cut:] + words(rnd.randrange(0, 15))
        rows.append((i, rnd.choice((" ", "\n", " \t ", "\u00a0 ")).join(parts)))
    rows[3] = (3, None)
    rows[4] = (4, "")
    rows[5] = (5, "x " * 200)
    rows[6] = (6, rows[7][1])
    rows[8] = (8, "\u2003wide\u2003 é \x1f a")
    return rows


@pytest.mark.parametrize("window", [20, 8])
@pytest.mark.parametrize("pack_bytes", [300, 8 << 20])
def test_matches_brute_force(spark, monkeypatch, window, pack_bytes):
    monkeypatch.setattr(packs, "PACK_BYTES", pack_bytes)
    for seed in (1, 2):
        rows = corpus(seed)
        docs = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], SCHEMA).repartition(5)
        got = {r.doc_id: r for r in substring.remove_repeats(docs, window=window, carry=["source", "bucket"]).collect()}
        for (i, text), kept in zip(rows, plain(rows, window), strict=True):
            assert got[i].kept_text.split(" ") == (kept or [""]), i
            gone = sum(s.stop - s.start for s in got[i].removed)
            assert got[i].n_words - gone == len(kept) and (got[i].source, got[i].bucket) == ("s", 1)


def test_equal_rows_null_ids_and_empty_table(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(7, text, 1, "a"), (7, text, 1, "a"), (None, text, 1, "b"), (9, "short", 1, "c")], SCHEMA)
    got = sorted((r.doc_id or -1, len(r.kept_text.split())) for r in substring.remove_repeats(docs).collect())
    assert got == [(-1, 30), (7, 0), (7, 0), (9, 1)]
    assert substring.remove_repeats(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        substring.remove_repeats(docs.withColumn("removed", F.lit(1)), carry=["removed"])


def test_a_pack_is_dropped_before_the_next_is_opened(monkeypatch):
    import weakref

    import pyarrow as pa
    alive, most = weakref.WeakSet(), []

    class Counted(substring._Pack):
        def __init__(self, *args):
            most.append(len(alive))
            alive.add(self)
            super().__init__(*args)

    monkeypatch.setattr(substring, "_Pack", Counted)
    table = pa.table({"doc_id": pa.array([1, 2], pa.int64()), "text": [" ".join(f"w{i}" for i in range(60)), None]})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    blob = sink.getvalue().to_pybytes()
    (sent,) = substring._find_anchors("text", 20, 2)(iter([pa.record_batch([pa.array([0]), pa.array([blob])], ["batch", "blob"])]))
    replies = [{"bucket": b, "shared": b"\x00" * 8, "anchored": b"\x00" * 8} for b in sent["bucket"].to_pylist()]
    number, blobs, replies = pa.array([0, 1, 2]), pa.array([blob] * 3), pa.array([replies] * 3)
    none = pa.nulls(3)
    windows = pa.record_batch([number, blobs, replies], ["batch", "blob", "replies"])
    cuts = pa.record_batch([blobs, replies, none], ["blob", "replies", "later"])
    list(substring._find_windows("doc_id", "text", 20, 2)(iter([windows])))
    got = list(substring._cut_out("doc_id", "text", 20, 2, [], True)(iter([cuts])))
    assert most == [0] * 7 and [b.num_rows for b in got] == [2] * 3
