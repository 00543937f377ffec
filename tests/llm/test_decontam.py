"""Hits against a brute-force version."""

import random
import re

import pytest

from termtrail.llm import decontam

DOCS, ITEMS = "doc_id long, text string, hits int, items string", "item_id long, text string, doc_id int"


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain(text, items):
    ws, hit, names = words(text), set(), set()
    for item, body in items:
        iw = words(body)
        n = min(13, len(iw))
        for k in range(len(iw) - n + 1 if n else 0):
            for i in range(len(ws) - n + 1):
                if ws[i:i + n] == iw[k:k + n]:
                    hit |= set(range(i, i + n))
                    names.add(str(item))
    return len(ws), len(hit), sorted(names), bool(hit) and 20 * len(hit) >= len(ws)


def fixture(seed):
    rnd = random.Random(seed)
    run = lambda n, a: " ".join(rnd.choice(a) for _ in range(n))
    alphabet = ["Aa", "b-b", "cÉ", "d_9", "e"]
    items = [(i, run(n, alphabet)) for i, n in enumerate([30, 14, 13, 12, 5, 2, 1, 0, 40, 13])]
    items += [(20, None), (21, items[0][1]), (3, items[3][1]), (22, "rare words here"), (23, "words here")]
    docs = []
    for i in range(50):
        parts = [run(rnd.randrange(0, 20), alphabet + ["zzz", "yyy"])]
        body = rnd.choice(items)[1] or ""
        parts += [body[rnd.randrange(0, 3):], run(rnd.randrange(0, 200), ["zzz", "yyy", "xxx"])]
        docs.append((i, rnd.choice((" ", ", ", "\x7f")).join(parts)))
    return docs + [(60, None), (61, ""), (62, "some Rare, words; HERE!"), (62, "some Rare, words; HERE!"), (None, "e")], items


@pytest.mark.parametrize("part_words", [10 ** 6, 40])
def test_matches_brute_force(spark, part_words):
    for seed in (1, 2, 3):
        docs, items = fixture(seed)
        got = decontam.contamination(spark.createDataFrame([(i, t, 0, "x") for i, t in docs], DOCS),
                                     spark.createDataFrame([(i, t, 0) for i, t in items], ITEMS), part_words=part_words).collect()
        got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_hit, list(r.items), r.contaminated) for r in got)
        assert got == sorted((i if i is not None else -1, *plain(t, items)) for i, t in docs)


def test_clean_text_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "Keep this. Alpha, BETA gamma! And this.", 0, "")], DOCS)
    items = spark.createDataFrame([(1, "alpha beta gamma", 0)], ITEMS)
    row = decontam.contamination(docs, items, carry=[]).collect()[0]
    assert row.clean_text == "Keep this. ! And this." and row.contaminated
    assert decontam.contamination(docs.limit(0), items).count() == 0
    assert decontam.contamination(docs, items.limit(0)).collect()[0].n_hit == 0
