"""Ids against the library of the rank file and against a plain search for the lowest rank."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from termtrail.llm import byte_bpe as bb

SCHEMA = "doc_id long, text string, ids string"


@pytest.fixture(scope="module")
def library():
    with open(bb.RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def numbers(raw):
    return np.frombuffer(raw, dtype="<u4").tolist()


def samples(rnd, n):
    tokens = list(bb.coder().vocabulary.ranks)
    pick = lambda spans, size: "".join(chr(rnd.randrange(*rnd.choice(spans))) for _ in range(rnd.randrange(size)))
    for _ in range(n):
        yield pick([(32, 127)], 300)
        yield pick([(32, 127), (0x80, 0x500), (0x3000, 0xD7FF), (0x1F300, 0x1F700), (9, 33)], 200)
        yield "".join(rnd.choice("abcdeinotr") for _ in range(rnd.randrange(2500)))
        yield b"".join(rnd.choice(tokens) for _ in range(rnd.randrange(100))).decode("utf-8", "ignore")
        yield rnd.choice("aeA1 .=-\n") * rnd.randrange(2000)
        yield "".join(rnd.choice(["the", "ing", " and", "\n\n ", "'s", "12345", " -- ", "!!!", "\t"]) for _ in range(rnd.randrange(300)))


def test_ids_and_bytes_equal_the_librarys(library):
    own = bb.Coder(bb.RANKS, bb.PATTERN)
    texts = list(samples(random.Random(1), 60))
    for text, raw in zip(texts, own.encode(texts), strict=True):
        assert numbers(raw) == library.encode_ordinary(text)
        assert own.decode(raw) == text.encode()


def test_characters_of_every_range(library):
    own = bb.Coder(bb.RANKS, bb.PATTERN)
    points = [*range(0x3100), *range(0xA700, 0xAC00), *range(0xE000, 0x10000), *range(0x10000, 0x1F000, 3), *range(0x323B0, 0x323C0)]
    texts = [f"a{c}1{c} {c}{c}  {c}'s{c} !{c}" for c in map(chr, points)]
    for text, raw in zip(texts, own.encode(texts), strict=True):
        assert numbers(raw) == library.encode_ordinary(text), text


def test_splits_of_other_patterns():
    text = "It's 12 à\u2028 x\U00010400\U00016ea0 \u0558y\x1c\x85z"
    for pattern in (r"\s+|\S+", r"[\p{L}\p{N}]+|[^\p{L}\p{N}]", r"\p{Lu}|\p{L}+|."):
        plain = bb.regex.compile(pattern.replace(r"\p{L}", rf"[\p{{L}}--[{bb.NEWER}]]"), bb.regex.V1)
        for part in (text, text[:7], text[:12]):
            assert bb.splitter(pattern)(part) == plain.findall(part)


def test_merges_of_random_ranks():
    """Vocabularies in which a merge may bring up a lower rank than its own."""
    rnd = random.Random(3)
    for _ in range(40):
        vocabulary = bb.Vocabulary(bb.RANKS)
        tokens = {bytes(rnd.choice(b"abc") for _ in range(rnd.randrange(2, 7))) for _ in range(rnd.randrange(2, 60))}
        order = [bytes([b]) for b in range(256)] + rnd.sample(sorted(tokens), len(tokens))
        vocabulary.ranks = {t: i for i, t in enumerate(order)}
        vocabulary.size = len(order)
        vocabulary.by_left, vocabulary.by_right = {}, {}
        for t, r in vocabulary.ranks.items():
            for c in range(1, len(t)):
                if t[:c] in vocabulary.ranks and t[c:] in vocabulary.ranks:
                    a, b = vocabulary.ranks[t[:c]], vocabulary.ranks[t[c:]]
                    vocabulary.by_left.setdefault(a, {})[b] = r
                    vocabulary.by_right.setdefault(b, {})[a] = r
        vocabulary._single = np.arange(256)
        vocabulary._pair = np.full((256, 256), -1)
        for t, r in vocabulary.ranks.items():
            if len(t) == 2:
                vocabulary._pair[t[0], t[1]] = r
        pieces = [bytes(rnd.choice(b"abcd") for _ in range(rnd.randrange(1, 40))) for _ in range(50)]
        assert [numbers(x) for x in vocabulary.merge(pieces)] == [lowest_first(p, vocabulary.ranks) for p in pieces]


def lowest_first(piece, ranks):
    parts = [piece[i:i + 1] for i in range(len(piece))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        i = min(found)[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


def test_queue_gives_ranks_in_order():
    rnd = random.Random(4)
    queue, held = bb.RankQueue(50256), {}
    for step in range(6000):
        if rnd.random() < 0.55 or not held:
            rank = rnd.choice([rnd.randrange(50256), rnd.randrange(70)])
            queue.push(rank, step)
            held.setdefault(rank, []).append(step)
        else:
            rank = min(held)
            assert queue.pop() == (rank, held.pop(rank))
    while held:
        rank = min(held)
        assert queue.pop() == (rank, held.pop(rank))
    assert queue.pop() is None and not queue.top and not any(queue.mid) and not any(queue.low)


def test_very_long_pre_tokens(library):
    own = bb.Coder(bb.RANKS, bb.PATTERN)
    rnd = random.Random(6)
    texts = ["a" * 300_000, "".join(rnd.choice("abcdefghij") for _ in range(200_000)), " " * 50_000 + "x"]
    for text, raw in zip(texts, own.encode(texts), strict=True):
        assert numbers(raw) == library.encode_ordinary(text)


def test_cache_and_chunks_do_not_change_ids(library, monkeypatch):
    monkeypatch.setattr(bb, "_KNOWN", 20)
    monkeypatch.setattr(bb, "_MERGED", 64)
    own = bb.Coder(bb.RANKS, bb.PATTERN)
    for text in samples(random.Random(8), 10):
        assert numbers(own.encode([text])[0]) == library.encode_ordinary(text)


def test_query_and_round_trip(spark, tmp_path, library):
    texts = [None, "", " ", "plain text, twice", "plain text, twice", "é😀 x" * 50, "y" * 5000, "<|endoftext|>", "\x00\r\n"]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, "no id", None), (3, "other", None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, bb.query(spark, str(tmp_path)).collect()), key=repr)
    want = []
    for doc_id, text, _ in rows:
        ids = library.encode_ordinary(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(),
                     hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    back = bb.decode(bb.encode(docs)).collect()
    assert sorted(bytes(r.bytes) for r in back) == sorted((t or "").encode() for _, t, _ in rows)
    assert bb.encode(docs.limit(0)).count() == 0
