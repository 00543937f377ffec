"""Counts against the tokenizer on whole texts."""

import random

import numpy as np
import pyarrow as pa
import pytest

from termtrail.llm import token_counts, token_file

PARTS = ["ción", "Ñ", "ÅŁ", "ı", "×", "÷", "ȿ", "ɀ", "Ǆ", "a", "B", "the", "ing", " ", "  ", "\n", "\t", "\x1c", "'", "'s", "'t", "!", "...", "é", "É", "😀", "1", "23", "<|endoftext|>",
         "<|EndOfText|>", "<", "|", ">", "_", "İ", "ß", "́", " ", "中", "~", "`", "-", "\x00"]


@pytest.mark.parametrize("piece", [16, 64, 1 << 20])
def test_counts_equal_the_tokenizers(monkeypatch, piece):
    monkeypatch.setattr(token_counts, "_PIECE", piece)
    counter, library = token_counts.Counter(), token_file.encoder().library
    rnd = random.Random(piece)
    for _ in range(60):
        texts = ["".join(rnd.choice(PARTS) for _ in range(rnd.randrange(40))) for _ in range(30)] + [None, ""]
        want = [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
        assert counter.count(pa.array(texts, pa.string())).tolist() == want


def test_small_memory_and_long_texts(monkeypatch):
    monkeypatch.setattr(token_counts, "KNOWN", 5)
    counter, library = token_counts.Counter(), token_file.encoder().library
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice(["some", "Words", "here,", "x1"]) + str(i % 3) * (i % 2) for i in range(n)) for n in (0, 1, 400_000, 30)]
    texts.append("ab" * 200_000)
    assert counter.count(pa.array(texts)).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_known_runs_are_not_sorted_again(monkeypatch):
    counter = token_counts.Counter()
    texts = pa.array(["one two, three " * 500, None, "Three TWO ción 23 " * 500])
    want = counter.count(texts).tolist()
    sizes, unique = [], np.unique
    monkeypatch.setattr(np, "unique", lambda x, *a, **k: sizes.append(len(x)) or unique(x, *a, **k))
    assert counter.count(texts).tolist() == want
    assert max(sizes) <= len(texts)


def test_table_with_full_slots():
    """Hashes of equal leading bits, up to the last slot, are told apart and found again after growth."""
    rng = np.random.default_rng(3)
    known, want = token_counts.Known(4), {}
    for top in (0xFFFF << 48, 0x7777 << 48, 0):
        h = np.unique(rng.integers(1, 1 << 40, 50, dtype=np.uint64)) | np.uint64(top)
        counts, new = known.find(h)
        assert new.tolist() == list(range(len(h)))
        known.add(h, np.arange(len(h)) + 1)
        want |= dict(zip(h.tolist(), range(1, len(h) + 1), strict=True))
    every = np.array([*want, 12345 << 30], dtype=np.uint64)
    counts, new = known.find(every)
    assert counts[:-1].tolist() == list(want.values()) and new.tolist() == [len(want)] and known.rows == len(want)
