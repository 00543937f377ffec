"""Byte-level BPE by a hierarchical-bitmap rank queue, and decoding.

A text is cut into pre-tokens; within each, the neighbouring pair whose bytes have the lowest rank
merges first, the leftmost of equal ones, until no pair is in the vocabulary.

All pre-tokens of a slice that were not met before are merged together: their symbols form one
doubly linked list, with a border after each pre-token. A queue has one bucket of list positions
for each merge rank, and a bitmap over the ranks in three levels of 64-bit words: finding the first
set bit at each level gives the next rank. A bucket's positions are taken in text order. A position
whose pair has changed since it was put in is stale and skipped. A merge that brings up a lower rank
sends the rest of its bucket back, so that within each pre-token the order of merges is that of a
search for the lowest rank. Work is in proportion to the merges and not to the square of the
length, so a pre-token may be very long.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termtrail.llm import common, words

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
_SLICE = 1 << 20
_KNOWN = 1 << 18
_MERGED = 1 << 18
_WORD = 64

# Letters and numbers that Unicode assigned after version 16. The rank file's own
# library does not know them; to it they are neither.
NEWER = (
    r"\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    r"\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a"
    r"\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686"
    r"\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda"
    r"\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128"
    r"\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff"
    r"\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4"
    r"\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)


class RankQueue:
    """Positions in buckets by rank. ``pop`` gives the lowest rank and all its positions."""

    def __init__(self, ranks: int):
        self.buckets: dict[int, list[int]] = {}
        size = max(1, -(-ranks // _WORD))
        self.low = [0] * size
        self.mid = [0] * max(1, -(-size // _WORD))
        self.top = 0

    def push(self, rank: int, position: int) -> None:
        held = self.buckets.get(rank)
        if held is not None:
            held.append(position)
            return
        self.fill(rank, [position])

    def fill(self, rank: int, positions: list[int]) -> None:
        """Makes ``positions`` the bucket of a rank that has none."""
        self.buckets[rank] = positions
        a = rank >> 6
        self.low[a] |= 1 << (rank & 63)
        self.mid[a >> 6] |= 1 << (a & 63)
        self.top |= 1 << (a >> 6)

    def pop(self) -> tuple[int, list[int]] | None:
        if not self.top:
            return None
        c = (self.top & -self.top).bit_length() - 1
        word = self.mid[c]
        b = c << 6 | (word & -word).bit_length() - 1
        word = self.low[b]
        rest = word & (word - 1)
        rank = b << 6 | (word & -word).bit_length() - 1
        self.low[b] = rest
        if not rest:
            self.mid[c] &= ~(1 << (b & 63))
            if not self.mid[c]:
                self.top &= ~(1 << c)
        return rank, self.buckets.pop(rank)


class Vocabulary:
    """Byte strings and ranks of a rank file, and the rank of each pair of tokens that joins to one."""

    def __init__(self, path: str):
        self.ranks: dict[bytes, int] = {}
        with open(path, "rb") as lines:
            for line in lines:
                if line.strip():
                    token, rank = line.split()
                    self.ranks[base64.b64decode(token)] = int(rank)
        self.size = max(self.ranks.values()) + 1
        self.text = [b""] * self.size
        for token, rank in self.ranks.items():
            self.text[rank] = token
        self.single = [self.ranks.get(bytes([b]), -1) for b in range(256)]
        if min(self.single) < 0:
            raise ValueError(f"{path} lacks some single bytes")
        # rank of a pair, by its left token and then its right one, and the other way about
        self.by_left: dict[int, dict[int, int]] = {}
        self.by_right: dict[int, dict[int, int]] = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.by_left.setdefault(left, {})[right] = rank
                    self.by_right.setdefault(right, {})[left] = rank
        self._single = np.array(self.single, dtype=np.int64)
        self._pair = np.full((256, 256), -1, dtype=np.int64)
        for token, rank in self.ranks.items():
            if len(token) == 2:
                self._pair[token[0], token[1]] = rank

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece, as little-endian unsigned 32-bit integers; pieces are not empty."""
        border = -1  # an id that no pair has
        data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        ends = np.cumsum([len(p) for p in pieces])
        n = len(data)
        # a node for each byte and one border (id -1) behind each piece
        place = np.arange(n) + np.searchsorted(ends, np.arange(n), side="right")
        total = n + len(pieces)
        own = np.full(total, border, dtype=np.int64)
        own[place] = self._single[data]
        rank = np.full(total, -1, dtype=np.int64)
        if n > 1:
            beside = np.diff(place) == 1
            rank[place[:-1][beside]] = self._pair[data[:-1], data[1:]][beside]
        queue = RankQueue(self.size)
        starts = np.flatnonzero(rank >= 0)
        starts = starts[np.argsort(rank[starts], kind="stable")]
        if len(starts):
            first = np.flatnonzero(np.diff(rank[starts], prepend=-1))
            for r, bucket in zip(rank[starts[first]].tolist(), np.split(starts, first[1:]), strict=True):
                queue.fill(r, bucket.tolist())
        node, best = own.tolist(), rank.tolist()  # id of each node, rank of the pair that starts there
        # the last node is a border, so no merge runs over the end, and -1 before the first means a border too
        after, ahead = list(range(1, total + 1)), list(range(-1, total - 1))
        buckets, fill = queue.buckets, queue.fill
        nothing: dict[int, int] = {}
        while (taken := queue.pop()) is not None:
            lowest, bucket = taken
            bucket.sort()
            to_right, to_left = self.by_left.get(lowest, nothing).get, self.by_right.get(lowest, nothing).get
            for i, at in enumerate(bucket):
                if best[at] != lowest:  # stale: merged away or changed
                    continue
                gone, left = after[at], ahead[at]
                right = after[gone]
                node[at], node[gone], best[gone] = lowest, -2, -1
                after[at], ahead[right] = right, at
                least = lowest
                r = to_right(node[right])
                if r is None:
                    best[at] = -1
                else:
                    best[at] = r
                    held = buckets.get(r)
                    if held is None:
                        fill(r, [at])
                    else:
                        held.append(at)
                    if r < least:
                        least = r
                r = to_left(node[left])
                if r is None:
                    best[left] = -1
                else:
                    best[left] = r
                    held = buckets.get(r)
                    if held is None:
                        fill(r, [left])
                    else:
                        held.append(left)
                    if r < least:
                        least = r
                if least < lowest:  # a lower rank came up: the rest of the bucket waits
                    rest = bucket[i + 1:]
                    if rest:
                        fill(lowest, rest)
                    break
        ids = np.array(node, dtype=np.int64)
        alive = ids[ids != -2]
        borders = np.flatnonzero(alive == border)
        raw = alive.astype("<u4").tobytes()
        begin = np.concatenate(([0], borders[:-1] + 1))
        return [raw[4 * b:4 * e] for b, e in zip(begin.tolist(), borders.tolist(), strict=True)]


def _spans(found: list[str]) -> str:
    """Characters in ascending order as the inside of a character class."""
    points = np.array([ord(c) for c in found])
    cut = np.flatnonzero(np.diff(points) > 1)
    return "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in zip(
        points[np.concatenate(([0], cut + 1))], points[np.concatenate((cut, [len(points) - 1]))], strict=True))


def _spelled(pattern: str, characters: str) -> str:
    """A pattern with letters, numbers and white space as ranges of these characters, as in Unicode 16."""
    inside = {c: _spans(regex.findall(rf"[{c}--[{NEWER}]]", characters, regex.V1)) for c in (r"\p{L}", r"\p{N}", r"\s")}
    out, depth = [], 0
    for token in re.findall(r"\\p\{\w+\}|\\.|.", pattern, re.DOTALL):
        depth += (token == "[") - (token == "]")
        if token in inside:
            token = inside[token] if depth else f"[{inside[token]}]"
        elif token == r"\S" and not depth:
            token = f"[^{inside[r'\s']}]"
        out.append(token)
    return "".join(out)


@functools.lru_cache(maxsize=4)
def splitter(pattern: str) -> Callable[[str], list[str]]:
    """``findall`` of a pattern, with letters, numbers and white space as in Unicode 16.

    The standard library's engine is the faster one where classes are short or lie in the basic
    plane, so texts of ASCII and of that plane have their own spelling of the pattern. All others,
    and patterns of further classes, are left to the engine that knows the classes by name.
    """
    named = pattern.replace(r"\p{L}", rf"[\p{{L}}--[{NEWER}]]").replace(r"\p{N}", rf"[\p{{N}}--[{NEWER}]]")
    whole = regex.compile(named, regex.V1).findall
    if r"\p" in re.sub(r"\\p\{[LN]\}", "", pattern).lower():
        return whole
    ascii_only = re.compile(_spelled(pattern, "".join(map(chr, range(128))))).findall
    basic = re.compile(_spelled(pattern, "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)])))).findall
    beyond = re.compile("[\U00010000-\U0010ffff]").search

    def cut(text: str) -> list[str]:
        return (ascii_only if text.isascii() else whole if beyond(text) else basic)(text)
    return cut


class Coder:
    """Encodes and decodes whole texts; keeps the ids of pre-tokens it has met, up to ``_KNOWN``."""

    def __init__(self, path: str, pattern: str):
        self.vocabulary = Vocabulary(path)
        self.cut = splitter(pattern)
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        found = [self.cut(t) for t in texts]
        known = self.known
        if len(known) > _KNOWN:
            known.clear()
        whole = self.vocabulary.ranks.get
        open_: list[tuple[str, bytes]] = []
        size = 0
        for piece in set().union(*found).difference(known):
            raw = piece.encode()
            rank = whole(raw)
            if rank is not None:
                known[piece] = rank.to_bytes(4, "little")
                continue
            open_.append((piece, raw))
            size += len(raw)
            if size >= _MERGED:
                self._learn(open_)
                open_, size = [], 0
        self._learn(open_)
        return [b"".join(map(known.__getitem__, pieces)) for pieces in found]

    def _learn(self, pieces: list[tuple[str, bytes]]) -> None:
        if pieces:
            self.known.update(zip((p for p, _ in pieces), self.vocabulary.merge([raw for _, raw in pieces]), strict=True))

    def decode(self, ids: bytes) -> bytes:
        """Bytes of a sequence of ids in the same form."""
        return b"".join(map(self.vocabulary.text.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@functools.lru_cache(maxsize=4)
def coder(path: str = RANKS, pattern: str = PATTERN) -> Coder:
    return Coder(path, pattern)


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of about ``_SLICE`` bytes of text; a longer text is a slice of its own."""
    _, offsets = words.text_bytes(batch.column(column))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + _SLICE, side="right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS,
           pattern: str = PATTERN) -> DataFrame:
    """``(id, ids)`` of every row: token ids as little-endian unsigned 32-bit integers.

    Each match of ``pattern`` is merged by itself, without special tokens; a match that is a token
    is that token. Null and empty texts have no ids (an empty binary), null ids stay null, repeated
    rows give repeated results, an empty table gives none, further columns are not read. One narrow
    pass; memory is in proportion to the longest text. ``ranks`` must lie at this path on each executor.
    """
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(ranks, pattern)
        for batch in batches:
            for part in _slices(batch, 1):
                texts = [t or "" for t in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), pa.array(own.encode(texts), pa.binary())], ["id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        words.tidy(run), "id long, ids binary").withColumnRenamed("id", id_col)


def decode(rows: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", ranks: str = RANKS,
           pattern: str = PATTERN) -> DataFrame:
    """``(id, bytes)`` of every row of ``encode``: the bytes its ids stand for. Null ids give no bytes.

    An id that the rank file lacks raises. Repeated rows give repeated results, an empty table none.
    """
    common.ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(ranks, pattern)
        for batch in batches:
            for part in (batch.slice(lo, 256) for lo in range(0, batch.num_rows, 256)):
                raw = [own.decode(x or b"") for x in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), pa.array(raw, pa.binary())], ["id", "bytes"])

    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids")).mapInArrow(
        words.tidy(run), "id long, bytes binary").withColumnRenamed("id", id_col)


def digests(docs: DataFrame) -> DataFrame:
    """Counts and checksums of the ids of each document and of the bytes they decode to."""
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder()
        for batch in batches:
            for part in (batch.slice(lo, 256) for lo in range(0, batch.num_rows, 256)):
                raw = [own.decode(x) for x in part.column(1).to_pylist()]
                yield pa.record_batch([*part.columns, pa.array(raw, pa.binary())], ["doc_id", "ids", "bytes"])

    both = encode(docs).mapInArrow(words.tidy(run), "doc_id long, ids binary, bytes binary")
    return both.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("bytes", 256).alias("decoded_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
