"""Benchmark decontamination with a generalised suffix automaton of the test items.

Items and documents are lower-cased (A-Z) and cut into words. The automaton of all items reads each
document word by word and keeps the longest suffix that occurs in an item. Where that reaches
``WINDOW`` words, or is a whole shorter item, the words of the passage are hit.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termtrail.llm import common

WINDOW = 13
COVERAGE = 20
PART_WORDS = 400_000
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def normalised(text: str | None) -> list[bytes]:
    """Words of a text: runs of digits, letters and anything beyond ASCII, A-Z lower-cased."""
    return (text or "").encode().translate(_FOLD).split()


class Automaton:
    """Generalised suffix automaton over word numbers, with the items of each window.

    ``windows[s]`` holds the items whose windows of ``window`` words belong to state ``s``;
    ``short[s]`` the items of fewer words that do, with their lengths.
    """

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(i, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws]) for i, ws in items if ws]
        for _, codes in coded:
            last = 0
            for c in codes:
                last = self._extend(last, c)
        self.windows: dict[int, set[str]] = {}
        self.short: dict[int, set[tuple[int, str]]] = {}
        for item, codes in coded:
            state = 0
            for i, c in enumerate(codes, 1):
                state = self.next[state][c]
                if i >= window:
                    self.windows.setdefault(self._holding(state, window), set()).add(item)
            if len(codes) < window:
                self.short.setdefault(self._holding(state, len(codes)), set()).add((len(codes), item))
        self.least = min([window, *(n for s in self.short.values() for n, _ in s)])
        self.shorter = [-1] * len(self.link)  # nearest suffix state that is a short item
        for s in sorted(range(len(self.link)), key=self.length.__getitem__):
            self.shorter[s] = s if s in self.short else self.shorter[self.link[s]] if s else -1
        self.run = re.compile(b"\x01{%d,}" % self.least)

    def _new(self, length: int, following: dict[int, int], link: int) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        clone = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new = self._new(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def _holding(self, state: int, n: int) -> int:
        """The suffix state of ``state`` that the last ``n`` words belong to."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def match(self, doc: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit passages (word positions, not yet merged) and the items that occur."""
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        known = self.vocabulary
        for run in self.run.finditer(bytes(map(known.__contains__, doc))):
            state = size = 0
            for i in range(run.start(), run.end()):
                c = known[doc[i]]
                while c not in self.next[state] and state:
                    state = self.link[state]
                    size = self.length[state]
                to = self.next[state].get(c)
                if to is None:
                    continue
                state, size = to, size + 1
                if size >= self.window:
                    spans.append((i + 1 - self.window, i + 1))
                    items |= self.windows[self._holding(state, self.window)]
                s = self.shorter[state]
                while s > 0:
                    for n, item in self.short[s]:
                        if n <= size:
                            spans.append((i + 1 - n, i + 1))
                            items.add(item)
                    s = self.shorter[self.link[s]]
        return spans, items


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    raw = text.encode()
    places = [m.span() for m in _WORD.finditer(raw)]
    out, at = [], 0
    for start, stop in spans:
        out.append(raw[at:places[start][0]])
        at = places[stop - 1][1]
    return b"".join([*out, raw[at:]]).decode()


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                  coverage: int = COVERAGE, part_words: int = PART_WORDS,
                  carry: list[str] | None = None) -> DataFrame:
    """``(id, n_words, hits, n_hit, items, contaminated, clean_text)`` for every row of ``docs``.

    ``hits`` are merged word spans, ``items`` the sorted ids of items with a window in the text,
    ``contaminated`` is ``n_hit > 0 and coverage * n_hit >= n_words``. ``clean_text`` lacks all hit
    passages. An item of fewer words than a window counts whole; one without words never occurs; a
    null item id is not named in ``items``, and equal ids are one item. Null texts have no words.
    Repeated rows get equal results, an empty table gives no row, an empty benchmark hits nothing.
    Columns of ``docs`` named in ``carry``, the text too, pass through; others are not read, and one
    named like a result raises.

    The automaton is sent to all tasks, so its size is bounded: a benchmark of more than
    ``part_words`` words is dealt into parts by item, and the documents pass once for each part.
    """
    spark = docs.sparkSession
    carried = [c for c in carry or [] if c != id_col]
    clash = {"n_words", "hits", "n_hit", "items", "contaminated", "clean_text"} & {id_col, text_col, *carried}
    if clash:
        raise ValueError(f"rename these columns first: {sorted(clash)}")
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text"))
    size = items.agg(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), r"[^0-9A-Za-z\x{80}-\x{10FFFF}]+")))).first()[0]
    parts = max(1, -(-(size or 0) // part_words))
    names = list(dict.fromkeys([id_col, text_col, *carried]))
    base = ", ".join(f"`{c}` {kinds[c]}" for c in names)
    now = docs.select(*names)
    for part in range(parts):
        own = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part).collect()
        sent = spark.sparkContext.broadcast(Automaton(((r.item, normalised(r.text)) for r in own), window))
        first, last = part == 0, part == parts - 1
        now = now.mapInArrow(_pass(sent, names, first), f"{base}, hits array<struct<start: bigint, stop: bigint>>, items array<string>")
        if not last:
            now = common.stored(now, "hits")
    return now.mapInArrow(_judge(id_col, text_col, carried, coverage), ", ".join([
        f"`{id_col}` {kinds[id_col]}", "n_words bigint", "hits array<struct<start: bigint, stop: bigint>>",
        "n_hit bigint", "items array<string>", "contaminated boolean", "clean_text string",
        *(f"`{c}` {kinds[c]}" for c in carried)]))


def _pass(sent, names: list[str], first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = sent.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            before = zip(batch.column("hits").to_pylist(), batch.column("items").to_pylist(), strict=True) if not first else [((), ())] * len(texts)
            hits, items = [], []
            for text, (old_hits, old_items) in zip(texts, before, strict=True):
                spans, found = automaton.match(normalised(text))
                spans += [(s["start"], s["stop"]) for s in old_hits]
                hits.append([{"start": a, "stop": b} for a, b in merged(spans)])
                items.append(sorted({i for i in found if i is not None} | set(old_items)))
            yield pa.record_batch([*(batch.column(n) for n in names), pa.array(hits, _SPANS),
                                   pa.array(items, pa.list_(pa.string()))], [*names, "hits", "items"])
    return run


def _judge(id_col: str, text_col: str, carried: list[str], coverage: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, hits = batch.column(text_col).to_pylist(), batch.column("hits").to_pylist()
            spans = [[(s["start"], s["stop"]) for s in h] for h in hits]
            n_words = np.array([len(normalised(t)) for t in texts], dtype=np.int64)
            n_hit = np.array([sum(b - a for a, b in s) for s in spans], dtype=np.int64)
            clean = [without(t, s) if s else t for t, s in zip(texts, spans, strict=True)]
            yield pa.record_batch([
                batch.column(id_col), pa.array(n_words), batch.column("hits"), pa.array(n_hit), batch.column("items"),
                pa.array((n_hit > 0) & (coverage * n_hit >= n_words)), pa.array(clean, pa.string()),
                *(batch.column(c) for c in carried)],
                [id_col, "n_words", "hits", "n_hit", "items", "contaminated", "clean_text", *carried])
    return run


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                          spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'),
        lambda x: x <> '') AS ws FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'),
        lambda x: x <> '') AS ws FROM benchmark),
item_win AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS seq FROM (
    SELECT item_id, ws, least(len(ws), 13) AS n, unnest(range(1, len(ws) - least(len(ws), 13) + 2)) AS i
    FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM item_win),
doc_win AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS seq FROM (
    SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes WHERE len(ws) >= n)),
hit AS (SELECT w.doc_id, w.n, w.i, t.item_id FROM doc_win w JOIN item_win t ON w.n = t.n AND w.seq = t.seq),
marked AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit
           FROM (SELECT doc_id, i, unnest(range(0, n)) AS k FROM (SELECT DISTINCT doc_id, n, i FROM hit)) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item COLLATE "C") AS items
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(m.n_hit, 0)::BIGINT AS n_hit,
       coalesce(n.n_items, 0)::BIGINT AS n_items, sha256(coalesce(n.items, '')) AS items_sha256,
       coalesce(m.n_hit > 0 AND 20 * m.n_hit >= len(d.ws), false) AS contaminated
FROM d LEFT JOIN marked m ON m.doc_id = d.doc_id LEFT JOIN named n ON n.doc_id = d.doc_id
"""
