"""Removal of repeated passages by fixed-block anchors.

Reference blocks are the non-overlapping runs of ``BLOCK`` words of every document. They are indexed
by hash, and every rolling run of ``BLOCK`` words of every document probes the index. Any repeat of
``2 * BLOCK`` words or more holds a whole reference block, so each such repeat has an anchor. Around
an anchor the hit extends, word by word, as long as the rolling runs occur elsewhere too: to the
maximal stretch that can be an exact repeat. Only windows within such stretches are then compared
in full, by 96 bits of their word sequence, to find the earliest occurrence of each.

Index and probes meet in hash buckets. Each pack of documents sends a bucket its distinct hashes
once, so a run that occurs in a third of all documents costs a bucket one entry for each pack. A
bucket answers with bits in the order of what it was sent; locations never travel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termtrail.llm import common, packs, words

WINDOW = 20
EXTRA_BITS = 34
RANGE_HASHES = 1 << 18


class _Anchors:
    """Distinct rolling runs of a pack, each with its flags, and where each word start finds its own."""

    def __init__(self, h: np.ndarray, before: np.ndarray, block: int, bits: int):
        self.valid = words.inside(before, block)
        g = words.mix(words.grams(h, block)) >> words.U(64 - EXTRA_BITS - bits)
        at = np.arange(int(before[-1])) - np.repeat(before[:-1], np.diff(before))
        aligned = (at[:len(g)] % block == 0)[self.valid]
        self.values, self.inverse, counts = np.unique(g[self.valid], return_inverse=True, return_counts=True)
        self.many = counts > 1
        self.indexed = np.zeros(len(self.values), dtype=bool)
        self.indexed[self.inverse[aligned]] = True
        self.buckets, self.cuts = packs.bucket_edges(self.values, EXTRA_BITS + bits, bits)

    def spread(self, replies: list, names: tuple[str, ...]) -> list[np.ndarray]:
        """Reply bits laid out by word start (length: runs of the pack)."""
        found = [np.zeros(len(self.values), dtype=bool) for _ in names]
        place = {int(b): i for i, b in enumerate(self.buckets)}
        for reply in replies or []:
            i = place[reply["bucket"]]
            lo, hi = self.cuts[i], self.cuts[i + 1]
            for flags, name in zip(found, names, strict=True):
                flags[lo:hi] = packs.flags_of(reply[name], hi - lo)
        out = []
        for flags in found:
            laid = np.zeros(len(self.valid), dtype=bool)
            laid[self.valid] = flags[self.inverse]
            out.append(laid)
        return out


class _Pack:
    """One pack of documents: its words, and the windows that may be repeats."""

    def __init__(self, blob: bytes, text_col: str, window: int, bits: int):
        self.table = packs.unpack(blob)
        data, offsets = words.text_bytes(self.table[text_col])
        self.h, self.before = words.word_hashes(data, offsets)
        self.window, self.block, self.bits = window, window // 2, bits
        self.anchors = _Anchors(self.h, self.before, self.block, bits)

    def windows(self, replies: list) -> None:
        """Positions of candidate windows, their distinct sequences and the first of each."""
        shared, anchored = self.anchors.spread(replies, ("shared", "anchored"))
        self.anchors = None  # not needed any more
        span = self.window - self.block + 1
        runs = lambda flags: np.concatenate(([0], np.cumsum(flags)))
        a, s = runs(anchored), runs(shared)
        fits = words.inside(self.before, self.window)
        n = len(fits)
        ok = fits & (a[span:span + n] > a[:n]) & (s[span:span + n] - s[:n] == span) if n else fits
        self.at = np.flatnonzero(ok)
        first = words.mix(words.grams(self.h, self.window)[self.at])
        second = words.mix(words.grams(self.h, self.window, seed=0x5851F42D4C957F2D)[self.at] ^ words.U(0xA5A5))
        pair = np.empty(len(self.at), dtype=[("a", "<u8"), ("b", "<u4")])
        pair["a"], pair["b"] = first, (second >> words.U(32)).astype(np.uint32)
        order = np.lexsort((self.at, pair["b"], pair["a"]))
        ranked = pair[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = ranked[1:] != ranked[:-1]
        self.first = self.at[order[new]]
        self.values = ranked[new]
        self.inverse = np.empty(len(order), dtype=np.int64)
        self.inverse[order] = np.cumsum(new) - 1
        self.buckets, self.cuts = packs.bucket_edges(self.values["a"], 64, self.bits)

    def repeats(self, replies: list) -> np.ndarray:
        """Word positions covered by windows that occur earlier; call after ``windows``."""
        foreign = np.zeros(len(self.values), dtype=bool)
        place = {int(b): i for i, b in enumerate(self.buckets)}
        for reply in replies or []:
            lo, hi = self.cuts[place[reply["bucket"]]], self.cuts[place[reply["bucket"]] + 1]
            foreign[lo:hi] = packs.flags_of(reply["earlier"], hi - lo)
        again = foreign[self.inverse] | (self.first[self.inverse] != self.at)
        delta = np.zeros(len(self.h) + 1, dtype=np.int64)
        start = self.at[again]
        np.add.at(delta, start, 1)
        np.add.at(delta, start + self.window, -1)
        return np.cumsum(delta[:-1]) > 0


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    """One row after another. What a pack took goes back to the system before the next is opened:
    callers drop it at the end of a turn."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield [c[i].as_py() for c in batch.columns]
            words.release()


def _find_anchors(text_col: str, window: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, blob in _rows(batches):
            x = _Pack(blob, text_col, window, bits).anchors
            cut = list(zip(x.cuts[:-1], x.cuts[1:], strict=True))
            found = pa.record_batch([
                pa.array(x.buckets, pa.int64()), pa.array([number] * len(cut), pa.int64()),
                pa.array([packs.deltas(x.values[lo:hi]) for lo, hi in cut], pa.binary()),
                pa.array([packs.bits_of(x.indexed[lo:hi]) for lo, hi in cut], pa.binary()),
                pa.array([packs.bits_of(x.many[lo:hi]) for lo, hi in cut], pa.binary())],
                ["bucket", "batch", "hashes", "indexed", "many"])
            del x
            yield found
    return run


def _gathered(table: pa.Table) -> tuple[list[int], list[np.ndarray], np.ndarray]:
    """Batches, their hashes, and the borders between them in the concatenation."""
    hashes = [packs.from_deltas(x) for x in table["hashes"].to_pylist()]
    return table["batch"].to_pylist(), hashes, np.concatenate(([0], np.cumsum([len(x) for x in hashes])))


def _ranges(hashes: list[np.ndarray], border: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of one range of values after another, and their places in the concatenation.

    Each batch's hashes are sorted, so a range is a slice of each; sorting one range at a time keeps
    the memory of a bucket near that of its hashes.
    """
    some = [x for x in hashes if len(x)]
    if not some:
        return
    parts = -(-int(border[-1]) // RANGE_HASHES)
    least, most = int(min(x[0] for x in some)), int(max(x[-1] for x in some))
    cuts = np.array([least + (most - least) * k // parts for k in range(1, parts)], dtype=np.uint64)
    edges = [np.concatenate(([0], np.searchsorted(x, cuts), [len(x)])) for x in hashes]
    for k in range(parts):
        values = np.concatenate([x[e[k]:e[k + 1]] for x, e in zip(hashes, edges, strict=True)])
        places = np.concatenate([np.arange(b + e[k], b + e[k + 1]) for b, e in zip(border[:-1], edges, strict=True)])
        if len(values):
            yield values, places


def _meet(key: tuple, table: pa.Table) -> pa.Table:
    """For one bucket: which hashes occur more than once, and which of those are reference blocks."""
    batches, hashes, border = _gathered(table)
    indexed, twice = (np.concatenate([packs.flags_of(b, len(x)) for b, x in zip(table[c].to_pylist(), hashes, strict=True)])
                      for c in ("indexed", "many"))
    shared, anchored = np.zeros(len(indexed), dtype=bool), np.zeros(len(indexed), dtype=bool)
    for values, places in _ranges(hashes, border):
        order = np.argsort(values)
        values, places = values[order], places[order]
        start = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
        size = np.diff(np.append(start, len(values)))
        many = (size > 1) | np.logical_or.reduceat(twice[places], start)
        shared[places] = np.repeat(many, size)
        anchored[places] = np.repeat(many & np.logical_or.reduceat(indexed[places], start), size)
    del hashes
    keep = [i for i in range(len(batches)) if shared[border[i]:border[i + 1]].any()]
    cut = [slice(border[i], border[i + 1]) for i in keep]
    words.release()
    return pa.table({"batch": pa.array([batches[i] for i in keep], pa.int64()),
                     "bucket": pa.array([key[0].as_py()] * len(keep), pa.int64()),
                     "shared": pa.array([packs.bits_of(shared[c]) for c in cut], pa.binary()),
                     "anchored": pa.array([packs.bits_of(anchored[c]) for c in cut], pa.binary())})


def _find_windows(id_col: str, text_col: str, window: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, blob, replies in _rows(batches):
            if not replies:
                continue
            x = _Pack(blob, text_col, window, bits)
            x.windows(replies)
            row = np.searchsorted(x.before, x.first, side="right") - 1
            ids = x.table[id_col].cast(pa.int64()).fill_null(common.LOWEST).to_numpy()[row]
            cut = list(zip(x.cuts[:-1], x.cuts[1:], strict=True))
            found = pa.record_batch([
                pa.array(x.buckets, pa.int64()), pa.array([number] * len(cut), pa.int64()),
                pa.array([packs.deltas(x.values["a"][lo:hi]) for lo, hi in cut], pa.binary()),
                pa.array([packs.planes(x.values["b"][lo:hi]) for lo, hi in cut], pa.binary()),
                pa.array([packs.planes(ids[lo:hi]) for lo, hi in cut], pa.binary())],
                ["bucket", "batch", "hashes", "more", "ids"])
            del x, row, ids
            yield found
    return run


def _earliest(key: tuple, table: pa.Table) -> pa.Table:
    """For one bucket: which distinct windows of a batch occur earlier in another batch."""
    batches, hashes, border = _gathered(table)
    whole = lambda name, dtype: np.concatenate([packs.from_planes(x, dtype) for x in table[name].to_pylist()])
    a, b, ids = np.concatenate(hashes), whole("more", "<u4"), whole("ids", "<i8")
    number = np.repeat(np.array(batches, dtype=np.int64), np.diff(border))
    order = np.lexsort((number, ids, b, a))
    later = np.zeros(len(order), dtype=bool)
    later[1:] = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
    earlier = np.empty(len(order), dtype=bool)
    earlier[order] = later
    del hashes, a, b, ids, number, order, later
    words.release()
    keep = [i for i in range(len(batches)) if earlier[border[i]:border[i + 1]].any()]
    return pa.table({"batch": pa.array([batches[i] for i in keep], pa.int64()),
                     "bucket": pa.array([key[0].as_py()] * len(keep), pa.int64()),
                     "earlier": pa.array([packs.bits_of(earlier[border[i]:border[i + 1]]) for i in keep], pa.binary())})


def _cut_out(id_col: str, text_col: str, window: int, bits: int, carried: list[str], tidy: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blob, replies, later in _rows(batches):
            x = _Pack(blob, text_col, window, bits)
            x.windows(replies)
            gone, table, before = x.repeats(later), x.table, x.before
            del x
            step = 512
            span_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            for at in range(0, table.num_rows, step):
                part = table.slice(at, step)
                kept, spans = [], []
                for i, text in enumerate(part[text_col].cast(pa.large_string()).to_pylist(), at):
                    lo, hi = int(before[i]), int(before[i + 1])
                    own = (text or "").encode().split()
                    flags = gone[lo:hi]
                    if flags.any():
                        edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
                        spans.append([{"start": int(s), "stop": int(e)} for s, e in edge.reshape(-1, 2)])
                        own = [w for w, f in zip(own, flags.tolist(), strict=True) if not f]
                    else:
                        spans.append([])
                    kept.append(b" ".join(own).decode() if tidy or flags.any() else text)
                yield pa.record_batch([
                    part[id_col].combine_chunks(), pa.array(np.diff(before[at:at + step + 1])),
                    pa.array(spans, span_type), pa.array(kept, pa.string()), *(part[c].combine_chunks() for c in carried)],
                    [id_col, "n_words", "removed", "kept_text", *carried])
            del gone, table, before
    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   carry: list[str] | None = None, tidy: bool = True) -> DataFrame:
    """``(id, n_words, removed, kept_text)`` and the columns named in ``carry``, for every row.

    Words are runs of anything but ASCII white space, unchanged. A word goes if it lies in a window
    of ``window`` words (an even number) that also starts earlier: in a row with a smaller id, or
    earlier in the same row. All windows are judged on the input. ``removed`` holds word spans,
    ``kept_text`` the other words joined by one space; without ``tidy``, a text that loses nothing
    stays as it is. Null texts have no words; null ids come
    first; rows of equal id count in order of pack, so of two equal rows one keeps its words. An
    empty table gives no row. Columns not in ``carry`` are not read.
    """
    if window % 2 or window < 4:
        raise ValueError("window must be an even number of words")
    carried = [c for c in carry or [] if c not in (id_col, text_col)]
    common.ship(docs.sparkSession)
    clash = {"n_words", "removed", "kept_text"} & {id_col, *carried}
    if clash:
        raise ValueError(f"rename these columns first: {sorted(clash)}")
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    packed = packs.pack(docs.select(id_col, text_col, *carried), id_col, text_col)
    bits = packs.bucket_bits(packed)
    sent = packed.select("batch", "blob").mapInArrow(
        words.tidy(_find_anchors(text_col, window, bits)), "bucket bigint, batch bigint, hashes binary, indexed binary, many binary")
    met = common.stored(sent.groupBy("bucket").applyInArrow(
        _meet, "batch bigint, bucket bigint, shared binary, anchored binary"), "anchors")
    met = met.groupBy("batch").agg(F.collect_list(F.struct("bucket", "shared", "anchored")).alias("replies"))
    known = packed.select("batch", "blob").join(met, "batch", "left")
    sent = known.select("batch", "blob", "replies").mapInArrow(
        words.tidy(_find_windows(id_col, text_col, window, bits)),
        "bucket bigint, batch bigint, hashes binary, more binary, ids binary")
    later = common.stored(sent.groupBy("bucket").applyInArrow(
        _earliest, "batch bigint, bucket bigint, earlier binary"), "repeats")
    later = later.groupBy("batch").agg(F.collect_list(F.struct("bucket", "earlier")).alias("later"))
    schema = ", ".join([f"`{id_col}` {kinds[id_col]}", "n_words bigint",
                        "removed array<struct<start: bigint, stop: bigint>>", "kept_text string",
                        *(f"`{c}` {kinds[c]}" for c in carried)])
    return (packed.select("batch", "blob").join(met, "batch", "left").join(later, "batch", "left")
            .select("blob", "replies", "later")
            .mapInArrow(words.tidy(_cut_out(id_col, text_col, window, bits, carried, tidy)), schema))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s.stop - s.start)
    return done.select("doc_id", "n_words", gone.alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'),
                                      lambda x: x <> '') AS ws FROM documents),
win AS (SELECT doc_id, i AS pos, ws[i:i + 19] AS seq
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
again AS (SELECT doc_id, pos FROM win
          QUALIFY row_number() OVER (PARTITION BY seq ORDER BY doc_id, pos) > 1),
gone AS (SELECT DISTINCT doc_id, pos + k AS pos FROM again, range(0, 20) AS r(k)),
each_word AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM w),
kept AS (SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.pos) AS text
         FROM each_word e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.pos = e.pos
         WHERE g.pos IS NULL GROUP BY e.doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, coalesce(lost.n, 0)::BIGINT AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id LEFT JOIN lost ON lost.doc_id = w.doc_id
"""
