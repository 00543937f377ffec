"""Periodic runs of words: multi-scale minimizers seed maximal repetitions.

A run is a stretch of consecutive words whose smallest period is ``q`` (words ``q`` apart are
identical), of ``max(LEAST, 2 * q)`` words or more, that no neighbouring word extends.

Periods below ``SHORT`` are found by comparing the text with itself at each lag. Longer ones are
found scale by scale. At the scale of periods from ``s`` to ``2s - 1``, ``k = s / 2`` words make a
gram, and each window of ``k + 1`` grams (``s`` words) selects its smallest hash, rightmost on ties.
The first window of a run and the one a period later hold the same words, so both select the same
gram, one period apart: pairs of equal minimizers at distances of the scale seed all its runs. A
seed is extended word by word to its maximal stretch.

Inside a run of a much shorter period, equal minimizers follow each other in small steps. Such a
chain is one seed: pairs within it are multiples of the short period, and two chains are paired
once for each distance between them, so seeds stay in proportion to the words.

All texts of a slice are searched as one sequence, with a separator of its own after each: no run
crosses one. Texts too short for a scale leave the sequence.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termtrail.llm import common, words

LEAST = 12
SHORT = 16
WORD = r"[^\x20\x09-\x0D]+"
_SLICE = 1 << 21
_SEPARATOR = words.U(0x5851F42D4C957F2D)
_LEFT = words.U(0x9E3779B97F4A7C15)


def _stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Beginnings and ends of the runs of true values."""
    at = np.flatnonzero(same)
    if not len(at):
        return at, at
    cut = np.flatnonzero(np.diff(at) > 1)
    return at[np.concatenate(([0], cut + 1))], at[np.concatenate((cut, [len(at) - 1]))] + 1


def _minimizers(grams: np.ndarray, window: int) -> np.ndarray:
    """Positions of the smallest hash of every window, rightmost on ties, each once."""
    bits = max(1, int(len(grams)).bit_length())
    place = words.U((1 << bits) - 1)
    # high bits of the hash, then the position from the right: all keys differ
    key = (grams & ~place) | (place - np.arange(len(grams), dtype=np.uint64))
    width = 1
    least = key
    while 2 * width <= window:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < window:
        least = np.minimum(least[:-(window - width)], least[window - width:])
    chosen = least[np.concatenate(([True], least[1:] != least[:-1]))] if len(least) else least
    return np.unique(place - (chosen & place)).astype(np.int64)


def _seeds(grams: np.ndarray, at: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and distances (``scale`` to ``2 * scale - 1``) that reach each run of the scale."""
    order = np.lexsort((at, grams[at]))
    at = at[order]
    hashes = grams[at]
    equal = hashes[1:] == hashes[:-1]
    if not equal.any():
        return at[:0], at[:0]
    gap = np.diff(at)
    chained = equal & (gap <= scale // 4)
    first = np.flatnonzero(np.concatenate(([True], ~chained)))
    last = np.concatenate((first[1:] - 1, [len(at) - 1]))
    group = np.cumsum(np.concatenate(([0], ~equal)))
    # one step for all chains of a hash: the greatest common divisor of their gaps
    step = np.zeros(group[-1] + 1, dtype=np.int64)
    if chained.any():
        owner, gaps = group[1:][chained], gap[chained]
        starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        step[owner[starts]] = np.gcd.reduceat(gaps, starts)
    lo, hi, of = at[first], at[last], group[first]
    step = np.maximum(step[of], 1)
    found_at, found_lag = [], []
    j, left = 1, np.arange(len(lo))
    while True:
        left = left[left + j < len(lo)]
        left = left[(of[left + j] == of[left]) & (lo[np.minimum(left + j, len(lo) - 1)] - hi[left] < 2 * scale)]
        if not len(left):
            break
        a, b, g = left, left + j, step[left]
        # distances of a chain pair: lo[b] - lo[a] + t * g, from its first's last to its second's last place
        down, up = (hi[a] - lo[a]) // g, (hi[b] - lo[b]) // g
        count = down + up + 1
        t = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count + down, count)
        g = np.repeat(g, count)
        lag = np.repeat(lo[b] - lo[a], count) + t * g
        place = np.repeat(lo[a], count) + np.maximum(-t, 0) * g
        keep = (lag >= scale) & (lag < 2 * scale)
        found_at.append(place[keep])
        found_lag.append(lag[keep])
        j += 1
    if not found_at:
        return at[:0], at[:0]
    return np.concatenate(found_at), np.concatenate(found_lag)


def _reach(h: np.ndarray, a: int, q: int, step: int) -> int:
    """How many words from ``a`` on, in the direction of ``step``, equal those ``q`` further on."""
    n, width = 0, 32
    room = len(h) - q - a if step > 0 else a + 1
    while n < room:
        width = min(width, room - n)
        if step > 0:
            x, y = h[a + n:a + n + width], h[a + q + n:a + q + n + width]
        else:
            x, y = h[a - n - width + 1:a - n + 1][::-1], h[a + q - n - width + 1:a + q - n + 1][::-1]
        wrong = x != y
        if wrong.any():
            return n + int(wrong.argmax())
        n += width
        width *= 2
    return n


def _extended(h: np.ndarray, at: np.ndarray, lag: np.ndarray) -> list[tuple[int, int, int]]:
    """Maximal stretches ``(start, end, period)`` that the seeds lie in, each extended once."""
    order = np.lexsort((at, lag))
    at, lag = at[order], lag[order]
    out = []
    i = 0
    while i < len(at):
        m, q = int(at[i]), int(lag[i])
        right = _reach(h, m, q, 1)
        if right:
            start, end = m - _reach(h, m - 1, q, -1) if m else m, m + right
            if end + q - start >= max(LEAST, 2 * q):
                out.append((start, end + q, q))
        else:
            end = m + 1
        # go on behind this stretch; seeds are sorted by lag, then by position
        upto = i + int(np.searchsorted(lag[i:], q, side="right"))
        i = i + bisect_left(at[i:upto], end)
    return out


def find_runs(h: np.ndarray, before: np.ndarray) -> np.ndarray:
    """All runs of all rows, as rows ``(row, start, length, period)`` in that order.

    ``h`` holds the word hashes of all rows, ``before`` the number of words before each row.
    """
    sizes = np.diff(before)
    rows = np.flatnonzero(sizes >= LEAST)
    found: list[tuple[int, int, int]] = []
    origin: list[tuple[np.ndarray, np.ndarray]] = []
    parts: list[np.ndarray] = []
    scale, done = 1, None
    while len(rows):
        if done is None or len(rows) < done:  # a sequence of the rows still long enough
            done = len(rows)
            n = sizes[rows]
            starts = np.concatenate(([0], np.cumsum(n + 1)))
            seq = words.mix((np.arange(starts[-1], dtype=np.uint64) + words.U(1)) * _SEPARATOR)
            inner = np.arange(int(n.sum())) + np.repeat(np.arange(len(n)), n)
            seq[inner] = h[np.arange(int(n.sum())) + np.repeat(before[rows] - (np.cumsum(n) - n), n)]
            width = 0
        if scale == 1:
            for q in range(1, SHORT):
                begin, end = _stretches(seq[q:] == seq[:-q])
                long = end + q - begin >= max(LEAST, 2 * q)
                found += [(int(b), int(e) + q, q) for b, e in zip(begin[long], end[long], strict=True)]
            scale = SHORT
        else:
            k = scale // 2
            if not width:
                width, grams = 1, seq
            while width < k:
                grams = words.mix(grams[:-width] * _LEFT + grams[width:])
                width *= 2
            at = _minimizers(grams, k + 1)
            found = _extended(seq, *_seeds(grams, at, scale))
            scale *= 2
        if found:
            spans = np.array(found, dtype=np.int64)
            row = np.searchsorted(starts, spans[:, 0], side="right") - 1
            parts.append(np.column_stack((rows[row], spans[:, 0] - starts[row], spans[:, 1] - spans[:, 0], spans[:, 2])))
            found = []
        rows = rows[sizes[rows] >= 2 * scale]
    if not parts:
        return np.zeros((0, 4), dtype=np.int64)
    runs = np.concatenate(parts)
    # a stretch that is also one of a shorter period is reported for that alone
    runs = runs[np.lexsort((runs[:, 3], runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.concatenate(([True], (runs[1:, :3] != runs[:-1, :3]).any(axis=1)))
    runs = runs[new]
    return runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]


def _kept(n: int, runs: np.ndarray) -> np.ndarray:
    """Words that no run contains after its first period."""
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, runs[:, 1] + runs[:, 3], 1)
    np.add.at(step, runs[:, 1] + runs[:, 2], -1)
    return np.cumsum(step[:-1]) == 0


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of about ``_SLICE`` bytes of text; a longer text is a slice of its own."""
    _, offsets = words.text_bytes(batch.column(column))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + _SLICE, side="right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


_SCHEMA = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), (
    "runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
    ("collapsed", pa.string())])


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _slices(batch, 1):
            data, offsets = words.text_bytes(part.column(1))
            h, before = words.word_hashes(data, offsets)
            runs = find_runs(h, before)
            first = np.searchsorted(runs[:, 0], np.arange(part.num_rows + 1))
            raw, collapsed = data.tobytes(), []
            for i in range(part.num_rows):
                own = raw[offsets[i]:offsets[i + 1]].split()
                if first[i] < first[i + 1]:
                    keep = _kept(len(own), runs[first[i]:first[i + 1]])
                    own = [own[j] for j in np.flatnonzero(keep)]
                collapsed.append(b" ".join(own))
            fields = [pa.array(runs[:, c]) for c in (1, 2, 3)]
            lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.StructArray.from_arrays(
                fields, fields=list(_SCHEMA.field("runs").type.value_type)))
            yield pa.record_batch([part.column(0), pa.array(np.diff(before)), lists,
                                   pa.array(collapsed, pa.binary()).cast(pa.string())], schema=_SCHEMA)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_words, runs, collapsed)`` of every row.

    ``runs`` has all runs as (start, length, period) in words, by start, then period; ``collapsed``
    the text without the words that any run contains after its first period, joined by one space.

    Words are runs of anything but ASCII white space, unchanged, told apart by 64-bit hashes. Null
    and empty texts, or texts of white space, have no words, no runs and an empty ``collapsed``; null
    ids stay null. Repeated rows give repeated results, an empty table gives none, further columns
    are not read. Overlapping runs are all reported; of equal stretches only the smallest period.
    One narrow pass; memory is in proportion to the longest text.
    """
    common.ship(docs.sparkSession)
    kind = "id bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        words.tidy(_searched), kind).withColumnRenamed("id", id_col)


def planted(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The text, with one in ten made periodic from some word on, as its id's checksum says.

    With ``h`` the unsigned crc32 of the decimal id, texts of ``h % 10 = 0`` and ``n > 0`` words
    become ``words[:a]`` and then words ``a + (i - a) % p``, where ``g = h / 10``, ``a = g % n`` and
    ``p = 1 + (n - a) / (3 + g % 8)``, in integers. A null id changes nothing.
    """
    h = F.crc32(F.col(id_col).cast("string"))
    own = F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0))

    def periodic(w: Column) -> Column:
        n, g = F.size(w).cast("long"), F.floor(h / 10)
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, place(i).cast("int"))), " ")

    changed = F.transform(F.array(own), lambda w: F.when(F.size(w) > 0, periodic(w)))[0]
    return F.when(h % 10 == 0, F.coalesce(changed, F.col(text_col))).otherwise(F.col(text_col))


def digest(found: DataFrame) -> DataFrame:
    """One row of figures for each row of ``periodic_runs``: the longest run and checksums."""
    best = F.reduce("runs", F.get("runs", F.lit(0)), lambda a, r: F.when(r.length > a.length, r).otherwise(a))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digest(periodic_runs(docs.select("doc_id", planted().alias("text"))))
