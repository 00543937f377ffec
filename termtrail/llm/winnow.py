"""Document fingerprints by winnowing."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termtrail.llm import common, words

GRAM, WINDOW = 12, 20
_POSITION = (1 << 24) - 1
_BLOCK = 1 << 22


def winnow(text: str, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Selected gram hashes (40 bits) and their code-point positions, in text order.

    Every window of ``window`` neighbouring grams gives its smallest hash, the rightmost of equal
    ones. Two texts that share ``gram + window - 1`` code points in a row share a selected hash.
    A shorter text gives the minimum of the grams it has; below ``gram`` the whole text is one gram.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64) + words.U(1)
    hashes = words.mix(words.grams(points, min(gram, n)) + words.U(min(gram, n)))
    picked: list[np.ndarray] = []
    for lo in range(0, max(1, len(hashes) - window + 1), _BLOCK):
        part = hashes[lo:lo + _BLOCK + window - 1]
        place = words.U(_POSITION) - np.arange(len(part), dtype=np.uint64)
        low = (part & ~words.U(_POSITION)) | place
        span, width = min(window, len(part)), 1
        while 2 * width <= span:
            low = np.minimum(low[:len(low) - width], low[width:])
            width *= 2
        if span > width:
            low = np.minimum(low[:len(low) - (span - width)], low[span - width:])
        best = low[np.concatenate(([True], low[1:] != low[:-1]))]
        picked.append(_POSITION - (best & words.U(_POSITION)).astype(np.int64) + lo)
    at = np.unique(np.concatenate(picked))
    return hashes[at] >> words.U(24), at


def signature(text: str) -> np.ndarray:
    """The set of selected hashes, sorted, 32 bits each."""
    return np.unique(selected(text)[0])


def selected(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Selected hashes of 32 bits and their positions, in text order."""
    hashes, at = winnow(text)
    return (hashes >> words.U(8)).astype("<u4"), at


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two signatures; two empty ones are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    either = len(a) + len(b) - both
    return both / either if either else 1.0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, hashes, positions)`` of every row; null or empty text gives empty arrays.

    One narrow pass; repeated rows give repeated results and further columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [winnow(t or "") for t in batch.column(1).to_pylist()]
            yield pa.record_batch([
                batch.column(0), pa.array([h.astype(np.int64) for h, _ in found], pa.list_(pa.int64())),
                pa.array([p for _, p in found], pa.list_(pa.int64()))], ["id", "hashes", "positions"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(
        run, f"id {kind}, hashes array<bigint>, positions array<bigint>").withColumnRenamed("id", id_col)


_EDITED = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
           "edited_fingerprint string, near_edited double, near_next double")


def _compare(positions: bool):
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    if positions:
        names, types = [*names, "selected"], [*types, pa.string()]

    def encoded(s: np.ndarray) -> str:
        return base64.b64encode(s.tobytes()).decode()

    def fingerprint(text: str) -> tuple[np.ndarray, str]:
        hashes, at = selected(text)
        return np.unique(hashes), encoded(np.stack((hashes.astype("<u8"), at.astype("<u8")), axis=1)) if positions else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        out: list[tuple] = []
        for batch in batches:
            for shard, role, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = text or ""
                own = None
                if held is not None and held[0] == shard:
                    own = fingerprint(text)
                    half = len(held[2]) // 2
                    edited = held[2][:len(held[2]) - half] + text[:half]
                    changed = signature(edited)
                    first, where = held[3]
                    out.append((held[1], len(held[2]), hashlib.sha256(edited.encode()).hexdigest(), encoded(first),
                                encoded(changed), likeness(first, changed), likeness(first, own[0]), where)[:len(names)])
                held = (shard, doc_id, text, fingerprint(text) if own is None else own) if role == 0 else None
                if len(out) >= 512:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types, strict=True)], names)
                    out = []
        if out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types, strict=True)], names)
    return run


def likeness_to_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", positions: bool = False) -> DataFrame:
    """Fingerprint of each text, of the text edited with its successor, and both likenesses.

    With ``positions``, a further column ``selected`` has the pairs (hash, position) of the text in
    text order, as little-endian 64-bit numbers in base64.

    The successor is the next row by ascending (id, text); the first row follows the last. Rows are
    dealt out by id range, sorted within a shard, and the first row of a shard is also sent to the
    shard before it, so each text is shuffled once and no row needs the whole order. Null ids come
    first, null texts are empty, an empty table gives no row.
    """
    least, bounds = common.shard_bounds(docs, id_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       common.order_key(id_col).alias("key")).withColumn("shard", common.shard_of(F.col("key"), bounds))
    place = lambda shard, role: F.struct(shard.cast("int").alias("shard"), F.lit(role).alias("role"))
    places = [place(F.col("shard"), 0)]
    if bounds:
        ahead = (F.col("shard") > 0) & (F.get(F.lit(bounds), F.col("shard") - 1) == F.col("key"))
        places.append(F.when(ahead, place(F.col("shard") - 1, 1)))
    places.append(F.when(F.col("key") == least, place(F.lit(len(bounds)), 1)))
    rows = rows.select("doc_id", "text", "key", F.explode(F.filter(F.array(*places), lambda p: p.isNotNull())).alias("p"))
    rows = (rows.repartition(common.partitions(docs.sparkSession), "p.shard")
            .sortWithinPartitions("p.shard", "p.role", "key", "text"))
    return rows.select("p.shard", "p.role", "doc_id", "text").mapInArrow(
        _compare(positions), _EDITED + ", selected string" * positions)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return likeness_to_next(spark.read.parquet(f"{sf_dir}/documents.parquet"), positions=True)
