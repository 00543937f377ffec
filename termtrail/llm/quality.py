"""Text quality by a naive Bayes support vector machine.

Features are indicators of n-grams: runs of 4 bytes, words and pairs of words, hashed to fixed
tables. Each indicator is scaled by the log-count ratio of its n-gram between the classes; on the
scaled, length-normalised vectors a linear hinge-loss model is fitted by dual coordinate descent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termtrail.llm import labels, words

THRESHOLD = 0.5
SAMPLE = 3_000  # labelled rows of each label to fit on
BITS = 16  # for each of the three tables
COST, EPOCHS = 1.0, 12
_STEP, _STEP_ROWS = 1 << 20, 128
_SIZE = 3 << BITS


class Model(NamedTuple):
    weights: np.ndarray  # of each indicator, already scaled by its ratio
    scale: np.ndarray  # squared ratio of each indicator, for the length of a vector
    bias: float
    slope: tuple[float, float]


def indicators(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct feature numbers of each row, one after another, and where each row begins."""
    data, offsets = words.text_bytes(texts)
    n = len(texts)
    seen = np.zeros(n * _SIZE, dtype=bool)
    if len(data) >= 4:
        row = np.repeat(np.arange(n), np.diff(offsets))
        d = data.astype(np.uint32)
        g = (d[:-3] | d[1:-2] << np.uint32(8) | d[2:-1] << np.uint32(16) | d[3:] << np.uint32(24)) * np.uint32(0x9E3779B1)
        ok = row[:-3] == row[3:]
        seen[row[:-3][ok] * _SIZE + (g[ok] >> np.uint32(32 - BITS)).astype(np.int64)] = True
    h, before = words.word_hashes(data, offsets)
    owner = np.repeat(np.arange(n), np.diff(before))
    top = words.U(64 - BITS)
    seen[owner * _SIZE + (1 << BITS) + (h >> top).astype(np.int64)] = True
    if len(h) > 1:
        pair, ok = words.mix(words.grams(h, 2)), owner[:-1] == owner[1:]
        pair[h[1:] == h[:-1]] = 0  # any word twice in a row is one n-gram
        seen[(owner[:-1] * _SIZE + (2 << BITS) + (pair >> top).astype(np.int64))[ok]] = True
    found = np.flatnonzero(seen)
    return found % _SIZE, np.searchsorted(found, np.arange(n + 1) * _SIZE)


def _parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    _, offsets = words.text_bytes(batch.column(column))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + _STEP, side="right")) - 1)
        part = batch.slice(lo, min(hi - lo, _STEP_ROWS))
        yield part
        lo += part.num_rows


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _parts(batch, 0):
            found, at = indicators(part.column(0))
            packed = [found[x:y].astype("<i4").tobytes() for x, y in zip(at[:-1], at[1:], strict=True)]
            yield pa.record_batch([part.column(1), part.column(2), part.column(3), pa.array(packed, pa.binary())],
                                  ["id", "label", "weight", "x"])


def descend(row: Callable[[int], tuple[np.ndarray, np.ndarray]], y: np.ndarray, weight: np.ndarray, size: int,
            cost: float = COST, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss model, by dual coordinate descent over the rows.

    ``row(i)`` gives the positions and values of row ``i``; the bias is the weight of a constant 1.
    """
    w, bias = np.zeros(size), 0.0
    alpha = np.zeros(len(y))
    square = np.array([1 + float(v @ v) for _, v in map(row, range(len(y)))])
    order = np.random.default_rng(7)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(y)):
            at, v = row(i)
            gradient = y[i] * (float(w[at] @ v) + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost * weight[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[at] += step * v
                bias += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, bias


def fit(docs: DataFrame, known: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
        sample: int = SAMPLE) -> Model:
    """Ratios, hinge-loss weights and calibration from at most ``sample`` labelled rows of each label.

    Every fifth row by hash is kept from the descent and calibrates the margins; of fewer than 50
    rows all are used for both.
    """
    rows = labels.training_sample(docs, known, label_col, sample, id_col, text_col)
    got = (rows.select("text", "id", "label", "weight").mapInArrow(
        _features, "id bigint, label int, weight double, x binary").toArrow().sort_by("id"))
    x = [np.frombuffer(r.as_buffer(), dtype="<i4") for r in got["x"]]
    label, weight = got["label"].to_numpy().astype(float), got["weight"].to_numpy().astype(float)
    counts = [np.full(_SIZE, 1.0), np.full(_SIZE, 1.0)]
    for at, one in zip(x, label, strict=True):
        counts[int(one)][at] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())

    def scaled(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v = ratio[at]
        return at, v / max(float(np.sqrt(v @ v)), 1e-12)

    part = words.mix(got["id"].to_numpy().astype(np.int64).view(np.uint64)) % words.U(5) == 0
    if len(x) < 50:
        part[:] = False
    y = 2 * label - 1
    inner = np.flatnonzero(~part)
    w, bias = descend(lambda i: scaled(x[inner[i]]), y[inner], weight[inner] / max(1.0, weight.max(initial=1.0)), _SIZE)
    outer = np.flatnonzero(part) if part.any() else inner
    margin = np.array([float(w[a] @ v) + bias for a, v in (scaled(x[i]) for i in outer)]).reshape(-1, 1)
    slope = labels.calibrate(margin, label[outer], weight[outer])
    return Model((w * ratio).astype(np.float32), (ratio ** 2).astype(np.float32), bias, (float(slope[0]), float(slope[1])))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score)`` of every row; whole texts, no shuffle.

    Null and empty texts have no n-gram and get the score of the bias alone. Repeated rows get equal
    scores, an empty table gives no row, further columns are not read. The model has a fixed
    size (two numbers for each of ``3 * 2 ** BITS`` indicators) and is broadcast.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for part in _parts(batch, 0):
                found, at = indicators(part.column(0))
                owner = np.repeat(np.arange(part.num_rows), np.diff(at))
                raw = np.bincount(owner, m.weights[found], part.num_rows)
                length = np.sqrt(np.bincount(owner, m.scale[found], part.num_rows))
                margin = raw / np.maximum(length, 1e-12) + m.bias
                yield pa.record_batch([part.column(1), pa.array(labels.probability(margin[:, None], np.array(m.slope)))],
                                      [id_col, "score"])

    return docs.select(F.col(text_col).cast("string").alias("_text"), id_col).mapInArrow(run, f"`{id_col}` {kind}, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", labels.held_out().alias("held_out"), "score",
                                     (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
