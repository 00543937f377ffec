"""Toxicity by compression distance: windows compressed with a toxic and an ordinary dictionary.

Words (runs of letters, digits and anything beyond ASCII, A-Z lower-cased) become two codes of 8
bytes each, one for the word and one for its first bytes, so that zstandard matches whole words or
beginnings of words or nothing. The ordinary dictionary holds the codes of the
commonest words of ordinary texts. The toxic dictionary holds those too, and before them the codes
of words that toxic texts hold far more often than chance. A window's gain is the number of bytes
by which the toxic dictionary compresses it better. Gains of a document's windows are turned into a
probability by a logistic model fitted on the labelled sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termtrail.llm import labels, words

THRESHOLD = 0.7
SAMPLE = 10_000  # labelled rows of each label to fit on
WINDOW = 16  # words
BEGINNING = 5  # bytes
TERMS = 1_000  # codes in each part of a dictionary
LEAST_ROWS = 4
_RUN_IN = bytes(64)  # compressible, so that zstandard never stores a window uncompressed
_STEP, _STEP_ROWS = 1 << 20, 1024
_APART = np.ones(256, dtype=bool)
_APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


class Model(NamedTuple):
    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]


def _parts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    _, offsets = words.text_bytes(batch.column(column))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + _STEP, side="right")) - 1)
        part = batch.slice(lo, min(hi - lo, _STEP_ROWS))
        text = words.text_bytes(part.column(column))
        whole, before = words.word_hashes(*text, space=_APART, fold=words.LOWER)
        begun, _ = words.word_hashes(*text, space=_APART, fold=words.LOWER, first_bytes=BEGINNING)
        yield part, np.column_stack((whole, begun)).ravel(), 2 * before
        lo += part.num_rows


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    plan = zstandard.ZstdCompressionParameters(
        window_log=17, hash_log=15, chain_log=15, search_log=2, min_match=6, target_length=8,
        strategy=zstandard.STRATEGY_GREEDY, write_content_size=0, write_checksum=0, write_dict_id=0,
        format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    if not content:
        return zstandard.ZstdCompressor(compression_params=plan)
    known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    known.precompute_compress(compression_params=plan)
    return zstandard.ZstdCompressor(dict_data=known, compression_params=plan)


def gains(h: np.ndarray, before: np.ndarray, toxic, ordinary) -> np.ndarray:
    """For each row: saved bytes a word in hundreds, largest gain of a window in tens, share of
    windows with a gain. A row without words has zeros."""
    out = np.zeros((len(before) - 1, 3))
    for i in range(len(out)):
        raw = h[before[i]:before[i + 1]].tobytes()
        if raw:
            found = [len(ordinary.compress(w)) - len(toxic.compress(w))
                     for w in (_RUN_IN + raw[lo:lo + 16 * WINDOW] for lo in range(0, len(raw), 16 * WINDOW))]
            out[i] = (min(1600 * sum(found) / len(raw), 400) / 10, min(max(found), 50) / 10,
                      sum(g > 2 for g in found) / len(found))
    return out


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, h, before in _parts(batch, 0):
            owner = np.repeat(np.arange(part.num_rows), np.diff(before))
            order = np.lexsort((owner, h))
            h, owner = h[order], owner[order]
            first = np.ones(len(h), dtype=bool)
            first[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
            h, label = h[first], part.column(1).to_numpy()[owner[first]]
            codes, at = np.unique(h, return_inverse=True)
            yield pa.record_batch([
                pa.array(codes.view(np.int64)), pa.array(np.bincount(at, label == 0, len(codes)).astype(np.int64)),
                pa.array(np.bincount(at, label == 1, len(codes)).astype(np.int64))], ["code", "ordinary", "toxic"])


def _gain_rows(toxic: bytes, ordinary: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _compressor(toxic), _compressor(ordinary)
        for batch in batches:
            for part, h, before in _parts(batch, 0):
                x = gains(h, before, *pair)
                yield pa.record_batch([part.column(1), part.column(2), *(pa.array(x[:, k]) for k in range(3))],
                                      ["label", "weight", "x0", "x1", "x2"])
    return run


def fit(docs: DataFrame, known: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
        sample: int = SAMPLE) -> Model:
    """Dictionaries and calibration from at most ``sample`` labelled rows of each label.

    A code is toxic if it is in at least ``LEAST_ROWS`` toxic rows (an eighth of them where they are
    few, but two), and more standard deviations above chance than a bound that rises from 3.5 to 8 as
    toxic rows go from none to 1,000: with few rows a code cannot reach more. Each dictionary takes
    the ``TERMS`` foremost codes. These bounds belong to the fit; scoring knows none.
    """
    rows = labels.training_sample(docs, known, label_col, sample, id_col, text_col)
    size = {r.label: r.n for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = size.get(0, 0), size.get(1, 0)
    counts = (rows.select("text", "label").mapInArrow(_term_counts, "code bigint, ordinary bigint, toxic bigint")
              .groupBy("code").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic")))
    both = F.col("ordinary") + F.col("toxic")
    expected = both * (n1 / max(1, n0 + n1))
    spread = F.sqrt(expected * (1 - both / max(1, n0 + n1 + 1)) + 1e-9)
    least = 3.5 + 4.5 * min(n1, 1000) / 1000  # standard deviations
    scored = counts.withColumn("z", (F.col("toxic") - expected) / spread)
    telling = (scored.where((F.col("toxic") >= min(LEAST_ROWS, max(2, n1 // 8))) & (F.col("z") >= least))
               .orderBy(F.desc("z"), "code").limit(TERMS).select("code").collect())
    plain = scored.where(F.col("z") < 2).orderBy(F.desc("ordinary"), "code").limit(TERMS).select("code").collect()
    packed = lambda found: np.array([r.code for r in reversed(found)], dtype="<i8").tobytes()
    ordinary = packed(plain)
    toxic = packed(telling) + ordinary
    got = rows.select("text", "label", "weight").mapInArrow(
        _gain_rows(toxic, ordinary), "label int, weight double, x0 double, x1 double, x2 double").collect()
    x = np.array([r[2:] for r in got], dtype=float).reshape(-1, 3)
    weights = labels.calibrate(x, np.array([r[0] for r in got], dtype=float), np.array([r[1] for r in got], dtype=float))
    return Model(toxic, ordinary, tuple(weights.tolist()))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
          carry: list[str] | None = None) -> DataFrame:
    """``(id, score)`` and the columns named in ``carry`` for every row; whole texts, no shuffle.

    Null and empty texts get the score of a text without any gain. Repeated rows get equal scores, an
    empty table gives no row. Columns not named are not read; one named ``score`` raises.
    """
    carried = [c for c in carry or [] if c != id_col]
    if "score" in (id_col, *carried):
        raise ValueError("rename the column score first")
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _compressor(model.toxic), _compressor(model.ordinary)
        weights = np.array(model.weights)
        for batch in batches:
            for part, h, before in _parts(batch, 0):
                p = labels.probability(gains(h, before, *pair), weights)
                yield pa.record_batch([part.column(1), pa.array(p), *(part.column(2 + k) for k in range(len(carried)))],
                                      [id_col, "score", *carried])

    schema = ", ".join([f"`{id_col}` {kinds[id_col]}", "score double", *(f"`{c}` {kinds[c]}" for c in carried)])
    return docs.select(F.col(text_col).cast("string").alias("_text"), id_col, *carried).mapInArrow(words.tidy(run), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", labels.held_out().alias("held_out"), "score",
                                     (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
