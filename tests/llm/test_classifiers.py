"""Held-out accuracy of the two classifiers, and their handling of odd rows."""

import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from termtrail.llm import labels, quality, registry, toxicity, words
from tests.conftest import SMALL

LARGER = SMALL.replace("sf0.001", "sf0.1")
SCHEMA = "doc_id long, text string, weight int, label string"


def auc(score, label):
    order = np.argsort(np.argsort(score, kind="stable"))
    ones = label.sum()
    return (order[label == 1].sum() - ones * (ones - 1) / 2) / (ones * (len(label) - ones))


@pytest.mark.parametrize("name, column, least_auc, least_precision, least_recall", [
    ("op6_toxicity", "toxic", 0.93, 0.95, 0.85), ("op8_quality", "quality", 0.97, 0.95, 0.95)])
def test_held_out_accuracy(spark, name, column, least_auc, least_precision, least_recall):
    known = spark.read.parquet(f"{LARGER}/labels.parquet")
    got = registry.queries()[name](spark, LARGER)
    assert got.count() == spark.read.parquet(f"{LARGER}/documents.parquet").count()
    rows = got.where("held_out").join(known, "doc_id").select("score", "predicted", column, "doc_id").toPandas()
    assert all(zlib.crc32(str(i).encode()) % 3 == 1 for i in rows.doc_id)
    y, p = rows[column].to_numpy(), rows.predicted.to_numpy()
    assert auc(rows.score.to_numpy(), y) > least_auc
    assert (p * y).sum() / p.sum() > least_precision and (p * y).sum() / y.sum() > least_recall


@pytest.mark.parametrize("module, good, bad", [(toxicity, "calm and kind words go here", "you vile grobnik you"),
                                               (quality, "a plain sentence of words", "Zx%%% $$$ qq&&& ***")])
def test_odd_rows(spark, module, good, bad):
    texts = [(good if i % 2 else bad) + f" {i}" for i in range(80)]
    rows = [(i, t, 1, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows + [(3, texts[3], 1, "x"), (200, None, None, None), (201, "", 0, ""), (None, good, 1, ""),
                                         (202, (bad + " ") * 20000, 1, "")], SCHEMA)
    name = "toxic" if module is toxicity else "quality"
    flip = module is quality
    known = spark.createDataFrame([(i, i % 2 if flip else 1 - i % 2) for i in range(80)] + [(5, None), (999, 1), (None, 0), (7, 9)],
                                  f"doc_id long, {name} int")
    model = module.fit(docs, known)
    got = [(r.doc_id, r.score) for r in module.score(docs, model).collect()]
    assert len(got) == 85 and all(0 <= s <= 1 for _, s in got)
    score = dict(got)
    assert score[200] == score[201]
    high, low = (score[61], score[60]) if flip else (score[60], score[61])
    assert high > 0.6 > 0.4 > low
    assert module.score(docs.limit(0), model).count() == 0
    nothing = module.fit(docs, known.limit(0))
    assert module.score(docs, nothing).count() == 85


def test_no_held_out_label_is_learned(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    known = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    rows = labels.training_sample(docs, known, "toxic", 40).collect()
    assert all(zlib.crc32(str(r.id).encode()) % 3 != 1 for r in rows)
    assert sum(r.label for r in rows) == 40 and len(rows) == 80
    all_of = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert rows[0].weight == pytest.approx(sum(1 for i in all_of if i % 2 == rows[0].label) / 40)


def test_gain_is_a_difference_of_compressed_lengths():
    word = lambda *names: np.array([hash(n) & 0xFFFFFFFFFFFFFFFF for n in names], dtype=np.uint64)
    toxic, plain = (toxicity._compressor(word(*names).tobytes() * 3) for names in (("vile", "mean"), ("soft", "nice")))
    assert isinstance(toxic, zstandard.ZstdCompressor)
    text = np.concatenate((word("a", "b", "vile", "c"), word("d", "e"), word()))
    gains = toxicity.gains(text, np.array([0, 4, 6, 6]), toxic, plain)
    assert gains[0, 1] > 0 and gains[1].tolist() == [0, 0, 0] and gains[2].tolist() == [0, 0, 0]


def test_descent_separates_and_respects_the_box():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 5))
    y = np.sign(x @ [1, -2, 0.5, 0, 1] + 0.3)
    w, bias = quality.descend(lambda i: (np.arange(5), x[i]), y, np.ones(200), 5, cost=10, epochs=400)
    assert ((x @ w + bias) * y > 0).mean() > 0.97
    hinge = lambda w, b: 0.5 * (w @ w + b * b) + 10 * np.maximum(0, 1 - y * (x @ w + b)).sum()
    best = hinge(w, bias)
    assert all(hinge(w + rng.normal(size=5) * 0.2, bias + rng.normal() * 0.2) > best for _ in range(50))


def test_words_and_grams_hash_as_their_text_says():
    import pyarrow as pa
    data, offsets = words.text_bytes(pa.array(["ab cd", None, "", "cd\tab ab", " x "]))
    h, before = words.word_hashes(data, offsets)
    assert before.tolist() == [0, 2, 2, 2, 5, 6]
    assert h[0] == h[3] == h[4] and h[1] == h[2] and len(set(h.tolist())) == 3
    g = words.grams(h, 2)
    assert g[0] != g[2] and len(words.grams(h, 7)) == 0 and words.grams(h, 1).tolist() == h.tolist()
    for n in range(1, 24):
        long = np.tile(h, 6)
        assert words.grams(long, n)[3] == words.grams(long[3:3 + n], n)[0]
    assert words.inside(before, 2).tolist() == [True, False, True, True, False]
    begun, _ = words.word_hashes(data, offsets, first_bytes=1)
    assert begun[0] == begun[3] and begun[0] != h[0]
