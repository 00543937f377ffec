"""Labelled rows, the held-out rule, and logistic calibration shared by the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termtrail.llm import common

FOLDS, HELD_OUT = 3, 1


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learned from; a row without an id is held out."""
    fold = F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS
    return F.coalesce(fold == HELD_OUT, F.lit(True))


def training_sample(docs: DataFrame, labels: DataFrame, label_col: str, limit: int, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``(id, text, label, weight)``: at most ``limit`` labelled rows of each label, none held out.

    Rows are those with the smallest hash of their id, so the sample does not depend on order or
    partitioning; ``weight`` undoes a smaller share of one label. Labels other than 0 and 1 are left
    out; an id with several labels has the larger. The sample's ids, at most ``2 * limit``, are
    broadcast, so no text is shuffled.
    """
    known = (labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
             .where("label IN (0, 1) AND id IS NOT NULL").where(~held_out("id"))
             .groupBy("id").agg(F.max("label").alias("label")).withColumn("_h", F.xxhash64("id")))
    total = {r.label: r.n for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    some = None
    for label in (0, 1):
        weight = max(1.0, total.get(label, 0) / limit)
        own = (known.where(F.col("label") == label).orderBy("_h", "id").limit(limit)
               .select("id", "label", F.lit(weight).alias("weight")))
        some = own if some is None else some.unionAll(own)
    some = common.stored(some, "sample")
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return common.stored(own.join(F.broadcast(some), "id"), "training")


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Logistic weights (last: intercept) of rows ``x`` by damped Newton steps; without rows, zeros."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge * w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
