"""Data tests: each returns the violating keys, so an empty result is a pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check_unique(df: DataFrame, key: str) -> DataFrame:
    """Non-null key values that occur more than once."""
    return (df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("rows"))
            .where("rows > 1"))


def check_not_null(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


CHECKS = {"unique": check_unique, "not_null": check_not_null}


def key_report(layers: dict[str, DataFrame], rules: list[tuple[str, str, str]]) -> DataFrame:
    """Violations per (layer, column, rule); one pass over a layer serves all its rules.

    Values are counted per (column, value) before the shuffle, so a value or a
    null with a large share of the rows costs one row per task.
    """
    reports = []
    for layer, df in layers.items():
        own = [(column, rule) for name, column, rule in rules if name == layer]
        if not own:
            continue
        cells = F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
            for c in dict.fromkeys(c for c, _ in own)]))
        counted = (df.select(cells.alias("cell")).select("cell.*")
                   .groupBy("column", "value").agg(F.count("*").alias("n")))
        null, n, measures = F.col("value").isNull(), F.col("n"), []
        for i, (column, rule) in enumerate(own):
            here = F.col("column") == column
            bad = (F.count_if(here & ~null & (n > 1)) if rule == "unique"
                   else F.coalesce(F.sum(F.when(here & null, n)), F.lit(0)))
            measures.append(bad.alias(f"v{i}"))
        reports.append(counted.agg(*measures).select(F.inline(F.array(*[
            F.struct(F.lit(layer).alias("layer"), F.lit(column).alias("column_name"),
                     F.lit(rule).alias("rule"), F.col(f"v{i}").alias("violations"))
            for i, (column, rule) in enumerate(own)]))))
    return reduce(DataFrame.unionByName, reports)
