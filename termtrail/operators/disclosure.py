"""Small-cell suppression and the identifier guard of published tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from termtrail import fixed_values as fv


def suppress(df: DataFrame, count_columns, min_cell: int = fv.MIN_CELL, also: Column | None = None) -> DataFrame:
    """Blank every numeric column of a row with a count in 1..min_cell-1, or where ``also`` is true.

    Zero counts stay. Numeric columns come out as text in every row, so the
    schema does not depend on the data.
    """
    numeric = [f.name for f in df.schema.fields
               if isinstance(f.dataType, NumericType) or f.name in count_columns]
    small = [F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) for c in count_columns]
    hit = reduce(lambda a, b: a | b, [(v > 0) & (v < min_cell) for v in small],
                 F.lit(False) if also is None else F.coalesce(also, F.lit(False)))
    cell = lambda c: F.when(hit, F.lit(fv.SUPPRESSED)).otherwise(F.col(c).cast("string")).alias(c)
    return df.select(*[cell(c) if c in numeric else F.col(c) for c in df.columns])


def guard_identifiers(df: DataFrame, table: str = "table") -> DataFrame:
    """Refuse a table whose column names look like identifiers."""
    for column in df.columns:
        for bad in fv.BANNED_SUBSTRINGS:
            if bad in column.lower():
                raise ValueError(f'column "{column}" of {table} looks like an identifier')
    return df


SMALL, COMPLEMENT = "small", "complement"


def complementary(cells: DataFrame, totals: DataFrame, min_cell: int = fv.MIN_CELL) -> DataFrame:
    """Which counts to blank so that no small one can be worked out from published sums.

    ``cells`` has ``(group, margin, value, pathway, students)``, ``totals`` ``(group, pathway,
    students)``, both without zero counts. A reader knows the sum of each row (group, margin, value)
    of which some cell is shown, the sum of all totals of a group, and, of a margin that covers all
    students of the group, that each pathway's cells add up to its total. A margin that leaves out
    students (null values) has no such columns.

    Counts below ``min_cell`` are blanked first (``small``). Then each blanked count gets others
    (``complement``) that can change together with it without any known sum changing:

    - A total gets the smallest other total that shares a value with it in every covering margin,
      and in each such margin the cheapest value's cells of both.
    - A cell gets the three other corners of a rectangle (two values, two pathways) of its margin,
      those of the smallest shown counts.
    - A cell in no rectangle: of a small total, the same value's cell of the total's partner; of a
      margin without columns, the smallest other cell of its row; else its whole row and the
      smallest other row of its pathway, whose sums are then shown nowhere.

    A group whose small total has no partner is blanked whole. Both inputs are read several times:
    give written tables. Returns the rows of both, totals with a null margin and value, and
    ``hidden`` (null, ``small`` or ``complement``). Sizes are bounded by the categories.
    """
    line = ["group", "margin"]
    is_small = lambda n: n < min_cell
    price = lambda n, gone: F.when(gone, F.lit(0)).otherwise(n)
    total = totals.select("group", F.col("pathway").alias("c"), F.col("students").alias("t"))
    cell = cells.select(*line, F.col("value").alias("r"), F.col("pathway").alias("c"), F.col("students").alias("n"))
    covering = (cell.groupBy(*line).agg(F.sum("n").alias("n"))
                .join(total.groupBy("group").agg(F.sum("t").alias("t")), "group").where("n = t").select(*line))
    margins = covering.groupBy("group").agg(F.count("*").alias("margins"))
    small_total = total.where(is_small(F.col("t")))

    # partners of small totals
    other = cell.select(*line, "r", F.col("c").alias("c2"), F.col("n").alias("n2"))
    other_total = total.select("group", F.col("c").alias("c2"), F.col("t").alias("t2"))
    beside = (cell.join(covering, line).join(small_total.select("group", "c"), ["group", "c"])
              .join(other, [*line, "r"]).where("c <> c2"))
    shared = beside.groupBy("group", "c", "c2").agg(F.count_distinct("margin").alias("seen"))
    fit = (small_total.join(other_total, "group").where("c <> c2").join(shared, ["group", "c", "c2"], "left")
           .join(margins, "group", "left").where("coalesce(seen, 0) = coalesce(margins, 0)"))
    order = F.struct(price(F.col("t2"), is_small(F.col("t2"))), "c2")
    partner = fit.groupBy("group", "c").agg(F.min_by("c2", order).alias("c2"))
    whole = small_total.join(partner, ["group", "c"], "left_anti").select("group").distinct()
    anchor = (beside.join(partner, ["group", "c", "c2"]).groupBy(*line, "c", "c2")
              .agg(F.min_by("r", F.struct(price(F.col("n2"), is_small(F.col("n2"))), "r")).alias("r")))
    tied = anchor.select(*line, "r", F.explode(F.array("c", "c2")).alias("c")).distinct()

    # cells to protect: small ones, and those blanked beside a total
    first = tied.withColumn("tied", F.lit(True))
    cell = (cell.join(first, [*line, "r", "c"], "left")
            .withColumn("gone", is_small(F.col("n")) | F.coalesce("tied", F.lit(False)))
            .withColumn("cost", price(F.col("n"), F.col("gone"))))
    todo = cell.where("gone AND tied IS NULL").select(*line, "r", "c")
    corner = lambda r, c, cost: cell.select(*line, F.col("r").alias(r), F.col("c").alias(c), F.col("cost").alias(cost))
    boxes = (todo.join(corner("r", "c2", "x"), [*line, "r"]).where("c <> c2")
             .join(corner("r2", "c", "y"), [*line, "c"]).where("r <> r2")
             .join(corner("r2", "c2", "z"), [*line, "r2", "c2"]))
    box = boxes.groupBy(*line, "r", "c").agg(F.min_by(
        F.struct("r2", "c2"), F.struct(F.col("x") + F.col("y") + F.col("z"), "r2", "c2")).alias("far"))
    at = lambda r, c: F.struct(F.col(r).alias("r"), F.col(c).alias("c"))
    added = box.select(*line, F.inline(F.array(at("r", "far.c2"), at("far.r2", "c"), at("far.r2", "far.c2"))))

    # cells in no rectangle
    left = todo.join(box.select(*line, "r", "c"), [*line, "r", "c"], "left_anti")
    covered = left.join(covering, line, "left_semi")
    in_row = (left.join(covering, line, "left_anti").join(corner("r", "c2", "x"), [*line, "r"]).where("c <> c2")
              .groupBy(*line, "r", "c").agg(F.min_by("c2", F.struct("x", "c2")).alias("c2")))
    by_total = covered.join(partner, ["group", "c"]).join(corner("r", "c2", "x"), [*line, "r", "c2"])
    added = added.unionByName(in_row.select(*line, "r", F.col("c2").alias("c"))).unionByName(
        by_total.select(*line, "r", F.col("c2").alias("c")))
    sums = cell.groupBy(*line, "r").agg(F.sum("n").alias("row_sum"))
    rows = (covered.join(by_total.select(*line, "r", "c"), [*line, "r", "c"], "left_anti")
            .join(corner("r2", "c", "y"), [*line, "c"]).where("r <> r2")
            .join(sums.withColumnRenamed("r", "r2"), [*line, "r2"])
            .groupBy(*line, "r", "c").agg(F.min_by("r2", F.struct("row_sum", "r2")).alias("r2")))
    rows = rows.select(*line, F.explode(F.array("r", "r2")).alias("r")).distinct()

    mark = lambda df, name: df.distinct().withColumn(name, F.lit(True))
    cell = (cell.join(mark(added, "added"), [*line, "r", "c"], "left").join(mark(rows, "row"), [*line, "r"], "left")
            .join(mark(whole, "whole"), "group", "left"))
    reason = lambda n, *marks: F.when(is_small(n), SMALL).when(F.coalesce(*marks, F.lit(False)), COMPLEMENT)
    out = cell.select(*line, F.col("r").alias("value"), F.col("c").alias("pathway"), F.col("n").alias("students"),
                      reason(F.col("n"), F.when(F.col("gone"), F.lit(True)), "added", "row", "whole").alias("hidden"))
    chosen = mark(partner.select("group", F.col("c2").alias("c")), "chosen")
    over = total.join(chosen, ["group", "c"], "left").join(mark(whole, "whole"), "group", "left").select(
        "group", F.lit(None).cast("string").alias("margin"), F.lit(None).cast("string").alias("value"),
        F.col("c").alias("pathway"), F.col("t").alias("students"), reason(F.col("t"), "chosen", "whole").alias("hidden"))
    return out.unionByName(over)
