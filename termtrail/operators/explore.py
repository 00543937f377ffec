"""Counts behind the exploration dashboards: distributions, cross-tabs, overlap, flows.

Fixed-domain counts are conditional counts of one global aggregate, so zero
categories appear by construction and only one row per task is shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termtrail import fixed_values as fv
from termtrail.functions import recode
from termtrail.functions.rates import percent_half_even
from termtrail.sources.tables import require_columns

LEVEL_DOMAIN = (1, 8)


# --- filters and options ---------------------------------------------------
def in_years(df: DataFrame, years: Sequence[str] | None) -> DataFrame:
    """Rows whose first term starts with one of the two-digit years; no years keeps all.

    A table written by ``with_start_year`` is filtered by that column, so only the partitions of
    these years are read.
    """
    if not years:
        return df
    return df.where(start_year(df).isin(*years))


START_YEAR = "start_year"


def start_year(df: DataFrame) -> Column:
    if START_YEAR in df.columns:
        return F.col(START_YEAR)
    return F.left(F.col("sample_first_term").cast("string"), F.lit(2))


def with_start_year(df: DataFrame) -> DataFrame:
    """The exploration table with the column to partition its files by: two digits of the first term."""
    return df.withColumn(START_YEAR, start_year(df))


def in_listed_years(df: DataFrame, years: DataFrame) -> DataFrame:
    """Rows whose starting year is a ``value`` of another table, such as ``starting_years``.

    Over a partitioned table the list prunes partitions at run time.
    """
    return df.join(years.select(F.col("value").alias("_year")).distinct(), start_year(df) == F.col("_year"), "left_semi")


def where_equal(df: DataFrame, **values: str | None) -> DataFrame:
    """Optional equality filters on the text of a column; blank or absent means no filter."""
    for column, value in values.items():
        if value and column in df.columns:
            df = df.where(F.col(column).cast("string") == value)
    return df


def starting_years(df: DataFrame) -> DataFrame:
    year = F.left(F.col("sample_first_term").cast("string"), F.lit(2)).alias("value")
    return (df.where("sample_first_term IS NOT NULL").select(year).distinct()
            .select(F.concat(F.lit("20"), "value").alias("label"), "value").orderBy("value"))


def distinct_options(df: DataFrame, column: str) -> DataFrame:
    value = F.col(column).cast("string").alias("value")
    return df.where(F.col(column).isNotNull()).select(value).distinct().orderBy("value")


def field_options(df: DataFrame, excluded: Sequence[str] = fv.EXCLUDED_FIELDS) -> list[dict]:
    """Selectable fields, from the schema alone."""
    return [{"label": n.replace("_", " ").title(), "value": n}
            for n in df.columns if n not in excluded]


def field_rows(df: DataFrame, excluded: Sequence[str] = fv.EXCLUDED_FIELDS) -> DataFrame:
    """The selectable fields as rows (position, name, type, label) with how many rows fill them."""
    fields = [(i, f) for i, f in enumerate(df.schema.fields) if f.name not in excluded]
    rows = F.array(*[F.struct(
        F.lit(i).alias("position"), F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("type"),
        F.lit(f.name.replace("_", " ").title()).alias("label"), F.count(F.col(f"`{f.name}`")).alias("filled")) for i, f in fields])
    return df.agg(rows.alias("fields")).select(F.inline("fields"))


def first_of_duplicate_columns(df: DataFrame) -> DataFrame:
    """Keep the first column of every name."""
    names = df.columns
    unique = df.toDF(*[f"c{i}" for i in range(len(names))])
    kept = [i for i, n in enumerate(names) if n not in names[:i]]
    return unique.select(*[F.col(f"c{i}").alias(names[i]) for i in kept])


def with_true_flags(df: DataFrame, flags: Sequence[str] = fv.COHORT_FLAGS) -> DataFrame:
    """Normalise the flag columns that are present to booleans."""
    return df.withColumns({n: recode.truthy(F.col(n)) for n in flags if n in df.columns})


# --- distributions ---------------------------------------------------------
def _as_rows(counts: DataFrame, labels: Sequence[str], label: str) -> DataFrame:
    pairs = [F.struct(F.lit(n).alias(label), F.col(f"c{i}").alias("students"))
             for i, n in enumerate(labels)]
    return counts.select(F.inline(F.array(*pairs)))


def domain_counts(df: DataFrame, value: Column, domain: Sequence[str],
                  label: str = "value") -> DataFrame:
    """Rows per label of a fixed domain, zeros included."""
    keyed = df.select(value.alias("v"))
    counts = keyed.agg(*[F.count_if(F.col("v") == n).alias(f"c{i}") for i, n in enumerate(domain)])
    return _as_rows(counts, domain, label)


def flag_counts(df: DataFrame, flags: Mapping[str, Column], label: str) -> DataFrame:
    """Rows per flag that is set, most frequent first."""
    counts = df.agg(*[F.count_if(c).alias(f"c{i}") for i, c in enumerate(flags.values())])
    return _as_rows(counts, list(flags), label).orderBy(F.desc("students"), label)


def gender_counts(df: DataFrame) -> DataFrame:
    labels = fv.DASHBOARD_GENDER
    value = recode.label_map(recode.cleaned(F.col("gender")), labels, fv.UNKNOWN)
    return domain_counts(df, value, [*labels.values(), fv.UNKNOWN])


def hispanic_counts(df: DataFrame) -> DataFrame:
    labels = fv.DASHBOARD_HISPANIC
    value = recode.label_map(recode.cleaned(F.col("hispanic_non_hispanic")), labels, fv.UNKNOWN)
    return domain_counts(df, value, [*labels.values(), fv.UNKNOWN])


def race_flag_counts(df: DataFrame) -> DataFrame:
    flags = {label: recode.truthy(F.col(c)) for c, label in fv.DASHBOARD_RACES.items()
             if c in df.columns}
    return flag_counts(df, flags, "race")


def age_bucket_counts(df: DataFrame) -> DataFrame:
    return domain_counts(df, recode.age_bucket(F.col("age_at_first_term")),
                         [label for label, _, _ in fv.DASHBOARD_AGES])


def binary_counts(df: DataFrame, column: str) -> DataFrame:
    return domain_counts(df, recode.yes_no_unknown(F.col(column)), ["Yes", "No", fv.UNKNOWN])


def field_counts(df: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """Rows per trimmed value, most frequent first; ``limit`` makes it a top-k report."""
    counts = (df.groupBy(recode.text_or(F.col(column), fv.UNKNOWN).alias("value"))
              .agg(F.count("*").alias("students")).orderBy(F.desc("students"), "value"))
    return counts.limit(limit) if limit else counts


def top_campuses(df: DataFrame, limit: int = 10) -> DataFrame:
    return field_counts(df, "main_campus_name", limit)


def categorical_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts of one field, by the kind of field it is."""
    if column == "gender":
        return gender_counts(df)
    if column == "hispanic_non_hispanic":
        return hispanic_counts(df)
    if column in fv.BINARY_FIELDS:
        return binary_counts(df, column)
    return field_counts(df, column)


def sorted_values(df: DataFrame, column: str) -> DataFrame:
    """Counts of one field with display labels, in value order."""
    kind, number, text = recode.value_order(F.col("value"))
    return (field_counts(df, column)
            .select("value", recode.as_number_text(F.col("value")).alias("label"), "students",
                    kind.alias("sort_kind"), number.alias("sort_number"), text.alias("sort_text"))
            .orderBy("sort_kind", "sort_number", "sort_text"))


def summary_card(df: DataFrame) -> DataFrame:
    campus = F.col("main_campus_name")
    scored = F.col("earliest_efl_score").isNotNull() & F.col("latest_efl_score").isNotNull()
    return df.agg(
        F.count("*").alias("total_students"), F.count_if(scored).alias("with_efl"),
        F.count_if(campus.isNotNull()).alias("with_campus"),
        F.percentile_approx(recode.safe_number(F.col("age_at_first_term")), 0.5)
        .alias("median_age"),
        F.countDistinct(campus).alias("unique_campuses"))


# --- cross-tabs ------------------------------------------------------------
def _single(spark: SparkSession) -> DataFrame:
    return spark.range(1)


def level_heatmap(df: DataFrame, x: str = "first_level", y: str = "highest_level") -> DataFrame:
    """Counts over the full level grid, zeros included."""
    counts = (df.select(recode.safe_integer(F.col(x)).alias("x_val"),
                        recode.safe_integer(F.col(y)).alias("y_val"))
              .where("x_val IS NOT NULL AND y_val IS NOT NULL")
              .groupBy("x_val", "y_val").agg(F.count("*").alias("students")))
    low, high = LEVEL_DOMAIN
    domain = F.sequence(F.lit(low).cast("bigint"), F.lit(high).cast("bigint"))
    grid = _single(df.sparkSession).select(F.explode(domain).alias("x_val")).select(
        "x_val", F.explode(domain).alias("y_val"))
    return grid.join(counts, ["x_val", "y_val"], "left").na.fill(0, ["students"])


def crosstab_top(df: DataFrame, x: str, y: str, top: int = 12) -> DataFrame:
    """Cross-tab of the ``top`` values per axis, the rest as Other, zeros included.

    Only the ranked values, at most ``top`` per axis, are broadcast.
    """
    value = lambda c: recode.text_or(F.col(c), fv.UNKNOWN)
    cells = df.groupBy(value(x).alias("x_val"), value(y).alias("y_val")).agg(
        F.count("*").alias("n"))
    for axis in ("x_val", "y_val"):
        ranked = (cells.groupBy(axis).agg(F.sum("n").alias("size"))
                  .orderBy(F.desc("size"), axis).limit(top)
                  .select(F.col(axis).alias("kept_value")))
        cells = (cells.join(F.broadcast(ranked), cells[axis] == ranked["kept_value"], "left")
                 .withColumn(axis, F.coalesce("kept_value", F.lit(fv.OTHER))).drop("kept_value"))
    merged = cells.groupBy("x_val", "y_val").agg(F.sum("n").alias("students"))
    across = merged.agg(F.collect_set("y_val").alias("ys")).scalar()
    grid = merged.select("x_val").distinct().withColumn("ys", across).select(
        "x_val", F.explode("ys").alias("y_val"))
    return grid.join(merged, ["x_val", "y_val"], "left").na.fill(0, ["students"])


def _named(column: str) -> Column:
    """Text of a value, blank as Missing; a value that reads like a margin is marked as a value."""
    text = recode.text_or(F.col(column), fv.MISSING)
    clash = text.rlike(f"^{fv.TOTAL}( \\(value\\))*$")
    return F.when(clash, F.concat(text, F.lit(" (value)"))).otherwise(text)


def crosstab_margins(df: DataFrame, x: str, y: str) -> DataFrame:
    """Cross-tab with margins in long form, (x, column, students), zeros included.

    Rows are counted per cell before the cells are summed up to the margins. A
    margin is called Total; a value Total reads ``Total (value)``.
    """
    require_columns(df, (x, y))
    cells = df.groupBy(_named(x).alias("_row"), _named(y).alias("_col")).agg(F.count("*").alias("n"))
    level = lambda c: F.when(F.grouping(c) == 1, fv.TOTAL).otherwise(F.col(c))
    cube = cells.cube("_row", "_col").agg(
        level("_row").alias("down"), level("_col").alias("across"), F.sum("n").alias("students"))
    long = cube.where("students IS NOT NULL").select("down", "across", "students")
    columns = long.agg(F.collect_set("across").alias("columns")).scalar()
    grid = long.select("down").distinct().withColumn("columns", columns).select(
        "down", F.explode("columns").alias("across"))
    return (grid.join(long, ["down", "across"], "left").na.fill(0, ["students"])
            .select(F.col("down").alias(x), F.col("across").alias("column"), "students"))


def crosstab_wide(df: DataFrame, x: str, y: str) -> DataFrame:
    """The cross-tab with margins as a wide table, for files.

    Finding the column names runs a job. Spark refuses more of them than
    ``spark.sql.pivotMaxValues``.
    """
    return (crosstab_margins(df, x, y).groupBy(x).pivot("column").agg(F.first("students"))
            .na.fill(0))


def scaled_cells(cells: DataFrame, row: str) -> DataFrame:
    """Cells in long form with their position between the smallest and the largest."""
    span = cells.agg(F.struct(F.min("students").alias("low"), F.max("students").alias("high"))
                     .alias("span"))
    low, high = F.col("span")["low"], F.col("span")["high"]
    scaled = F.when(high == low, 0.5).otherwise(
        (F.col("students") - low).cast("double") / (high - low))
    return cells.withColumn("span", span.scalar()).select(row, "column", "students",
                                                          scaled.alias("scaled"))


# --- cohort dashboard ------------------------------------------------------
def overlap_regions(df: DataFrame, a: str = "first_term_noncredit",
                    b: str = "first_term_credit") -> DataFrame:
    """Rows in A only, B only and both, with their share of all rows."""
    in_a, in_b = recode.truthy(F.col(a)), recode.truthy(F.col(b))
    regions = {"A": in_a & ~in_b, "B": ~in_a & in_b, "AB": in_a & in_b}
    counts = df.agg(F.count("*").alias("total"),
                    *[F.count_if(c).alias(f"c{i}") for i, c in enumerate(regions.values())])
    pairs = [F.struct(F.lit(n).alias("region"), F.col(f"c{i}").alias("students"),
                      F.coalesce(percent_half_even(F.col(f"c{i}"), F.col("total")), F.lit(0.0))
                      .alias("share_of_total")) for i, n in enumerate(regions)]
    return counts.select(F.inline(F.array(*pairs)))


def retention(df: DataFrame, year: str = "first_academic_year", cohort: str = "cohort",
              six: str = "six_terms_attended", twelve: str = "twelve_terms_attended") -> DataFrame:
    """Students and retained students per (year, cohort), or per whichever is present."""
    keys = [k for k in (year, cohort) if k in df.columns]
    counted = [c for c in (six, twelve) if c in df.columns]
    if not keys or not counted:
        raise ValueError("retention needs a grouping column and a retention column")
    named = [F.coalesce(F.col(k).cast("string"), F.lit(fv.UNKNOWN)).alias(k) for k in keys]
    return df.groupBy(*named).agg(
        F.count("*").alias("total"),
        *[F.count_if(recode.truthy(F.col(c))).alias(c) for c in counted]).orderBy(*keys)


def flow_counts(df: DataFrame, left: Mapping[str, str] = fv.FLOW_LEFT,
                right: Mapping[str, str] = fv.FLOW_RIGHT) -> DataFrame:
    """Rows with both flags set, per (left flag, right flag); empty links are dropped."""
    links = [(a, b) for a in left if a in df.columns for b in right if b in df.columns]
    counts = df.agg(*[F.count_if(recode.truthy(F.col(a)) & recode.truthy(F.col(b))).alias(f"c{i}")
                      for i, (a, b) in enumerate(links)])
    pairs = [F.struct(F.lit(left[a]).alias("source"), F.lit(right[b]).alias("target"),
                      F.col(f"c{i}").alias("students")) for i, (a, b) in enumerate(links)]
    return counts.select(F.inline(F.array(*pairs))).where("students > 0")


def cohort_summary(df: DataFrame) -> DataFrame:
    flags = {"six_terms_attended": "six_terms", "twelve_terms_attended": "twelve_terms",
             "first_term_credit": "started_credit", "first_term_noncredit": "started_noncredit"}
    return df.agg(F.count("*").alias("total_students"), *[
        F.count_if(recode.truthy(F.col(c))).alias(n) for c, n in flags.items() if c in df.columns])


def refresh(df: DataFrame, years: Sequence[str] | None = None, heat_x: str = "first_level",
            heat_y: str = "highest_level", campuses: int = 10) -> DataFrame:
    """All distributions of a dashboard refresh in long form (measure, value, students), from one scan.

    Each row is stacked as its (measure, value) pairs, which are counted before anything is shuffled.
    Values of a fixed domain that no row has come out as 0, campuses as the most frequent ones, the
    level grid as ``x/y``.
    """
    coded = lambda column, labels: recode.label_map(recode.cleaned(F.col(column)), labels, fv.UNKNOWN)
    x, y = recode.safe_integer(F.col(heat_x)), recode.safe_integer(F.col(heat_y))
    low, high = LEVEL_DOMAIN
    levels = range(low, high + 1)
    campus = recode.text_or(F.col("main_campus_name"), fv.UNKNOWN)
    values = [("gender", coded("gender", fv.DASHBOARD_GENDER)), ("hispanic", coded("hispanic_non_hispanic", fv.DASHBOARD_HISPANIC)),
              ("age", recode.age_bucket(F.col("age_at_first_term"))), ("campus", campus),
              ("level", F.when(x.between(low, high) & y.between(low, high), F.concat_ws("/", x, y)))]
    races = [label for c, label in fv.DASHBOARD_RACES.items() if c in df.columns]
    values += [("race", F.when(recode.truthy(F.col(c)), label)) for c, label in fv.DASHBOARD_RACES.items() if c in df.columns]
    domains = {"gender": [*fv.DASHBOARD_GENDER.values(), fv.UNKNOWN], "hispanic": [*fv.DASHBOARD_HISPANIC.values(), fv.UNKNOWN],
               "age": [label for label, _, _ in fv.DASHBOARD_AGES], "race": races, "level": [f"{a}/{b}" for a in levels for b in levels]}
    pair = lambda measure, value: F.struct(F.lit(measure).alias("measure"), value.cast("string").alias("value"))
    stacked = in_years(df, years).select(F.inline(F.array(*[pair(m, v) for m, v in values]))).where("value IS NOT NULL")
    counts = stacked.groupBy("measure", "value").agg(F.count("*").alias("n"))
    known = _single(df.sparkSession).select(F.inline(F.array(*[
        pair(m, F.lit(v)) for m, names in domains.items() for v in dict.fromkeys(names)])))
    both = counts.join(known.withColumn("fixed", F.lit(True)), ["measure", "value"], "full")
    place = F.row_number().over(Window.partitionBy("measure").orderBy(F.desc_nulls_last("n"), "value"))
    kept = (F.col("measure") != "campus") & F.col("fixed") | (F.col("measure") == "campus") & (place <= campuses)
    return both.withColumn("kept", F.coalesce(kept, F.lit(False))).where("kept").select(
        "measure", "value", F.coalesce("n", F.lit(0)).alias("students"))


def profile(df: DataFrame, years: Sequence[str] | None = None, x: str | None = None,
            y: str | None = None, heat_x: str = "first_level") -> dict[str, DataFrame]:
    """Everything one dashboard refresh shows, over one filtered input.

    Each table is a query of its own; ``refresh`` has all distributions from one scan.
    """
    kept = in_years(df, years)
    out = {"input": kept, "gender": gender_counts(kept), "hispanic": hispanic_counts(kept),
           "race": race_flag_counts(kept), "age": age_bucket_counts(kept),
           "campus": top_campuses(kept), "heatmap": level_heatmap(kept, heat_x),
           "summary": summary_card(kept)}
    if x and y:
        out["explore"] = crosstab_top(kept, x, y)
    elif x:
        out["explore"] = categorical_counts(kept, x).limit(15)
    return out

