"""Registered queries: name -> (spark, test-table folder) -> DataFrame.

Layer queries are built from the raw tables. Report queries start from the
written student table, as reports over a warehouse do.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from termtrail import fixed_values as fv
from termtrail.functions.colleges import college_group
from termtrail.functions.sequences import FEATURES
from termtrail.operators import checks, explore, rollup
from termtrail.operators.disclosure import guard_identifiers, suppress
from termtrail.params import DisclosureParams
from termtrail.plans import facts, history, pathways
from termtrail.plans.journey import Journey, flat_file
from termtrail.sources import sinks
from termtrail.sources.store import TableStore
from termtrail.sources.tables import BAD_VALUES, read_csv
from termtrail.sources.testdata import DriverTables, dashboard_cohort, dashboard_people

Query = Callable[[SparkSession, str], DataFrame]
_journeys: dict[tuple[str, str], Journey] = {}

SHARES = 200   # up to here, Spark deals rows out to files without sorting them in memory
SESSION = {
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.files.maxPartitionBytes": "16m",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(SHARES),
    "spark.sql.execution.replaceHashWithSortAgg": "true",   # a student's sorted rows are not sorted once more
}


def bound_tasks(spark: SparkSession) -> None:
    """Bounds what one task reads, unless the session says otherwise.

    Rows of codes and flags take far less in files and shuffles than in memory. Spark's shares of 64 and
    128 MB need more memory to sort and group than a task has, and spill. Small tables still end up
    in few tasks: shuffles are dealt into many parts, which adaptive execution joins.
    """
    conf = spark.conf
    for name, value in SESSION.items():
        enough = name.endswith("initialPartitionNum") and int(conf.get("spark.sql.shuffle.partitions")) >= SHARES
        if conf.get(name, None) is None and not enough:
            conf.set(name, value)


def journey(spark: SparkSession, sf_dir: str) -> Journey:
    """One set of layers per session and input folder."""
    bound_tasks(spark)
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _journeys:
        store = TableStore(spark)
        _journeys[key] = Journey(DriverTables(spark, sf_dir, store), store=store)
    return _journeys[key]


def _layer(pick: Callable[[Journey], DataFrame]) -> Query:
    return lambda spark, sf_dir: pick(journey(spark, sf_dir))


def _history(where: str, *columns: str) -> Query:
    """Columns of the history, as SQL text: registering needs no session."""
    return _layer(lambda j: j.history.where(where).selectExpr("student_uuid", *columns))


def _cohort_assignment(j: Journey) -> DataFrame:
    return j.history.where("first_college_name IS NOT NULL").select(
        "student_uuid", "first_esl_term", "first_college_name", "multiple_colleges",
        "first_term_integrated_esl_course", "first_academic_year", "cohort",
        college_group(F.col("first_college_name")).alias("first_college_group"))


def _flat(pick: Callable[[DataFrame], DataFrame]) -> Query:
    return _layer(lambda j: pick(j.stored.flat_file))


def _people(pick: Callable[[DataFrame], DataFrame]) -> Query:
    """Exploration runs over all students, not over the study sample."""
    return _layer(lambda j: pick(dashboard_people(j.stored.wide)))


def _cohort(pick: Callable[[DataFrame], DataFrame]) -> Query:
    return _layer(lambda j: pick(dashboard_cohort(j.stored.wide)))


def _published(pick: Callable[[DataFrame], DataFrame], *counts: str) -> Query:
    counts = counts or ("students",)
    return _flat(lambda flat: guard_identifiers(
        suppress(pick(pathways.classified(flat)), counts)))


def _key_checks(j: Journey) -> DataFrame:
    stored = j.stored
    layers = {"students": j.raw.students, "cohort_info": stored.cohort_info,
              "course_info": stored.course_info, "demographic_base": stored.demographic_base,
              "terms": j.raw.terms, "flat_file": stored.flat_file, "colleges": j.raw.colleges,
              "levels": j.raw.levels, "award_types": j.raw.award_types, "topcodes": j.raw.topcodes}
    keys = [("students", "maskedsb00"), ("students", "uuid"), ("cohort_info", "maskedsb00"),
            ("cohort_info", "uuid"), ("course_info", "uuid"), ("demographic_base", "uuid"),
            ("demographic_base", "maskedsb00"), ("terms", "gi03"), ("flat_file", "uuid"),
            ("colleges", "gi01_college"), ("levels", "cb21"), ("levels", "levels_below_transfer"),
            ("award_types", "award_code"), ("topcodes", "top6")]
    return checks.key_report(layers, [(t, c, r) for t, c in keys for r in checks.CHECKS])


def _crosstab(people: DataFrame) -> DataFrame:
    return explore.crosstab_margins(people, "earliest_efl_score", "latest_efl_score")


# Written and read back: what a reader of the file gets.
def _csv_round_trip(j: Journey) -> DataFrame:
    sequences = [history.relative_name(m) for m in facts.FLAG_SEQUENCES]
    rows = j.stored.flat_file.select("uuid", "first_esl_term", "multiple_colleges", *sequences)
    path = j.store.path("sequences_csv")
    rows.write.option("header", True).csv(path)
    return read_csv(rows.sparkSession, path, rows.schema)


def _snapshot_round_trip(j: Journey) -> DataFrame:
    path = sinks.write_snapshot(j.stored.flat_file.select("uuid", "first_esl_term", "cohort"),
                                j.store.path("snapshots"), "flat_file", "20240131")
    return j.raw.students.sparkSession.read.parquet(path)


def _wide_round_trip(j: Journey) -> DataFrame:
    wide = explore.crosstab_wide(dashboard_people(j.stored.wide), "earliest_efl_score",
                                 "latest_efl_score")
    path = j.store.path("crosstab_csv")
    sinks.write_csv(wide, path)
    return read_csv(wide.sparkSession, path, wide.schema)


def _csv_by_name(j: Journey) -> DataFrame:
    """All code-like columns, written in another order and read by name."""
    rows = j.stored.flat_file.select("uuid", "first_esl_term", *fv.SEQUENCE_COLUMNS)
    path = j.store.path("sequences_by_name")
    rows.select(*reversed(rows.columns)).write.option("header", True).csv(path)
    return read_csv(rows.sparkSession, path, rows.schema)


def _csv_bad_values(j: Journey) -> DataFrame:
    """How many values of a column a typed reader refuses, and which: nothing turns to null unseen."""
    term = F.col("first_esl_term")
    rows = j.stored.flat_file.select(
        F.when(term % 10 == 7, F.concat(term.cast("string"), F.lit("F"))).otherwise(term.cast("string")).alias("first_esl_term"),
        "uuid", F.col("multiple_colleges").cast("string").alias("multiple_colleges"))
    path = j.store.path("bad_values")
    rows.write.option("header", True).csv(path)
    read = read_csv(rows.sparkSession, path, StructType.fromDDL("uuid string, first_esl_term int, multiple_colleges boolean"), True)
    found = read.select(F.inline(BAD_VALUES))
    return found.groupBy("column", "value").agg(F.count("*").alias("rows"))


def _csv_doubled_header(j: Journey) -> DataFrame:
    """A small table whose file names two columns alike: the first of them counts."""
    counts = j.stored.flat_file.groupBy("first_esl_term").agg(F.count("*").alias("students"))
    lines = counts.select(F.lit(1).alias("part"), F.concat_ws(",", "first_esl_term", "students", F.lit("0")).alias("value"))
    head = counts.sparkSession.createDataFrame([(0, "first_esl_term,students,students")], "part int, value string")
    path = j.store.path("doubled_header")
    lines.unionAll(head).coalesce(1).sortWithinPartitions("part").select("value").write.text(path)
    return read_csv(counts.sparkSession, path, StructType.fromDDL("students bigint, first_esl_term int"))


def _student_tables(j: Journey) -> DataFrame:
    """Two layers as bucketed tables of the student key, joined without a shuffle."""
    tag = uuid.uuid4().hex[:12]
    count = int(j.raw.students.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keep = {"cohort_info": ("uuid", "first_esl_term", "cohort"), "course_info": ("uuid", "any_esl_enrollment_by_terms")}
    left, right = (sinks.write_model(getattr(j.stored, layer).select(*columns), f"{layer}_{tag}", by="uuid", buckets=count,
                                     path=j.store.path(layer)) for layer, columns in keep.items())
    return left.join(right, "uuid")


def _manifest(j: Journey) -> DataFrame:
    """The files of a publishing run, their rows and columns, as its manifest lists them."""
    out = pathways.publish_tables(j.stored.flat_file, j.store.path("published"), "20240131")
    return out.select(F.inline("files")).select("file", "rows", F.array_join("columns", ",").alias("columns"), "note")


def _parts(j: Journey) -> DataFrame:
    """Fingerprints by starting cohort: their rows, and whether the parts add up to the whole."""
    flat = j.stored.flat_file
    parts = sinks.part_fingerprints(flat, F.coalesce("first_academic_year", F.lit("none")))
    text = lambda whole: whole.select(F.concat_ws("/", "content_hash", "source_rows")).scalar()
    return parts.select("part", "source_rows", (text(sinks.merged(parts)) == text(sinks.fingerprint(flat))).alias("adds_up"))


def _by_year(j: Journey) -> DataFrame:
    """The exploration table, written by starting year."""
    people = explore.with_start_year(dashboard_people(j.stored.wide))
    return sinks.write_partitioned(people, j.store.path("people_by_year"), explore.START_YEAR)


def _protected(j: Journey) -> DataFrame:
    d = pathways.classified(j.stored.flat_file)
    hidden = pathways.protected(d, TableStore(d.sparkSession), DisclosureParams(complementary=True))
    shown = F.when(F.col("hidden").isNull(), F.col("students").cast("string")).otherwise(fv.SUPPRESSED)
    return hidden.withColumn("students", shown)


# Queries built from the raw tables; all others read the written student table.
LAYER_QUERIES = (
    "terms_adjusted", "semesters_abs", "courses_level_adjusted", "college_groups", "demographics",
    "degree_info", "degree_expanded", "first_terms", "cohort_assignment", "esl_profile",
    "first_term_courses", "first_level", "first_level_adjusted", "first_level_credit_only",
    "level_completion", "term_windows", "cohort_info", "per_term_info", "sequences_relative",
    "sequences_absolute", "flat_file", "demographic_base")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppressed pathway totals straight from the raw tables."""
    flat = journey(spark, sf_dir).flat_file
    return suppress(pathways.pathway_totals(pathways.classified(flat)), ("students",))


def queries() -> dict[str, Query]:
    relative = [history.relative_name(m) for m in facts.RELATIVE_SEQUENCES]
    absolute = [history.absolute_name(m) for m in facts.ABSOLUTE_SEQUENCES]
    return {
        # layers, from raw tables
        "terms_adjusted": _layer(lambda j: j.terms_adjusted),
        "semesters_abs": _layer(lambda j: j.semesters),
        "courses_level_adjusted": _layer(lambda j: j.courses_adjusted),
        "college_groups": _layer(lambda j: rollup.college_group_counts(
            j.raw.enrollments, j.raw.colleges, college_group)),
        "demographics": _layer(lambda j: j.demographics),
        "degree_info": _layer(lambda j: j.degree_info),
        "degree_expanded": _layer(lambda j: j.degree_expanded),
        "first_terms": _layer(lambda j: j.first_terms),
        "cohort_assignment": _layer(_cohort_assignment),
        "esl_profile": _history(
            "ever_credit_esl IS NOT NULL", "ever_credit_esl", "always_noncredit_esl",
            "always_credit_esl", "both_credit_noncredit_esl"),
        "first_term_courses": _history(
            "first_term_noncredit IS NOT NULL", "first_term_noncredit", "first_term_credit_only",
            "first_term_credit_and_noncredit"),
        "first_level": _history(
            "first_cb21_level IS NOT NULL", "first_level AS lowest_starting_level",
            "first_cb21_level"),
        "first_level_adjusted": _history(
            "first_cb21_level_adj IS NOT NULL",
            "first_level_adj AS lowest_starting_level", "first_cb21_level_adj"),
        "first_level_credit_only": _history(
            "first_cb21_level_credit_only IS NOT NULL",
            "credit_level AS lowest_starting_level_credit_only",
            "first_cb21_level_credit_only"),
        "level_completion": _history(
            "terms_to_full_completion_adj IS NOT NULL", "terms_to_full_completion_adj",
            "full_completion_levels_adj"),
        "term_windows": _history("has_term_window", "latest_6_term", "latest_12_term",
                                 "term_in_6", "term_in_12"),
        "cohort_info": _layer(lambda j: j.cohort_info),
        "per_term_info": _layer(lambda j: j.per_term_info),
        "sequences_relative": _history(f"{relative[0]} IS NOT NULL", *relative),
        "sequences_absolute": _history(f"{relative[0]} IS NOT NULL", *absolute),
        "flat_file": _layer(lambda j: j.flat_file),
        "demographic_base": _layer(lambda j: j.demographic_base),
        # report tables
        "table1_demographics": _layer(lambda j: rollup.demographics_table(j.stored.demographic_base)),
        "table2_education": _layer(lambda j: rollup.education_table(j.stored.demographic_base)),
        "table3_program": _layer(lambda j: rollup.program_table(j.stored.demographic_base)),
        "rq2_first_level": _layer(lambda j: rollup.first_level_report(j.stored.demographic_base)),
        "key_checks": _layer(_key_checks),
        # disclosure tables
        "sequence_features": _flat(lambda flat: pathways.classified(flat).select(
            "uuid", "group", "level_seq", *FEATURES, "pathway")),
        "provenance": _flat(lambda flat: pathways.provenance(pathways.classified(flat))),
        "composition": _published(pathways.composition),
        "pathway_totals": _published(pathways.pathway_totals),
        "pathway_by_margin": _published(pathways.pathway_by_margins),
        "pathway_by_race": _published(pathways.pathway_by_race),
        "pathway_protected": _layer(_protected),
        "terms_within_pathway": _published(pathways.terms_within_pathway),
        "entry_levels": _published(pathways.entry_levels),
        "advancement_by_level": _published(pathways.advancement_by_level, "students_at_level",
                                           "returned_for_later_esl_term"),
        "arrival_after": _published(pathways.arrival_and_after),
        "awards_by_family": _published(pathways.awards_by_family),
        # sinks and readers
        "sequences_csv": _layer(_csv_round_trip),
        "dated_snapshot": _layer(_snapshot_round_trip),
        "sequences_csv_by_name": _layer(_csv_by_name),
        "csv_bad_values": _layer(_csv_bad_values),
        "csv_doubled_header": _layer(_csv_doubled_header),
        "student_tables": _layer(_student_tables),
        "published_manifest": _layer(_manifest),
        "fingerprint_parts": _layer(_parts),
        "crosstab_csv": _layer(_wide_round_trip),
        "other_college_ever": _layer(lambda j: flat_file(
            j.stored.course_info, j.params, ever=True).select("uuid", "non_64_college_enrollment")),
        # exploration
        "field_counts_gender": _people(explore.gender_counts),
        "field_counts_hispanic": _people(explore.hispanic_counts),
        "field_counts_binary": _people(lambda d: explore.categorical_counts(d, "prior_non_success")),
        "field_counts_generic": _people(lambda d: explore.field_counts(d, "age_at_first_term", 15)),
        "field_catalogue": lambda spark, sf_dir: explore.field_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"), ("text",)),
        "field_values_sorted": _people(lambda d: explore.sorted_values(d, "age_at_first_term")),
        "race_flag_counts": _people(explore.race_flag_counts),
        "age_buckets": _people(explore.age_bucket_counts),
        "top_campuses": _people(explore.top_campuses),
        "summary_card": _people(lambda d: explore.summary_card(explore.in_years(
            d, ["17", "18", "19", "20"]))),
        "summary_card_all_years": _people(explore.summary_card),
        "summary_card_pruned": _layer(lambda j: explore.summary_card(explore.in_years(_by_year(j), ["17", "18", "19", "20"]))),
        "refresh": _people(explore.refresh),
        "starting_years": _people(explore.starting_years),
        "level_heatmap": _people(explore.level_heatmap),
        "crosstab_top12": _people(lambda d: explore.crosstab_top(
            d, "main_campus_name", "age_at_first_term")),
        "crosstab_margins": _people(_crosstab),
        "cells_scaled": _people(lambda d: explore.scaled_cells(_crosstab(d), "earliest_efl_score")),
        "overlap_regions": _cohort(explore.overlap_regions),
        "retention": _cohort(explore.retention),
        "retention_of_cohort": _cohort(lambda d: explore.retention(
            explore.where_equal(d, cohort="F", first_academic_year=""))),
        "flow_counts": _cohort(explore.flow_counts),
        "cohort_summary": _cohort(explore.cohort_summary),
    }
