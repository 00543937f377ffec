import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from termtrail import fixed_values as fv
from termtrail.operators import checks, disclosure, explore, rollup
from termtrail.plans import pathways
from termtrail.sources import sinks, tables
from termtrail.sources.store import TableStore, shared_folder


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.select(*columns).collect())


# --- suppression -----------------------------------------------------------
def test_suppress_blanks_whole_numeric_rows(spark):
    df = spark.createDataFrame([("a", 0, 5.0), ("b", 1, 5.0), ("c", 10, None), ("d", 11, 2.5)],
                               "k string, n bigint, p double")
    got = {r.k: (r.n, r.p) for r in disclosure.suppress(df, ["n"]).collect()}
    s = fv.SUPPRESSED
    assert got == {"a": ("0", "5.0"), "b": (s, s), "c": (s, s), "d": ("11", "2.5")}


def test_suppress_looks_at_every_count_column_and_no_other(spark):
    df = spark.createDataFrame([(20, 3, 1), (20, 30, 1)], "a int, b int, other int")
    got = [tuple(r) for r in disclosure.suppress(df, ["a", "b"]).collect()]
    assert (fv.SUPPRESSED,) * 3 in got and ("20", "30", "1") in got
    assert disclosure.suppress(df, []).first().a == "20"


@pytest.mark.parametrize("name", ["student_uuid", "College_Name", "start_date", "gi01"])
def test_identifier_guard(spark, name):
    df = spark.range(1).withColumn(name, F.lit(1))
    with pytest.raises(ValueError, match="identifier"):
        disclosure.guard_identifiers(df)


# --- pathways --------------------------------------------------------------
def flat_rows(spark):
    """40 noncredit and 30 credit students, plus one of each other group."""
    data = []
    for i in range(40):
        data.append((f"U{i}", "1" * (1 + i % 13), "1", "0", "F" * (1 + i % 13), "0", fv.GROUP_SIX))
    for i in range(40, 70):
        data.append((f"U{i}", "101", "000", "101", "000", "C0B", fv.GROUP_AB))
    data.append(("U70", "11", "10", "01", "C0", "CC", fv.GROUP_EF))
    data.append(("U71", "0", "0", "0", "0", "0", fv.GROUP_EF))
    names = "uuid e n c l lc first_college_group".split()
    df = spark.createDataFrame(data, names)
    return df.select(
        "uuid", F.col("e").alias(pathways.ESL), F.col("n").alias(pathways.NONCREDIT),
        F.col("c").alias(pathways.CREDIT), F.col("l").alias(pathways.LEVELS),
        F.col("lc").alias(pathways.CREDIT_LEVELS),
        *[F.lit("1").alias(c) for c in fv.SEQUENCE_COLUMNS[5:]], "first_college_group",
        F.lit("30").alias("age_at_first_term"), F.lit("F").alias("gender"),
        F.lit("1").alias("citizenship_earliest"), F.lit("A").alias("sb14_student_ed_goal"),
        F.when(F.col("uuid") == "U0", "2022-2023").otherwise("2018-2019").alias("first_academic_year"),
        *[F.lit(c in ("white", "aapi")).alias(c) for c in fv.RACE_FLAG_LABELS],
        F.when(F.col("uuid") < "U3", F.lit(493084)).alias("earliest_degree_topcode"))


@pytest.fixture(scope="module")
def classified(spark):
    return pathways.classified(flat_rows(spark)).cache()


def test_missing_sequence_column_is_refused(spark):
    with pytest.raises(ValueError, match=pathways.ESL):
        pathways.classified(flat_rows(spark).drop(pathways.ESL))


def test_pathway_totals_add_up(classified):
    got = pathways.pathway_totals(classified).collect()
    assert {r.group for r in got} == {fv.GROUP_NONCREDIT, fv.GROUP_CREDIT}
    for group, size in ((fv.GROUP_NONCREDIT, 39), (fv.GROUP_CREDIT, 30)):   # U0 is not eligible
        part = [r for r in got if r.group == group]
        assert sum(r.students for r in part) == size == part[0].group_total


def test_margins_add_up_and_match_the_single_margin(classified):
    stacked = pathways.pathway_by_margins(classified)
    assert {r.margin for r in stacked.select("margin").distinct().collect()} == set(pathways.MARGINS)
    one = pathways.pathway_by(classified, "structure", "structure")
    assert rows(stacked.where("margin = 'structure'"), "group", "value", "pathway", "students",
                "pct_of_group") == rows(one, "group", "structure", "pathway", "students", "pct_of_group")


def test_race_rows_are_not_exclusive(classified):
    got = pathways.pathway_by_race(classified).groupBy("race_flag").agg(F.sum("students").alias("n"))
    assert rows(got, "race_flag", "n") == [("AAPI", 69), ("White", 69)]


def test_term_counts_are_capped_but_statistics_are_not(classified):
    got = pathways.terms_within_pathway(classified).where(F.col("group") == fv.GROUP_NONCREDIT).collect()
    stay = [r for r in got if r.pathway == fv.PATHWAY_SAME_LEVEL]
    sizes = [1 + i % 13 for i in range(1, 40) if i % 13]
    assert {r.esl_terms for r in stay} == {str(n) for n in range(2, 10)} | {"10+"}
    assert sum(r.students for r in stay) == len(sizes)
    assert stay[0].mean_esl_terms == round(sum(sizes) / len(sizes), 2)
    assert stay[0].median_esl_terms == sorted(sizes)[len(sizes) // 2 - 1] / 2 + sorted(sizes)[len(sizes) // 2] / 2


def test_entry_levels_always_have_the_top_row(classified):
    got = pathways.entry_levels(classified)
    top = got.where(F.col("levels_below_transfer") == fv.AT_OR_ABOVE_TRANSFER)
    assert rows(top, "group", "students", "group_total") == [
        (fv.GROUP_CREDIT, 0, 30), (fv.GROUP_NONCREDIT, 0, 39)]
    none = pathways.entry_levels(classified.where("false"))
    assert rows(none, "students", "pct_of_group") == [(0, None), (0, None)]


def test_advancement(spark, classified):
    seqs = [("CDB", 1), ("C", 1), ("CC", 1), ("DCBA", 1), ("0Y1", 1)]
    df = spark.createDataFrame(seqs, "level_seq string, i int").withColumns({
        "cohort": F.lit(fv.ENTRY_COHORTS[0]), "group": F.lit(fv.GROUP_NONCREDIT),
        "first_college_group": F.lit(fv.GROUP_SIX)})
    got = {r.levels_below_transfer: (r.students_at_level, r.returned_for_later_esl_term,
                                     r.reached_next_level, r.reached_any_higher_level)
           for r in pathways.advancement_by_level(df).collect()}
    assert got == {1: (1, 0, 0, 0), 2: (2, 1, 1, 1), 3: (4, 3, 2, 2), 4: (2, 2, 1, 2)}


def test_arrival_awards_and_provenance(classified):
    got = pathways.arrival_and_after(classified).where(F.col("group") == fv.GROUP_CREDIT).first()
    assert (got.students, got.any_non_esl_enrolled_term, got.esl_was_first_enrollment) == (30, 30, 30)
    awards = pathways.awards_by_family(classified)
    assert {r.award_family for r in awards.collect()} == {"ESL basic skills"}
    assert all(r.pathway_total >= r.students for r in awards.collect())
    line = pathways.provenance(classified).first()
    assert (line.source_rows, line.students_in_eligible_cohorts) == (72, 71)


def test_publish_writes_guarded_files_and_manifest(spark, tmp_path):
    manifest = pathways.publish_tables(flat_rows(spark), str(tmp_path), "20240101").first()
    stems = sorted(os.path.basename(p) for p in glob.glob(f"{tmp_path}/*.csv"))
    assert len(stems) == 22 and stems[0] == "00_provenance.csv" and len(manifest.files) == 22
    assert manifest.source_rows == 72 and manifest.min_cell_suppression == 11
    for path in glob.glob(f"{tmp_path}/*.csv"):
        text = spark.read.option("header", True).csv(path)
        if "students" in text.columns:
            seen = {r.students for r in text.select("students").collect()}
            assert not seen & {str(n) for n in range(1, 11)}
    stored = json.loads(spark.read.text(f"{tmp_path}/MANIFEST.json").first().value)
    assert {f["file"] for f in stored["files"]} == set(stems)


def test_fingerprint_ignores_order_but_not_content(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "i int, s string")
    b = a.orderBy(F.desc("i")).repartition(3)
    c = a.withColumn("s", F.upper("s"))
    prints = [tuple(sinks.fingerprint(d).first()) for d in (a, b, c)]
    assert prints[0] == prints[1] != prints[2]


def test_fingerprint_sees_swapped_nulls_and_pairs(spark):
    print_of = lambda *data: sinks.fingerprint(spark.createDataFrame(data, "a string, b string")).first()
    assert print_of(("a", None)) != print_of((None, "a"))
    assert print_of(("a", "a"), ("a", "a"), ("q", "q")) != print_of(("z", "z"), ("z", "z"), ("q", "q"))


def test_a_value_called_total_stays_apart_from_the_margin(spark):
    df = spark.createDataFrame([("Total", "a"), ("p", "a"), ("p", "b")], "x string, y string")
    got = {(r.x, r.column): r.students for r in explore.crosstab_margins(df, "x", "y").collect()}
    assert got["Total", "Total"] == 3 and got["Total (value)", "Total"] == 1 and got["Total", "a"] == 2


# --- rollups ---------------------------------------------------------------
BASE = ("uuid string, gender string, age_at_first_term string, always_noncredit_esl boolean, "
        "always_credit_esl boolean, both_credit_noncredit_esl boolean, first_college_group string")


def base(spark, data):
    return spark.createDataFrame(data, BASE)


def test_universes_overlap_and_empty_ones_print_zero(spark):
    df = base(spark, [("a", "M", "24", True, None, None, ""), ("b", "X", "25", False, False, True, ""),
                      ("c", None, "17", None, None, None, "")])
    measures = {"m": F.col("gender") == "M", "u": ~F.col("gender").isin("M", "F")}
    got = {r.cte_name: (r.total, r.m, r.u) for r in rollup.universe_table(df, measures).collect()}
    assert got["total_uni"] == (3.0, 1.0, 1.0)              # a null gender is counted nowhere
    assert got["total_uni_pct"] == (100.0, 33.33, 33.33)
    assert got["both_uni"] == (1.0, 0.0, 1.0)
    assert got["credit_only_uni"] == (0.0, 0.0, 0.0)
    assert got["credit_only_uni_pct"] == (100.0, None, None)


def test_first_level_report_counts_students_once(spark):
    data = [("a", "A", True, False, False, fv.GROUP_AB), ("a", "A", True, False, False, fv.GROUP_AB),
            ("b", None, False, True, False, fv.GROUP_SIX), ("c", None, False, False, True, fv.GROUP_OTHER)]
    df = spark.createDataFrame(data, "uuid string, first_cb21_level_adj string, always_noncredit_esl boolean,"
                                     "always_credit_esl boolean, both_credit_noncredit_esl boolean,"
                                     "first_college_group string").withColumns({
        "first_esl_term": F.lit(175), "first_term_integrated_esl_course": F.lit(False)})
    got = {r[0]: r for r in rollup.first_level_report(df).collect()}
    assert got["A"].total == 1 and got["A"].confirmed_cc_a_b_levels_pct == 100.0
    assert got[fv.ALWAYS_CREDIT_LABEL].credit_only == 1
    assert got[fv.TOTAL].total == 2 and got[fv.TOTAL].possible_cc_pct == 100.0


# --- exploration -----------------------------------------------------------
def test_year_filter_and_equality_filters(spark):
    df = spark.createDataFrame([("175", "F"), ("185", "S"), (None, "S")], "sample_first_term string, cohort string")
    assert explore.in_years(df, []).count() == 3
    assert explore.in_years(df, ["17", "18' OR 1=1"]).count() == 1
    assert explore.where_equal(df, cohort="S", absent="x").count() == 2
    assert explore.where_equal(df, cohort="").count() == 3
    assert rows(explore.starting_years(df), "label", "value") == [("2017", "17"), ("2018", "18")]
    assert [r.value for r in explore.distinct_options(df, "cohort").collect()] == ["F", "S"]


def test_field_options_and_duplicate_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], "uuid int, zip_code int, main_campus int")
    assert explore.field_options(df) == [{"label": "Main Campus", "value": "main_campus"}]
    twice = df.select("uuid", "zip_code", F.lit(9).alias("uuid"))
    assert [tuple(r) for r in explore.first_of_duplicate_columns(twice).collect()] == [(1, 2)]


def test_domains_are_zero_filled_even_without_rows(spark):
    empty = spark.createDataFrame([], "gender string")
    assert {r.students for r in explore.gender_counts(empty).collect()} == {0}
    heat = explore.level_heatmap(spark.createDataFrame(
        [("1", "8"), ("1", "8"), ("9", "1"), ("x", "1")], "first_level string, highest_level string"))
    got = {(r.x_val, r.y_val): r.students for r in heat.collect()}
    assert len(got) == 64 and got[(1, 8)] == 2 and sum(got.values()) == 2


def test_categorical_dispatch(spark):
    df = spark.createDataFrame([("x ", "yes", "a"), ("F", "n", " ")],
                               "gender string, prior_non_success string, campus string")
    assert rows(explore.categorical_counts(df, "gender"), "value", "students")[2] == ("Nonbinary/Unknown", 1)
    assert rows(explore.categorical_counts(df, "prior_non_success"), "value", "students") == [
        ("No", 1), ("Unknown", 0), ("Yes", 1)]
    assert rows(explore.categorical_counts(df, "campus"), "value", "students") == [("Unknown", 1), ("a", 1)]


def test_crosstab_top_folds_the_rest(spark):
    data = [(f"x{i % 5}", f"y{i % 3}") for i in range(30)] + [("x0", None)] * 3
    got = explore.crosstab_top(spark.createDataFrame(data, "x string, y string"), "x", "y", top=2)
    cells = {(r.x_val, r.y_val): r.students for r in got.collect()}
    assert sum(cells.values()) == 33 and {x for x, _ in cells} == {"x0", "x1", "Other"}
    assert {y for _, y in cells} == {"y0", "y1", "Other"} and len(cells) == 9


def test_crosstab_margins_and_scaling(spark):
    df = spark.createDataFrame([("A1", "A2"), ("A1", " "), (None, "A2")], "x string, y string")
    long = explore.crosstab_margins(df, "x", "y")
    got = {r.x: r.asDict() for r in explore.crosstab_wide(df, "x", "y").collect()}
    assert got["A1"] == {"x": "A1", "A2": 1, "Missing": 1, "Total": 2}
    assert got["Total"] == {"x": "Total", "A2": 2, "Missing": 1, "Total": 3}
    assert got["Missing"]["Missing"] == 0
    scaled = {(r.x, r.column): r.scaled for r in explore.scaled_cells(long, "x").collect()}
    assert scaled[("Total", "Total")] == 1.0 and scaled[("Missing", "Missing")] == 0.0
    flat = explore.scaled_cells(
        spark.createDataFrame([("a", "n", 4)], "x string, column string, students bigint"), "x")
    assert flat.first().scaled == 0.5
    with pytest.raises(ValueError, match="nope"):
        explore.crosstab_margins(df, "x", "nope")


def test_overlap_flows_retention(spark):
    df = spark.createDataFrame(
        [("Y", "N", "Y", "N", "1", "", "2017-2018", "F"), ("Y", "true", "N", "Y", "0", "", None, "F"),
         ("N", "N", "Y", "Y", "yes", "1", "2017-2018", "F")],
        "first_term_noncredit string, first_term_credit string, ever_credit_esl string,"
        "always_noncredit_esl string, six_terms_attended string, twelve_terms_attended string,"
        "first_academic_year string, cohort string")
    assert rows(explore.overlap_regions(df), "region", "students", "share_of_total") == [
        ("A", 1, 33.3), ("AB", 1, 33.3), ("B", 0, 0.0)]
    assert rows(explore.flow_counts(df), "source", "target", "students") == [
        ("Credit First Term", "Always Noncredit ESL", 1), ("Noncredit First Term", "Always Noncredit ESL", 1),
        ("Noncredit First Term", "Ever Credit ESL", 1)]
    assert rows(explore.retention(df), "first_academic_year", "cohort", "total", "six_terms_attended") == [
        ("2017-2018", "F", 2, 2), ("Unknown", "F", 1, 0)]
    assert explore.retention(df.drop("cohort", "twelve_terms_attended")).columns == [
        "first_academic_year", "total", "six_terms_attended"]
    with pytest.raises(ValueError):
        explore.retention(df.drop("cohort", "first_academic_year"))
    assert explore.overlap_regions(df.where("false")).agg(F.sum("share_of_total")).first()[0] == 0.0
    flags = explore.with_true_flags(df).first()
    assert flags.first_term_noncredit is True and flags.twelve_terms_attended is False


# --- checks, sources, sinks --------------------------------------------------
def test_key_checks_report_violations(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "k string")
    got = checks.key_report({"t": df}, [("t", "k", "unique"), ("t", "k", "not_null")])
    assert rows(got, "rule", "violations") == [("not_null", 1), ("unique", 1)]


def test_typed_csv_keeps_leading_zeros(spark, tmp_path):
    df = spark.createDataFrame([("0011",)], "any_esl_enrollment_by_terms string")
    sinks.write_csv(df, f"{tmp_path}/flat.csv")
    back = tables.read_csv(spark, f"{tmp_path}/flat.csv", df.schema)
    assert back.first()[0] == "0011"


def test_snapshot_and_models(spark, tmp_path):
    df = spark.range(3)
    path = sinks.write_snapshot(df, str(tmp_path), "flat_file", "20240131")
    assert path.endswith("flat_file_20240131") and spark.read.parquet(path).count() == 3
    sinks.write_model(df, "some_view", materialized="view")
    assert spark.table("some_view").count() == 3


def test_raw_tables_round_trip_through_parquet(spark, tmp_path):
    from tests.helpers import enrollment, tables as mini
    raw = mini(spark, enrollments=[enrollment(1, 175, "a")])
    for name in tables.TABLE_NAMES:
        getattr(raw, name).write.parquet(f"{tmp_path}/{tables.WAREHOUSE_NAMES[name]}")
    back = tables.read_parquet_tables(spark, str(tmp_path))
    assert back.enrollments.first().gi03 == 175
    assert back.enrollments.schema == tables.schema("enrollments")


def test_store_writes_once_and_reads_back(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    first = store.table("t", spark.range(5))
    assert store.table("t", spark.range(5)) is first and first.count() == 5
    assert len(glob.glob(f"{store.root}/t-*/*.parquet")) > 0
    with pytest.raises(ValueError, match="another plan"):
        store.table("t", spark.range(9))
    assert store.table("t", spark.range(9), "other parameters").count() == 9


def test_store_uses_the_cluster_folder(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    folder = shared_folder(spark)
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    assert folder == configured if configured else folder.startswith(warehouse)


def test_profile_bundles_one_dashboard_refresh(spark):
    df = spark.createDataFrame(
        [("175", "F", "Y", "Y", "30", "CITRUS", "A1", "A2", "3", "1"),
         ("185", "M", "N", "N", "60", " ", None, "A2", "2", "2")],
        "sample_first_term string, gender string, hispanic_non_hispanic string, white string,"
        "age_at_first_term string, main_campus_name string, earliest_efl_score string,"
        "latest_efl_score string, first_level string, highest_level string")
    got = explore.profile(df, years=["17"], x="gender", y="main_campus_name")
    assert got["summary"].first().total_students == 1
    assert rows(got["race"], "race", "students") == [("White", 1)]
    assert rows(got["explore"], "x_val", "y_val", "students") == [("F", "CITRUS", 1)]
    assert got["heatmap"].where("students > 0").count() == 1
    assert rows(explore.profile(df, x="gender")["explore"], "value", "students")[0] == ("Female", 1)
