"""CSV files by column name, and tables laid out by a key."""

import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from termtrail import fixed_values as fv
from termtrail.operators import explore
from termtrail.sources import sinks
from termtrail.sources.tables import BAD_VALUES, csv_header, read_csv

TYPES = StructType([StructField("seq", StringType()), StructField("uuid", StringType()), StructField("n", IntegerType())])


def written(folder, *lines):
    path = folder / f"{uuid.uuid4().hex}.csv"
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_columns_are_bound_by_name(spark, tmp_path):
    path = written(tmp_path, "uuid,extra,seq,n", "x1,9,00110,7", "x2,9,,", 'x3,9,"0,1",-1')
    got = [tuple(r) for r in read_csv(spark, path, TYPES).collect()]
    assert got == [("00110", "x1", 7), (None, "x2", None), ("0,1", "x3", -1)]
    assert csv_header(spark, path) == ["uuid", "extra", "seq", "n"]


def test_missing_and_doubled_columns(spark, tmp_path):
    path = written(tmp_path, "uuid,seq,seq", "x1,001,zzz")
    assert [tuple(r) for r in read_csv(spark, path, TYPES).collect()] == [("001", "x1", None)]
    plain = read_csv(spark, written(tmp_path, "n", "1", "2"), StructType.fromDDL("n int"))
    assert [r.n for r in plain.collect()] == [1, 2]


def test_bad_values_raise_or_are_reported(spark, tmp_path):
    path = written(tmp_path, "uuid,n,seq", "x1,7,1", "x2,seven,0", "x3,1.5,0", "x4,,0", "x5,99999999999,0", "x6,1,0,more", "x7")
    with pytest.raises(Exception, match="is not int|is broken"):
        read_csv(spark, path, TYPES).collect()
    got = {r.uuid: r for r in read_csv(spark, path, TYPES, report_bad=True).collect()}
    bad = {k: [tuple(b) for b in r[BAD_VALUES]] for k, r in got.items()}
    assert bad == {"x1": [], "x2": [("n", "seven")], "x3": [("n", "1.5")], "x4": [], "x5": [("n", "99999999999")],
                   "x6": [("_row", "x6,1,0,more")], "x7": [("_row", "x7")]}
    assert got["x1"].n == 7 and got["x2"].n is None and got["x4"].n is None
    good = written(tmp_path, "uuid,n,seq", "x1,7,1")
    assert read_csv(spark, good, TYPES).first().n == 7


def test_all_sequence_columns_keep_leading_zeros(spark, tmp_path):
    types = StructType.fromDDL(", ".join(f"{c} string" for c in fv.SEQUENCE_COLUMNS))
    rows = spark.createDataFrame([tuple(f"00{i}" for i in range(9)), ("0",) * 9], types)
    rows.select(*reversed(rows.columns)).write.option("header", True).csv(f"{tmp_path}/seq")
    got = sorted(tuple(r) for r in read_csv(spark, f"{tmp_path}/seq", types).collect())
    assert got == sorted(tuple(r) for r in rows.collect())


def test_empty_files_and_files_that_disagree(spark, tmp_path):
    assert read_csv(spark, written(tmp_path, ""), TYPES).columns == ["seq", "uuid", "n"]
    head = read_csv(spark, written(tmp_path, "n,uuid"), TYPES, report_bad=True)
    assert head.count() == 0 and head.columns[-1] == BAD_VALUES
    folder = tmp_path / "two"
    folder.mkdir()
    (folder / "a.csv").write_text("uuid,n\nx1,1\n")
    (folder / "b.csv").write_text("n,uuid\n2,x2\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_csv(spark, str(folder), TYPES).collect()


def test_first_of_doubled_columns(spark):
    both = spark.range(3).select(F.col("id").alias("a"), (F.col("id") * 2).alias("b"), (F.col("id") * 3).alias("a"))
    assert explore.first_of_duplicate_columns(both).columns == ["a", "b"]
    assert [tuple(r) for r in explore.first_of_duplicate_columns(both).collect()] == [(0, 0), (1, 2), (2, 4)]


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    tag = uuid.uuid4().hex[:8]
    people = spark.range(3000).selectExpr("CAST(id AS string) AS student", "id % 7 AS cohort")
    terms = spark.range(9000).selectExpr("CAST(id % 3000 AS string) AS student", "id AS term")
    a = sinks.write_model(people, f"people_{tag}", by="student", buckets=6, path=f"{tmp_path}/people")
    b = sinks.write_model(terms, f"terms_{tag}", by="student", buckets=6, path=f"{tmp_path}/terms")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = a.join(b, "student").groupBy("student").agg(F.count("*").alias("n"), F.first("cohort").alias("cohort"))
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        plain = people.join(terms, "student")._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" in plain
        assert joined.where("n = 3").count() == 3000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    again = sinks.write_model(people.where("cohort = 1"), f"people_{tag}", by="student", buckets=6, path=f"{tmp_path}/people2")
    assert again.count() == people.where("cohort = 1").count()
    plain = sinks.write_model(people, f"plain_{tag}", path=f"{tmp_path}/plain")
    assert plain.count() == 3000
    assert sinks.write_model(people, f"view_{tag}", "view").count() == 3000
    for name in ("people", "terms", "plain"):
        spark.sql(f"DROP TABLE {name}_{tag}")


def test_field_rows(spark):
    df = spark.createDataFrame([(1, "x", None), (2, None, None)], "doc_id long, first_name string, uuid string")
    got = [tuple(r) for r in explore.field_rows(df, ("uuid",)).collect()]
    assert got == [(0, "doc_id", "bigint", "Doc Id", 2), (1, "first_name", "string", "First Name", 1)]


def test_years_prune_partitions(spark, tmp_path):
    people = spark.range(400).selectExpr("CAST(id AS string) AS who", "CASE WHEN id % 50 = 49 THEN NULL ELSE "
                                         "CAST(170 + 10 * (id % 5) + id % 3 AS string) END AS sample_first_term")
    path = f"{tmp_path}/people"
    table = sinks.write_partitioned(explore.with_start_year(people), path, explore.START_YEAR)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    chosen = explore.in_years(table, ["17", "19"])
    scan = plan(chosen)
    assert "PartitionFilters: [start_year" in scan and "PushedFilters: []" in scan
    read = {r[0] for r in chosen.select(F.input_file_name()).distinct().collect()}
    assert {f.split("start_year=")[1][:2] for f in read} == {"17", "19"}
    expected = explore.in_years(people, ["17", "19"])
    assert sorted(r.who for r in chosen.collect()) == sorted(r.who for r in expected.collect())
    listed = explore.starting_years(people).where("value IN ('18', '20')")
    joined = explore.in_listed_years(table, listed)
    assert "dynamicpruning" in plan(joined)
    assert sorted(r.who for r in joined.collect()) == sorted(r.who for r in explore.in_years(people, ["18", "20"]).collect())
    assert explore.in_years(table, []).count() == 400


def test_refresh_is_one_scan_and_equals_the_single_tables(spark, tmp_path):
    columns = ["gender", "hispanic_non_hispanic", "age_at_first_term", "main_campus_name", "first_level", "highest_level",
               "sample_first_term", *fv.DASHBOARD_RACES]
    letters = ["M", " f", "X", "", None, "Y", "N", "22", "61", "n/a", "3", "8", "9"]
    rows = [tuple(letters[(i * (k + 3) + k) % len(letters)] for k in range(len(columns))) for i in range(200)]
    people = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))
    people.write.parquet(f"{tmp_path}/people")
    people = spark.read.parquet(f"{tmp_path}/people")
    got = explore.refresh(people)
    assert got._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    found = {(r.measure, r.value): r.students for r in got.collect()}
    want = {}
    for measure, table, value in (("gender", explore.gender_counts(people), "value"), ("age", explore.age_bucket_counts(people), "value"),
                                  ("hispanic", explore.hispanic_counts(people), "value"), ("campus", explore.top_campuses(people), "value"),
                                  ("race", explore.race_flag_counts(people), "race")):
        want |= {(measure, r[value]): r.students for r in table.collect()}
    want |= {("level", f"{r.x_val}/{r.y_val}"): r.students for r in explore.level_heatmap(people).collect()}
    assert found == want and 0 in found.values()
