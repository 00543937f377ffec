"""Blanked counts cannot be worked out from what is published."""

import glob
import os
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from termtrail import fixed_values as fv
from termtrail.operators.disclosure import complementary, suppress
from termtrail.params import DisclosureParams
from termtrail.plans import pathways
from termtrail.sources import sinks
from tests.test_reports import flat_rows

CELLS = "group string, margin string, value string, pathway string, students long"
TOTALS = "group string, pathway string, students long"


def students(rnd, group):
    """Students with a pathway and a value (or none) of each margin."""
    paths = [f"p{i}" for i in range(rnd.randrange(2, 6))]
    weight = [rnd.choice([1, 3, 10, 40]) for _ in paths]
    margins = {}
    for k in range(rnd.randrange(1, 4)):
        values = [f"v{i}" for i in range(rnd.randrange(1, 6))]
        margins[f"m{k}"] = values, [rnd.choice([1, 4, 20]) for _ in values], rnd.random() < 0.3
    for _ in range(rnd.choice([30, 300, 1500])):
        yield group, rnd.choices(paths, weight)[0], {
            m: None if nulls and rnd.random() < 0.2 else rnd.choices(values, w)[0] for m, (values, w, nulls) in margins.items()}


def counts(people):
    totals, cells = defaultdict(int), defaultdict(int)
    for group, path, values in people:
        totals[group, path] += 1
        for margin, value in values.items():
            if value is not None:
                cells[group, margin, value, path] += 1
    return totals, cells


def fixed(group, totals, cells, hidden):
    """Blanked counts of a group that follow from the sums a reader knows, by linear algebra."""
    unknown = {k: i for i, k in enumerate(k for k, h in hidden.items() if k[0] == group and h)}
    if not unknown:
        return set()
    sums = [[k for k in unknown if k[1] is None]]
    signs = [{}]
    of = [t for (g, _), t in totals.items() if g == group]
    for margin in {k[1] for k in cells if k[0] == group}:
        own = [k for k in cells if k[:2] == (group, margin)]
        for value in {k[2] for k in own}:
            row = [k for k in own if k[2] == value]
            if any(k not in unknown for k in row):  # a row's sum is shown beside its cells
                sums.append([k for k in row if k in unknown])
                signs.append({})
        if sum(cells[k] for k in own) == sum(of):
            for path in {k[3] for k in own}:
                total = (group, None, None, path)
                sums.append([k for k in own if k[3] == path and k in unknown] + [total] * (total in unknown))
                signs.append({total: -1})
    a = np.zeros((len(sums), len(unknown)))
    for i, (keys, sign) in enumerate(zip(sums, signs, strict=True)):
        for k in keys:
            a[i, unknown[k]] = sign.get(k, 1)
    _, s, vt = np.linalg.svd(a)
    free = np.abs(vt[(s > 1e-9).sum():])
    free = free.max(axis=0) > 1e-9 if len(free) else np.zeros(len(unknown), dtype=bool)
    return {k for k, i in unknown.items() if not free[i]}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_no_small_count_follows_from_sums(spark, seed):
    rnd = random.Random(seed)
    totals, cells = counts(x for g in range(25) for x in students(rnd, f"g{g}"))
    out = complementary(spark.createDataFrame([(*k, n) for k, n in cells.items()], CELLS),
                        spark.createDataFrame([(*k, n) for k, n in totals.items()], TOTALS)).collect()
    hidden = {(r.group, r.margin, r.value, r.pathway): r.hidden for r in out}
    assert len(hidden) == len(out) == len(totals) + len(cells)
    count = lambda k: totals[k[0], k[3]] if k[1] is None else cells[k]
    assert all((h == "small") == (count(k) < 11) for k, h in hidden.items())
    for group in {g for g, _ in totals}:
        given_away = fixed(group, totals, cells, hidden)
        assert not [k for k in given_away if hidden[k] == "small"]
        alone = {k: "small" if count(k) < 11 else None for k in hidden}
        if not fixed(group, totals, cells, alone):  # nothing more to blank than what is small
            continue
        assert any(h == "complement" for k, h in hidden.items() if k[0] == group)
    assert sum(h is None for h in hidden.values()) > len(hidden) // 10


def test_large_counts_stay_and_empty_tables_work(spark):
    cells = spark.createDataFrame([("g", "m", v, p, 50) for v in "ab" for p in "xy"], CELLS)
    totals = spark.createDataFrame([("g", p, 100) for p in "xy"], TOTALS)
    assert complementary(cells, totals).where("hidden IS NOT NULL").count() == 0
    assert complementary(cells.limit(0), totals.limit(0)).count() == 0


def test_one_small_cell_takes_a_rectangle_with_it(spark):
    size = {("a", "x"): 4, ("a", "y"): 90, ("b", "x"): 60, ("b", "y"): 30, ("c", "x"): 20, ("c", "y"): 500}
    cells = spark.createDataFrame([("g", "m", v, p, n) for (v, p), n in size.items()], CELLS)
    totals = spark.createDataFrame([("g", p, sum(n for (_, q), n in size.items() if q == p)) for p in "xy"], TOTALS)
    got = {(r.value, r.pathway): r.hidden for r in complementary(cells, totals).collect()}
    assert {k for k, h in got.items() if h} == {("a", "x"), ("a", "y"), ("b", "x"), ("b", "y")}
    assert got["a", "x"] == "small" and got["b", "y"] == "complement"


def test_suppress_takes_further_rows(spark):
    df = spark.createDataFrame([("a", 50, True), ("b", 60, None), ("c", 3, False)], "k string, n int, hide boolean")
    got = {r.k: r.n for r in suppress(df, ["n"], also=F.col("hide")).collect()}
    assert got == {"a": fv.SUPPRESSED, "b": "60", "c": fv.SUPPRESSED}


def published(spark, folder):
    return {os.path.basename(p): sorted(r.value for r in spark.read.text(p).collect()) for p in glob.glob(f"{folder}/*.csv")}


def test_publish_with_complements_hides_more(spark, tmp_path):
    flat = flat_rows(spark)
    pathways.publish_tables(flat, f"{tmp_path}/plain", "20240101")
    pathways.publish_tables(flat, f"{tmp_path}/safe", "20240101", DisclosureParams(complementary=True))
    plain, safe = published(spark, f"{tmp_path}/plain"), published(spark, f"{tmp_path}/safe")
    assert set(plain) == set(safe) and len(safe) == 22
    hidden = lambda files: sum(line.count(fv.SUPPRESSED) for lines in files.values() for line in lines)
    assert hidden(safe) >= hidden(plain) > 0
    assert all(len(plain[f]) == len(safe[f]) and lines[0] is not None for f, lines in safe.items())
    assert not any("hide_row" in line for lines in safe.values() for line in lines)


def test_a_failed_run_leaves_the_old_files(spark, tmp_path):
    folder, flat = f"{tmp_path}/out", flat_rows(spark)
    pathways.publish_tables(flat, folder, "20240101")
    before = published(spark, folder)
    good = spark.range(20).selectExpr("id AS students")
    broken = spark.range(20).select(F.raise_error(F.lit("half-way")).cast("string").alias("k"), F.col("id").alias("students"))
    with pytest.raises(Exception, match="half-way"):
        sinks.publish([("a", good, ["students"], ""), ("b", broken, ["students"], "")], flat, folder, "20240102")
    assert published(spark, folder) == before
    assert os.listdir(tmp_path) == ["out"]
    sinks.publish([("a", good, ["students"], "")], flat, folder, "20240103")
    assert sorted(published(spark, folder)) == ["a.csv"] and os.listdir(tmp_path) == ["out"]
    assert "name" not in str(published(spark, folder))
    with pytest.raises(ValueError, match="identifier"):
        sinks.publish([("a", good.withColumnRenamed("students", "student_name"), [], "")], flat, folder, "20240104")
    assert sorted(published(spark, folder)) == ["a.csv"]


def test_parts_add_up_and_an_appended_file_is_checked_alone(spark, tmp_path):
    rows = spark.range(500).selectExpr("id", "CASE WHEN id % 7 = 0 THEN NULL ELSE CAST(id AS string) END AS text")
    path = f"{tmp_path}/t"
    rows.where("id < 300").repartition(3).write.parquet(path)
    old = sinks.part_fingerprints(spark.read.parquet(path)).collect()
    rows.where("id >= 300").coalesce(1).write.mode("append").parquet(path)
    known = spark.createDataFrame(old, sinks.part_fingerprints(rows).schema)
    files = {r.part for r in old}
    new = sinks.part_fingerprints(spark.read.parquet(path)).where(~F.col("part").isin(*files))
    assert len(files) == 3 and new.count() == 1
    assert sinks.merged(known.unionAll(new)).first() == sinks.fingerprint(rows).first()
    assert sinks.merged(known).first() != sinks.fingerprint(rows).first()
    assert sinks.merged(known.limit(0)).first() == sinks.fingerprint(rows.limit(0)).first()
