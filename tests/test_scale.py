"""Plan shape of every registered query, and results under skew."""

import random

import pytest
from pyspark.sql import functions as F

from termtrail import fixed_values as fv
from termtrail.operators import explore
from termtrail.operators.aggregates import FlagBits
from termtrail.plans import catalog, facts
from termtrail.plans.journey import Journey
from tests.conftest import SMALL
from tests.helpers import course, enrollment, tables


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_no_cross_join_and_no_python_in_the_plan(spark, name):
    plan = plan_of(catalog.queries()[name](spark, SMALL))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "PythonUDF",
                 "InPandas"):
        assert node not in plan


def test_enrollment_scan_is_pruned_and_filtered(spark):
    j = catalog.journey(spark, SMALL)
    plan = plan_of(j.term_facts)
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "sx02" in line)
    assert "sx02)" in scan and f"EqualTo(sx02,{fv.NOT_DROPPED})" in scan.replace(" ", "")
    assert "sx01" not in scan and "maskedsb00" not in scan


def test_facts_combine_before_the_only_shuffle(spark):
    plan = plan_of(catalog.journey(spark, SMALL).term_facts)
    assert "partial_" in plan and "SortAggregate" not in plan
    assert plan.count("Exchange hashpartitioning") - plan.count("ReusedExchange") <= 3


def test_history_of_one_measure_prunes_the_rest(spark):
    j = catalog.journey(spark, SMALL)
    plan = plan_of(j.history.select("student_uuid", "ever_credit_esl"))
    for unused in ("any_493084_course_enrollment", "lowest_cb21", "collect_set", "sx01"):
        assert unused not in plan


def brute_history(rows, offered):
    """First ESL term, sequence and mode college per student, by plain loops."""
    out = {}
    for u, _, gi01, gi03, cb00, _, sx02, grade in rows:
        if sx02 != fv.NOT_DROPPED:
            continue
        for c in offered:
            if (c[2], c[1]) != (cb00, gi03):
                continue
            s = out.setdefault(u, {"terms": {}, "esl": [], "names": {}})
            esl = c[4] in fv.ESL_PROGRAMS
            key = (gi03, gi01)
            s["terms"][key] = s["terms"].get(key, False) or esl
            if esl and grade not in fv.WITHDRAWN_GRADES:
                s["esl"].append(gi03)
                s["names"][gi01] = s["names"].get(gi01, 0) + 1
    return {u: (min(s["esl"]) if s["esl"] else None,
                "".join("1" if s["terms"][k] else "0" for k in sorted(s["terms"])))
            for u, s in out.items()}


def test_one_student_and_one_course_hold_a_third_of_the_rows(spark):
    rng = random.Random(3)
    codes = [f"k{i}" for i in range(12)]
    term_list = (175, 177, 181, 183, 195, 205)
    offered = [course(k, t, cb03=rng.choice(("493084", "150100"))) for k in codes for t in term_list]
    rows = []
    for i in range(3000):
        student = 0 if i % 3 == 0 else rng.randint(1, 60)
        code = codes[0] if i % 3 == 1 else rng.choice(codes)
        rows.append(enrollment(student, rng.choice(term_list), code,
                               gi01=rng.choice(("141", "271")),
                               grade=rng.choice(("P", "W", "F")),
                               sx02=rng.choice((fv.NOT_DROPPED, "20190101"))))
    raw = tables(spark, enrollments=rows, courses=offered)
    got = {r.student_uuid: (r.first_esl_term, r.any_esl_enrollment_by_terms)
           for r in Journey(raw).history.collect()}
    names = {"141": "COMPTON", "271": "DIABLO VALLEY"}
    assert names["141"] < names["271"]          # the brute force sorts codes, Spark sorts names
    assert got == brute_history(rows, offered)
    per_student = facts.term_facts(raw).where("student_uuid = 'U0'").count()
    assert per_student <= len(term_list) * 2    # a hot student is bounded by terms x colleges


def test_one_award_holder_holds_most_awards(spark):
    awards = [("S1", "U1", 1, "A", 20190101 + i % 9, 191) for i in range(900)] + [
        ("S2", "U2", 1, "A", 20190101, 191)]
    raw = tables(spark, enrollments=[enrollment(1, 175, "a"), enrollment(2, 175, "a")],
                 courses=[course("a", 175)], awards=awards, topcodes=[(1, "One")])
    got = Journey(raw).degree_expanded
    counts = {r.award_number: r.n for r in got.where("uuid = 'U1'").groupBy("award_number").agg(
        F.count("*").alias("n")).collect()}
    assert counts == {k: 100 for k in range(1, 10)} and got.count() == 901
    assert got.select("award_uuid").distinct().count() == 901


def test_a_hot_value_does_not_change_a_crosstab(spark):
    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(
        (F.col("id") % 50).cast("string")).alias("x"), (F.col("id") % 7).cast("string").alias("y"))
    got = explore.crosstab_top(df, "x", "y", top=3)
    assert got.agg(F.sum("students")).first()[0] == 9000
    assert got.where("x_val = 'hot'").agg(F.sum("students")).first()[0] == 3000


def test_offerings_are_shuffled_as_they_are_read(spark):
    """What follows from an offering is worked out after it met an enrollment."""
    j = catalog.journey(spark, SMALL)
    plan = facts.enrollment_courses(j.raw)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 4 and "Join LeftOuter" not in plan.split("Join Inner")[1]
    grouped = j.term_facts._jdf.queryExecution().optimizedPlan().toString()
    first = next(line for line in grouped.splitlines() if "Aggregate [" in line)
    assert first.count(" AS ") < 25 and "bit_or(" in first


def test_flag_bits_keep_nulls_and_both_rules(spark):
    rows = [(k, a, b) for k, pairs in enumerate([
        [(None, None)], [(True, True), (None, None)], [(True, False), (False, True)], [(False, False)],
        [(None, True), (False, None)]]) for a, b in pairs]
    df = spark.createDataFrame(rows, "k int, a boolean, b boolean")
    bits = FlagBits(any_={"any_a": F.col("a"), "any_b": F.col("b")}, all_={"all_a": F.col("a"), "all_b": F.col("b")})
    got = df.groupBy("k").agg(bits.packed().alias("bits")).withColumns(bits.unpacked(F.col("bits"))).drop("bits")
    want = df.groupBy("k").agg(F.bool_or("a").alias("any_a"), F.bool_or("b").alias("any_b"),
                               F.bool_and("a").alias("all_a"), F.bool_and("b").alias("all_b"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    with pytest.raises(ValueError, match="31"):
        FlagBits(any_={f"f{i}": F.lit(True) for i in range(32)})


def test_tasks_of_a_journey_are_bounded_unless_the_session_says_otherwise(spark):
    session = spark.newSession()
    session.conf.set("spark.sql.files.maxPartitionBytes", "99m")
    catalog.journey(session, SMALL)
    assert {n: session.conf.get(n) for n in catalog.SESSION} == catalog.SESSION | {"spark.sql.files.maxPartitionBytes": "99m"}
    wide = spark.newSession()
    wide.conf.set("spark.sql.shuffle.partitions", "400")
    catalog.journey(wide, SMALL)
    assert wide.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None) is None


def test_sorted_rows_of_a_student_are_not_sorted_once_more(spark):
    """Hash aggregation of objects falls back to a sort at 128 keys; the window has sorted them already."""
    plan = plan_of(catalog.journey(spark, SMALL).history)
    assert "SortAggregate" in plan and "ObjectHashAggregate(keys=[student_uuid" not in plan


def test_values_at_the_first_term_are_held_once(spark):
    from termtrail.operators.aggregates import earliest, latest
    rows = [(1, 5, None), (1, 3, "b"), (1, 3, "a"), (1, None, "z"), (2, None, "y"), (2, None, "x"), (3, 4, None), (3, 9, "q")]
    df = spark.createDataFrame(rows, "k int, t int, v string")
    grouped = df.groupBy("k").agg(earliest(F.col("v"), F.col("t")).alias("first"), latest(F.col("v"), F.col("t")).alias("last"),
                                  earliest(F.col("v"), F.col("t"), F.col("t") > 4).alias("later"))
    assert sorted(map(tuple, grouped.collect())) == [(1, "a", None, None), (2, "x", "x", None), (3, None, "q", "q")]
    assert "min_by" not in plan_of(grouped)
