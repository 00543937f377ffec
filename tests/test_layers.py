"""Quirks of the layers on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from termtrail import fixed_values as fv
from termtrail.plans import facts, students
from termtrail.plans.journey import Journey, flat_file
from tests.helpers import by_key, course, detail, enrollment, tables


def history(spark, enrollments, courses, **more):
    raw = tables(spark, enrollments=enrollments, courses=courses, **more)
    return by_key(Journey(raw).history, "student_uuid")


def per_term(spark, enrollments, courses, **more):
    raw = tables(spark, enrollments=enrollments, courses=courses, **more)
    rows = facts.per_term_info(facts.term_facts(raw)).collect()
    return {(r.student_uuid, r.term, r.college_name): r.asDict() for r in rows}


def test_first_terms_reconciliation(spark):
    rows = [
        enrollment(1, 175, "x"), enrollment(1, 181, "x"),                    # plain
        enrollment(2, 175, "x", sx02="20190101"), enrollment(2, 177, "x"),   # dropped first
        enrollment(3, 177, "x"),                                             # earlier record, same year
        enrollment(4, 183, "x"),                                             # earlier record, other year
        enrollment(5, 175, "x", grade="W"),                                  # never finished
        enrollment(6, 955, "x"), enrollment(6, 961, "x"),                    # only the 1900s
        enrollment(7, 955, "x"), enrollment(7, 175, "x"),                    # both centuries
        enrollment(8, 175, "x", grade=None),                                 # unknown grade
    ]
    raw = tables(spark, enrollments=rows, head=[(f"S{i}", {3: 175, 4: 165}.get(i, 999))
                                                for i in range(1, 9)])
    got = {k: (v["first_term_enrollment"], v["first_term_enrollment_finished_term"])
           for k, v in by_key(students.first_terms(raw), "uuid").items()}
    assert got == {"U1": (175, 175), "U2": (177, 177), "U3": (177, 177), "U4": (165, 183),
                   "U5": (175, None), "U6": (955, 955), "U7": (175, 175), "U8": (175, None)}


def test_a_student_missing_from_a_source_has_no_first_term(spark):
    raw = tables(spark, enrollments=[enrollment(1, 175, "x")], head=[])
    assert students.first_terms(raw).count() == 0


def test_demographics_ties_nulls_and_windows(spark):
    details = [detail(1, 177, gi01="a", sb06="3"), detail(1, 177, gi01="b", sb06="2"),
               detail(1, 181, sb06="4", std1="21"), detail(1, 165, sb06="9", std1="18"),
               detail(2, 175, sb06=None), detail(2, 181, sb06="1", sb11="10000")]
    raw = tables(spark, enrollments=[enrollment(1, 175, "x"), enrollment(2, 175, "x")],
                 details=details, disability=[("S2", "P"), ("S2", "M")],
                 aid=[("S1", "GP"), ("S1", "XX")])
    got = by_key(students.demographics(raw), "maskedsb00")
    one, two = got["S1"], got["S2"]
    assert (one["citizenship_earliest"], one["citizenship_latest"]) == ("2", "4")
    assert one["age_at_first_term"] == "18"            # age has no window
    assert one["highest_ed"] == "3" and two["highest_ed"] == "1"
    assert two["citizenship_earliest"] is None          # a null first value is kept
    assert two["special_admit_dual_enrollment"] and not one["special_admit_dual_enrollment"]
    assert two["primary_disability"] == "M"
    assert (one["pell_grant_recipient"], one["eops_recipient"]) == (True, False)
    assert two["pell_grant_recipient"] is None


def test_english_or_math_counts_every_offering(spark):
    offered = [course("m", t, cb03="170000", cb05="A") for t in (175, 177, 181)]
    raw = tables(spark, enrollments=[enrollment(1, 175, "m"), enrollment(2, 175, "m", sx01=None),
                                     enrollment(3, 175, "z")],
                 courses=offered + [course("z", 175, cb03="170000", cb05="Y")])
    got = by_key(students.demographics(raw), "maskedsb00")
    assert got["S1"]["english_or_math_enrollment"] is True      # 1 enrollment x 3 offerings
    assert got["S2"]["english_or_math_enrollment"] is False     # null sx01 does not count
    assert got["S3"]["english_or_math_enrollment"] is None


def test_degree_layer(spark):
    awards = [("S1", "U1", 493084, "T", 20190515, 195), ("S1", "U1", 493100, "A", 20190515, 195),
              ("S1", "U1", 70100, "Z", 20180101, 165), ("S1", "U1", 70100, "Z", None, 195)]
    types = [("A", "Arts", 1), ("T", "Cert", 3)]
    raw = tables(spark, enrollments=[enrollment(1, 175, "x"), enrollment(2, 175, "x")],
                 awards=awards, award_types=types)
    got = by_key(Journey(raw).degree_info, "maskedsb00")
    one = got["S1"]
    assert str(one["earliest_degree_date"]) == "2019-05-15" and one["number_degrees_17_23"] == 2
    assert (one["earliest_degree_type"], one["earliest_degree_topcode"]) == ("A", 493084)
    assert one["highest_degree_earned"] == "A"
    assert one["earliest_degree_term"] == 193
    assert got["S2"]["earliest_degree_date"] is None


def test_two_colleges_in_a_term_give_two_characters(spark):
    rows = [enrollment(1, 175, "a"), enrollment(1, 175, "b", gi01="9001"), enrollment(1, 177, "a")]
    courses = [course("a", 175, cb21="B"), course("b", 175, cb21="D", gi01="9001"),
               course("a", 177, cb21="C")]
    got = history(spark, rows, courses)["U1"]
    assert got["any_esl_enrollment_by_terms"] == "111"
    assert got["lowest_cb21_level_adjusted_all_by_terms"] == "ADC"     # B is A at this college
    assert got["college_group_enrollment_by_terms"] == "A6A"
    grid = got["lowest_cb21_level_adjusted_all_abs_by_terms"]
    assert len(grid) == 26 and grid == "DC" + "-" * 24                 # from 175 on, lowest level wins
    assert got["highest_cb21_level_adjusted_achieved_all_abs_by_terms"][0] == "A"
    assert got["multiple_colleges"] and got["first_college_name"] == "COMPTON"


def test_unspecified_level_shortens_only_the_achieved_sequence(spark):
    rows = [enrollment(1, 175, "y"), enrollment(1, 177, "a")]
    courses = [course("y", 175, cb21="Y"), course("a", 177, cb21="C")]
    got = history(spark, rows, courses)["U1"]
    assert got["lowest_cb21_level_adjusted_all_by_terms"] == "1C"
    assert got["highest_cb21_level_adjusted_achieved_all_by_terms"] == "C"
    assert got["highest_cb21_level_adjusted_achieved_all_abs_by_terms"].startswith("-C")


def test_withdrawn_term_counts_as_any_esl_only(spark):
    rows = [enrollment(1, 175, "a", grade="W"), enrollment(1, 177, "a")]
    courses = [course("a", 175), course("a", 177)]
    got = history(spark, rows, courses)["U1"]
    assert got["any_esl_enrollment_by_terms"] == "11"
    assert got["any_noncredit_esl_enrollment_by_terms"] == "01"
    assert got["first_esl_term"] == 177


def test_failed_course_forces_zero_achieved(spark):
    rows = [enrollment(1, 175, "a"), enrollment(1, 175, "b", grade="F")]
    got = per_term(spark, rows, [course("a", 175, cb21="C"), course("b", 175, cb21="D")])
    row = got[("U1", 175, "COMPTON")]
    assert row["lowest_cb21_level_adjusted_all"] == "D"
    assert row["highest_cb21_level_adjusted_achieved_all"] == "0"
    assert row["any_both_esl_enrollment"] == "0"


def test_letters_g_and_h_collapse_or_vanish(spark):
    got = per_term(spark, [enrollment(1, 175, "h")], [course("h", 175, cb21="H")])
    row = got[("U1", 175, "COMPTON")]
    assert row["lowest_cb21_level_adjusted_all"] == "H"
    assert row["lowest_cb21_level_adjusted_a_f_only_collapsed"] == "F"
    assert row["lowest_cb21_level_adjusted_a_f_only_others_0"] == "0"


def test_unknown_grade_is_null_not_zero(spark):
    got = per_term(spark, [enrollment(1, 175, "a", grade=None)], [course("a", 175)])
    row = got[("U1", 175, "COMPTON")]
    assert row["any_esl_enrollment"] == "1" and row["any_noncredit_esl_enrollment"] is None
    assert row["any_493084_course_enrollment"] == "0"


def test_lookups_filter_rows(spark):
    rows = [enrollment(1, 175, "a"), enrollment(1, 177, "a", gi01="none"), enrollment(1, 181, "q")]
    courses = [course("a", 175), course("a", 177), course("q", 181, cb21="Q")]
    got = per_term(spark, rows, courses)
    assert set(got) == {("U1", 175, "COMPTON")}


def test_fan_out_weighs_the_first_college(spark):
    # one enrollment meets the same course id offered at three colleges
    rows = [enrollment(1, 175, "a"), enrollment(1, 177, "b", gi01="9001"),
            enrollment(1, 181, "c", gi01="9001")]
    courses = [course("a", 175, gi01=g) for g in ("141", "271", "9001")] + [
        course("b", 177, gi01="9001"), course("c", 181, gi01="9001")]
    assert history(spark, rows, courses)["U1"]["first_college_name"] == "COMPTON"


def test_levels_and_completion(spark):
    rows = [enrollment(1, 175, "y"), enrollment(1, 175, "c"), enrollment(1, 177, "d"),
            enrollment(1, 181, "b"), enrollment(1, 181, "c2"),
            enrollment(2, 175, "k"), enrollment(2, 177, "k2")]
    courses = [course("y", 175, cb21="Y"), course("c", 175, cb21="C"), course("d", 177, cb21="D"),
               course("b", 181, cb21="B"), course("c2", 181, cb21="C"),
               course("k", 175, cb04="C", cb21="E"), course("k2", 177, cb04="D", cb21="B")]
    got = history(spark, rows, courses)
    one, two = got["U1"], got["U2"]
    assert one["first_cb21_level"] == "Y"              # the raw rule keeps the unspecified level
    assert one["first_cb21_level_adj"] == "C"          # the adjusted rule does not, if it can
    assert one["terms_to_full_completion_adj"] == 3    # B is A at this college
    assert one["full_completion_levels_adj"] == 2      # lowest level of the completing term, less 1
    assert one["first_cb21_level_credit_only"] is None
    assert two["first_cb21_level"] is None and two["first_cb21_level_credit_only"] == "E"
    assert two["always_credit_esl"] and two["first_term_credit_only"]
    assert two["both_credit_noncredit_esl"] is False and one["both_credit_noncredit_esl"] is None


def test_first_esl_term_wraps_at_the_century(spark):
    rows = [enrollment(1, 955, "a"), enrollment(1, 175, "a"), enrollment(2, 175, "a")]
    got = history(spark, rows, [course("a", 955), course("a", 175)])
    assert got["U1"]["first_esl_term"] == 955 and got["U2"]["first_esl_term"] == 175
    assert got["U1"]["first_academic_year"] is None and got["U1"]["has_term_window"] is False


def test_integrated_flag_looks_at_all_history(spark):
    rows = [enrollment(1, 175, "i"), enrollment(1, 177, "a"), enrollment(2, 175, "i")]
    courses = [course("i", 175, cb03=fv.INTEGRATED_PROGRAM), course("a", 177)]
    got = history(spark, rows, courses)
    assert got["U1"]["first_term_integrated_esl_course"] is False
    assert got["U2"]["first_term_integrated_esl_course"] is True


def test_window_terms(spark):
    rows = [enrollment(1, t, "a") for t in (175, 203, 205, 233, 237)]
    got = history(spark, rows, [course("a", t) for t in (175, 203, 205, 233, 237)])["U1"]
    assert (got["latest_6_term"], got["latest_12_term"]) == (204, 234)
    assert (got["term_in_6"], got["term_in_12"]) == (203, 233)


def test_flat_file_flag_reads_the_last_term(spark):
    rows = [("6O", True), ("O6", True), ("PP6", True), ("6P", False)]
    df = spark.createDataFrame(rows, "college_group_enrollment_by_terms string, multiple_colleges boolean")
    df = df.withColumns({"first_college_group": F.lit(fv.GROUP_SIX), "first_esl_term": F.lit(240)})
    last = {r[0]: r["non_64_college_enrollment"] for r in flat_file(df).collect()}
    ever = {r[0]: r["non_64_college_enrollment"] for r in flat_file(df, ever=True).collect()}
    assert last == {"6O": True, "O6": False, "PP6": False, "6P": False}
    assert ever == {"6O": True, "O6": True, "PP6": True, "6P": False}
    row = flat_file(df).first()
    assert row.observation_6_sem and not row.observation_12_sem


def test_semesters_join_terms_in_code_order(spark):
    terms = [(178, "2017-2018", "FALL QUARTER", 4), (177, "2017-2018", "FALL SEMESTER", 4),
             (170, "2016-2017", "ANNUAL", None)]
    row = facts.semesters(tables(spark, terms=terms).terms).collect()
    assert [(r.term, r.term_names, r.term_codes) for r in row] == [
        (20174, "FALL SEMESTER, FALL QUARTER", "177-178")]


def test_award_rows_are_ranked_by_date_with_ties(spark):
    rows = [enrollment(1, 175, "a")]
    awards = [("S1", "U1", 1, "Z", 20190101, 191), ("S1", "U1", 1, "B", 20190101, 191),
              ("S1", "U1", 1, "Q", 20200101, 201), ("S1", "U1", 2, "A", 20180101, 181),
              ("S1", "U1", 1, "?", 20210101, 211)]
    raw = tables(spark, enrollments=rows, courses=[course("a", 175)], awards=awards,
                 topcodes=[(1, "One")])
    got = Journey(raw).degree_expanded.collect()
    assert sorted((r.award_code, r.award_number, r.award_description[:12]) for r in got) == [
        ("?", 3, "Unknown"), ("B", 1, "Credit Certi"), ("Q", 2, "Noncredit aw"),
        ("Z", 1, "Baccalaureat")]
    assert len({r.award_uuid for r in got}) == 4


def test_terms_beyond_three_digits_are_kept(spark):
    from termtrail.plans import facts
    from tests.helpers import TERMS
    raw = tables(spark, terms=[*TERMS, (1025, "2102-2103", "SUMMER TERM", 3)])
    kept = {r.gi03 for r in facts.term_lookup(raw.terms).collect()}
    assert kept == {r.gi03 for r in facts.terms_adjusted(raw.terms).collect()} and 1025 in kept


def test_a_code_of_two_characters_raises(spark):
    from termtrail.operators.aggregates import letter_of, max_letter
    largest = letter_of(max_letter(F.col("l"), F.lit(True)))
    assert spark.createDataFrame([("A",), ("C",), (None,)], "l string").agg(largest.alias("x")).first().x == "C"
    with pytest.raises(Exception, match="one character"):
        spark.createDataFrame([("10",)], "l string").agg(largest).collect()


def test_english_or_math_with_a_hot_course_and_missing_course_ids(spark):
    from termtrail.plans import students
    hot = [enrollment(i % 40, 175, "hot") for i in range(900)] + [enrollment(99, 177, "hot")]
    none = [enrollment(i % 5, 181, None) for i in range(600)]
    offered = [course("hot", 175, cb03="150100", cb05="A"), course("hot", 185, cb03="150100", cb05="A"),
               course("other", 175, cb03="150100", cb05="A")]
    raw = tables(spark, enrollments=hot + none + [enrollment(50, 175, "else"), enrollment(51, 175, "other")],
                 courses=offered)
    got = {r.maskedsb00: (r.english_or_math_enrollment, r.first_term_enrollment_any)
           for r in students.enrollment_summary(raw.enrollments, raw.courses).collect()}
    assert got["S0"] == (True, 175) and got["S99"] == (True, 177)    # one enrollment, two offerings
    assert got["S50"] == (None, 175) and got["S51"] == (False, 175) and len(got) == 43
    plan = students.enrollment_summary(raw.enrollments, raw.courses)._jdf.queryExecution().optimizedPlan().toString()
    joined = plan.split("Join Inner")[1]
    assert joined.count("Aggregate [") == 2 and "isnotnull(cb00" in joined
