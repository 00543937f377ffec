"""Wide conditional-count rollups over overlapping universes of students."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termtrail import fixed_values as fv
from termtrail.functions.rates import percent_half_up


def demographics_measures() -> dict[str, Column]:
    gender, age = F.col("gender"), F.col("age_at_first_term").cast("int")
    citizen, disabled = F.col("citizenship_earliest"), F.col("has_disability")
    races = ("latin_american", "black", "aapi", "white", "indigenous_american", "unknown_race",
             "two_or_more_races")
    return {
        "gender_m": gender == "M", "gender_f": gender == "F", "gender_u": ~gender.isin("M", "F"),
        **{r: F.col(r) for r in races},
        "traditional_age_at_entry": age <= 24, "over_traditional_age_at_entry": age > 24,
        "age_at_entry_below_18": age < 18,
        **{name: age.between(low, high) for name, (low, high) in fv.AGE_MEASURES.items()},
        "has_disability": disabled, "not_has_disability": ~disabled,
        **{name: citizen == code for code, name in fv.CITIZENSHIP_MEASURES.items()},
        "citizenship_earliest_unknown": (citizen == "X") | citizen.isNull()}


def education_measures() -> dict[str, Column]:
    ed, goal = F.col("highest_ed"), F.col("sb14_student_ed_goal")
    return {**{name: ed == code for code, name in fv.HIGHEST_ED_MEASURES.items()},
            "highest_ed_unknown": (ed == "X") | ed.isNull(),
            **{name: goal == code for code, name in fv.GOAL_MEASURES.items()}}


def program_measures() -> dict[str, Column]:
    flags = ("pell_grant_recipient", "eops_recipient", "special_admit_dual_enrollment",
             "english_or_math_enrollment")
    adj, credit = F.col("first_cb21_level_adj"), F.col("first_cb21_level_credit_only")
    out: dict[str, Column] = {}
    for flag in flags:
        out |= {flag: F.col(flag), f"not_{flag}": ~F.col(flag)}
    for letter in fv.LEVEL_LETTERS:
        out[f"starting_level_esl_{letter.lower()}"] = (adj == letter) | (credit == letter)
    earned = F.col("earned_degree_3_year")
    return out | {
        "starting_level_esl_y_credit": credit == fv.UNSPECIFIED_LEVEL,
        "starting_level_esl_y_noncredit": adj == fv.UNSPECIFIED_LEVEL,
        "starting_level_esl_unknown": adj.isNull() & credit.isNull(),
        "earned_degree_3_year": earned, "not_earned_degree_3_year": ~earned}


def student_universes() -> dict[str, Column]:
    total, noncredit, credit, both = fv.UNIVERSES
    return {total: F.lit(True), noncredit: F.col("always_noncredit_esl"),
            credit: F.col("always_credit_esl"), both: F.col("both_credit_noncredit_esl")}


def universe_table(base: DataFrame, measures: Mapping[str, Column],
                   universes: Mapping[str, Column] | None = None,
                   label: str = "cte_name") -> DataFrame:
    """A count row and a percent row per universe, from one pass over ``base``.

    Universes overlap: each row is counted in every universe it belongs to. An
    empty universe still prints zeros.
    """
    universes = universes or student_universes()
    inside = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in universes.items()]),
                      lambda n: n.isNotNull())
    flagged = base.select(F.explode(inside).alias(label), *[c.alias(n) for n, c in measures.items()])
    counts = flagged.groupBy(label).agg(
        F.count("*").alias("total"), *[F.count_if(F.col(f"`{n}`")).alias(n) for n in measures])
    names = base.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(n) for n in universes])).alias(label))
    full = names.join(counts, label, "left").na.fill(0)
    count_of = lambda n: F.col(f"`{n}`")
    as_counts = F.struct(F.col(label).alias(label), F.col("total").cast("double").alias("total"),
                         *[count_of(n).cast("double").alias(n) for n in measures])
    as_percents = F.struct(
        F.concat(F.col(label), F.lit("_pct")).alias(label), F.lit(100.0).alias("total"),
        *[percent_half_up(count_of(n), F.col("total")).alias(n) for n in measures])
    return full.select(F.inline(F.array(as_counts, as_percents)))


def confirmed(base: DataFrame) -> DataFrame:
    return base.where(F.col("first_college_group").isin(*fv.CONFIRMED_GROUPS))


def demographics_table(base: DataFrame) -> DataFrame:
    return universe_table(confirmed(base), demographics_measures())


def education_table(base: DataFrame) -> DataFrame:
    return universe_table(confirmed(base), education_measures())


def program_table(base: DataFrame) -> DataFrame:
    return universe_table(confirmed(base), program_measures())


def first_level_label() -> Column:
    adj = F.col("first_cb21_level_adj")
    return (F.when(adj.isNotNull(), adj)
            .when(F.col("first_esl_term").isNull(), fv.NEVER_COMPLETED_LABEL)
            .when(F.col("always_credit_esl"), fv.ALWAYS_CREDIT_LABEL)
            .when(F.col("first_term_integrated_esl_course"), fv.INTEGRATED_LABEL)
            .otherwise(fv.OTHER_ISSUE_LABEL))


def first_level_report(base: DataFrame) -> DataFrame:
    """Distinct students per first level and kind, with shares and a Total row.

    Students are made distinct by grouping once, so eight distinct counts cost
    one shuffle and no row expansion.
    """
    label = "first_cb21_level_desc"
    group = F.col("first_college_group")
    kinds = {
        "noncredit_only": F.col("always_noncredit_esl"), "credit_only": F.col("always_credit_esl"),
        "both_credit_noncredit": F.col("both_credit_noncredit_esl"),
        "confirmed_cc_6_levels": group == fv.GROUP_SIX,
        "confirmed_cc_a_b_levels": group == fv.GROUP_AB,
        "confirmed_cc_e_f_levels": group == fv.GROUP_EF, "possible_cc": group == fv.GROUP_POSSIBLE}
    students = (base.where(group != fv.GROUP_OTHER).groupBy("uuid", first_level_label().alias(label))
                .agg(*[F.bool_or(c).alias(n) for n, c in kinds.items()]))
    per_level = students.groupBy(label).agg(
        F.count("*").alias("total"), *[F.count_if(F.col(n)).alias(n) for n in kinds])
    shares = lambda pct: [c for n in kinds for c in (F.col(n), pct(n).alias(f"{n}_pct"))]
    levels = per_level.select(label, "total", *shares(
        lambda n: percent_half_up(F.col(n), F.col("total"))))
    totals = per_level.agg(*[F.sum(n).alias(n) for n in ("total", *kinds)]).select(
        F.lit(fv.TOTAL).alias(label), "total", *shares(lambda n: F.lit(100.0)))
    return levels.unionByName(totals)


def college_group_counts(enrollments: DataFrame, colleges: DataFrame, group) -> DataFrame:
    """Colleges and enrollments per college group."""
    per_college = enrollments.groupBy("gi01").agg(F.count("*").alias("n")).join(
        colleges.select(F.col("gi01_college").alias("gi01"), "college_name"), "gi01")
    return per_college.groupBy(group(F.col("college_name")).alias("college_group")).agg(
        F.count("*").alias("colleges"), F.sum("n").alias("enrollments"))

