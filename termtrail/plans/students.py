"""Student-level layers that do not depend on course levels: who, awards, first term."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termtrail import fixed_values as fv
from termtrail.functions import terms as term_fn
from termtrail.functions.recode import race_flags
from termtrail.operators.aggregates import earliest, latest
from termtrail.params import STUDY, StudyParams
from termtrail.sources.tables import RawTables

KEY = "maskedsb00"


def person_details(details: DataFrame, p: StudyParams = STUDY) -> DataFrame:
    """Everything read off the per-term detail rows, in one grouped pass."""
    gi03 = F.col("gi03")
    in_window = gi03.between(*p.profile_window)
    flags = race_flags(F.col("sb29"))
    last = flags.pop("no_data")
    return details.groupBy(KEY).agg(
        F.min("sb04").alias("gender"),
        *[F.bool_or(c).alias(n) for n, c in flags.items()],
        F.bool_and(last).alias("no_data"),
        earliest(F.col("sb06"), gi03, in_window).alias("citizenship_earliest"),
        latest(F.col("sb06"), gi03, in_window).alias("citizenship_latest"),
        F.min(F.when(in_window, F.left("sb11", F.lit(1)))).alias("highest_ed"),
        earliest(F.col("std1"), gi03).alias("age_at_first_term"),
        F.bool_or(F.col("sb11") == fv.SPECIAL_ADMIT_CODE).alias("special_admit_dual_enrollment"),
        earliest(F.col("sb14"), gi03).alias("sb14_student_ed_goal"))


def enrollment_summary(enrollments: DataFrame, courses: DataFrame,
                       p: StudyParams = STUDY) -> DataFrame:
    """First terms and the English/Math flag of a student.

    First terms come from the enrollments alone. The flag counts transferable
    English/Math enrollments once per offering of the course id in any term:
    both sides are counted first, enrollments per (student, course id) and
    offerings per id, so a large course, or rows without a course id, never
    meet in a join row by row.
    """
    programs = fv.TRANSFER_ENGLISH_PROGRAMS + fv.TRANSFER_MATH_PROGRAMS
    offered = (courses.where(F.col("cb05").isin(*fv.TRANSFERABLE_STATUS)
                             & F.col("cb03").isin(*programs))
               .groupBy("cb00").agg(F.count("*").alias("offerings")))
    gi03 = F.col("gi03")
    finished = F.when((F.col("sx02") == p.not_dropped) & ~F.col("sx04").isin(*p.withdrawn), gi03)
    taken = (enrollments.where(F.col("cb00").isNotNull()).groupBy(KEY, "cb00")
             .agg(F.count("sx01").alias("taken")))
    flags = taken.join(offered, "cb00").groupBy(KEY).agg(
        (F.sum(F.col("taken") * F.col("offerings")) > 1).alias("english_or_math_enrollment"))
    cut, low, high = p.enrollment_wrap
    firsts = enrollments.groupBy(KEY).agg(
        term_fn.first_term_wrapped(gi03, cut, low, high).alias("first_term_enrollment_any"),
        term_fn.first_term_wrapped(finished, cut, low, high)
        .alias("first_term_enrollment_finished_term"),
        F.lit(True).alias("enrolled"))
    return firsts.join(flags, KEY, "left")


def side_sources(raw: RawTables) -> DataFrame:
    """Aid flags and the two recorded first terms, stacked and grouped in one shuffle."""
    empty = {"sf21": "string", "ccc_first_term": "int", "scd1": "int"}

    def source(df: DataFrame, kind: str, column: str) -> DataFrame:
        return df.select(KEY, F.lit(kind).alias("kind"), *[
            F.col(c) if c == column else F.lit(None).cast(t).alias(c) for c, t in empty.items()])

    stacked = (source(raw.aid, "aid", "sf21")
               .unionByName(source(raw.head, "head", "ccc_first_term"))
               .unionByName(source(raw.basic, "basic", "scd1")))
    kind, aid = F.col("kind"), F.col("kind") == "aid"
    return stacked.groupBy(KEY).agg(
        F.bool_or(F.when(aid, F.col("sf21") == fv.PELL_AWARD)).alias("pell_grant_recipient"),
        F.bool_or(F.when(aid, F.col("sf21") == fv.EOPS_AWARD)).alias("eops_recipient"),
        F.min("ccc_first_term").alias("hf"), F.min("scd1").alias("scd1_val"),
        (F.bool_or(kind == "head") & F.bool_or(kind == "basic")).alias("recorded"))


def person(raw: RawTables, p: StudyParams = STUDY) -> DataFrame:
    """Demographics and first terms per student: every table keyed by student, joined once."""
    disability = raw.disability.groupBy(KEY).agg(F.min("sd01").alias("primary_disability"))
    out = raw.students.select(KEY, "uuid")
    for part in (person_details(raw.details, p), disability,
                 enrollment_summary(raw.enrollments, raw.courses, p), side_sources(raw)):
        out = out.join(part, KEY, "left")
    any_term, done = F.col("first_term_enrollment_any"), F.col("first_term_enrollment_finished_term")
    first = F.least(any_term, F.col("hf"), F.col("scd1_val"))
    # A recorded start in the same year is trusted only as far as it was finished.
    same_year = term_fn.year_prefix(first) == term_fn.year_prefix(any_term)
    chosen = F.when(same_year & done.isNotNull(), done).otherwise(first)
    enrolled = F.coalesce(F.col("recorded"), F.lit(False)) & F.col("enrolled")
    return out.withColumn("first_term_enrollment", F.when(enrolled, chosen))


DEMOGRAPHICS = (
    KEY, "uuid", "gender", "hispanic_non_hispanic", "latin_american", "aapi", "black",
    "indigenous_american", "white", "no_data", "citizenship_earliest", "citizenship_latest",
    "highest_ed", "primary_disability", "age_at_first_term", "special_admit_dual_enrollment",
    "sb14_student_ed_goal", "english_or_math_enrollment", "pell_grant_recipient", "eops_recipient")
AWARDS = (
    "earliest_degree_date", "earliest_degree_type", "earliest_degree_topcode",
    "number_degrees_17_23", "earliest_degree_term", "highest_degree_earned",
    "highest_degree_earned_description")
FIRST_TERMS = ("uuid", KEY, "first_term_enrollment_any", "first_term_enrollment_finished_term",
               "hf", "scd1_val", "first_term_enrollment")


def demographics(raw: RawTables, p: StudyParams = STUDY) -> DataFrame:
    return person(raw, p).select(*DEMOGRAPHICS)


def dated_awards(awards: DataFrame, p: StudyParams = STUDY) -> DataFrame:
    return awards.where(F.col("sp03").isNotNull() & (F.col("gi03") >= p.award_from)).withColumn(
        "degree_date", F.to_date(F.col("sp03").cast("string"), "yyyyMMdd"))


def award_summary(raw: RawTables, p: StudyParams = STUDY) -> DataFrame:
    """First award, number of awards, highest-ranked award and the first award's term.

    Award types are looked up before grouping, so one grouped pass serves the
    first and the highest award alike.
    """
    types = raw.award_types.select(F.col("award_code").alias("sp02"), "award_ranking",
                                   "award_description", F.lit(True).alias("ranked"))
    awards = dated_awards(raw.awards, p).join(types, "sp02", "left")
    when, rank = F.col("degree_date"), F.col("award_ranking")
    counted = F.col("ranked") & F.col("gi03").between(*p.profile_window)
    firsts = awards.groupBy(KEY).agg(
        F.min(when).alias("earliest_degree_date"),
        earliest(F.col("sp02"), when).alias("earliest_degree_type"),
        earliest(F.col("sp01"), when).alias("earliest_degree_topcode"),
        F.count("*").alias("number_degrees_17_23"),
        earliest(F.col("sp02"), rank, counted).alias("highest_degree_earned"),
        earliest(F.col("award_description"), rank, counted)
        .alias("highest_degree_earned_description"))
    # One row per calendar quarter, so the join cannot fan out.
    quarters = raw.terms.groupBy(
        F.col("quarter").alias("_q"), term_fn.year_prefix(F.col("gi03")).alias("_yy")).agg(
            F.max("gi03").alias("earliest_degree_term"))
    day = F.col("earliest_degree_date")
    dated = firsts.withColumns({
        "_q": F.quarter(day), "_yy": F.right(F.year(day).cast("string"), F.lit(2))})
    return dated.join(quarters, ["_q", "_yy"], "left").drop("_q", "_yy")


def with_awards(people: DataFrame, raw: RawTables, p: StudyParams = STUDY) -> DataFrame:
    return people.join(award_summary(raw, p), KEY, "left")


def degree_info(raw: RawTables, p: StudyParams = STUDY) -> DataFrame:
    return with_awards(person(raw, p), raw, p).select(*DEMOGRAPHICS, *AWARDS)


def first_terms(raw: RawTables, p: StudyParams = STUDY) -> DataFrame:
    """Students with an enrollment and a record in both other sources, and their first term."""
    return person(raw, p).where("enrolled AND recorded").select(*FIRST_TERMS)
