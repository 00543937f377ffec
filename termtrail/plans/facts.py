"""Enrollment facts: one join of enrollments with courses, one grouped pass over it.

Every per-term and ESL-history measure of a student comes from
``term_facts``, keyed (student, term, college). Its aggregates combine before
the shuffle, so a student or course holding a large share of the rows costs at
most (terms x colleges) rows per map task afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termtrail import fixed_values as fv
from termtrail.functions import colleges as col_fn
from termtrail.functions import sequences as seq
from termtrail.functions import terms as term_fn
from termtrail.operators.aggregates import FlagBits, letter_of, max_letter, min_letter
from termtrail.params import STUDY, StudyParams
from termtrail.sources.tables import RawTables

FLAG_SEQUENCES = ("any_esl_enrollment", "any_noncredit_esl_enrollment",
                  "any_credit_esl_enrollment", "any_both_esl_enrollment")
LOWEST_SEQUENCES = ("lowest_cb21_level_adjusted_rws", "lowest_cb21_level_adjusted_all",
                    "lowest_cb21_level_adjusted_all_credit_types",
                    "lowest_cb21_level_adjusted_a_f_only_collapsed",
                    "lowest_cb21_level_adjusted_a_f_only_others_0")
HIGHEST_SEQUENCES = ("highest_cb21_level_adjusted_achieved_rws",
                     "highest_cb21_level_adjusted_achieved_all")
UNUSED_HIGHEST = "highest_cb21_level_adjusted_achieved_crnc"
PROGRAM_SEQUENCES = tuple(f"any_{p}_course_enrollment" for p in fv.ESL_PROGRAMS)
COLLEGE_SEQUENCE = "college_group_enrollment"
ABSOLUTE_SEQUENCES = FLAG_SEQUENCES + LOWEST_SEQUENCES + HIGHEST_SEQUENCES + PROGRAM_SEQUENCES
RELATIVE_SEQUENCES = ABSOLUTE_SEQUENCES + (COLLEGE_SEQUENCE,)
SMALLEST_WINS = tuple(m in HIGHEST_SEQUENCES for m in RELATIVE_SEQUENCES)
PER_TERM_MEASURES = RELATIVE_SEQUENCES + (UNUSED_HIGHEST,)


def terms_adjusted(terms: DataFrame) -> DataFrame:
    """Terms with a quarter decoded from the code; whole-year codes dropped."""
    return terms.where(term_fn.is_quarter_term(F.col("gi03"))).select(
        "gi03", "year", "term", term_fn.quarter(F.col("gi03")).alias("quarter"))


def term_lookup(terms: DataFrame) -> DataFrame:
    """Terms to look up: all of them. Spark's size check decides how they are joined."""
    return terms_adjusted(terms)


def semesters(terms: DataFrame, p: StudyParams = STUDY) -> DataFrame:
    """Terms rolled up to (year label, quarter), names and codes joined in code order."""
    low, high = p.sequence_window
    rows = F.array_sort(F.collect_list(F.struct("gi03", "term")))
    grouped = (terms_adjusted(terms).where(F.col("gi03").between(low, high))
               .groupBy("year", "quarter").agg(rows.alias("rows")))
    joined = lambda field, sep: F.array_join(
        F.transform("rows", lambda r: r[field].cast("string")), sep)
    return grouped.select(
        "year", "quarter",
        term_fn.absolute_term(F.col("rows")[0]["gi03"], F.col("quarter")).alias("term"),
        joined("term", ", ").alias("term_names"), joined("gi03", "-").alias("term_codes"))


def _course_flags(gi01: Column, p: StudyParams) -> dict[str, Column]:
    """Program flags of an offering and its level letter after the college's rule."""
    esl = F.coalesce(F.col("cb03").isin(*p.esl_programs), F.lit(False))
    noncredit = F.coalesce(esl & (F.col("cb04") == fv.NONCREDIT), F.lit(False))
    credit = F.coalesce(esl & F.col("cb04").isin(*fv.CREDIT_CODES), F.lit(False))
    return {"esl": esl, "noncredit": noncredit, "credit": credit,
            "letter": F.when(noncredit, col_fn.level_by_college_code(F.col("cb21"), gi01)).otherwise(F.col("cb21"))}


def courses_adjusted(courses: DataFrame, p: StudyParams = STUDY) -> DataFrame:
    """Course offerings with program flags and the level after the college's rule."""
    flags = _course_flags(F.col("gi01"), p)
    return courses.select(
        F.col("gi03").alias("term"), "cb00", "cb01", "gi01", "cb04", "cb21", "cb03",
        flags["esl"].alias("is_esl_course"), flags["noncredit"].alias("is_noncredit_esl_course"),
        flags["credit"].alias("is_credit_esl_course"),
        flags["letter"].alias("esl_course_level_adjusted_for_college"))


def _leveled(joined: DataFrame, raw: RawTables, p: StudyParams) -> DataFrame:
    """Joined offerings with the numeric level of the raw and the name-adjusted letter.

    Lookups are left joins: each measure states which lookups it needs. They
    carry no hint, so Spark broadcasts them only while their size allows it.
    """
    named = joined.join(
        raw.colleges.select(F.col("gi01_college").alias("course_gi01"),
                            F.col("college_name").alias("course_college")), "course_gi01", "left")
    named = named.withColumn("letter_adj", col_fn.level_by_college_name(
        F.col("cb21"), F.col("course_college")))
    raw_level = raw.levels.select("cb21", F.col("levels_below_transfer").alias("level_raw"))
    adj_level = raw.levels.select(F.col("cb21").alias("letter_adj"),
                                  F.col("levels_below_transfer").alias("level_adj"))
    return named.join(raw_level, "cb21", "left").join(adj_level, "letter_adj", "left")


def enrollment_courses(raw: RawTables, p: StudyParams = STUDY) -> DataFrame:
    """Kept enrollments joined to course offerings on (course id, term).

    The join is deliberately not on college, so one enrollment can meet the
    same course id offered at several colleges; ``same_college`` marks the
    three-key matches. Offerings are shuffled as they are read: what follows
    from them is worked out for those that meet an enrollment.
    """
    kept = raw.enrollments.where(F.col("sx02") == p.not_dropped).select(
        "student_uuid", "gi01", "gi03", "cb00", "sx04")
    offered = raw.courses.select("gi03", "cb00", F.col("gi01").alias("course_gi01"), "cb03", "cb04", "cb21")
    colleges = raw.colleges.select(F.col("gi01_college").alias("gi01"), "college_name")
    grade = F.col("sx04")
    joined = kept.join(offered, ["cb00", "gi03"]).withColumns({
        **_course_flags(F.col("course_gi01"), p),
        "same_college": F.col("gi01") == F.col("course_gi01"),
        "stayed": ~grade.isin(*p.withdrawn),
        "passed": ~grade.isin(*p.not_passed)})
    return _leveled(joined, raw, p).join(colleges, "gi01", "left")


def _lowest(taken: Column, specials: dict[str, str]) -> Column:
    """Level letter of a taken course ('0' if not taken), unspecified level as '1'."""
    letter = F.when(F.col("letter") == fv.UNSPECIFIED_LEVEL, F.lit("1"))
    for source, target in specials.items():
        letter = letter.when(F.col("letter") == source, F.lit(target))
    return F.when(taken, letter.otherwise(F.col("letter"))).otherwise("0")


def _achieved(taken: Column) -> Column:
    """Like ``_lowest`` but an unspecified level counts as no value at all."""
    specified = F.when(F.col("letter") != fv.UNSPECIFIED_LEVEL, F.col("letter"))
    return F.when(taken, specified).otherwise("0")


def term_facts(raw: RawTables, p: StudyParams = STUDY) -> DataFrame:
    """Per (student, term, college): sequence measures and ESL-history measures."""
    rows = enrollment_courses(raw, p)
    gi03, cb03, cb04 = F.col("gi03"), F.col("cb03"), F.col("cb04")
    esl, noncredit, credit = F.col("esl"), F.col("noncredit"), F.col("credit")
    stayed, passed, same = F.col("stayed"), F.col("passed"), F.col("same_college")
    level, level_adj = F.col("level_raw"), F.col("level_adj")
    known = F.col("college_name").isNotNull()
    apart = cb03 != fv.INTEGRATED_PROGRAM
    in_sequence = known & level.isNotNull() & gi03.between(*p.sequence_window)
    history = esl & stayed
    passed_noncredit = esl & passed & same & known & (cb04 == fv.NONCREDIT)
    raw_scope = passed_noncredit & level.isNotNull() & gi03.between(*p.first_level_window)
    adj_scope = passed_noncredit & gi03.between(*p.completion_window)
    is_n, is_c = cb04 == fv.NONCREDIT, cb04.isin(*fv.CREDIT_CODES)
    merged, zeroed = {"G": "F", "H": "F"}, {"G": "0", "H": "0"}

    flags = dict(zip(FLAG_SEQUENCES, (esl, noncredit & stayed, credit & stayed,
                                      noncredit & credit & stayed)))
    lowest = dict(zip(LOWEST_SEQUENCES, (
        _lowest(noncredit & apart & stayed, {}), _lowest(noncredit & stayed, {}),
        _lowest(esl & stayed, {}), _lowest(noncredit & stayed, merged),
        _lowest(noncredit & stayed, zeroed))))
    highest = dict(zip(HIGHEST_SEQUENCES + (UNUSED_HIGHEST,), (
        _achieved(noncredit & apart & passed), _achieved(noncredit & passed),
        _achieved(esl & passed))))
    programs = {n: (cb03 == code) & stayed for n, code in zip(PROGRAM_SEQUENCES, fv.ESL_PROGRAMS)}

    # all flags of a scope are one number in the hash table and in the shuffle
    sequence = FlagBits(any_={n: F.when(in_sequence, c) for n, c in (flags | programs).items()})
    past = FlagBits(
        any_={"history_noncredit": F.when(history, is_n), "history_credit": F.when(history, is_c),
              "late_noncredit": F.when(esl & passed & (gi03 >= p.noncredit_from), is_n)},
        all_={"only_integrated": F.when(history & known, ~apart),
              "history_all_noncredit": F.when(history, is_n), "history_all_credit": F.when(history, is_c),
              "passed_all_credit": F.when(esl & passed & level.isNotNull(), ~is_n)})
    grouped = rows.groupBy("student_uuid", "gi03", "college_name").agg(
        F.count_if(in_sequence).alias("sequence_rows"), sequence.packed().alias("sequence_bits"),
        *[max_letter(c, in_sequence).alias(n) for n, c in lowest.items()],
        *[min_letter(c, in_sequence).alias(n) for n, c in highest.items()],
        F.count_if(history & known).alias("history_rows"), past.packed().alias("history_bits"),
        F.max(F.when(raw_scope, level)).alias("first_level"),
        F.max(F.when(esl & passed, level)).alias("credit_level"),
        F.count_if(adj_scope).alias("completion_rows"),
        F.max(F.when(adj_scope, level_adj)).alias("lowest_adj"),
        F.max(F.when(adj_scope & (F.col("letter_adj") != fv.UNSPECIFIED_LEVEL), level_adj))
        .alias("lowest_specified_adj"),
        F.min(F.when(adj_scope, level_adj)).alias("highest_adj"))
    grouped = grouped.withColumns(sequence.unpacked(F.col("sequence_bits"))
                                  | past.unpacked(F.col("history_bits"))).drop("sequence_bits", "history_bits")
    text = {n: F.col(n).cast("int").cast("string") for n in FLAG_SEQUENCES}
    text |= {n: letter_of(F.col(n)) for n in (*lowest, *highest)}
    text |= {n: F.coalesce(F.col(n), F.lit(False)).cast("int").cast("string") for n in programs}
    out = grouped.withColumns(text).withColumn(
        COLLEGE_SEQUENCE, col_fn.group_letter(F.col("college_name")))
    return out.withColumn("code", seq.term_code([F.col(m) for m in RELATIVE_SEQUENCES],
                                                SMALLEST_WINS))


def per_term_info(facts: DataFrame) -> DataFrame:
    """One row per (student, term, college) with an enrollment in the sequence window."""
    return facts.where("sequence_rows > 0").select(
        "student_uuid", F.col("gi03").alias("term"), "college_name", *PER_TERM_MEASURES)
