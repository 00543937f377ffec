"""One row per student: ESL history, levels, windows and all sequences, in one grouped pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termtrail.functions import sequences as seq
from termtrail.functions import terms as term_fn
from termtrail.params import STUDY, StudyParams
from termtrail.plans.facts import (
    ABSOLUTE_SEQUENCES, RELATIVE_SEQUENCES, SMALLEST_WINS, term_lookup)

NO_QUARTER = 2147483647   # grid key of a term without a quarter: sorts last


def absolute_name(measure: str) -> str:
    return f"{measure}_abs_by_terms"


def relative_name(measure: str) -> str:
    return f"{measure}_by_terms"


def _grid_key():
    return F.coalesce(term_fn.absolute_term(F.col("gi03"), F.col("quarter")), F.lit(NO_QUARTER))


def _student_rows(facts: DataFrame, terms: DataFrame, p: StudyParams) -> DataFrame:
    """Facts with each student's anchor terms; one shuffle and one sort by student."""
    calendar = term_lookup(terms)
    this = calendar.select("gi03", F.lit(True).alias("listed"), _grid_key().alias("grid_key"))
    own = Window.partitionBy("student_uuid").orderBy("gi03")
    whole = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    peers = own.rangeBetween(Window.currentRow, Window.currentRow)
    gi03 = F.col("gi03")
    history = F.when(F.col("history_rows") > 0, gi03)
    staged = facts.join(this, "gi03", "left").withColumn(
        "ranked", F.coalesce((F.col("completion_rows") > 0) & F.col("listed"), F.lit(False)))
    staged = staged.withColumns({
        "first_esl_term": term_fn.first_term_wrapped(history, *p.esl_wrap, by="max", over=whole),
        "first_ranked_term": F.min(F.when(F.col("ranked"), gi03)).over(whole),
        "term_highest_adj": F.min(F.when(F.col("ranked"), F.col("highest_adj"))).over(peers),
    })
    start = calendar.select(
        gi03.alias("first_esl_term"), F.col("year").alias("first_year"),
        F.col("term").alias("first_term_name"), F.lit(True).alias("start_listed"))
    staged = staged.join(start, "first_esl_term", "left")
    end = lambda years: term_fn.window_end(F.col("first_esl_term"), F.col("first_year"), years)
    return staged.withColumns({
        "latest_6_term": F.when(F.col("start_listed"), end(3)),
        "latest_12_term": F.when(F.col("start_listed"), end(6))})


def _college_counts(rows):
    """Per college name: (negated ESL row count, name), so the minimum is the mode."""
    esl = F.filter(rows, lambda r: r["history_rows"] > 0)
    names = F.array_distinct(F.transform(esl, lambda r: r["college_name"]))
    total = lambda name: F.aggregate(
        F.filter(esl, lambda r: r["college_name"] == name), F.lit(0).cast("bigint"),
        lambda acc, r: acc - r["history_rows"])
    return F.transform(names, lambda name: F.struct(total(name).alias("n"), name.alias("name")))


def student_history(facts: DataFrame, terms: DataFrame, levels: DataFrame,
                    p: StudyParams = STUDY) -> DataFrame:
    rows = _student_rows(facts, terms, p)
    gi03, first = F.col("gi03"), F.col("first_esl_term")
    at_first = gi03 == first
    ranked, listed = F.col("ranked"), F.coalesce(F.col("listed"), F.lit(False))
    in_sequence = F.col("sequence_rows") > 0
    done = ranked & (F.col("term_highest_adj") == 1)
    first_level = F.min(F.when(
        F.col("first_level").isNotNull() & listed & (gi03 >= first),
        F.struct(gi03.alias("t"), (-F.col("first_level")).alias("l"))))
    at_ranked = ranked & (gi03 == F.col("first_ranked_term"))
    inside = lambda low, high: F.max(F.when(in_sequence & gi03.between(low, high), gi03))

    grouped = rows.groupBy("student_uuid").agg(
        F.array_sort(F.collect_list(F.struct(
            "gi03", "college_name", "grid_key", "sequence_rows", "history_rows", "code")))
        .alias("all_rows"),
        F.first(first).alias("first_esl_term"),
        F.first("first_year").alias("first_academic_year"),
        F.first(term_fn.half_year(F.col("first_term_name"))).alias("cohort"),
        F.first("latest_6_term").alias("latest_6_term"),
        F.first("latest_12_term").alias("latest_12_term"),
        F.sum("history_rows").alias("history_rows"),
        F.sum("sequence_rows").alias("sequence_rows"),
        F.bool_and("only_integrated").alias("first_term_integrated_esl_course"),
        F.bool_or(F.when(at_first, F.col("history_noncredit"))).alias("first_term_noncredit"),
        F.bool_or(F.when(at_first, F.col("history_credit"))).alias("first_credit"),
        F.bool_or("history_credit").alias("ever_credit_esl"),
        F.bool_and("history_all_noncredit").alias("always_noncredit_esl"),
        F.bool_and("history_all_credit").alias("always_credit_esl"),
        F.bool_or("late_noncredit").alias("took_noncredit"),
        first_level.alias("first_level"),
        F.max(F.when(at_first, F.col("credit_level"))).alias("credit_level"),
        F.bool_and("passed_all_credit").alias("passed_all_credit"),
        F.coalesce(F.max(F.when(at_ranked, F.col("lowest_specified_adj"))),
                   F.max(F.when(at_ranked, F.col("lowest_adj")))).alias("first_level_adj"),
        F.collect_set(F.when(ranked, gi03)).alias("ranked_terms"),
        F.min(F.when(done, gi03)).alias("done_term"),
        (F.max(F.when(done, F.col("lowest_adj"))) - 1).alias("full_completion_levels_adj"),
        inside(first + 1, F.col("latest_6_term")).alias("term_in_6"),
        inside(F.col("latest_6_term") + 1, F.col("latest_12_term")).alias("term_in_12"))

    low, high = p.sequence_window
    grid = (term_lookup(terms).where(gi03.between(low, high))
            .agg(F.array_sort(F.collect_set(_grid_key())).alias("grid")).scalar())
    counts = _college_counts(F.col("all_rows"))
    has_history = F.col("history_rows") > 0
    shaped = grouped.withColumns({
        "rows": F.filter("all_rows", lambda r: r["sequence_rows"] > 0),
        "college_counts": counts,
        "first_level": -F.col("first_level")["l"],
        "credit_level": F.when(F.col("passed_all_credit") & has_history, F.col("credit_level")),
        "terms_to_full_completion_adj": F.when(
            F.col("done_term").isNotNull(),
            F.size(F.filter("ranked_terms", lambda t: t <= F.col("done_term")))),
        "grid": grid,
    })
    shaped = shaped.withColumns({
        "codes": F.transform("rows", lambda r: r["code"]),
        "grid_codes": seq.grid_codes(F.col("rows"), F.col("grid"), SMALLEST_WINS)})
    nc, cr = F.col("first_term_noncredit"), F.col("first_credit")
    out = shaped.select(
        "student_uuid", "first_esl_term",
        F.when(has_history, F.size("college_counts") > 1).alias("multiple_colleges"),
        "first_academic_year", "cohort", "first_term_noncredit",
        (~nc).alias("first_term_credit_only"), (nc & cr).alias("first_term_credit_and_noncredit"),
        "ever_credit_esl", "always_noncredit_esl", "always_credit_esl",
        F.when(F.col("ever_credit_esl"), F.col("took_noncredit"))
        .alias("both_credit_noncredit_esl"),
        "terms_to_full_completion_adj", "full_completion_levels_adj",
        F.array_min("college_counts")["name"].alias("first_college_name"),
        "first_term_integrated_esl_course", "first_level", "first_level_adj", "credit_level",
        "latest_6_term", "latest_12_term", "term_in_6", "term_in_12",
        ((F.col("sequence_rows") > 0) & F.col("latest_6_term").isNotNull())
        .alias("has_term_window"),
        *[seq.relative_sequence(F.col("codes"), i).alias(relative_name(m))
          for i, m in enumerate(RELATIVE_SEQUENCES)],
        *[seq.absolute_sequence(F.col("grid_codes"), i).alias(absolute_name(m))
          for i, m in enumerate(ABSOLUTE_SEQUENCES)])
    # The level table has one row per letter. A map of it refuses doubled levels, and
    # leaves no join behind in queries that do not read a letter.
    pairs = F.collect_list(F.struct(F.col("levels_below_transfer").cast("int"), "cb21"))
    inverse = levels.where("levels_below_transfer IS NOT NULL").agg(
        F.map_from_entries(pairs).alias("inverse")).scalar()
    return out.withColumns({
        letter: F.try_element_at(inverse, F.col(level).cast("int"))
        for level, letter in (("first_level", "first_cb21_level"),
                              ("first_level_adj", "first_cb21_level_adj"),
                              ("credit_level", "first_cb21_level_credit_only"))})
