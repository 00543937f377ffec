"""Per-term sequences and what is read off them, as native array expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from termtrail import fixed_values as fv


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


# A term code packs one row's measures into a string, one character per measure. A measure
# without a value is a blank, or a tilde where the smallest value wins, so that it loses
# every comparison.
BLANK, TILDE, ABSENT = " ", "~", "-"


def term_code(values: Sequence[Column], smallest_wins: Sequence[bool]) -> Column:
    return F.concat(*[F.coalesce(v, F.lit(TILDE if low else BLANK))
                      for v, low in zip(values, smallest_wins)])


def _at(code: Column, position: int) -> Column:
    return F.substring(code, position + 1, 1)


def merge_codes(a: Column, b: Column, smallest_wins: Sequence[bool]) -> Column:
    """Character-wise best of two codes."""
    return F.concat(*[(F.least if low else F.greatest)(_at(a, i), _at(b, i))
                      for i, low in enumerate(smallest_wins)])


def relative_sequence(codes: Column, position: int) -> Column:
    """One character per ordered code; measures without a value are skipped."""
    text = F.array_join(F.transform(codes, lambda c: _at(c, position)), "")
    return blank_to_null(F.translate(text, BLANK + TILDE, ""))


def grid_codes(rows: Column, grid: Column, smallest_wins: Sequence[bool]) -> Column:
    """One code per grid key, merging the rows that share it; blank where there is none.

    ``rows`` are structs of (grid_key, code). The merge runs only for shared keys.
    """
    blank = F.lit(BLANK * len(smallest_wins))
    add = lambda acc, r: F.when(acc == blank, r["code"]).otherwise(
        merge_codes(acc, r["code"], smallest_wins))
    return F.transform(grid, lambda g: F.aggregate(
        F.filter(rows, lambda r: r["grid_key"] == g), blank, add))


def absolute_sequence(codes: Column, position: int) -> Column:
    """One character per grid key, ``-`` where there is no value."""
    text = F.array_join(F.transform(codes, lambda c: _at(c, position)), "")
    return blank_to_null(F.translate(text, BLANK + TILDE, ABSENT * 2))


def contains_term(sequence: Column) -> Column:
    return F.coalesce(sequence.contains("1"), F.lit(False))


def credit_group(noncredit: Column, credit: Column) -> Column:
    n, c = contains_term(noncredit), contains_term(credit)
    return (F.when(n & c, fv.GROUP_MIXED).when(n, fv.GROUP_NONCREDIT).when(c, fv.GROUP_CREDIT)
            .otherwise(fv.GROUP_NONE))


def level_number(letter: Column) -> Column:
    """A..H -> 1..8, anything else null."""
    return F.when(letter.rlike("^[A-H]$"), F.ascii(letter) - 64)


def characters(text: Column) -> Column:
    """Array of single characters; empty for null or blank."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: c != "")


def level_numbers(text: Column) -> Column:
    """Level numbers of a sequence in order, ungraded characters left out."""
    return F.filter(F.transform(characters(text), level_number), lambda x: x.isNotNull())


def esl_levels(esl: Column, levels: Column) -> Column:
    """Level number (or null) at each ESL term, in order."""
    letters = F.transform(
        characters(esl),
        lambda c, i: F.struct((c == "1").alias("on"),
                              level_number(F.substr(levels, i + 1, F.lit(1))).alias("level")))
    return F.transform(F.filter(letters, lambda s: s["on"]), lambda s: s["level"])


def slipped_back(graded: Column) -> Column:
    """True if a later level is further from the top than the best one seen before it."""
    start = F.struct(F.lit(99).alias("best"), F.lit(False).alias("slipped"))
    step = lambda acc, x: F.struct(
        F.least(acc["best"], x).alias("best"),
        (acc["slipped"] | ((acc["best"] < 99) & (x > acc["best"]))).alias("slipped"))
    return F.aggregate(graded, start, step, lambda acc: acc["slipped"])


def gap_runs(esl: Column) -> Column:
    """Runs of 0 strictly between two 1s."""
    return F.size(F.regexp_extract_all(esl, F.lit("10+(?=1)"), F.lit(0)))


FEATURES = ("esl_terms", "enrolled_terms", "graded_terms", "entry_level", "exit_level",
            "best_level", "net_levels_gained", "ever_slipped_back", "gap_terms",
            "esl_first_term", "nothing_after_last_esl")


def with_sequence_features(df, esl: str, levels: str):
    """Add FEATURES to ``df`` from an ESL sequence and a level sequence."""
    e = F.coalesce(F.col(esl), F.lit(""))
    lv = F.coalesce(F.col(levels), F.lit(""))
    staged = df.withColumn("_levels", esl_levels(e, lv))
    staged = staged.withColumn("_graded", F.filter("_levels", lambda x: x.isNotNull()))
    at = lambda arr, i: F.try_element_at(F.col(arr), F.lit(i))
    return staged.withColumns({
        "esl_terms": F.size("_levels"),
        "enrolled_terms": F.length(e),
        "graded_terms": F.size("_graded"),
        "entry_level": at("_levels", 1),
        "exit_level": at("_graded", -1),
        "best_level": F.array_min("_graded"),
        "net_levels_gained": F.coalesce(at("_graded", 1) - at("_graded", -1), F.lit(0)),
        "ever_slipped_back": slipped_back(F.col("_graded")),
        "gap_terms": gap_runs(e),
        "esl_first_term": F.left(e, F.lit(1)) == "1",
        "nothing_after_last_esl": F.right(e, F.lit(1)) == "1",
    }).drop("_levels", "_graded")


def pathway(esl_terms: str = "esl_terms") -> Column:
    """Pathway type. The first rule that holds decides."""
    gained = F.col("net_levels_gained")
    return (F.when(F.col(esl_terms) == 1, fv.PATHWAY_ONE_TERM)
            .when(F.col("graded_terms") == 0, fv.PATHWAY_UNCLASSIFIED)
            .when(F.col("best_level") == 1, fv.PATHWAY_TOP)
            .when(F.col("gap_terms") > 0, fv.PATHWAY_UP_AND_DOWN)
            .when((gained > 0) & ~F.col("ever_slipped_back"), fv.PATHWAY_STEADY)
            .when(gained == 0, fv.PATHWAY_SAME_LEVEL)
            .otherwise(fv.PATHWAY_UP_AND_DOWN))
