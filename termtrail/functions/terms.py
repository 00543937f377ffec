"""Term-code columns. A term code is an integer YYT; T 1-2/3-4/5-6/7-8 are quarters 1-4."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

from termtrail import fixed_values as fv


def is_quarter_term(gi03: Column) -> Column:
    """Codes ending in 0 stand for a whole year and have no quarter."""
    return gi03 % 10 != 0


def quarter(gi03: Column) -> Column:
    digit = gi03 % 10
    return F.when(digit.between(1, 8), F.floor((digit + 1) / 2).cast("int"))


def year_prefix(gi03: Column) -> Column:
    return F.left(gi03.cast("string"), F.lit(2))


def absolute_term(gi03: Column, quarter_col: Column) -> Column:
    """Calendar key 20YYQ; null where the quarter is unknown."""
    return F.concat(F.lit("20"), year_prefix(gi03), quarter_col.cast("string")).cast("int")


def half_year(term_name: Column) -> Column:
    name = F.trim(term_name)
    return F.when(name.isin(*fv.FALL_TERM_NAMES), "F").when(name.isin(*fv.SPRING_TERM_NAMES), "S")


def window_end(first_term: Column, year_label: Column, years: int) -> Column:
    """Last term code of an observation window of ``years`` after ``first_term``.

    A fall start is recognised by the year label carrying the term's two year
    digits from its second character on; every other label counts as spring.
    """
    decade = first_term - first_term % 10
    fall = year_prefix(first_term) == F.substring(year_label, 2, 2)
    return decade + 10 * years + F.when(fall, 8).otherwise(4)


def first_term_wrapped(term: Column, cut: int, low: int, high: int, by: str = "min",
                       over: WindowSpec | None = None) -> Column:
    """Aggregate (or window value): earliest term when codes wrap at the century.

    ``by="min"``: codes are taken as 2000s if the smallest is below ``cut``.
    ``by="max"``: codes are taken as 2000s if the largest is below ``cut``.
    Otherwise the earliest code inside ``low..high`` (the 1900s) is taken.
    """
    scoped = (lambda agg: agg.over(over)) if over is not None else (lambda agg: agg)
    probe = scoped(F.min(term) if by == "min" else F.max(term))
    wrapped = scoped(F.min(F.when(term.between(low, high), term)))
    return F.when(probe < cut, scoped(F.min(term))).otherwise(wrapped)
