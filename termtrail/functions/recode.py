"""Recodes of raw values into labels, flags and bands."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from termtrail import fixed_values as fv


def label_map(code: Column, labels: Mapping, default: str | None = None) -> Column:
    """code -> label; ``default`` (null if none) for null and unlisted codes."""
    out = None
    for value, label in labels.items():
        hit = code == F.lit(value)
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out.otherwise(F.lit(default)) if default is not None else out


def cleaned(value: Column) -> Column:
    """Upper-case trimmed text, blank for null."""
    return F.upper(F.trim(F.coalesce(value.cast("string"), F.lit(""))))


def truthy(value: Column) -> Column:
    return cleaned(value).isin(*fv.YES_VALUES)


def yes_no_unknown(value: Column) -> Column:
    text = cleaned(value)
    return (F.when(text.isin(*fv.YES_VALUES), "Yes").when(text.isin(*fv.NO_VALUES), "No")
            .otherwise(fv.UNKNOWN))


def text_or(value: Column, label: str) -> Column:
    """Trimmed text, ``label`` where null or blank."""
    return F.coalesce(F.nullif(F.trim(value.cast("string")), F.lit("")), F.lit(label))


def false_if_null(flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False))


def safe_number(value: Column) -> Column:
    return value.cast("string").try_cast("double")


def safe_integer(value: Column) -> Column:
    return value.cast("string").try_cast("bigint")


def age_bucket(value: Column) -> Column:
    """Coarse dashboard buckets, upper bound inclusive; null where not a number."""
    age = safe_number(value)
    out = None
    for label, low, high in fv.DASHBOARD_AGES:
        hit = F.lit(True)
        if low is not None:
            hit = hit & (age > low)
        if high is not None:
            hit = hit & (age <= high)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return F.when(~F.isnan(age), out)


def age_band(value: Column) -> Column:
    """Bands over cleaned age; ages outside the outermost bounds are null.

    Bands are half-open at the bottom, (previous upper bound, upper bound].
    """
    age = safe_number(value)
    clean = F.when(age.between(fv.AGE_BANDS[0][1], fv.AGE_BANDS[-1][2]), age)
    return reduce(lambda acc, band: acc.when(clean <= band[2], band[0]), fv.AGE_BANDS[1:],
                  F.when(clean <= fv.AGE_BANDS[0][2], fv.AGE_BANDS[0][0]))


def award_family(topcode: Column) -> Column:
    out = F.when(topcode.isNull(), F.lit(None).cast("string"))
    for family, codes in fv.AWARD_FAMILY_CODES.items():
        out = out.when(topcode.isin(*codes), family)
    return out.otherwise(fv.AWARD_FAMILY_DEFAULT)


def race_flags(bits: Column) -> dict[str, Column]:
    """Flags from the 21-character multi-race string; null bits give false."""

    def any_yes(*spans: tuple[int, int]) -> Column:
        parts = [F.substring(bits, start, length).contains("Y") for start, length in spans]
        return false_if_null(reduce(lambda a, b: a | b, parts))

    return {
        "hispanic_non_hispanic": any_yes((1, 1)),
        "latin_american": any_yes((2, 4)),
        "aapi": any_yes((6, 9), (17, 4)),
        "black": any_yes((15, 1)),
        "indigenous_american": any_yes((16, 1)),
        "white": any_yes((21, 1)),
        "no_data": false_if_null((F.length(bits) < 21) | ~bits.contains("Y")),
    }


def count_true(flags: Iterable[Column]) -> Column:
    """Number of true flags; null if any flag is null."""
    return reduce(lambda a, b: a + b, [f.cast("int") for f in flags])


def as_number_text(value: Column) -> Column:
    """Whole numbers lose their decimals ("3.0" -> "3"); other text is unchanged."""
    number = safe_number(value)
    whole = (number == F.floor(number)) & (F.abs(number) < 1e15)
    return F.when(whole, number.cast("bigint").cast("string")).otherwise(value)


def value_order(value: Column) -> list[Column]:
    """Sort key: numbers by size, then text, then unknown/missing."""
    lower = F.lower(value)
    number = safe_number(value)
    last = lower.isin(fv.UNKNOWN.lower(), fv.MISSING.lower())
    rank = F.when(last, 2).when(number.isNotNull(), 0).otherwise(1)
    return [rank, F.when(rank == 0, number).otherwise(0.0), F.when(rank == 0, "").otherwise(lower)]
