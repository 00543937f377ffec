"""College groups and the level letters that some groups combine."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from termtrail import fixed_values as fv


GROUP_MEMBERS = {fv.GROUP_AB: fv.COLLEGES_AB, fv.GROUP_EF: fv.COLLEGES_EF,
                 fv.GROUP_SIX: fv.COLLEGES_SIX, fv.GROUP_POSSIBLE: fv.COLLEGES_POSSIBLE}


def _by_group(name: Column, labels: Mapping[str, str], default: str) -> Column:
    arms = [F.when(name.isin(*members), labels[group]) for group, members in GROUP_MEMBERS.items()]
    return F.coalesce(*arms, F.lit(default))


def college_group(name: Column) -> Column:
    return _by_group(name, {g: g for g in GROUP_MEMBERS}, fv.GROUP_OTHER)


def group_letter(name: Column) -> Column:
    return _by_group(name, fv.GROUP_LETTERS, fv.OTHER_GROUP_LETTER)


def combined_level(letter: Column, merges_ab: Column, merges_ef: Column,
                   keep_unlisted: bool) -> Column:
    """Level letter after a college's combination rule.

    ``keep_unlisted=False`` turns letters outside the level alphabet into null
    at colleges that have a rule; other colleges always pass letters through.
    """
    known = letter.isin(*fv.LEVEL_LETTERS, fv.UNSPECIFIED_LEVEL)
    rest = letter if keep_unlisted else F.when(known, letter)
    merged = (F.when(merges_ab & (letter == "B"), F.lit("A"))
              .when(merges_ef & (letter == "E"), F.lit("F")))
    has_rule = F.coalesce(merges_ab | merges_ef, F.lit(False))
    return F.coalesce(merged, F.when(has_rule, rest).otherwise(letter))


def level_by_college_code(letter: Column, code: Column) -> Column:
    return combined_level(letter, code.isin(*fv.COLLEGE_CODES_AB),
                          code.isin(*fv.COLLEGE_CODES_EF), keep_unlisted=False)


def level_by_college_name(letter: Column, name: Column) -> Column:
    return combined_level(letter, name.isin(*fv.COLLEGES_AB), name.isin(*fv.COLLEGES_EF),
                          keep_unlisted=True)
