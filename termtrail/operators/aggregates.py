"""Aggregate builders shared by the layers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def earliest(value: Column, key: Column, where: Column | None = None) -> Column:
    """Value at the smallest key; ties go to the smallest value. A null value is kept.

    The value is part of what is compared, so a group holds and sends it once.
    """
    order = F.struct(key.isNull().alias("no_key"), key.alias("key"), value.isNull().alias("no_value"), value.alias("value"))
    return F.min(order if where is None else F.when(where, order))["value"]


def latest(value: Column, key: Column, where: Column | None = None) -> Column:
    """Value at the largest numeric key; ties go to the smallest value."""
    return earliest(value, -key, where)


def any_of(flag: Column, where: Column) -> Column:
    return F.bool_or(F.when(where, flag))


def all_of(flag: Column, where: Column) -> Column:
    return F.bool_and(F.when(where, flag))


class FlagBits:
    """``bool_or`` and ``bool_and`` of many flags as one ``bit_or`` of a number.

    Each flag has two bits, for a true and a false value seen; a null sets neither, so a flag that
    was null in all rows comes out null. At most 31 flags fit.
    """

    def __init__(self, any_: dict[str, Column] | None = None, all_: dict[str, Column] | None = None):
        self._flags = [(n, c, True) for n, c in (any_ or {}).items()] + [(n, c, False) for n, c in (all_ or {}).items()]
        if len(self._flags) > 31:
            raise ValueError("more than 31 flags do not fit in one number")

    def packed(self) -> Column:
        bits = F.lit(0).cast("bigint")
        for i, (_, flag, _) in enumerate(self._flags):
            bits = bits + F.when(flag, F.lit(1 << 2 * i).cast("bigint")).when(
                ~flag, F.lit(2 << 2 * i).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
        return F.bit_or(bits)

    def unpacked(self, bits: Column) -> dict[str, Column]:
        seen = lambda mask: bits.bitwiseAND(F.lit(mask).cast("bigint")) != 0
        return {n: F.when(seen((1 if wins else 2) << 2 * i), F.lit(wins)).when(
            seen((2 if wins else 1) << 2 * i), F.lit(not wins)) for i, (n, _, wins) in enumerate(self._flags)}


def max_letter(letter: Column, where: Column) -> Column:
    """Largest single-character code as its character number.

    Numbers keep the aggregation hash-based; a string buffer would force a sort
    of every input row. ``letter_of`` turns the result back into text. A longer
    code raises: sequences hold one character per row, so it would be cut.
    """
    return F.max(F.when(where, _character_number(letter)))


def min_letter(letter: Column, where: Column) -> Column:
    return F.min(F.when(where, _character_number(letter)))


def _character_number(letter: Column) -> Column:
    longer = F.raise_error(F.concat(F.lit("a code must be one character: "), letter)).cast("int")
    return F.when(F.length(letter) > 1, longer).otherwise(F.ascii(letter))


def letter_of(code: Column) -> Column:
    return F.char(code)
