"""Small helpers that print SQL."""

from __future__ import annotations


def quoted(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def cases(expr: str, labels: dict, default: str | None = None) -> str:
    arms = " ".join(f"WHEN {quoted([k])} THEN {quoted([v])}" for k, v in labels.items())
    tail = f" ELSE {quoted([default])}" if default is not None else ""
    return f"(CASE {expr} {arms}{tail} END)"


def rows(values) -> str:
    out = []
    for row in values:
        out.append("(" + ", ".join(str(v) if isinstance(v, int) else quoted([v]) for v in row) + ")")
    return "VALUES " + ", ".join(out)


def pct2(n: str, d: str) -> str:
    return f"(CASE WHEN ({d}) > 0 THEN (((20000*({n})+({d}))::BIGINT) // ((2*({d}))::BIGINT)) / 100.0 END)::DOUBLE"


def half_even(n: str, d: str, factor: int, places: int) -> str:
    """factor*n/d rounded to ``places`` with ties to even, by exact remainders."""
    big = f"(({n})::BIGINT*{factor * 10**places})"
    den = f"(({d})::BIGINT)"
    q = f"({big} // {den})"
    r2 = f"(2*({big} % {den}))"
    return (f"(CASE WHEN {den} > 0 THEN ({q} + CASE WHEN {r2} > {den} OR ({r2} = {den} AND {q} % 2 = 1) "
            f"THEN 1 ELSE 0 END) / {10.0**places} END)::DOUBLE")


def pct1(n: str, d: str) -> str:
    return half_even(n, d, 100, 1)
