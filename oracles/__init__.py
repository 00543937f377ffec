"""DuckDB SQL that restates every registered query in set logic.

Each block is a named CTE. ``compose`` puts the blocks a query needs in front
of its final SELECT. The SQL is written from the semantics, with unnest and
window logic, and shares only fixed values with the Spark code.
"""

from __future__ import annotations

import re

from oracles import explore, layers, raw, reports

BLOCKS: dict[str, str] = {**raw.BLOCKS, **layers.BLOCKS, **reports.BLOCKS, **explore.BLOCKS}
QUERIES: dict[str, str] = {**layers.QUERIES, **reports.QUERIES, **explore.QUERIES}


def _needs(sql: str) -> list[str]:
    words = set(re.findall(r"\b[a-z_0-9]+\b", sql))
    return [n for n in BLOCKS if n in words]


def compose(sql: str) -> str:
    wanted: set[str] = set()
    frontier = _needs(sql)
    while frontier:
        name = frontier.pop()
        if name not in wanted:
            wanted.add(name)
            frontier += [n for n in _needs(BLOCKS[name]) if n != name]
    body = ",\n".join(f"{n} AS ({BLOCKS[n]})" for n in BLOCKS if n in wanted)
    return (f"WITH {body}\n" if body else "") + f"SELECT * FROM ({sql})"


def oracle_sql() -> dict[str, str]:
    return {name: compose(sql) for name, sql in QUERIES.items()}
