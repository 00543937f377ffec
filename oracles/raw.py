"""The raw tables, derived from the driver's tables (the fixture rules)."""

from __future__ import annotations

from oracles.text import cases, quoted, rows
from termtrail import fixed_values as fv
from termtrail.sources import testdata as td

_BITS = {2: (), 3: (1, 2), 4: (5,), 5: (14,), 6: (17, 21), 7: (15,), 8: (15, 16), 9: (21,),
         10: (1, 3, 21)}


def _bits(spots) -> str:
    return "".join("Y" if i in spots else "N" for i in range(1, 22))


BLOCKS = {
    "t_orders": """
      SELECT o_orderkey, o_custkey AS c, year(o_orderdate)+22 AS y, o_orderdate, o_orderstatus,
             left(o_orderpriority, 1) AS pri,
             ((CASE WHEN o_custkey % 149 = 0 THEN year(o_orderdate)-1905
                    WHEN o_orderkey % 397 = 0 AND year(o_orderdate) < 2000 THEN year(o_orderdate) % 100
                    ELSE (year(o_orderdate)+22) % 100 END)*10 + 2*quarter(o_orderdate) - 1)::INTEGER AS gi03
      FROM orders""",
    "t_colleges": f"""SELECT * FROM ({rows(
        [(i, td.college_code(i), n) for i, n in enumerate(td.COLLEGE_NAMES)])}) v(idx, code, college_name)""",
    "t_levels": f"""SELECT * FROM ({rows(list(td.LEVEL_OF.items()))}) v(letter, lvl)""",
    "t_base": f"""
      SELECT o.c, o.y, o.gi03, o.pri, k.idx, k.code AS gi01, k.college_name, p_partkey AS pk,
             {cases("p_type", td.PROGRAM_BY_TYPE)} AS cb03,
             CASE WHEN c % 10 < 5 THEN 'N'
                  WHEN c % 10 < 8 THEN (CASE p_partkey % 2 WHEN 0 THEN 'C' ELSE 'D' END)
                  WHEN p_size <= 25 THEN 'N' ELSE 'C' END AS cb04,
             CASE WHEN p_brand = 'Brand#25' THEN 'Y'
                  ELSE substr('ABCDEFGH', 1 + greatest(0, least(7,
                       (c // 10) % 9 + substr(p_brand, 7)::INT % 3 - 1 - (o.y - 2017) // 2))::INT, 1) END AS cb21,
             CASE WHEN k.idx % 4 = 0 THEN 'Y'
                  ELSE (CASE p_partkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'Y' END) END AS cb05,
             CASE WHEN l_tax > 0 THEN l_linenumber::VARCHAR END AS sx01,
             CASE WHEN o_orderkey % 5 < 1 + c % 5 AND (o_orderkey + l_linenumber) % 3 <> 0
                       AND l_discount < 0.095 THEN '{fv.NOT_DROPPED}' ELSE '20190101' END AS sx02,
             CASE WHEN l_quantity = 50 AND l_linenumber = 3 THEN NULL
                  WHEN l_quantity < 3 THEN 'W' WHEN l_quantity < 5 THEN 'F'
                  WHEN l_quantity < 6 THEN 'NP' ELSE 'P' END AS sx04
      FROM lineitem JOIN t_orders o ON l_orderkey = o.o_orderkey
      JOIN part ON l_partkey = p_partkey
      JOIN t_colleges k ON k.idx = (CASE l_linenumber WHEN 7 THEN (c*7+3) % 92 ELSE (c*13) % 92 END)""",
    "t_enr": "SELECT *, pk || '-' || cb04 || '-' || cb21 AS cb00 FROM t_base",
    "t_crs": """SELECT DISTINCT gi01, college_name AS course_college, gi03, cb00, 'ESL ' || pk AS cb01,
                cb03, cb04, cb05, cb21 FROM t_enr""",
    "t_terms": f"""
      WITH codes AS (SELECT DISTINCT unnest([gi03, gi03 - gi03 % 10]) AS gi03 FROM t_orders)
      SELECT gi03::INTEGER AS gi03, yr || '-' || (yr + 1) AS year,
             {cases("gi03 % 10", td.TERM_NAMES)} AS term,
             (CASE WHEN gi03 % 10 > 0 THEN (gi03 % 10 + 1) // 2 END)::INTEGER AS quarter
      FROM (SELECT gi03, gi03 // 10 + (CASE WHEN gi03 < 270 THEN 2000 ELSE 1900 END)
                   - (CASE WHEN gi03 % 10 IN (1, 3) THEN 1 ELSE 0 END) AS yr FROM codes)""",
    "t_details": f"""
      SELECT c, gi01, gi03,
             CASE WHEN c % 7 < 3 THEN 'F' WHEN c % 7 < 5 THEN 'M' WHEN c % 7 = 5 THEN 'X' END AS sb04,
             replace(min(pri), '5', 'X') AS sb06,
             CASE c % 10 WHEN 9 THEN 'X0000' ELSE (c % 10) || '0000' END AS sb11,
             substr('{td.GOAL_CODES}', ((c + idx) % 14 + 1)::INT, 1) AS sb14,
             {"CASE c % 11 WHEN 1 THEN 'NNN' " + " ".join(f"WHEN {k} THEN '{_bits(v)}'" for k, v in _BITS.items())} END AS sb29,
             (16 + c % 60 + y - 2017)::VARCHAR AS std1
      FROM t_base GROUP BY c, idx, gi01, gi03, y""",
    "t_awards": f"""
      SELECT c, gi03, CASE WHEN o_orderkey % 23 <> 0 THEN
               ([{", ".join(map(str, td.TOPCODES))}])[(o_orderkey % {len(td.TOPCODES)} + 1)::INT] END::INTEGER AS top,
             substr('{td.AWARD_CODES}', (o_orderkey % {len(td.AWARD_CODES)} + 1)::INT, 1) AS code,
             make_date(y::INT, month(o_orderdate)::INT, least(day(o_orderdate), 28)::INT) AS day
      FROM t_orders WHERE pri = '1' AND o_orderstatus = 'F' AND gi03 >= 175 AND o_orderkey % 29 <> 0""",
    "t_aid": """
      SELECT user_id AS c, coalesce(bool_or(event_type = 'purchase' AND user_id % 2 = 0), false) AS pell,
             coalesce(bool_or(event_type = 'signup' AND user_id % 3 = 0), false) AS eops
      FROM events GROUP BY 1""",
}
