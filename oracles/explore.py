"""Dashboard fixtures and exploration queries."""

from __future__ import annotations

from oracles.text import cases, pct1, quoted, rows
from termtrail import fixed_values as fv

_RACES = ("latin_american", "aapi", "black", "indigenous_american", "white", "no_data")
YES, NO = quoted(fv.YES_VALUES), quoted(fv.NO_VALUES)


def _yn(col: str) -> str:
    return (f"CASE WHEN {col} AND c % 8 = 0 THEN 'y ' WHEN {col} THEN 'Y' "
            f"WHEN NOT {col} THEN 'N' END")


def _spell(flag: str) -> str:
    return f"CASE WHEN {flag} THEN (['Y', 'true', ' 1 '])[(c % 3 + 1)::INT] WHEN NOT ({flag}) THEN 'N' END"


def _domain(labels, expr: str, source: str = "e_people") -> str:
    return f"""
      SELECT d.value, count(p.v) AS students FROM ({rows([(x,) for x in labels])}) d(value)
      LEFT JOIN (SELECT {expr} AS v FROM {source}) p ON p.v = d.value GROUP BY d.value"""


def _flag(col: str) -> str:
    return f"coalesce(upper(trim({col})), '') IN ({YES})"


def _named(col: str, label: str) -> str:
    return f"CASE WHEN trim(coalesce({col}, '')) = '' THEN '{label}' ELSE trim({col}) END"


_AGE = "TRY_CAST(age_at_first_term AS DOUBLE)"
_EFL = [f"A{i}" for i in range(1, 7)]

BLOCKS = {
    "e_students": """
      SELECT i.*, r.any_esl_enrollment_by_terms, r.lowest_cb21_level_adjusted_all_credit_types_by_terms
      FROM o_cohort_info i LEFT JOIN o_relative r ON r.c = i.c""",
    "e_levels": """
      SELECT c, arg_min(lvl, i) AS first_level, max(lvl) AS lowest_level, min(lvl) AS highest_level
      FROM (SELECT c, i, ascii(ch) - 64 AS lvl FROM (
              SELECT c, i, substr(s, i, 1) AS ch FROM (
                SELECT c, lowest_cb21_level_adjusted_all_credit_types_by_terms AS s,
                       unnest(generate_series(1, length(lowest_cb21_level_adjusted_all_credit_types_by_terms))) AS i
                FROM e_students)) WHERE ch BETWEEN 'A' AND 'H') GROUP BY c""",
    "e_people": f"""
      SELECT f.c, first_term_enrolled::VARCHAR AS sample_first_term,
             CASE WHEN f.c % 13 = 0 THEN '' WHEN f.c % 11 = 0 THEN ' ' || lower(gender) ELSE gender END AS gender,
             CASE WHEN f.c % 9 = 0 THEN NULL WHEN f.c % 9 = 1 THEN 'X'
                  ELSE {_yn('hispanic_non_hispanic').replace('c %', 'f.c %')} END AS hispanic_non_hispanic,
             {", ".join(f"{_yn(r).replace('c %', 'f.c %')} AS {r}" for r in _RACES)},
             ([ 'YES', 'N', 'maybe', NULL ])[(f.c % 4 + 1)::INT] AS prior_non_success,
             CASE WHEN f.c % 31 = 0 THEN 'n/a' ELSE age_at_first_term END AS age_at_first_term,
             CASE WHEN f.c % 37 = 0 THEN ' ' WHEN f.c % 41 = 0 THEN NULL ELSE first_college_name END AS main_campus_name,
             CASE WHEN f.c % 19 = 0 THEN ' ' WHEN f.c % 5 = 0 THEN NULL ELSE 'A' || (f.c % 6 + 1) END AS earliest_efl_score,
             CASE WHEN f.c % 3 = 0 THEN NULL ELSE 'A' || ((f.c // 3) % 6 + 1) END AS latest_efl_score,
             l.first_level::VARCHAR AS first_level, l.lowest_level::VARCHAR AS lowest_level,
             CASE WHEN f.c % 43 = 0 THEN 'unknown' ELSE l.highest_level::VARCHAR END AS highest_level
      FROM e_students f LEFT JOIN e_levels l ON l.c = f.c""",
    "e_cohort": f"""
      SELECT {_spell('first_term_noncredit')} AS first_term_noncredit,
             {_spell('first_term_credit_only')} AS first_term_credit,
             {_spell('ever_credit_esl')} AS ever_credit_esl, {_spell('always_noncredit_esl')} AS always_noncredit_esl,
             {_spell('length(any_esl_enrollment_by_terms) >= 6')} AS six,
             {_spell('length(any_esl_enrollment_by_terms) >= 12')} AS twelve,
             CASE WHEN c % 53 <> 0 THEN first_academic_year END AS yr, cohort FROM e_students""",
    "e_pairs": f"SELECT {_named('earliest_efl_score', fv.MISSING)} AS x, {_named('latest_efl_score', fv.MISSING)} AS y FROM e_people",
    "e_wide": f"""
      WITH r AS (SELECT unnest([x, '{fv.TOTAL}']) AS x, y FROM e_pairs)
      SELECT x AS earliest_efl_score, {", ".join(
          f'count(*) FILTER (WHERE y = {quoted([v])}) AS "{v}"' for v in [*_EFL, fv.MISSING])},
             count(*) AS "{fv.TOTAL}" FROM r GROUP BY x""",
    "e_flags": f"""SELECT {_flag('first_term_noncredit')} AS n, {_flag('first_term_credit')} AS k,
                   {_flag('ever_credit_esl')} AS ever, {_flag('always_noncredit_esl')} AS always,
                   {_flag('six')} AS six, {_flag('twelve')} AS twelve, yr, cohort FROM e_cohort""",
}

_TOP = f"{_named('main_campus_name', fv.UNKNOWN)}"
QUERIES = {
    "field_counts_gender": _domain(
        [*fv.DASHBOARD_GENDER.values(), fv.UNKNOWN],
        cases("upper(trim(coalesce(gender, '')))", fv.DASHBOARD_GENDER, fv.UNKNOWN)),
    "field_counts_hispanic": _domain(
        [*fv.DASHBOARD_HISPANIC.values(), fv.UNKNOWN],
        cases("upper(trim(coalesce(hispanic_non_hispanic, '')))", fv.DASHBOARD_HISPANIC, fv.UNKNOWN)),
    "field_counts_binary": _domain(
        ["Yes", "No", fv.UNKNOWN],
        f"CASE WHEN upper(trim(prior_non_success)) IN ({YES}) THEN 'Yes' "
        f"WHEN upper(trim(prior_non_success)) IN ({NO}) THEN 'No' ELSE 'Unknown' END"),
    "field_counts_generic": f"""
      SELECT {_named('age_at_first_term', fv.UNKNOWN)} AS value, count(*) AS students FROM e_people
      GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15""",
    "field_values_sorted": f"""
      SELECT value, CASE WHEN n = trunc(n) THEN n::BIGINT::VARCHAR ELSE value END AS label, students,
             CASE WHEN lower(value) IN ('unknown', 'missing') THEN 2 WHEN n IS NULL THEN 1 ELSE 0 END::INTEGER AS sort_kind,
             CASE WHEN lower(value) IN ('unknown', 'missing') THEN 0 ELSE coalesce(n, 0) END::DOUBLE AS sort_number,
             CASE WHEN n IS NULL THEN lower(value) ELSE '' END AS sort_text
      FROM (SELECT *, TRY_CAST(value AS DOUBLE) AS n FROM (
              SELECT {_named('age_at_first_term', fv.UNKNOWN)} AS value, count(*) AS students FROM e_people GROUP BY 1))""",
    "race_flag_counts": " UNION ALL ".join(
        f"SELECT '{label}' AS race, count(*) FILTER (WHERE {_flag(c)}) AS students FROM e_people"
        for c, label in fv.DASHBOARD_RACES.items()),
    "age_buckets": _domain(["Under 24", "25 to 50", "Over 50"],
                           f"CASE WHEN {_AGE} > 50 THEN 'Over 50' WHEN {_AGE} > 24 THEN '25 to 50' "
                           f"WHEN {_AGE} <= 24 THEN 'Under 24' END"),
    "top_campuses": f"""SELECT {_TOP} AS value, count(*) AS students FROM e_people
                        GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
    "summary_card": f"""
      SELECT count(*) AS total_students,
             sum((earliest_efl_score IS NOT NULL AND latest_efl_score IS NOT NULL)::INT)::BIGINT AS with_efl,
             count(main_campus_name) AS with_campus, quantile_disc({_AGE}, 0.5) AS median_age,
             count(DISTINCT main_campus_name) AS unique_campuses
      FROM e_people WHERE sample_first_term[1:2] BETWEEN '17' AND '20'""",
    "summary_card_all_years": f"""
      SELECT count(*) AS total_students,
             sum((earliest_efl_score IS NOT NULL AND latest_efl_score IS NOT NULL)::INT)::BIGINT AS with_efl,
             count(main_campus_name) AS with_campus, quantile_disc({_AGE}, 0.5) AS median_age,
             count(DISTINCT main_campus_name) AS unique_campuses FROM e_people""",
    "starting_years": """SELECT DISTINCT '20' || sample_first_term[1:2] AS label, sample_first_term[1:2] AS value
                         FROM e_people WHERE sample_first_term IS NOT NULL""",
    "level_heatmap": """
      SELECT x.v AS x_val, y.v AS y_val, count(p.c) AS students
      FROM generate_series(1, 8) x(v) CROSS JOIN generate_series(1, 8) y(v)
      LEFT JOIN e_people p ON TRY_CAST(p.first_level AS BIGINT) = x.v AND TRY_CAST(p.highest_level AS BIGINT) = y.v
      GROUP BY 1, 2""",
    "crosstab_top12": f"""
      WITH v AS (SELECT {_TOP} AS x, {_named('age_at_first_term', fv.UNKNOWN)} AS y FROM e_people),
      tx AS (SELECT x FROM v GROUP BY x ORDER BY count(*) DESC, x LIMIT 12),
      ty AS (SELECT y FROM v GROUP BY y ORDER BY count(*) DESC, y LIMIT 12),
      m AS (SELECT CASE WHEN x IN (FROM tx) THEN x ELSE 'Other' END AS x,
                   CASE WHEN y IN (FROM ty) THEN y ELSE 'Other' END AS y FROM v)
      SELECT a.x AS x_val, b.y AS y_val, (SELECT count(*) FROM m WHERE m.x = a.x AND m.y = b.y) AS students
      FROM (SELECT DISTINCT x FROM m) a, (SELECT DISTINCT y FROM m) b""",
    "crosstab_margins": """
      UNPIVOT e_wide ON COLUMNS(* EXCLUDE (earliest_efl_score)) INTO NAME "column" VALUE students""",
    "cells_scaled": f"""
      WITH u AS (UNPIVOT e_wide ON COLUMNS(* EXCLUDE (earliest_efl_score)) INTO NAME "column" VALUE students)
      SELECT *, CASE WHEN max(students) OVER () = min(students) OVER () THEN 0.5
                     ELSE (students - min(students) OVER ())::DOUBLE
                          / (max(students) OVER () - min(students) OVER ()) END AS scaled FROM u""",
    "overlap_regions": f"""
      SELECT region, students, {pct1('students', 'total')} AS share_of_total FROM (
        SELECT d.region, count(f.r) AS students, (SELECT count(*) FROM e_flags) AS total
        FROM (VALUES ('A'), ('B'), ('AB')) d(region)
        LEFT JOIN (SELECT CASE WHEN n AND k THEN 'AB' WHEN n THEN 'A' WHEN k THEN 'B' END AS r FROM e_flags) f
        ON f.r = d.region GROUP BY d.region)""",
    "retention": """
      SELECT coalesce(yr, 'Unknown') AS first_academic_year, coalesce(cohort, 'Unknown') AS cohort,
             count(*) AS total, sum(six::INT)::BIGINT AS six_terms_attended,
             sum(twelve::INT)::BIGINT AS twelve_terms_attended
      FROM e_flags GROUP BY 1, 2""",
    "retention_of_cohort": """
      SELECT coalesce(yr, 'Unknown') AS first_academic_year, cohort, count(*) AS total,
             sum(six::INT)::BIGINT AS six_terms_attended, sum(twelve::INT)::BIGINT AS twelve_terms_attended
      FROM e_flags WHERE cohort = 'F' GROUP BY 1, 2""",
    "flow_counts": " UNION ALL ".join(
        f"SELECT * FROM (SELECT '{fv.FLOW_LEFT[a]}' AS source, '{fv.FLOW_RIGHT[b]}' AS target, "
        f"sum(({x} AND {y})::INT)::BIGINT AS students FROM e_flags) WHERE students > 0"
        for a, x in (("first_term_credit", "k"), ("first_term_noncredit", "n"))
        for b, y in (("ever_credit_esl", "ever"), ("always_noncredit_esl", "always"))),
    "cohort_summary": """
      SELECT count(*) AS total_students, sum(six::INT)::BIGINT AS six_terms, sum(twelve::INT)::BIGINT AS twelve_terms,
             sum(k::INT)::BIGINT AS started_credit, sum(n::INT)::BIGINT AS started_noncredit FROM e_flags""",
}

QUERIES["summary_card_pruned"] = QUERIES["summary_card"]
QUERIES["refresh"] = " UNION ALL ".join(
    f"SELECT '{measure}' AS measure, {value} AS value, students FROM ({QUERIES[key]})" for measure, value, key in (
        ("gender", "value", "field_counts_gender"), ("hispanic", "value", "field_counts_hispanic"), ("age", "value", "age_buckets"),
        ("race", "race", "race_flag_counts"), ("campus", "value", "top_campuses"), ("level", "x_val || '/' || y_val", "level_heatmap")))
