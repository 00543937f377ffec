"""Report tables and disclosure tables."""

from __future__ import annotations

from oracles.layers import CONFIRMED
from oracles.text import cases, half_even, pct1, pct2, quoted, rows
from termtrail import fixed_values as fv
from termtrail.sources import testdata as td

ENTRY = quoted(fv.ENTRY_COHORTS)
TWO = quoted((fv.GROUP_NONCREDIT, fv.GROUP_CREDIT))


def _ident(name: str) -> str:
    return '"' + name + '"'


_AGE = "TRY_CAST(age_at_first_term AS INT)"
TABLE1 = {
    "gender_m": "gender = 'M'", "gender_f": "gender = 'F'", "gender_u": "gender NOT IN ('M', 'F')",
    **{n: n for n in ("latin_american", "black", "aapi", "white", "indigenous_american",
                      "unknown_race", "two_or_more_races", "has_disability")},
    "not_has_disability": "NOT has_disability",
    "traditional_age_at_entry": f"{_AGE} < 25", "over_traditional_age_at_entry": f"{_AGE} > 24",
    "age_at_entry_below_18": f"{_AGE} < 18",
    **{n: f"{_AGE} >= {a} AND {_AGE} <= {b}" for n, (a, b) in fv.AGE_MEASURES.items()},
    **{n: f"citizenship_earliest = '{k}'" for k, n in fv.CITIZENSHIP_MEASURES.items()},
    "citizenship_earliest_unknown": "coalesce(citizenship_earliest, 'X') = 'X'",
}
TABLE2 = {
    **{n: f"highest_ed = '{k}'" for k, n in fv.HIGHEST_ED_MEASURES.items()},
    "highest_ed_unknown": "coalesce(highest_ed, 'X') = 'X'",
    **{n: f"sb14_student_ed_goal = '{k}'" for k, n in fv.GOAL_MEASURES.items()},
}
_FLAGS = ("pell_grant_recipient", "eops_recipient", "special_admit_dual_enrollment",
          "english_or_math_enrollment")
TABLE3 = {
    **{n: n for n in _FLAGS}, **{f"not_{n}": f"NOT {n}" for n in _FLAGS},
    **{f"starting_level_esl_{x.lower()}":
       f"list_contains([first_cb21_level_adj, first_cb21_level_credit_only], '{x}')"
       for x in fv.LEVEL_LETTERS},
    "starting_level_esl_y_noncredit": "first_cb21_level_adj = 'Y'",
    "starting_level_esl_y_credit": "first_cb21_level_credit_only = 'Y'",
    "starting_level_esl_unknown": "coalesce(first_cb21_level_adj, first_cb21_level_credit_only) IS NULL",
    "earned_degree_3_year": "earned_degree_3_year",
    "not_earned_degree_3_year": "NOT earned_degree_3_year",
}


def _table(measures: dict[str, str]) -> str:
    names = [_ident(n) for n in measures]
    sums = ", ".join(f"coalesce(sum(({p})::INT) FILTER (WHERE inside), 0) AS {_ident(n)}"
                     for n, p in measures.items())
    return f"""
      WITH m AS (
        SELECT u.cte_name, count(*) FILTER (WHERE inside) AS total, {sums}
        FROM (SELECT b.*, u.cte_name, (CASE u.cte_name
                WHEN 'total_uni' THEN true WHEN 'noncred_only_uni' THEN always_noncredit_esl
                WHEN 'credit_only_uni' THEN always_credit_esl ELSE both_credit_noncredit_esl END) IS TRUE AS inside
              FROM o_base b, ({rows([(u,) for u in fv.UNIVERSES])}) u(cte_name)
              WHERE first_college_group IN ({CONFIRMED})) u
        GROUP BY u.cte_name)
      SELECT cte_name, total::DOUBLE AS total, {", ".join(f"{n}::DOUBLE AS {n}" for n in names)} FROM m
      UNION ALL
      SELECT cte_name || '_pct', 100.0::DOUBLE, {", ".join(f"{pct2(n, 'total')}" for n in names)} FROM m"""


_KINDS = {"noncredit_only": "always_noncredit_esl", "credit_only": "always_credit_esl",
          "both_credit_noncredit": "both_credit_noncredit_esl",
          "confirmed_cc_6_levels": f"first_college_group = '{fv.GROUP_SIX}'",
          "confirmed_cc_a_b_levels": f"first_college_group = '{fv.GROUP_AB}'",
          "confirmed_cc_e_f_levels": f"first_college_group = '{fv.GROUP_EF}'",
          "possible_cc": f"first_college_group = '{fv.GROUP_POSSIBLE}'"}

_CHECKS = [("students", "maskedsb00"), ("students", "uuid"), ("cohort_info", "maskedsb00"),
           ("cohort_info", "uuid"), ("course_info", "uuid"), ("demographic_base", "uuid"),
           ("demographic_base", "maskedsb00"), ("terms", "gi03"), ("flat_file", "uuid"),
           ("colleges", "gi01_college"), ("levels", "cb21"), ("levels", "levels_below_transfer"),
           ("award_types", "award_code"), ("topcodes", "top6")]
_CHECK_TABLES = {"students": "o_demographics", "cohort_info": "o_cohort_info",
                 "course_info": "o_course_info", "demographic_base": "o_base", "terms": "t_terms",
                 "flat_file": "o_flat", "colleges": "(SELECT code AS gi01_college FROM t_colleges)",
                 "levels": "(SELECT letter AS cb21, lvl AS levels_below_transfer FROM t_levels)",
                 "award_types": f"(SELECT unnest(string_split('{td.AWARD_CODES}', '')) AS award_code)",
                 "topcodes": f"(SELECT unnest([{', '.join(map(str, td.TOPCODES))}]) AS top6)"}


def _check(layer: str, column: str) -> str:
    t = _CHECK_TABLES[layer]
    return f"""
      SELECT '{layer}' AS layer, '{column}' AS column_name, 'unique' AS rule,
             (SELECT count(*) FROM (SELECT {column} FROM {t} WHERE {column} IS NOT NULL
                                    GROUP BY 1 HAVING count(*) > 1)) AS violations
      UNION ALL
      SELECT '{layer}', '{column}', 'not_null', (SELECT count(*) FROM {t} WHERE {column} IS NULL)"""


def _hide(sql: str, numeric: list[str], text: list[str], counts=("students",)) -> str:
    small = " OR ".join(f"coalesce({c}, 0) BETWEEN 1 AND {fv.MIN_CELL - 1}" for c in counts)
    cells = ", ".join(f"CASE WHEN {small} THEN '{fv.SUPPRESSED}' ELSE {c}::VARCHAR END AS {c}"
                      for c in numeric)
    return f"SELECT {', '.join(text + [cells])} FROM ({sql})"


def _margin(margin: str, expr: str) -> str:
    return f"SELECT grp, pathway, '{margin}' AS margin, ({expr})::VARCHAR AS value FROM p_rep"


_AGE_CLEAN = "TRY_CAST(age_at_first_term AS DOUBLE)"
_MARGINS = {
    "entry_level": "entry_level || ' below transfer'", "cohort": "first_academic_year",
    "structure": cases("first_college_group", fv.STRUCTURE_LABELS, "other"),
    "age_band": f"CASE WHEN {_AGE_CLEAN} < 14 OR {_AGE_CLEAN} > 99 THEN NULL "
                f"WHEN {_AGE_CLEAN} > 54 THEN '55 and over' WHEN {_AGE_CLEAN} > 44 THEN '45 to 54' "
                f"WHEN {_AGE_CLEAN} > 24 THEN '25 to 44' WHEN {_AGE_CLEAN} > 13 THEN '18 to 24' END",
    "gender": cases("coalesce(gender, '')", fv.GENDER_LABELS, "Unreported"),
    "goal": cases("coalesce(sb14_student_ed_goal, '')", fv.GOAL_LABELS, "Not reported")}
_FAMILY = "CASE " + " ".join(
    f"WHEN earliest_degree_topcode IN ({', '.join(map(str, codes))}) THEN '{name}'"
    for name, codes in fv.AWARD_FAMILY_CODES.items()
) + f" WHEN earliest_degree_topcode IS NOT NULL THEN '{fv.AWARD_FAMILY_DEFAULT}' END"
_GOT = "count(*)"

BLOCKS = {
    # one row per student with the credit group and the level sequence that goes with it
    "p_seq": f"""
      SELECT f.*, any_esl_enrollment_by_terms AS e,
             CASE (strpos(coalesce(any_noncredit_esl_enrollment_by_terms, ''), '1') > 0)::INT
                  + 2 * (strpos(coalesce(any_credit_esl_enrollment_by_terms, ''), '1') > 0)::INT
                  WHEN 0 THEN '{fv.GROUP_NONE}' WHEN 1 THEN '{fv.GROUP_NONCREDIT}'
                  WHEN 2 THEN '{fv.GROUP_CREDIT}' ELSE '{fv.GROUP_MIXED}' END AS grp,
             CASE WHEN strpos(coalesce(any_noncredit_esl_enrollment_by_terms, ''), '1') = 0
                       AND strpos(coalesce(any_credit_esl_enrollment_by_terms, ''), '1') > 0
                  THEN lowest_cb21_level_adjusted_all_credit_types_by_terms
                  ELSE lowest_cb21_level_adjusted_all_by_terms END AS lv
      FROM o_flat f""",
    # one row per sequence position, one running scan for best level and gap islands
    "p_pos": """
      SELECT c, i, substr(e, i, 1) = '1' AS on_esl,
             CASE WHEN substr(lv, i, 1) BETWEEN 'A' AND 'H' THEN ascii(substr(lv, i, 1)) - 64 END AS lvl
      FROM (SELECT c, e, lv, unnest(generate_series(1, length(e))) AS i FROM p_seq)""",
    "p_esl": """
      SELECT *, row_number() OVER w AS k, lag(i) OVER w AS before,
             min(lvl) OVER (PARTITION BY c ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before
      FROM p_pos WHERE on_esl WINDOW w AS (PARTITION BY c ORDER BY i)""",
    "p_feat": """
      SELECT c, count(*) AS esl_terms, count(lvl) AS graded_terms,
             max(CASE WHEN k = 1 THEN lvl END) AS entry_level,
             arg_max(lvl, CASE WHEN lvl IS NOT NULL THEN k END) AS exit_level, min(lvl) AS best_level,
             coalesce(arg_min(lvl, CASE WHEN lvl IS NOT NULL THEN k END)
                      - arg_max(lvl, CASE WHEN lvl IS NOT NULL THEN k END), 0) AS net_levels_gained,
             coalesce(bool_or(lvl > best_before), false) AS ever_slipped_back,
             count(*) FILTER (WHERE i - before > 1) AS gap_terms, min(i) = 1 AS starts, max(i) AS last_on
      FROM p_esl GROUP BY c""",
    "p_all": f"""
      SELECT s.*, coalesce(f.esl_terms, 0)::INTEGER AS esl_terms, length(s.e)::INTEGER AS enrolled_terms,
             coalesce(f.graded_terms, 0)::INTEGER AS graded_terms, f.entry_level, f.exit_level, f.best_level,
             coalesce(f.net_levels_gained, 0)::INTEGER AS net_levels_gained,
             coalesce(f.ever_slipped_back, false) AS ever_slipped_back,
             coalesce(f.gap_terms, 0)::INTEGER AS gap_terms, coalesce(f.starts, false) AS esl_first_term,
             coalesce(f.last_on = length(s.e), false) AS nothing_after_last_esl,
             CASE WHEN f.esl_terms = 1 THEN '{fv.PATHWAY_ONE_TERM}'
                  WHEN coalesce(f.graded_terms, 0) = 0 THEN '{fv.PATHWAY_UNCLASSIFIED}'
                  WHEN f.best_level = 1 THEN '{fv.PATHWAY_TOP}'
                  WHEN f.gap_terms > 0 OR f.net_levels_gained < 0
                       OR (f.net_levels_gained > 0 AND f.ever_slipped_back) THEN '{fv.PATHWAY_UP_AND_DOWN}'
                  WHEN f.net_levels_gained > 0 THEN '{fv.PATHWAY_STEADY}'
                  ELSE '{fv.PATHWAY_SAME_LEVEL}' END AS pathway
      FROM p_seq s LEFT JOIN p_feat f ON f.c = s.c""",
    "p_elig": f"SELECT * FROM p_all WHERE first_academic_year IN ({ENTRY})",
    "p_rep": f"SELECT * FROM p_elig WHERE grp IN ({TWO})",
}

_SHARE = f"{_GOT} AS students, sum(count(*)) OVER (PARTITION BY {{by}})::BIGINT AS group_total"
_PCT = f"{pct1('students', 'group_total')} AS pct_of_group"

QUERIES = {
    "table1_demographics": _table(TABLE1),
    "table2_education": _table(TABLE2),
    "table3_program": _table(TABLE3),
    "rq2_first_level": f"""
      WITH d AS (
        SELECT CASE WHEN first_cb21_level_adj IS NOT NULL THEN first_cb21_level_adj
                    WHEN always_credit_esl THEN '{fv.ALWAYS_CREDIT_LABEL}'
                    WHEN first_term_integrated_esl_course THEN '{fv.INTEGRATED_LABEL}'
                    ELSE '{fv.OTHER_ISSUE_LABEL}' END AS k, * FROM o_base
        WHERE first_college_group <> '{fv.GROUP_OTHER}'),
      n AS (SELECT k, count(DISTINCT uuid) AS total, {", ".join(
          f"count(DISTINCT CASE WHEN {p} THEN uuid END) AS {n}" for n, p in _KINDS.items())} FROM d GROUP BY k)
      SELECT k AS first_cb21_level_desc, total, {", ".join(
          f"{n}, {pct2(n, 'total')} AS {n}_pct" for n in _KINDS)} FROM n
      UNION ALL
      SELECT 'Total', sum(total)::BIGINT, {", ".join(f"sum({n})::BIGINT, 100.0::DOUBLE" for n in _KINDS)} FROM n""",
    "sequences_csv": """
      SELECT uuid, first_esl_term, multiple_colleges, any_esl_enrollment_by_terms,
             any_noncredit_esl_enrollment_by_terms, any_credit_esl_enrollment_by_terms,
             any_both_esl_enrollment_by_terms FROM o_flat""",
    "dated_snapshot": "SELECT uuid, first_esl_term, cohort FROM o_flat",
    "crosstab_csv": "SELECT * FROM e_wide",
    "other_college_ever": f"""
      SELECT uuid, multiple_colleges AND regexp_matches(college_group_enrollment_by_terms, '[OP]')
               AS non_64_college_enrollment
      FROM o_course_info WHERE first_college_group IN ({CONFIRMED})""",
    "key_checks": " UNION ALL ".join(_check(*c) for c in _CHECKS),
    "sequence_features": """
      SELECT uuid, grp AS "group", lv AS level_seq, esl_terms, enrolled_terms, graded_terms, entry_level,
             exit_level, best_level, net_levels_gained, ever_slipped_back, gap_terms, esl_first_term,
             nothing_after_last_esl, pathway FROM p_all""",
    "provenance": f"""
      SELECT count(*) AS source_rows, count(*) FILTER (WHERE first_academic_year IN ({ENTRY}))
               AS students_in_eligible_cohorts, {quoted([', '.join(fv.ENTRY_COHORTS)])} AS eligible_cohorts,
             '{fv.CENSORED_COHORT}' AS censored_cohort_reported_separately,
             {fv.MIN_CELL}::INTEGER AS min_cell_suppression, '{fv.LEVEL_VARIANT_NOTE}' AS level_variant_used,
             '{fv.CREDIT_STATUS_NOTE}' AS credit_status_source FROM o_flat""",
    "composition": _hide("SELECT grp AS \"group\", first_academic_year AS cohort, count(*) AS students "
                         "FROM p_all WHERE first_academic_year IS NOT NULL GROUP BY 1, 2",
                         ["students"], ['"group"', "cohort"]),
    "pathway_totals": _hide(f"""
      SELECT *, {_PCT} FROM (SELECT grp AS "group", pathway, {_SHARE.format(by='grp')}
                             FROM p_rep GROUP BY grp, pathway)""",
                            ["students", "group_total", "pct_of_group"], ['"group"', "pathway"]),
    "pathway_by_margin": _hide(f"""
      SELECT *, {_PCT} FROM (
        SELECT grp AS "group", margin, value, pathway, {_SHARE.format(by='grp, margin, value')}
        FROM ({" UNION ALL ".join(_margin(m, x) for m, x in _MARGINS.items())})
        WHERE value IS NOT NULL GROUP BY grp, margin, value, pathway)""",
                               ["students", "group_total", "pct_of_group"],
                               ['"group"', "margin", "value", "pathway"]),
    "pathway_by_race": _hide(f"""
      SELECT *, {_PCT} FROM (
        SELECT grp AS "group", race_flag, pathway, {_SHARE.format(by='grp, race_flag')}
        FROM ({" UNION ALL ".join(f"SELECT grp, pathway, '{label}' AS race_flag FROM p_rep WHERE {c}"
                                  for c, label in fv.RACE_FLAG_LABELS.items())})
        GROUP BY grp, race_flag, pathway)""",
                             ["students", "group_total", "pct_of_group"],
                             ['"group"', "race_flag", "pathway"]),
    "terms_within_pathway": _hide(f"""
      WITH s AS (SELECT grp, pathway, count(*) AS pathway_total, quantile_cont(esl_terms, 0.5)::DOUBLE AS median_esl_terms,
                        {half_even('sum(esl_terms)', 'count(*)', 1, 2)} AS mean_esl_terms FROM p_rep GROUP BY 1, 2)
      SELECT grp AS "group", pathway, CASE WHEN esl_terms > 9 THEN '10+' ELSE esl_terms::VARCHAR END AS esl_terms,
             count(*) AS students, any_value(pathway_total) AS pathway_total,
             any_value(median_esl_terms) AS median_esl_terms, any_value(mean_esl_terms) AS mean_esl_terms
      FROM p_rep JOIN s USING (grp, pathway) GROUP BY 1, 2, 3""",
                                  ["students", "pathway_total", "median_esl_terms", "mean_esl_terms"],
                                  ['"group"', "pathway", "esl_terms"]),
    "entry_levels": _hide(f"""
      SELECT *, {_PCT} FROM (
        WITH g AS (SELECT x.grp, count(p_rep.c) AS group_total,
                          count(*) FILTER (WHERE starts_with(lv, '1')) AS top
                   FROM (VALUES ('{fv.GROUP_NONCREDIT}'), ('{fv.GROUP_CREDIT}')) x(grp)
                   LEFT JOIN p_rep ON p_rep.grp = x.grp GROUP BY 1)
        SELECT grp AS "group", entry_level::VARCHAR AS levels_below_transfer, count(*) AS students,
               any_value(group_total) AS group_total
        FROM p_rep JOIN g USING (grp) WHERE entry_level IS NOT NULL GROUP BY 1, 2
        UNION ALL SELECT grp, '{fv.AT_OR_ABOVE_TRANSFER}', top, group_total FROM g)""",
                          ["students", "group_total", "pct_of_group"],
                          ['"group"', "levels_below_transfer"]),
    "advancement_by_level": _hide(f"""
      WITH x AS (SELECT c, unnest(generate_series(1, length(lv))) AS i, lv FROM p_elig
                 WHERE grp = '{fv.GROUP_NONCREDIT}' AND first_college_group = '{fv.GROUP_SIX}'),
      l AS (SELECT c, i, ascii(substr(lv, i, 1)) - 64 AS lvl FROM x WHERE substr(lv, i, 1) BETWEEN 'A' AND 'H'),
      f AS (SELECT c, lvl, min(i) AS i FROM l GROUP BY c, lvl),
      r AS (SELECT f.c, f.lvl, count(l.i) AS later, coalesce(bool_or(l.lvl = f.lvl - 1), false) AS nxt,
                   coalesce(bool_or(l.lvl < f.lvl), false) AS higher
            FROM f LEFT JOIN l ON l.c = f.c AND l.i > f.i GROUP BY f.c, f.lvl),
      n AS (SELECT lvl AS levels_below_transfer, count(*) AS students_at_level,
                   count(*) FILTER (WHERE later > 0) AS returned_for_later_esl_term,
                   count(*) FILTER (WHERE nxt) AS reached_next_level,
                   count(*) FILTER (WHERE higher) AS reached_any_higher_level FROM r GROUP BY lvl)
      SELECT *, {pct1('returned_for_later_esl_term', 'students_at_level')} AS pct_returned,
             {pct1('reached_next_level', 'returned_for_later_esl_term')} AS pct_of_returners_next_level,
             {pct1('reached_any_higher_level', 'returned_for_later_esl_term')} AS pct_of_returners_any_higher FROM n""",
                                  ["levels_below_transfer", "students_at_level", "returned_for_later_esl_term",
                                   "reached_next_level", "reached_any_higher_level", "pct_returned",
                                   "pct_of_returners_next_level", "pct_of_returners_any_higher"], [],
                                  ("students_at_level", "returned_for_later_esl_term")),
    "arrival_after": _hide("""
      SELECT grp AS "group", pathway, count(*) AS students, sum(esl_first_term::INT)::BIGINT AS esl_was_first_enrollment,
             sum(nothing_after_last_esl::INT)::BIGINT AS nothing_after_last_esl_term,
             sum((enrolled_terms > esl_terms)::INT)::BIGINT AS any_non_esl_enrolled_term,
             sum(ever_slipped_back::INT)::BIGINT AS ever_slipped_back_a_level
      FROM p_rep GROUP BY 1, 2""",
                           ["students", "esl_was_first_enrollment", "nothing_after_last_esl_term",
                            "any_non_esl_enrolled_term", "ever_slipped_back_a_level"], ['"group"', "pathway"]),
    "awards_by_family": _hide(f"""
      SELECT grp AS "group", pathway, award_family, count(*) AS students, any_value(pathway_total) AS pathway_total
      FROM (SELECT grp, pathway, {_FAMILY} AS award_family,
                   count(*) OVER (PARTITION BY grp, pathway) AS pathway_total FROM p_rep)
      WHERE award_family IS NOT NULL GROUP BY 1, 2, 3""",
                              ["students", "pathway_total"], ['"group"', "pathway", "award_family"]),
}

# --- published files -------------------------------------------------------
_TAIL = "pathway,students,group_total,pct_of_group"
_STEMS = {"entry_level": "03_pathway_by_entry_level", "cohort": "04_pathway_by_cohort",
          "structure": "05_pathway_by_college_structure", "age_band": "06_pathway_by_age",
          "gender": "07_pathway_by_gender", "goal": "08_pathway_by_goal"}
_FILES = [("00_provenance", "provenance", "true",
           "source_rows,students_in_eligible_cohorts,eligible_cohorts,censored_cohort_reported_separately,"
           "min_cell_suppression,level_variant_used,credit_status_source,generated", "run parameters"),
          ("01_composition_by_group_and_cohort", "composition", "true", "group,cohort,students",
           "students by credit status and entry cohort"),
          ("09_pathway_by_race_flag", "pathway_by_race", "true", f"group,race_flag,{_TAIL}", "race flags are not mutually exclusive"),
          ("10_terms_within_pathway", "terms_within_pathway", "true",
           "group,pathway,esl_terms,students,pathway_total,median_esl_terms,mean_esl_terms", "ESL term counts, capped at 10 or more"),
          ("11_entry_level_distribution", "entry_levels", "true", "group,levels_below_transfer,students,group_total,pct_of_group",
           "level at first ESL term"),
          ("12_advancement_by_level_six_level_colleges", "advancement_by_level", "true",
           "levels_below_transfer,students_at_level,returned_for_later_esl_term,pct_returned,reached_next_level,"
           "pct_of_returners_next_level,reached_any_higher_level,pct_of_returners_any_higher",
           "a student is counted at every level they appear at; rows are not exclusive"),
          ("13_arrival_and_what_followed", "arrival_after", "true",
           "group,pathway,students,esl_was_first_enrollment,nothing_after_last_esl_term,any_non_esl_enrolled_term,"
           "ever_slipped_back_a_level", "counts within each pathway"),
          ("14_awards_by_top_code_family", "awards_by_family", "true", "group,pathway,award_family,students,pathway_total",
           "first award only")]
for _g in (fv.GROUP_NONCREDIT, fv.GROUP_CREDIT):
    _tag = _g.split()[0]
    _FILES.append((f"02_pathway_totals_{_tag}", "pathway_totals", f"\"group\" = '{_g}'", _TAIL, f"pathway totals, {_g}"))
    _FILES += [(f"{stem}_{_tag}", "pathway_by_margin", f"\"group\" = '{_g}' AND margin = '{m}'", f"{m},{_TAIL}", f"pathway by {m}")
               for m, stem in _STEMS.items()]
QUERIES["published_manifest"] = " UNION ALL ".join(
    f"SELECT '{stem}.csv' AS file, (SELECT count(*) FROM ({QUERIES[key]}) WHERE {where}) AS rows, '{columns}' AS columns, '{note}' AS note"
    for stem, key, where, columns, note in _FILES)

_FLAG_NAMES = ", ".join(fv.SEQUENCE_COLUMNS)
QUERIES |= {
    "sequences_csv_by_name": f"SELECT uuid, first_esl_term, {_FLAG_NAMES} FROM o_flat",
    "csv_bad_values": """
      SELECT 'first_esl_term' AS "column", first_esl_term::VARCHAR || 'F' AS value, count(*) AS rows
      FROM o_flat WHERE first_esl_term % 10 = 7 GROUP BY 2""",
    "csv_doubled_header": "SELECT count(*) AS students, first_esl_term FROM o_flat GROUP BY 2",
    "student_tables": """
      SELECT a.uuid, a.first_esl_term, a.cohort, b.any_esl_enrollment_by_terms
      FROM o_cohort_info a JOIN o_course_info b ON a.uuid = b.uuid""",
    "fingerprint_parts": """
      SELECT coalesce(first_academic_year, 'none') AS part, count(*) AS source_rows, true AS adds_up FROM o_flat GROUP BY 1""",
    "field_catalogue": """
      SELECT (ordinal_position - 1)::INTEGER AS position, column_name AS name,
             CASE data_type WHEN 'VARCHAR' THEN 'string' ELSE lower(data_type) END AS type,
             array_to_string(list_transform(string_split(column_name, '_'), lambda w: upper(w[1]) || w[2:]), ' ') AS label,
             CASE column_name WHEN 'doc_id' THEN n.a WHEN 'lang' THEN n.b WHEN 'source' THEN n.c WHEN 'n_chars' THEN n.d END AS filled
      FROM information_schema.columns,
           (SELECT count(doc_id) AS a, count(lang) AS b, count(source) AS c, count(n_chars) AS d FROM documents) n
      WHERE table_name = 'documents' AND column_name <> 'text'""",
    # one arm for each rule: partners of small totals, their shared values, rectangles, and what is left
    "pathway_protected": f"""
      WITH tot AS (SELECT grp AS g, pathway AS p, count(*) AS t FROM p_rep GROUP BY 1, 2),
      cel AS (SELECT grp AS g, margin AS m, value AS v, pathway AS p, count(*) AS n
              FROM ({" UNION ALL ".join(_margin(m, x) for m, x in _MARGINS.items())}
                    UNION ALL {" UNION ALL ".join(f"SELECT grp, pathway, 'race_flag', '{label}' FROM p_rep WHERE {c}"
                                                  for c, label in fv.RACE_FLAG_LABELS.items())})
              WHERE value IS NOT NULL GROUP BY ALL),
      cov AS (SELECT g, m FROM cel GROUP BY 1, 2 HAVING sum(n) = (SELECT sum(t) FROM tot WHERE tot.g = cel.g)),
      fits AS (SELECT a.g, a.p, b.p AS q, CASE WHEN b.t < {fv.MIN_CELL} THEN 0 ELSE b.t END AS price
               FROM tot a JOIN tot b ON a.g = b.g AND a.p <> b.p
               WHERE a.t < {fv.MIN_CELL} AND NOT EXISTS (
                 SELECT 1 FROM cov WHERE cov.g = a.g AND NOT EXISTS (
                   SELECT 1 FROM cel x JOIN cel y USING (g, m, v) WHERE x.g = a.g AND x.m = cov.m AND x.p = a.p AND y.p = b.p))),
      pal AS (SELECT g, p, q FROM fits QUALIFY row_number() OVER (PARTITION BY g, p ORDER BY price, q) = 1),
      alone AS (SELECT DISTINCT g FROM tot WHERE t < {fv.MIN_CELL} AND (g, p) NOT IN (SELECT (g, p) FROM pal)),
      anch AS (SELECT cov.g, cov.m, x.v, pal.p, pal.q FROM pal JOIN cov ON cov.g = pal.g
               JOIN cel x ON x.g = cov.g AND x.m = cov.m AND x.p = pal.p
               JOIN cel y ON y.g = x.g AND y.m = x.m AND y.v = x.v AND y.p = pal.q
               QUALIFY row_number() OVER (PARTITION BY cov.g, cov.m, pal.p, pal.q
                                          ORDER BY CASE WHEN y.n < {fv.MIN_CELL} THEN 0 ELSE y.n END, x.v) = 1),
      tie AS (SELECT g, m, v, p FROM anch UNION SELECT g, m, v, q FROM anch),
      pri AS (SELECT c.*, tie.g IS NOT NULL AS tied, CASE WHEN c.n < {fv.MIN_CELL} OR tie.g IS NOT NULL THEN 0 ELSE c.n END AS w
              FROM cel c LEFT JOIN tie ON tie.g = c.g AND tie.m = c.m AND tie.v = c.v AND tie.p = c.p),
      todo AS (SELECT * FROM pri WHERE w = 0 AND NOT tied),
      best AS (SELECT o.g, o.m, o.v, o.p, z.v AS v2, z.p AS p2 FROM todo o
               JOIN pri x ON x.g = o.g AND x.m = o.m AND x.v = o.v AND x.p <> o.p
               JOIN pri y ON y.g = o.g AND y.m = o.m AND y.p = o.p AND y.v <> o.v
               JOIN pri z ON z.g = o.g AND z.m = o.m AND z.v = y.v AND z.p = x.p
               QUALIFY row_number() OVER (PARTITION BY o.g, o.m, o.v, o.p ORDER BY x.w + y.w + z.w, z.v, z.p) = 1),
      rest AS (SELECT o.*, (o.g, o.m) IN (SELECT (g, m) FROM cov) AS full_margin FROM todo o
               WHERE (o.g, o.m, o.v, o.p) NOT IN (SELECT (g, m, v, p) FROM best)),
      side AS (SELECT r.g, r.m, r.v, x.p FROM rest r JOIN pri x ON x.g = r.g AND x.m = r.m AND x.v = r.v AND x.p <> r.p
               WHERE NOT r.full_margin
               QUALIFY row_number() OVER (PARTITION BY r.g, r.m, r.v, r.p ORDER BY x.w, x.p) = 1),
      byt AS (SELECT r.g, r.m, r.v, r.p, pal.q FROM rest r JOIN pal ON pal.g = r.g AND pal.p = r.p
              JOIN cel x ON x.g = r.g AND x.m = r.m AND x.v = r.v AND x.p = pal.q WHERE r.full_margin),
      dark AS (SELECT r.g, r.m, r.v, y.v AS v2 FROM rest r JOIN cel y ON y.g = r.g AND y.m = r.m AND y.p = r.p AND y.v <> r.v
               WHERE r.full_margin AND (r.g, r.m, r.v, r.p) NOT IN (SELECT (g, m, v, p) FROM byt)
               QUALIFY row_number() OVER (PARTITION BY r.g, r.m, r.v, r.p ORDER BY
                 (SELECT sum(n) FROM cel s WHERE s.g = y.g AND s.m = y.m AND s.v = y.v), y.v) = 1),
      more AS (SELECT g, m, v, p2 AS p FROM best UNION SELECT g, m, v2, p FROM best UNION SELECT g, m, v2, p2 FROM best
               UNION SELECT g, m, v, p FROM side UNION SELECT g, m, v, q FROM byt UNION SELECT g, m, v, p FROM tie),
      dim AS (SELECT g, m, v FROM dark UNION SELECT g, m, v2 FROM dark),
      fin AS (
        SELECT g, m, v, p, n, CASE WHEN n < {fv.MIN_CELL} THEN 'small'
                 WHEN (g, m, v, p) IN (SELECT (g, m, v, p) FROM more) OR (g, m, v) IN (SELECT (g, m, v) FROM dim)
                      OR g IN (SELECT g FROM alone) THEN 'complement' END AS hidden FROM cel
        UNION ALL
        SELECT g, NULL, NULL, p, t, CASE WHEN t < {fv.MIN_CELL} THEN 'small'
                 WHEN (g, p) IN (SELECT (g, q) FROM pal) OR g IN (SELECT g FROM alone) THEN 'complement' END FROM tot)
      SELECT g AS "group", m AS margin, v AS value, p AS pathway,
             CASE WHEN hidden IS NULL THEN n::VARCHAR ELSE '{fv.SUPPRESSED}' END AS students, hidden FROM fin""",
}
