"""Layers of the student table."""

from __future__ import annotations

from oracles.text import cases, quoted, rows
from oracles.raw import td
from termtrail import fixed_values as fv

ESL = quoted(fv.ESL_PROGRAMS)
GONE = quoted(fv.WITHDRAWN_GRADES)
BAD = quoted(fv.NOT_PASSED_GRADES)
LETTERS = quoted(fv.LEVEL_LETTERS + ("Y",))
CONFIRMED = quoted(fv.CONFIRMED_GROUPS)

FLAGS = ("any_esl_enrollment", "any_noncredit_esl_enrollment", "any_credit_esl_enrollment",
         "any_both_esl_enrollment")
LOWEST = ("lowest_cb21_level_adjusted_rws", "lowest_cb21_level_adjusted_all",
          "lowest_cb21_level_adjusted_all_credit_types",
          "lowest_cb21_level_adjusted_a_f_only_collapsed",
          "lowest_cb21_level_adjusted_a_f_only_others_0")
HIGHEST = ("highest_cb21_level_adjusted_achieved_rws", "highest_cb21_level_adjusted_achieved_all")
PROGRAMS = tuple(f"any_{p}_course_enrollment" for p in fv.ESL_PROGRAMS)
ABS = FLAGS + LOWEST + HIGHEST + PROGRAMS

_groups = [(n, g) for g, names in ((fv.GROUP_AB, fv.COLLEGES_AB), (fv.GROUP_EF, fv.COLLEGES_EF),
                                   (fv.GROUP_SIX, fv.COLLEGES_SIX),
                                   (fv.GROUP_POSSIBLE, fv.COLLEGES_POSSIBLE)) for n in names]

# Level value of one joined row for each "lowest" measure: condition and letters for Y, G, H.
_LOW = {LOWEST[0]: ("nonc AND cb03 <> '493087' AND kept", "1GH"),
        LOWEST[1]: ("nonc AND kept", "1GH"),
        LOWEST[2]: ("esl AND kept", "1GH"),
        LOWEST[3]: ("nonc AND kept", "1FF"),
        LOWEST[4]: ("nonc AND kept", "100")}
_HIGH = {HIGHEST[0]: "nonc AND cb03 <> '493087' AND ok", HIGHEST[1]: "nonc AND ok",
         "highest_cb21_level_adjusted_achieved_crnc": "esl AND ok"}


def _low(cond: str, to: str) -> str:
    return f"max(CASE WHEN {cond} THEN translate(letter, 'YGH', '{to}') ELSE '0' END)"


def _first(value: str, key: str, where: str, desc: bool = False) -> str:
    order = f"{key} {'DESC' if desc else 'ASC'}, {value} NULLS LAST"
    return f"(array_agg({value} ORDER BY {order}) FILTER ({where}))[1]"


_RACE = {"hispanic_non_hispanic": [(1, 1)], "latin_american": [(2, 4)], "aapi": [(6, 9), (17, 4)],
         "black": [(15, 1)], "indigenous_american": [(16, 1)], "white": [(21, 1)]}


def _race(spans) -> str:
    tests = " OR ".join(f"strpos(substr(sb29, {a}, {n}), 'Y') > 0" for a, n in spans)
    return f"max(CASE WHEN {tests} THEN 1 ELSE 0 END) = 1"


BLOCKS = {
    "o_groups": f"SELECT * FROM ({rows(_groups)}) v(name, grp)",
    "o_terms": """SELECT gi03, year, term, ([1,1,2,2,3,3,4,4])[gi03 % 10]::INTEGER AS quarter
                  FROM t_terms WHERE gi03 % 10 > 0""",
    "o_courses": f"""
      SELECT t_crs.*, cb03 IN ({ESL}) AS esl, cb03 IN ({ESL}) AND cb04 = 'N' AS nonc,
             cb03 IN ({ESL}) AND cb04 IN ('C', 'D') AS cred,
             CASE WHEN NOT (cb03 IN ({ESL}) AND cb04 = 'N') THEN cb21
                  WHEN gi01 IN ({quoted(fv.COLLEGE_CODES_AB)}) AND cb21 IN ({LETTERS}) THEN replace(cb21, 'B', 'A')
                  WHEN gi01 IN ({quoted(fv.COLLEGE_CODES_EF)}) AND cb21 IN ({LETTERS}) THEN replace(cb21, 'E', 'F')
                  WHEN gi01 NOT IN ({quoted(fv.COLLEGE_CODES_AB + fv.COLLEGE_CODES_EF)}) THEN cb21 END AS letter,
             CASE (SELECT grp FROM o_groups WHERE name = course_college)
                  WHEN '{fv.GROUP_AB}' THEN replace(cb21, 'B', 'A')
                  WHEN '{fv.GROUP_EF}' THEN replace(cb21, 'E', 'F') ELSE cb21 END AS letter2
      FROM t_crs""",
    # kept enrollments with their course offerings (course id and term, any college)
    "o_rows": f"""
      SELECT e.c, e.gi03, e.gi01, e.college_name, k.gi01 = e.gi01 AS same, k.cb03, k.cb04, k.cb21,
             k.letter, k.letter2, k.esl, k.nonc, k.cred,
             e.sx04 NOT IN ({GONE}) AS kept, e.sx04 NOT IN ({BAD}) AS ok
      FROM t_enr e JOIN o_courses k ON k.cb00 = e.cb00 AND k.gi03 = e.gi03
      WHERE e.sx02 = '{fv.NOT_DROPPED}'""",
    "o_demographics": f"""
      WITH d AS (
        SELECT c, min(sb04) AS gender, {", ".join(f"{_race(s)} AS {n}" for n, s in _RACE.items())},
               min(CASE WHEN length(sb29) < 21 OR sb29 NOT LIKE '%Y%' THEN 1 ELSE 0 END) = 1 AS no_data,
               {_first("sb06", "gi03", "WHERE gi03 BETWEEN 175 AND 234")} AS citizenship_earliest,
               {_first("sb06", "gi03", "WHERE gi03 BETWEEN 175 AND 234", True)} AS citizenship_latest,
               min(left(sb11, 1)) FILTER (WHERE gi03 BETWEEN 175 AND 234) AS highest_ed,
               {_first("std1", "gi03", "WHERE true")} AS age_at_first_term,
               max((sb11 = '10000')::INT) = 1 AS special_admit_dual_enrollment,
               {_first("sb14", "gi03", "WHERE true")} AS sb14_student_ed_goal
        FROM t_details GROUP BY c),
      em AS (
        SELECT e.c, count(e.sx01) > 1 AS english_or_math_enrollment
        FROM t_enr e JOIN t_crs k ON k.cb00 = e.cb00
        WHERE k.cb05 IN ('A', 'B') AND k.cb03 IN ('150100', '170000') GROUP BY e.c)
      SELECT 'S' || c_custkey AS maskedsb00, 'U' || c_custkey AS uuid, c_custkey AS c,
             d.* EXCLUDE (c),
             CASE WHEN c_acctbal < 0 THEN (CASE c_custkey % 2 WHEN 0 THEN 'M' ELSE 'P' END) END AS primary_disability,
             em.english_or_math_enrollment, a.pell AS pell_grant_recipient, a.eops AS eops_recipient
      FROM customer LEFT JOIN d ON d.c = c_custkey LEFT JOIN em ON em.c = c_custkey
      LEFT JOIN t_aid a ON a.c = c_custkey""",
    "o_degrees": f"""
      WITH a AS (
        SELECT c, min(day) AS earliest_degree_date, {_first("code", "day", "WHERE true")} AS earliest_degree_type,
               {_first("top", "day", "WHERE true")} AS earliest_degree_topcode,
               count(*) AS number_degrees_17_23,
               min(strpos('{td.AWARD_CODES}', code)) FILTER (WHERE gi03 BETWEEN 175 AND 234) AS best
        FROM t_awards GROUP BY c)
      SELECT a.*, (SELECT max(gi03) FROM t_terms t WHERE t.quarter = quarter(a.earliest_degree_date)
                   AND t.gi03 // 10 = year(a.earliest_degree_date) % 100) AS earliest_degree_term,
             substr('{td.AWARD_CODES}', best::INT, 1) AS highest_degree_earned,
             'Award ' || substr('{td.AWARD_CODES}', best::INT, 1) AS highest_degree_earned_description
      FROM a""",
    "o_degree_info": """
      SELECT d.*, g.* EXCLUDE (c, best) FROM o_demographics d LEFT JOIN o_degrees g ON g.c = d.c""",
    "o_first_terms": f"""
      WITH seen AS (
        SELECT c, gi03, bool_or(sx02 = '{fv.NOT_DROPPED}' AND sx04 NOT IN ({GONE})) AS done
        FROM t_enr GROUP BY c, gi03),
      ends AS (
        SELECT c, CASE WHEN min(gi03) < 700 THEN min(gi03)
                       ELSE min(gi03) FILTER (WHERE gi03 BETWEEN 300 AND 999) END AS a,
               coalesce(min(gi03) FILTER (WHERE done AND gi03 < 700),
                        min(gi03) FILTER (WHERE done AND gi03 BETWEEN 300 AND 999)) AS f
        FROM seen GROUP BY c),
      recorded AS (SELECT c, min(gi03) AS m FROM t_orders GROUP BY c),
      three AS (
        SELECT ends.c, a, f, m - (CASE c % 13 WHEN 0 THEN 10 ELSE 0 END) AS hf,
               CASE WHEN c % 17 <> 0 THEN m END AS scd1 FROM ends JOIN recorded USING (c))
      SELECT 'U' || c AS uuid, 'S' || c AS maskedsb00, c, a AS first_term_enrollment_any,
             f AS first_term_enrollment_finished_term, hf::INTEGER AS hf, scd1::INTEGER AS scd1_val,
             (CASE WHEN f IS NOT NULL AND left(least(a, hf, scd1)::VARCHAR, 2) = left(a::VARCHAR, 2)
                   THEN f ELSE least(a, hf, scd1) END)::INTEGER AS first_term_enrollment
      FROM three""",
    # ESL history: rows that count as attended ESL
    "o_hist": "SELECT * FROM o_rows WHERE esl AND kept",
    "o_first_esl": """
      WITH names AS (SELECT c, college_name, count(*) AS n FROM o_hist GROUP BY ALL),
      top AS (SELECT c, college_name FROM names
              QUALIFY row_number() OVER (PARTITION BY c ORDER BY n DESC, college_name) = 1),
      agg AS (SELECT c, CASE WHEN max(gi03) < 270 THEN min(gi03)
                             ELSE min(gi03) FILTER (WHERE gi03 BETWEEN 270 AND 999) END AS first_esl_term,
                     count(DISTINCT college_name) > 1 AS multiple_colleges,
                     min(cb03) = '493087' AS first_term_integrated_esl_course
              FROM o_hist GROUP BY c)
      SELECT agg.*, top.college_name AS first_college_name,
             coalesce((SELECT grp FROM o_groups g WHERE g.name = top.college_name), 'Other CC') AS first_college_group
      FROM agg JOIN top USING (c)""",
    "o_cohort_terms": f"""
      SELECT f.c, t.year AS first_academic_year,
             CASE WHEN t.term IN ({quoted(fv.FALL_TERM_NAMES)}) THEN 'F'
                  WHEN t.term IN ({quoted(fv.SPRING_TERM_NAMES)}) THEN 'S' END AS cohort
      FROM o_first_esl f JOIN o_terms t ON t.gi03 = f.first_esl_term""",
    "o_profile": """
      SELECT c, count(*) FILTER (WHERE cb04 <> 'N') > 0 AS ever_credit_esl,
             count(*) FILTER (WHERE cb04 <> 'N') = 0 AS always_noncredit_esl,
             count(*) FILTER (WHERE cb04 = 'N') = 0 AS always_credit_esl
      FROM o_hist GROUP BY c""",
    "o_late": """SELECT c, count(*) FILTER (WHERE cb04 = 'N') > 0 AS late FROM o_rows
                 WHERE esl AND ok AND gi03 > 174 GROUP BY c""",
    "o_first_courses": """
      WITH h AS (SELECT h.c, sum((cb04 = 'N')::INT) AS n, sum((cb04 <> 'N')::INT) AS k
                 FROM o_hist h JOIN o_first_esl f ON f.c = h.c AND f.first_esl_term = h.gi03 GROUP BY h.c)
      SELECT c, n > 0 AS first_term_noncredit, n = 0 AS first_term_credit_only,
             n > 0 AND k > 0 AS first_term_credit_and_noncredit FROM h""",
    "o_pass_n": """SELECT r.*, a.lvl AS lvl, b.lvl AS lvl2 FROM o_rows r
                   LEFT JOIN t_levels a ON a.letter = r.cb21 LEFT JOIN t_levels b ON b.letter = r.letter2
                   WHERE esl AND ok AND same AND cb04 = 'N' AND gi03 IN (SELECT gi03 FROM o_terms)""",
    "o_first_level": """
      WITH r AS (SELECT p.c, p.lvl, dense_rank() OVER (PARTITION BY p.c ORDER BY p.gi03) AS k
                 FROM o_pass_n p JOIN o_first_esl f ON f.c = p.c AND p.gi03 >= f.first_esl_term
                 WHERE p.gi03 BETWEEN 175 AND 269 AND p.lvl IS NOT NULL),
      m AS (SELECT c, max(lvl) AS lvl FROM r WHERE k = 1 GROUP BY c)
      SELECT c, m.lvl AS lowest_starting_level, letter AS first_cb21_level FROM m JOIN t_levels USING (lvl)""",
    "o_ranked": """SELECT c, gi03, lvl2, letter2, dense_rank() OVER (PARTITION BY c ORDER BY gi03) AS k
                   FROM o_pass_n WHERE gi03 BETWEEN 175 AND 300""",
    "o_first_adj": """
      WITH m AS (SELECT c, coalesce(max(lvl2) FILTER (WHERE letter2 <> 'Y'), max(lvl2)) AS lvl
                 FROM o_ranked WHERE k = 1 AND lvl2 IS NOT NULL GROUP BY c)
      SELECT c, m.lvl AS lowest_starting_level, letter AS first_cb21_level_adj FROM m JOIN t_levels USING (lvl)""",
    "o_first_credit": """
      WITH r AS (SELECT r.c, r.gi03 = f.first_esl_term AS at_first, r.cb04, t.lvl FROM o_rows r
                 JOIN o_first_esl f ON f.c = r.c JOIN t_levels t ON t.letter = r.cb21
                 WHERE esl AND ok),
      m AS (SELECT c, max(CASE WHEN at_first THEN lvl END) AS lvl FROM r GROUP BY c
            HAVING count(*) FILTER (WHERE cb04 = 'N') = 0)
      SELECT c, m.lvl AS lowest_starting_level_credit_only, letter AS first_cb21_level_credit_only
      FROM m JOIN t_levels USING (lvl)""",
    "o_completion": """
      WITH t AS (SELECT c, k, max(lvl2) AS low, min(lvl2) AS high FROM o_ranked
                 WHERE lvl2 IS NOT NULL GROUP BY c, k)
      SELECT c, min(k)::INTEGER AS terms_to_full_completion_adj,
             (max(low) - 1)::INTEGER AS full_completion_levels_adj
      FROM t WHERE high = 1 GROUP BY c""",
    "o_cohort_info": """
      SELECT d.*, ft.first_term_enrollment AS first_term_enrolled, f.first_esl_term, f.multiple_colleges,
             ct.first_academic_year, ct.cohort, fc.* EXCLUDE (c), p.* EXCLUDE (c),
             CASE WHEN p.ever_credit_esl THEN l.late END AS both_credit_noncredit_esl,
             k.terms_to_full_completion_adj, k.full_completion_levels_adj, f.first_college_name,
             f.first_term_integrated_esl_course, fl.first_cb21_level, fa.first_cb21_level_adj,
             fx.first_cb21_level_credit_only, coalesce(f.first_college_group, 'Other CC') AS first_college_group
      FROM o_degree_info d
      LEFT JOIN o_first_terms ft ON ft.c = d.c LEFT JOIN o_first_esl f ON f.c = d.c
      LEFT JOIN o_cohort_terms ct ON ct.c = d.c LEFT JOIN o_first_courses fc ON fc.c = d.c
      LEFT JOIN o_profile p ON p.c = d.c LEFT JOIN o_late l ON l.c = d.c
      LEFT JOIN o_completion k ON k.c = d.c LEFT JOIN o_first_level fl ON fl.c = d.c
      LEFT JOIN o_first_adj fa ON fa.c = d.c LEFT JOIN o_first_credit fx ON fx.c = d.c""",
    "o_per_term": f"""
      SELECT c, gi03 AS term, college_name,
             (count(*) FILTER (WHERE esl) > 0)::INT AS any_esl_enrollment,
             bool_or(nonc AND kept)::INT AS any_noncredit_esl_enrollment,
             bool_or(cred AND kept)::INT AS any_credit_esl_enrollment,
             bool_or(nonc AND cred AND kept)::INT AS any_both_esl_enrollment,
             {", ".join(f"{_low(*v)} AS {n}" for n, v in _LOW.items())},
             {", ".join(f"min(CASE WHEN {v} THEN nullif(letter, 'Y') ELSE '0' END) AS {n}" for n, v in _HIGH.items())},
             {", ".join(f"coalesce(max((cb03 = '{p}' AND kept)::INT), 0) AS {n}" for n, p in zip(PROGRAMS, fv.ESL_PROGRAMS))},
             {cases("coalesce((SELECT grp FROM o_groups g WHERE g.name = college_name), '')", fv.GROUP_LETTERS, "O")}
               AS college_group_enrollment
      FROM o_rows WHERE gi03 BETWEEN 175 AND 299 AND cb21 IN (SELECT letter FROM t_levels)
      GROUP BY c, gi03, college_name""",
    "o_relative": f"""
      SELECT c, {", ".join(f"string_agg({m}::VARCHAR, '' ORDER BY term, college_name) AS {m}_by_terms"
                           for m in ABS + ("college_group_enrollment",))}
      FROM o_per_term GROUP BY c""",
    "o_absolute": f"""
      WITH grid AS (SELECT DISTINCT p.c, t.gi03, 20000 + (t.gi03 // 10) * 10 + t.quarter AS slot
                    FROM (SELECT DISTINCT c FROM o_per_term) p, o_terms t WHERE t.gi03 BETWEEN 175 AND 299),
      cells AS (
        SELECT g.c, g.slot, {", ".join(
            f"coalesce({'min' if m in HIGHEST else 'max'}(p.{m}::VARCHAR), '-') AS {m}" for m in ABS)}
        FROM grid g LEFT JOIN o_per_term p ON p.c = g.c AND p.term = g.gi03 GROUP BY g.c, g.slot)
      SELECT c, {", ".join(f"string_agg({m}, '' ORDER BY slot) AS {m}_abs_by_terms" for m in ABS)}
      FROM cells GROUP BY c""",
    "o_windows": """
      WITH b AS (SELECT f.c, f.first_esl_term AS t0,
                        (f.first_esl_term // 10) * 10 + CASE
                          WHEN starts_with(substr(t.year, 2), left(f.first_esl_term::VARCHAR, 2)) THEN 8 ELSE 4 END AS b0
                 FROM o_first_esl f JOIN o_terms t ON t.gi03 = f.first_esl_term)
      SELECT b.c, b.b0 + 30 AS latest_6_term, b.b0 + 60 AS latest_12_term,
             max(CASE WHEN p.term > t0 AND p.term <= b0 + 30 THEN p.term END) AS term_in_6,
             max(CASE WHEN p.term > b0 + 30 AND p.term <= b0 + 60 THEN p.term END) AS term_in_12
      FROM b JOIN o_per_term p ON p.c = b.c GROUP BY ALL""",
    "o_course_info": """
      SELECT i.*, r.* EXCLUDE (c), w.term_in_6, w.term_in_12, i.uuid AS sca_uuid, a.* EXCLUDE (c)
      FROM o_cohort_info i JOIN o_relative r ON r.c = i.c JOIN o_absolute a ON a.c = i.c
      JOIN o_windows w ON w.c = i.c
      WHERE i.first_term_enrolled BETWEEN 175 AND 234 AND i.first_esl_term BETWEEN 175 AND 264""",
    "o_flat": f"""
      SELECT *, multiple_colleges AND right(college_group_enrollment_by_terms, 1) IN ('O', 'P')
                AS non_64_college_enrollment,
             first_esl_term BETWEEN 175 AND 251 AS observation_6_sem,
             first_esl_term BETWEEN 175 AND 235 AS observation_12_sem
      FROM o_course_info WHERE first_college_group IN ({CONFIRMED})""",
    "o_awards_long": f"""
      SELECT s.*, sha256(concat_ws('|', s.uuid, a.day, a.top, a.code, a.gi03, 'Subject ' || a.top,
               row_number() OVER (PARTITION BY s.c, a.day, a.top, a.code, a.gi03))) AS award_uuid,
             a.top AS topcode, 'Subject ' || a.top AS award_subject_title, a.code AS award_code,
             {cases("a.code", fv.AWARD_DESCRIPTIONS, fv.UNKNOWN_AWARD)} AS award_description,
             a.gi03, a.day AS awarded_date,
             dense_rank() OVER (PARTITION BY s.c ORDER BY a.day)::INTEGER AS award_number
      FROM o_flat s JOIN t_awards a ON a.c = s.c WHERE a.top IS NOT NULL""",
    "o_base": f"""
      SELECT i.maskedsb00, i.uuid, i.c, age_at_first_term, gender, latin_american, black, aapi, white,
             indigenous_american, no_data AS unknown_race,
             latin_american::INT + black::INT + aapi::INT + indigenous_american::INT + white::INT >= 2
               AS two_or_more_races,
             hispanic_non_hispanic IS TRUE AS hispanic_non_hispanic, citizenship_earliest, highest_ed,
             special_admit_dual_enrollment, pell_grant_recipient IS TRUE AS pell_grant_recipient,
             english_or_math_enrollment IS TRUE AS english_or_math_enrollment,
             (earliest_degree_term <= w.term_in_6) IS TRUE AS earned_degree_3_year,
             (earliest_degree_term <= w.term_in_12) IS TRUE AS earned_degree_6_year,
             eops_recipient IS TRUE AS eops_recipient, primary_disability IS NOT NULL AS has_disability,
             sb14_student_ed_goal,
             {cases("sb14_student_ed_goal", fv.GOAL_AT_ENROLLMENT)} AS goal_at_enrollment,
             ever_credit_esl, always_noncredit_esl, always_credit_esl, both_credit_noncredit_esl,
             first_esl_term, first_term_integrated_esl_course, first_term_enrolled, cohort,
             first_academic_year, first_cb21_level, first_cb21_level_adj, first_cb21_level_credit_only,
             first_college_name, first_college_group
      FROM o_cohort_info i LEFT JOIN o_windows w ON w.c = i.c
      WHERE first_term_enrolled BETWEEN 175 AND 234 AND first_esl_term IS NOT NULL""",
}

_U = "'U' || c AS student_uuid"
QUERIES = {
    "terms_adjusted": "SELECT * FROM o_terms",
    "semesters_abs": """
      SELECT year, quarter, (20000 + (min(gi03) // 10) * 10 + quarter)::INTEGER AS term,
             string_agg(term, ', ' ORDER BY gi03) AS term_names,
             string_agg(gi03::VARCHAR, '-' ORDER BY gi03) AS term_codes
      FROM o_terms WHERE gi03 BETWEEN 175 AND 299 GROUP BY year, quarter""",
    "courses_level_adjusted": """
      SELECT gi03 AS term, cb00, cb01, gi01, cb04, cb21, cb03, esl AS is_esl_course,
             nonc AS is_noncredit_esl_course, cred AS is_credit_esl_course,
             letter AS esl_course_level_adjusted_for_college FROM o_courses""",
    "college_groups": """
      SELECT coalesce(g.grp, 'Other CC') AS college_group, count(DISTINCT b.idx) AS colleges,
             count(*) AS enrollments
      FROM t_base b LEFT JOIN o_groups g ON g.name = b.college_name GROUP BY 1""",
    "demographics": "SELECT * EXCLUDE (c) FROM o_demographics",
    "degree_info": "SELECT * EXCLUDE (c) FROM o_degree_info",
    "degree_expanded": "SELECT * EXCLUDE (c, non_64_college_enrollment, observation_6_sem, observation_12_sem) FROM o_awards_long",
    "first_terms": "SELECT * EXCLUDE (c) FROM o_first_terms",
    "cohort_assignment": f"""
      SELECT 'U' || f.c AS student_uuid, f.first_esl_term, f.first_college_name, f.multiple_colleges,
             f.first_term_integrated_esl_course, f.first_college_group, t.first_academic_year, t.cohort
      FROM o_first_esl f LEFT JOIN o_cohort_terms t ON t.c = f.c""",
    "esl_profile": f"""
      SELECT 'U' || p.c AS student_uuid, ever_credit_esl, always_noncredit_esl, always_credit_esl,
             CASE WHEN ever_credit_esl THEN late END AS both_credit_noncredit_esl
      FROM o_profile p LEFT JOIN o_late l ON l.c = p.c""",
    "first_term_courses": f"SELECT {_U}, * EXCLUDE (c) FROM o_first_courses",
    "first_level": f"SELECT {_U}, lowest_starting_level, first_cb21_level FROM o_first_level",
    "first_level_adjusted": f"SELECT {_U}, lowest_starting_level, first_cb21_level_adj FROM o_first_adj",
    "first_level_credit_only": f"""SELECT {_U}, lowest_starting_level_credit_only,
                                   first_cb21_level_credit_only FROM o_first_credit""",
    "level_completion": f"SELECT {_U}, * EXCLUDE (c) FROM o_completion",
    "term_windows": f"SELECT {_U}, * EXCLUDE (c) FROM o_windows",
    "cohort_info": "SELECT * EXCLUDE (c) FROM o_cohort_info",
    "per_term_info": f"""
      SELECT {_U}, * EXCLUDE (c) REPLACE ({", ".join(f"{n}::VARCHAR AS {n}" for n in FLAGS + PROGRAMS)})
      FROM o_per_term""",
    "sequences_relative": f"SELECT {_U}, * EXCLUDE (c) FROM o_relative",
    "sequences_absolute": f"SELECT {_U}, * EXCLUDE (c) FROM o_absolute",
    "flat_file": "SELECT * EXCLUDE (c) FROM o_flat",
    "demographic_base": "SELECT * EXCLUDE (c) FROM o_base",
}
