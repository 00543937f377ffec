"""The layered student table: each layer is the previous one plus columns."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termtrail import fixed_values as fv
from termtrail.functions.colleges import college_group
from termtrail.functions.recode import count_true, false_if_null, label_map
from termtrail.params import STUDY, StudyParams
from termtrail.plans import facts as facts_plan
from termtrail.plans import history as history_plan
from termtrail.plans import students as student_plan
from termtrail.sources.store import TableStore
from termtrail.sources.tables import RawTables

DEGREE_COLUMNS = student_plan.DEMOGRAPHICS + student_plan.AWARDS
COHORT_COLUMNS = (
    "first_term_enrolled", "first_esl_term", "multiple_colleges", "first_academic_year", "cohort",
    "first_term_noncredit", "first_term_credit_only", "first_term_credit_and_noncredit",
    "ever_credit_esl", "always_noncredit_esl", "always_credit_esl", "both_credit_noncredit_esl",
    "terms_to_full_completion_adj", "full_completion_levels_adj", "first_college_name",
    "first_term_integrated_esl_course", "first_cb21_level", "first_cb21_level_adj",
    "first_cb21_level_credit_only", "first_college_group")

AWARD_KEY = ("uuid", "awarded_date", "topcode", "award_code", "gi03", "award_subject_title")


class Journey:
    """Lazy layers over one set of raw tables. Every property is a DataFrame."""

    def __init__(self, raw: RawTables, params: StudyParams = STUDY,
                 store: TableStore | None = None):
        self.raw = raw
        self.params = params
        self.store = store

    @cached_property
    def stored(self) -> Journey:
        """The same layers read from the written student table."""
        if self.store is None:
            return self
        reader = Journey(self.raw, self.params)
        reader.wide = self.store.table("student_table", self.wide, repr(self.params))
        return reader

    @cached_property
    def terms_adjusted(self) -> DataFrame:
        return facts_plan.terms_adjusted(self.raw.terms)

    @cached_property
    def semesters(self) -> DataFrame:
        return facts_plan.semesters(self.raw.terms, self.params)

    @cached_property
    def courses_adjusted(self) -> DataFrame:
        return facts_plan.courses_adjusted(self.raw.courses, self.params)

    @cached_property
    def demographics(self) -> DataFrame:
        return student_plan.demographics(self.raw, self.params)

    @cached_property
    def degree_info(self) -> DataFrame:
        return student_plan.degree_info(self.raw, self.params)

    @cached_property
    def first_terms(self) -> DataFrame:
        return student_plan.first_terms(self.raw, self.params)

    @cached_property
    def term_facts(self) -> DataFrame:
        return facts_plan.term_facts(self.raw, self.params)

    @cached_property
    def per_term_info(self) -> DataFrame:
        return facts_plan.per_term_info(self.term_facts)

    @cached_property
    def history(self) -> DataFrame:
        return history_plan.student_history(self.term_facts, self.raw.terms, self.raw.levels,
                                            self.params)

    @cached_property
    def wide(self) -> DataFrame:
        """Person, award and history columns of every student, joined once.

        The cohort and course layers are projections of this one plan, so the
        enrollment facts are never computed twice.
        """
        people = student_plan.with_awards(student_plan.person(self.raw, self.params), self.raw,
                                          self.params)
        named = people.select(*student_plan.DEMOGRAPHICS, *student_plan.AWARDS,
                              F.col("first_term_enrollment").alias("first_term_enrolled"))
        joined = named.join(self.history.withColumnRenamed("student_uuid", "uuid"), "uuid", "left")
        return joined.withColumn("first_college_group", college_group(F.col("first_college_name")))

    @cached_property
    def cohort_info(self) -> DataFrame:
        return self.wide.select(*DEGREE_COLUMNS, *COHORT_COLUMNS)

    def _sample(self, first_esl_window: bool) -> DataFrame:
        kept = self.wide.where(F.col("first_term_enrolled").between(*self.params.entry_window)
                               & F.col("first_esl_term").isNotNull())
        if first_esl_window:
            kept = kept.where(F.col("first_esl_term").between(*self.params.first_esl_window))
        return kept

    @cached_property
    def course_info(self) -> DataFrame:
        """Study sample with at least one term in the sequence window."""
        relative = [history_plan.relative_name(m) for m in facts_plan.RELATIVE_SEQUENCES]
        absolute = [history_plan.absolute_name(m) for m in facts_plan.ABSOLUTE_SEQUENCES]
        return self._sample(True).where("has_term_window").select(
            *DEGREE_COLUMNS, *COHORT_COLUMNS, *relative, "term_in_6", "term_in_12",
            F.col("uuid").alias("sca_uuid"), *absolute)

    @cached_property
    def flat_file(self) -> DataFrame:
        return flat_file(self.course_info, self.params)

    @cached_property
    def degree_expanded(self) -> DataFrame:
        return degree_expanded(self.course_info, self.raw, self.params)

    @cached_property
    def demographic_base(self) -> DataFrame:
        return demographic_base(self._sample(False))


def flat_file(course_info: DataFrame, p: StudyParams = STUDY, ever: bool = False) -> DataFrame:
    """Students who started at a confirmed college, with observation flags.

    The other-college flag looks at the last term of the college sequence;
    ``ever=True`` looks at every term.
    """
    seq = F.col(history_plan.relative_name(facts_plan.COLLEGE_SEQUENCE))
    test = seq.contains if ever else seq.endswith
    first = F.col("first_esl_term")
    return course_info.where(F.col("first_college_group").isin(*fv.CONFIRMED_GROUPS)).withColumns({
        "non_64_college_enrollment": F.col("multiple_colleges") & (test("O") | test("P")),
        "observation_6_sem": first.between(*p.observe_six_window),
        "observation_12_sem": first.between(*p.observe_twelve_window)})


def degree_expanded(course_info: DataFrame, raw: RawTables, p: StudyParams = STUDY) -> DataFrame:
    """One row per award of a confirmed-college student, awards ranked by date.

    Ranks are taken over the distinct award dates of a student and joined back,
    so a student holding a large share of the awards is never one window group.
    The award id hashes the award and numbers equal awards of a student, so it
    does not depend on files or partitions.
    """
    students = course_info.where(F.col("first_college_group").isin(*fv.CONFIRMED_GROUPS))
    awards = student_plan.dated_awards(raw.awards, p).select(
        F.col("student_uuid").alias("uuid"), F.col("sp01").alias("topcode"),
        F.col("sp02").alias("award_code"), "gi03", F.col("degree_date").alias("awarded_date"))
    titles = raw.topcodes.select(F.col("top6").alias("topcode"),
                                 F.col("top6title").alias("award_subject_title"))
    # ranks need a student's own awards only, so the student plan is met once, at the end
    titled = awards.join(titles, "topcode").withColumn("copy", F.row_number().over(
        Window.partitionBy(*AWARD_KEY).orderBy(F.lit(1))))
    by_date = Window.partitionBy("uuid").orderBy("awarded_date")
    ranks = (titled.select("uuid", "awarded_date").distinct()
             .withColumn("award_number", F.row_number().over(by_date)))
    described = titled.join(ranks, ["uuid", "awarded_date"]).withColumns({
        "award_description": label_map(F.col("award_code"), fv.AWARD_DESCRIPTIONS,
                                       fv.UNKNOWN_AWARD),
        "award_uuid": F.sha2(F.concat_ws("|", *AWARD_KEY, "copy"), 256)})
    return students.join(described, "uuid").select(
        *course_info.columns, "award_uuid", "topcode", "award_subject_title", "award_code",
        "award_description", "gi03", "awarded_date", "award_number")


def demographic_base(sample: DataFrame) -> DataFrame:
    """Study sample with the recoded features the report tables count."""
    races = ("latin_american", "black", "aapi", "indigenous_american", "white")
    within = lambda limit: false_if_null(F.col("earliest_degree_term") <= F.col(limit))
    flag = lambda name: false_if_null(F.col(name)).alias(name)
    return sample.select(
        "maskedsb00", "uuid", "age_at_first_term", "gender", "latin_american", "black", "aapi",
        "white", "indigenous_american", F.col("no_data").alias("unknown_race"),
        (count_true(F.col(r) for r in races) >= 2).alias("two_or_more_races"),
        flag("hispanic_non_hispanic"), "citizenship_earliest", "highest_ed",
        "special_admit_dual_enrollment", flag("pell_grant_recipient"),
        flag("english_or_math_enrollment"), within("term_in_6").alias("earned_degree_3_year"),
        within("term_in_12").alias("earned_degree_6_year"), flag("eops_recipient"),
        F.col("primary_disability").isNotNull().alias("has_disability"), "sb14_student_ed_goal",
        label_map(F.col("sb14_student_ed_goal"), fv.GOAL_AT_ENROLLMENT).alias("goal_at_enrollment"),
        "ever_credit_esl", "always_noncredit_esl", "always_credit_esl",
        "both_credit_noncredit_esl", "first_esl_term", "first_term_integrated_esl_course",
        "first_term_enrolled", "cohort", "first_academic_year", "first_cb21_level",
        "first_cb21_level_adj", "first_cb21_level_credit_only", "first_college_name",
        "first_college_group")
