"""Aggregate tables of pathway types from the flat file, before suppression.

Every table groups before it shuffles, so a category holding most students
costs one partial row per map task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termtrail import fixed_values as fv
from termtrail.functions import recode
from termtrail.functions import sequences as seq
from termtrail.functions.rates import percent_half_even, ratio_half_even
from termtrail.operators.disclosure import complementary
from termtrail.params import DISCLOSURE, DisclosureParams
from termtrail.sources.sinks import publish
from termtrail.sources.store import TableStore
from termtrail.sources.tables import require_columns

ESL = "any_esl_enrollment_by_terms"
NONCREDIT = "any_noncredit_esl_enrollment_by_terms"
CREDIT = "any_credit_esl_enrollment_by_terms"
LEVELS = "lowest_cb21_level_adjusted_all_by_terms"
CREDIT_LEVELS = "lowest_cb21_level_adjusted_all_credit_types_by_terms"
# columns of a classified student that the published tables read
DISCLOSED = ("group", "pathway", "cohort", "level_seq", "entry_level", "entry_level_label", "structure", "age_band",
             "gender_label", "goal", "esl_terms", "enrolled_terms", "esl_first_term", "nothing_after_last_esl",
             "ever_slipped_back", "first_college_group", "earliest_degree_topcode")
MARGINS = {"entry_level": "entry_level_label", "cohort": "cohort", "structure": "structure",
           "age_band": "age_band", "gender": "gender_label", "goal": "goal"}


def classified(flat: DataFrame) -> DataFrame:
    """Flat file plus credit group, sequence features, pathway and labels: a narrow plan."""
    require_columns(flat, fv.SEQUENCE_COLUMNS)
    staged = flat.withColumn("group", seq.credit_group(F.col(NONCREDIT), F.col(CREDIT)))
    staged = staged.withColumn("level_seq", F.when(F.col("group") == fv.GROUP_CREDIT,
                                                   F.col(CREDIT_LEVELS)).otherwise(F.col(LEVELS)))
    staged = seq.with_sequence_features(staged, ESL, "level_seq")
    labels = {
        "pathway": seq.pathway(),
        "age_band": recode.age_band(F.col("age_at_first_term")),
        "gender_label": recode.label_map(F.col("gender"), fv.GENDER_LABELS, "Unreported"),
        "structure": recode.label_map(F.col("first_college_group"), fv.STRUCTURE_LABELS, "other"),
        "citizenship": recode.label_map(F.col("citizenship_earliest"), fv.CITIZENSHIP_LABELS,
                                        fv.UNKNOWN),
        "goal": recode.label_map(F.col("sb14_student_ed_goal"), fv.GOAL_LABELS, "Not reported"),
        "entry_level_label": F.when(F.col("entry_level").isNotNull(), F.concat(
            F.col("entry_level").cast("string"), F.lit(" below transfer"))),
        "cohort": F.col("first_academic_year")}
    return staged.withColumns(labels)


def eligible(d: DataFrame, p: DisclosureParams = DISCLOSURE) -> DataFrame:
    return d.where(F.col("cohort").isin(*p.cohorts))


def reported(d: DataFrame, p: DisclosureParams = DISCLOSURE) -> DataFrame:
    """Eligible students of the credit groups the tables report."""
    return eligible(d, p).where(F.col("group").isin(*p.groups))


def _with_share(counts: DataFrame, keys: list[str], count: str = "students",
                total: str = "group_total", share: str | None = "pct_of_group") -> DataFrame:
    """Group totals over already aggregated counts, and the share of each row."""
    out = counts.withColumn(total, F.sum(count).over(Window.partitionBy(*keys)))
    return out.withColumn(share, percent_half_even(F.col(count), F.col(total))) if share else out


def provenance(d: DataFrame, p: DisclosureParams = DISCLOSURE) -> DataFrame:
    return d.agg(F.count("*").alias("source_rows"),
                 F.count_if(F.col("cohort").isin(*p.cohorts)).alias("students_in_eligible_cohorts")
                 ).select(
        "*", F.lit(", ".join(p.cohorts)).alias("eligible_cohorts"),
        F.lit(p.censored_cohort).alias("censored_cohort_reported_separately"),
        F.lit(p.min_cell).alias("min_cell_suppression"),
        F.lit(fv.LEVEL_VARIANT_NOTE).alias("level_variant_used"),
        F.lit(fv.CREDIT_STATUS_NOTE).alias("credit_status_source"))


def composition(d: DataFrame) -> DataFrame:
    """Students by credit group and entry cohort, over every cohort."""
    return d.where("cohort IS NOT NULL").groupBy("group", "cohort").agg(
        F.count("*").alias("students"))


def pathway_totals(d: DataFrame, p: DisclosureParams = DISCLOSURE) -> DataFrame:
    counts = reported(d, p).groupBy("group", "pathway").agg(F.count("*").alias("students"))
    return _with_share(counts, ["group"])


def pathway_by(d: DataFrame, column: str, label: str, p: DisclosureParams = DISCLOSURE) -> DataFrame:
    """Pathways within each value of one column; a null value is not a group."""
    counts = (reported(d, p).where(F.col(column).isNotNull())
              .groupBy("group", F.col(column).alias(label), "pathway")
              .agg(F.count("*").alias("students")))
    return _with_share(counts, ["group", label])


def pathway_by_margins(d: DataFrame, p: DisclosureParams = DISCLOSURE) -> DataFrame:
    """``pathway_by`` for all six margins at once, stacked as (margin, value)."""
    pairs = F.array(*[F.struct(F.lit(m).alias("margin"), F.col(c).alias("value"))
                      for m, c in MARGINS.items()])
    counts = (reported(d, p).select("group", "pathway", F.inline(pairs))
              .where("value IS NOT NULL").groupBy("group", "margin", "value", "pathway")
              .agg(F.count("*").alias("students")))
    return _with_share(counts, ["group", "margin", "value"])


def pathway_by_race(d: DataFrame, p: DisclosureParams = DISCLOSURE) -> DataFrame:
    """Race flags are not exclusive: a student counts under every flag that is set."""
    flags = F.array(*[F.when(F.col(c), F.lit(label)) for c, label in fv.RACE_FLAG_LABELS.items()])
    counts = (reported(d, p).select("group", "pathway", F.explode(flags).alias("race_flag"))
              .where("race_flag IS NOT NULL").groupBy("group", "race_flag", "pathway")
              .agg(F.count("*").alias("students")))
    return _with_share(counts, ["group", "race_flag"])


def terms_within_pathway(d: DataFrame, p: DisclosureParams = DISCLOSURE) -> DataFrame:
    """Students per capped term count, with the exact median and mean of the uncapped counts."""
    keys = ["group", "pathway"]
    exact = reported(d, p).groupBy(*keys, "esl_terms").agg(F.count("*").alias("n"))
    terms, n = F.col("esl_terms"), F.col("n")
    stats = exact.groupBy(*keys).agg(
        F.sum("n").alias("pathway_total"),
        F.percentile(terms, F.lit(0.5), n).alias("median_esl_terms"),
        ratio_half_even(F.sum(terms * n), F.sum(n), 1, 2).alias("mean_esl_terms"))
    text = F.when(terms >= p.term_cap, f"{p.term_cap}+").otherwise(terms.cast("string"))
    capped = exact.groupBy(*keys, text.alias("esl_terms")).agg(F.sum("n").alias("students"))
    return capped.join(stats, keys).select(*keys, "esl_terms", "students", "pathway_total",
                                           "median_esl_terms", "mean_esl_terms")


def entry_levels(d: DataFrame, p: DisclosureParams = DISCLOSURE) -> DataFrame:
    """Level at the first ESL term, plus one at-or-above-transfer row per group."""
    above = F.left(F.col("level_seq"), F.lit(1)) == "1"
    counts = reported(d, p).groupBy("group", "entry_level").agg(
        F.count("*").alias("students"), F.count_if(above).alias("above"))
    own = counts.groupBy("group").agg(
        F.collect_list(F.struct(F.col("entry_level").cast("string").alias("levels_below_transfer"),
                                "students")).alias("levels"),
        F.sum("above").alias("above"), F.sum("students").alias("group_total"))
    names = d.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(g) for g in p.groups])).alias("group"))
    always = F.array(F.struct(F.lit(fv.AT_OR_ABOVE_TRANSFER).alias("levels_below_transfer"),
                              F.coalesce("above", F.lit(0)).cast("bigint").alias("students")))
    known = F.filter("levels", lambda r: r["levels_below_transfer"].isNotNull())
    rows = F.when(F.col("levels").isNull(), always).otherwise(F.concat(known, always))
    both = names.join(own, "group", "left").na.fill(0, ["group_total"]).select(
        "group", "group_total", F.inline(rows))
    return both.select("group", "levels_below_transfer", "students", "group_total", percent_half_even(
        F.col("students"), F.col("group_total")).alias("pct_of_group"))


def advancement_by_level(d: DataFrame, p: DisclosureParams = DISCLOSURE) -> DataFrame:
    """Of noncredit students seen at a level of a six-level college: who returned and advanced."""
    six = eligible(d, p).where((F.col("group") == fv.GROUP_NONCREDIT)
                               & (F.col("first_college_group") == fv.GROUP_SIX))
    seen = six.select(seq.level_numbers(F.col("level_seq")).alias("seen"))
    at = seen.select("seen", F.explode(F.array_distinct("seen")).alias("levels_below_transfer"))
    level = F.col("levels_below_transfer")
    position = F.array_position("seen", level)
    later = F.slice("seen", (position + 1).cast("int"), F.size("seen"))
    at = at.select(level, later.alias("later"))
    counts = at.groupBy(level).agg(
        F.count("*").alias("students_at_level"),
        F.count_if(F.size("later") > 0).alias("returned_for_later_esl_term"),
        F.count_if(F.array_contains("later", level - 1)).alias("reached_next_level"),
        F.count_if(F.array_min("later") < level).alias("reached_any_higher_level"))
    back = F.col("returned_for_later_esl_term")
    return counts.select(
        level, "students_at_level", back,
        percent_half_even(back, F.col("students_at_level")).alias("pct_returned"),
        "reached_next_level",
        percent_half_even(F.col("reached_next_level"), back).alias("pct_of_returners_next_level"),
        "reached_any_higher_level",
        percent_half_even(F.col("reached_any_higher_level"), back)
        .alias("pct_of_returners_any_higher"))


def arrival_and_after(d: DataFrame, p: DisclosureParams = DISCLOSURE) -> DataFrame:
    return reported(d, p).groupBy("group", "pathway").agg(
        F.count("*").alias("students"),
        F.count_if(F.col("esl_first_term")).alias("esl_was_first_enrollment"),
        F.count_if(F.col("nothing_after_last_esl")).alias("nothing_after_last_esl_term"),
        F.count_if(F.col("enrolled_terms") > F.col("esl_terms")).alias("any_non_esl_enrolled_term"),
        F.count_if(F.col("ever_slipped_back")).alias("ever_slipped_back_a_level"))


def awards_by_family(d: DataFrame, p: DisclosureParams = DISCLOSURE) -> DataFrame:
    """First award by family; students without an award count in the total only."""
    family = recode.award_family(F.col("earliest_degree_topcode"))
    counts = (reported(d, p).groupBy("group", "pathway", family.alias("award_family"))
              .agg(F.count("*").alias("students")))
    return _with_share(counts, ["group", "pathway"], total="pathway_total", share=None).where(
        "award_family IS NOT NULL")


def counted(d: DataFrame, store: TableStore, p: DisclosureParams = DISCLOSURE) -> tuple[DataFrame, DataFrame]:
    """Pathways by all margins and in total, written once: small tables that several outputs read."""
    return (store.table("pathway_margins", pathway_by_margins(d, p), repr(p)),
            store.table("pathway_totals", pathway_totals(d, p), repr(p)))


def protected(d: DataFrame, store: TableStore, p: DisclosureParams = DISCLOSURE) -> DataFrame:
    """``complementary`` over all margins and race flags: which counts to blank, and why."""
    margins, totals = counted(d, store, p)
    key = ["group", "margin", "value", "pathway", "students"]
    race = pathway_by_race(d, p).select("group", F.lit("race_flag").alias("margin"), F.col("race_flag").alias("value"),
                                        "pathway", "students")
    cells = store.table("pathway_cells", margins.select(key).unionByName(race), repr(p))
    return store.table("hidden", complementary(cells, totals.select("group", "pathway", "students"), p.min_cell), repr(p))


def _marked(df: DataFrame, hidden: DataFrame, keys: list[str]) -> DataFrame:
    """``hide_row`` where the row's keys are among those hidden."""
    return df.join(hidden.select(*keys).distinct().withColumn("hide_row", F.lit(True)), keys, "left")


def tables(d: DataFrame, run_date: str, p: DisclosureParams = DISCLOSURE, store: TableStore | None = None) -> list[tuple]:
    """The published tables: (file stem, table, count columns, note)."""
    margin_files = (("entry_level", "03_pathway_by_entry_level"), ("cohort", "04_pathway_by_cohort"),
                    ("structure", "05_pathway_by_college_structure"), ("age_band", "06_pathway_by_age"),
                    ("gender", "07_pathway_by_gender"), ("goal", "08_pathway_by_goal"))
    store = store or TableStore(d.sparkSession)
    margins, totals = counted(d, store, p)
    people, race, levels = composition(d), pathway_by_race(d, p), entry_levels(d, p)
    terms, after, awards = terms_within_pathway(d, p), arrival_and_after(d, p), awards_by_family(d, p)
    if p.complementary:
        hidden = protected(d, store, p)
        gone = hidden.where("hidden IS NOT NULL")
        margins = _marked(margins, gone, ["group", "margin", "value", "pathway"])
        race = _marked(race, gone.where("margin = 'race_flag'").withColumnRenamed("value", "race_flag"),
                       ["group", "race_flag", "pathway"])
        # further tables that show a total, or the sum of a row of which no cell is shown
        over = gone.where("margin IS NULL")
        totals, terms, after, awards = (_marked(t, over, ["group", "pathway"]) for t in (totals, terms, after, awards))
        dark = hidden.where("margin IS NOT NULL").groupBy("group", "margin", "value").agg(
            F.every(F.col("hidden").isNotNull()).alias("dark")).where("dark")
        people = _marked(people, dark.where("margin = 'cohort'").withColumnRenamed("value", "cohort"), ["group", "cohort"])
        level = F.regexp_replace("value", " below transfer$", "").alias("levels_below_transfer")
        levels = _marked(levels, dark.where("margin = 'entry_level'").select("group", level), ["group", "levels_below_transfer"])
    one = ["students"]
    out = [("00_provenance", provenance(d, p).withColumn("generated", F.lit(run_date)), [], "run parameters"),
           ("01_composition_by_group_and_cohort", people, one, "students by credit status and entry cohort")]
    for group in p.groups:
        tag = group.split()[0]
        pick = F.col("group") == group
        out.append((f"02_pathway_totals_{tag}", totals.where(pick).drop("group"), one, f"pathway totals, {group}"))
        out += [(f"{stem}_{tag}", margins.where(pick & (F.col("margin") == m)).drop("group", "margin").withColumnRenamed(
            "value", m), one, f"pathway by {m}") for m, stem in margin_files]
    return out + [
        ("09_pathway_by_race_flag", race, one, "race flags are not mutually exclusive"),
        ("10_terms_within_pathway", terms, one, f"ESL term counts, capped at {p.term_cap} or more"),
        ("11_entry_level_distribution", levels, one, "level at first ESL term"),
        ("12_advancement_by_level_six_level_colleges", advancement_by_level(d, p),
         ["students_at_level", "returned_for_later_esl_term"],
         "a student is counted at every level they appear at; rows are not exclusive"),
        ("13_arrival_and_what_followed", after, one, "counts within each pathway"),
        ("14_awards_by_top_code_family", awards, one, "first award only")]


def publish_tables(flat: DataFrame, folder: str, run_date: str, p: DisclosureParams = DISCLOSURE,
                   store: TableStore | None = None) -> DataFrame:
    """The whole disclosure job: classify once, then write every table and the manifest."""
    store = store or TableStore(flat.sparkSession)
    keep = [*DISCLOSED, *fv.RACE_FLAG_LABELS]
    d = store.table("classified", classified(flat).select(*keep), repr(p))
    return publish(tables(d, run_date, p, store), flat, folder, run_date, p)
