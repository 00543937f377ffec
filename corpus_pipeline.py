"""From raw documents to packed training sequences: five stages, each over all that the last one kept.

Every stage function takes ``(spark, docs, sf_dir)`` and returns a DataFrame; its result is written
as Parquet and read again as the next stage's ``docs``. All but the last return the columns of
``documents``; further columns of the input are left behind. Null texts and ids, repeated rows and
empty tables are handled as the operators in ``termtrail.llm`` say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termtrail.llm import common, decontam, merkle, near_duplicates, packing, substring, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SHINGLE = 5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below the threshold; the model is fitted on the labels."""
    common.ship(spark)
    docs = docs.select(*COLUMNS)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, carry=COLUMNS).where(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word shingles, 0.8 or more): that of smallest id.

    Where ids stand for several rows, each row is judged by its own text, and of rows of the smallest
    id the one of smallest text stays. Texts without words and rows without an id all stay.
    """
    common.ship(spark)
    docs = docs.select(*COLUMNS)
    known = docs.where("doc_id IS NOT NULL")
    if known.groupBy("doc_id").count().where("count > 1").isEmpty():
        judged = near_duplicates.near_duplicates(docs, shingle=SHINGLE)
        gone = common.stored(judged.where("NOT kept").select("doc_id"), "gone")
        return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)
    placed = merkle.numbered(known.withColumn("row", F.monotonically_increasing_id()), ["doc_id", "text", "row"], None, "rows")
    placed = common.stored(placed.select(*COLUMNS, "place"), "placed")
    judged = near_duplicates.near_duplicates(placed, id_col="place", shingle=SHINGLE)
    gone = common.stored(judged.where("NOT kept").select("place"), "gone")
    rest = placed.join(gone, "place", "left_anti").select(*COLUMNS)
    return rest.unionByName(docs.where("doc_id IS NULL"))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 20 words or more that occur earlier; emptied ones go.

    Texts without such a passage stay as they are.
    """
    common.ship(spark)
    carry = [c for c in COLUMNS if c not in ("doc_id", "text", "n_chars")]
    done = substring.remove_repeats(docs.select(*COLUMNS), carry=carry, tidy=False)
    done = done.where((F.size("removed") == 0) | (F.coalesce("kept_text", F.lit("")) != ""))
    return done.select("doc_id", F.col("kept_text").alias("text"), "lang", "source",
                       F.length("kept_text").cast("long").alias("n_chars"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than a twentieth lie in passages of the benchmark, unchanged."""
    common.ship(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    judged = decontam.contamination(docs.select(*COLUMNS), benchmark, carry=COLUMNS)
    return judged.where(~F.col("contaminated")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, each with its place in a training sequence."""
    common.ship(spark)
    return packing.pack(docs.select(*COLUMNS))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", keep_one_of_near_copies),
          ("substring_dedup", cut_repeated_passages), ("decontamination", drop_contaminated), ("packing", pack)]

#: Neither scores of compression nor best-fit packing can be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
