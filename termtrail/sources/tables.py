"""The raw tables, their schemas and how to open them."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# DDL of every raw table. Reads are always typed; nothing is inferred.
RAW_SCHEMAS = {
    "students": "maskedsb00 string, uuid string",
    "details": "maskedsb00 string, gi01 string, gi03 int, sb04 string, sb06 string, sb11 string, "
               "sb14 string, sb29 string, std1 string",
    "disability": "maskedsb00 string, sd01 string",
    "aid": "maskedsb00 string, sf21 string",
    "head": "maskedsb00 string, ccc_first_term int",
    "basic": "maskedsb00 string, scd1 int",
    "awards": "maskedsb00 string, student_uuid string, sp01 int, sp02 string, sp03 int, gi03 int",
    "award_types": "award_code string, award_description string, award_ranking int",
    "enrollments": "student_uuid string, maskedsb00 string, gi01 string, gi03 int, cb00 string, "
                   "sx01 string, sx02 string, sx04 string",
    "courses": "gi01 string, gi03 int, cb00 string, cb01 string, cb03 string, cb04 string, "
               "cb05 string, cb21 string",
    "terms": "gi03 int, year string, term string, quarter int",
    "colleges": "gi01_college string, college_name string",
    "levels": "cb21 string, levels_below_transfer int",
    "topcodes": "top6 int, top6title string",
}

# Name of each raw table in the source warehouse.
WAREHOUSE_NAMES = {
    "students": "students",
    "details": "sr1318st",
    "disability": "sr1318sd",
    "aid": "sr1318sfa",
    "head": "sr1318hf",
    "basic": "sr1318sb",
    "awards": "sr1318sp",
    "award_types": "sp_award_types",
    "enrollments": "sr1318sx",
    "courses": "sr1318cb",
    "terms": "sr1318term",
    "colleges": "sr1318colldist",
    "levels": "course_efl_score_mapping",
    "topcodes": "sr1318topcode",
}


@dataclass(frozen=True)
class RawTables:
    students: DataFrame
    details: DataFrame
    disability: DataFrame
    aid: DataFrame
    head: DataFrame
    basic: DataFrame
    awards: DataFrame
    award_types: DataFrame
    enrollments: DataFrame
    courses: DataFrame
    terms: DataFrame
    colleges: DataFrame
    levels: DataFrame
    topcodes: DataFrame


TABLE_NAMES = tuple(f.name for f in fields(RawTables))


def schema(name: str) -> StructType:
    return StructType.fromDDL(RAW_SCHEMAS[name])


def read_parquet_tables(spark: SparkSession, folder: str) -> RawTables:
    """Open every raw table from ``folder/<warehouse name>``."""
    return RawTables(**{
        n: spark.read.schema(schema(n)).parquet(f"{folder}/{WAREHOUSE_NAMES[n]}")
        for n in TABLE_NAMES})


def read_catalog_tables(spark: SparkSession, database: str) -> RawTables:
    """Open every raw table from a catalog database."""
    return RawTables(**{n: spark.table(f"{database}.{WAREHOUSE_NAMES[n]}") for n in TABLE_NAMES})


BAD_VALUES = "bad_values"
_ROW = "_row"


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Names in the first line of a CSV file, or of the first of several."""
    first = spark.read.option("header", False).csv(path).first()
    return [] if first is None else [n or "" for n in first]


def read_csv(spark: SparkSession, path: str, columns: StructType, report_bad: bool = False) -> DataFrame:
    """Columns of a CSV file by the names in its header, as the stated types.

    Order and number of the file's columns do not matter: a column that the file lacks is null, a
    further one is not read, and of columns of one name the first counts. Text stays text, so codes
    keep their leading zeros. A value that is not of its type, or a line with too many or too few
    fields, raises; with ``report_bad`` it is null and listed in ``bad_values``, an array of
    (column, value) that is empty in a good row; a line is listed whole, under ``_row``. Files of
    one path whose headers differ raise.
    """
    header = csv_header(spark, path)
    if not header:
        none = spark.createDataFrame([], columns)
        empty = F.lit(None).cast("array<struct<column: string, value: string>>")
        return none.withColumn(BAD_VALUES, empty) if report_bad else none
    single = len(set(header)) == len(header)
    names = header if single else [f"c{i}" for i in range(len(header))]  # the engine knows no doubled names
    text = StructType([StructField(n, StringType()) for n in [*names, _ROW]])
    rows = (spark.read.schema(text).option("header", True).option("enforceSchema", not single)
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _ROW).csv(path))
    at = {n: names[i] for i, n in reversed(list(enumerate(header)))}
    raw = lambda f: F.col(f"`{at[f.name]}`") if f.name in at else F.lit(None).cast("string")
    bad, typed = [], []
    for f in columns.fields:
        value = raw(f).try_cast(f.dataType)
        wrong = raw(f).isNotNull() & value.isNull()
        report = F.struct(F.lit(f.name).alias("column"), raw(f).alias("value"))
        if not isinstance(f.dataType, StringType):
            bad.append(F.when(wrong, report))
            if not report_bad:
                value = F.when(wrong, F.raise_error(F.concat(F.lit(f"{f.name} of {path} is not {f.dataType.simpleString()}: "),
                                                             raw(f)))).otherwise(value)
        typed.append(value.cast(f.dataType).alias(f.name))
    line = F.col(_ROW)
    if not report_bad:
        intact = F.when(line.isNotNull(), F.raise_error(F.concat(F.lit(f"a line of {path} is broken: "), line)))
        return rows.where(intact.cast("boolean").isNull()).select(*typed)
    broken = F.when(line.isNotNull(), F.struct(F.lit(_ROW).alias("column"), line.alias("value")))
    return rows.select(*typed, F.filter(F.array(broken, *bad), lambda b: b.isNotNull()).alias(BAD_VALUES))


def require_columns(df: DataFrame, names) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError("missing required columns: " + ", ".join(missing))
    return df
