"""Sinks: guarded aggregate files, pivots, dated snapshots and the run manifest."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termtrail.operators.disclosure import guard_identifiers, suppress
from termtrail.params import DISCLOSURE, DisclosureParams


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV part file with a header, for tables bounded by their categories."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_snapshot(df: DataFrame, folder: str, name: str, run_date: str) -> str:
    """Dated table ``name_YYYYMMDD``; the date is the caller's."""
    path = f"{folder}/{name}_{run_date}"
    df.write.mode("overwrite").parquet(path)
    return path


def write_model(df: DataFrame, name: str, materialized: str = "table", by: str | None = None,
                buckets: int = 200, path: str | None = None) -> DataFrame:
    """Keep a layer as a catalog table, or as a view for cheap projections; returns how it reads.

    With ``by``, the table is bucketed and sorted by that key: tables of one key and as many buckets
    join on it without a shuffle. ``path`` is where the files go, else the warehouse decides.
    """
    if materialized == "view":
        df.createOrReplaceTempView(name)
        return df.sparkSession.table(name)
    if by:
        # one task for each bucket, so that a bucket is one sorted file
        out = df.repartition(buckets, by).write.bucketBy(buckets, by).sortBy(by)
    else:
        out = df.write
    if path:
        out = out.option("path", path)
    out.mode("overwrite").saveAsTable(name)
    return df.sparkSession.table(name)


def write_partitioned(df: DataFrame, path: str, by: str) -> DataFrame:
    """Parquet files in one folder for each value of a column; returns how they read.

    Each task writes its rows of a value, so a value with most rows is many files.
    """
    df.write.mode("overwrite").partitionBy(by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _content(df: DataFrame) -> list:
    """Two sums of row hashes, and the rows; sums of parts add up to that of the whole.

    A row's hash covers each value and whether it is null, and is summed without overflow, so equal
    rows do not cancel out.
    """
    parts = [x for c in df.columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    wide = lambda seed: F.coalesce(F.sum(F.xxhash64(F.lit(seed), *parts).cast("decimal(38,0)")), F.lit(0))
    return [wide(1).alias("hash_1"), wide(2).alias("hash_2"), F.count("*").alias("source_rows")]


def _joined(sums: DataFrame) -> DataFrame:
    text = lambda c: F.col(c).cast("decimal(38,0)").cast("string")
    return sums.select(F.concat_ws("/", text("hash_1"), text("hash_2")).alias("content_hash"), "source_rows")


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-free content hash and row count, computed where the data is."""
    return _joined(df.agg(*_content(df)))


def part_fingerprints(df: DataFrame, part: Column | None = None) -> DataFrame:
    """``(part, hash_1, hash_2, source_rows)``: the fingerprint by input file, or by another column.

    The parts of files that were already there stay as they were, so of a table that files are
    appended to, only the new files are read again: ``merged`` adds up the parts of both.
    """
    return df.groupBy((F.input_file_name() if part is None else part).alias("part")).agg(*_content(df))


def merged(parts: DataFrame) -> DataFrame:
    """The fingerprint of all rows, from those of their parts."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return _joined(parts.agg(total("hash_1"), total("hash_2"), total("source_rows")))


def _folder(spark: SparkSession, path: str):
    """A path and its file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _lines(stem: str, df: DataFrame) -> DataFrame:
    """The rows of a table as (file, part, value): CSV text, to be stacked with other tables."""
    return df.select(F.lit(f"{stem}.csv").alias("file"), F.lit(1).alias("part"),
                     F.to_csv(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("value"))


def publish(tables: list[tuple], source: DataFrame, folder: str, run_date: str,
            p: DisclosureParams = DISCLOSURE) -> DataFrame:
    """Suppress and guard all tables, write them in one job, then the manifest; returns the manifest.

    ``tables`` has (stem, table, count columns, note); a boolean column ``hide_row`` blanks further
    rows and is not written. All tables are stacked as text and written by file into a staging folder
    beside ``folder``. Only when the manifest is complete does the staging folder take the place of
    the old one, so a run that fails leaves the old files as they were.
    """
    spark: SparkSession = source.sparkSession
    stacked, heads, notes = None, [], []
    for stem, df, counts, note in tables:
        also = F.col("hide_row") if "hide_row" in df.columns else None
        safe = suppress(df, counts, p.min_cell, also) if counts else df
        safe = guard_identifiers(safe.drop("hide_row"), stem)
        rows = _lines(stem, safe)
        stacked = rows if stacked is None else stacked.unionAll(rows)
        heads.append((f"{stem}.csv", 0, ",".join(safe.columns)))
        notes.append((f"{stem}.csv", safe.columns, note))
    stacked = stacked.unionAll(spark.createDataFrame(heads, "file string, part int, value string"))
    staging = f"{folder.rstrip('/')}.staging-{uuid.uuid4().hex}"
    at, fs = _folder(spark, staging)
    try:
        (stacked.repartition("file").sortWithinPartitions("file", "part", "value").select("file", "value")
         .write.partitionBy("file").text(staging))
        written = spark.read.text(staging).groupBy("file").agg((F.count("*") - 1).alias("rows"))
        files = spark.createDataFrame(notes, "file string, columns array<string>, note string").join(written, "file").select(
            "file", "rows", "columns", "note")
        packed = files.agg(F.array_sort(F.collect_list(F.struct(*files.columns))).alias("files"))
        manifest = fingerprint(source).select(
            F.lit(run_date).alias("generated"), "content_hash", "source_rows",
            F.lit(p.min_cell).alias("min_cell_suppression"), packed.select("files").scalar().alias("files"))
        manifest.coalesce(1).write.json(f"{staging}/MANIFEST.json")
        for stem, *_ in tables:
            renamed = fs.rename(_folder(spark, f"{staging}/file={stem}.csv")[0], _folder(spark, f"{staging}/{stem}.csv")[0])
            if not renamed:
                raise OSError(f"{stem} was not written")
        _replace(spark, staging, folder)
    finally:
        fs.delete(at, True)
    return spark.read.schema(manifest.schema).json(f"{folder}/MANIFEST.json")


def _replace(spark: SparkSession, staging: str, folder: str) -> None:
    """Puts ``staging`` in the place of ``folder``; if that fails, the old folder comes back."""
    new, fs = _folder(spark, staging)
    target, aside = _folder(spark, folder)[0], _folder(spark, f"{folder.rstrip('/')}.old-{uuid.uuid4().hex}")[0]
    there = fs.exists(target)
    if there and not fs.rename(target, aside):
        raise OSError(f"{folder} cannot be replaced")
    if not fs.rename(new, target):
        if there:
            fs.rename(aside, target)
        raise OSError(f"{folder} cannot be written")
    if there:
        fs.delete(aside, True)
