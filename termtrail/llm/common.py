"""Shared storage, ordered sharding and connected components."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termtrail.sources.store import shared_folder

LOWEST = -(1 << 63)
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application, and bounds Arrow batches.

    Texts are long: the session's default of 10,000 rows would hold a batch of tens of megabytes
    several times over in each task.
    """
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, BATCH_ROWS)
    spark.conf.set(_BYTES, BATCH_BYTES)
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        made = shutil.make_archive(os.path.join(tempfile.mkdtemp(), "termtrail_llm"), "zip", root, "termtrail")
        context.addPyFile(made)
        _shipped.add(context.applicationId)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the folder that driver and executors share; removed when the session ends.

    Reads ``spark.checkpoint.dir``. Where that is unset, the warehouse folder serves, on a cluster
    only if it is no folder of one machine.
    """
    path = f"{shared_folder(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to shared storage and read back: cuts the lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def order_key(id_col: str) -> Column:
    """Document ids as a total order: null ids come first."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST))


def shard_bounds(docs: DataFrame, id_col: str, rows_per_shard: int = 1024) -> tuple[int, list[int]]:
    """Smallest key and the first keys of all shards but the first, from one scan of the id column.

    Bounds are ids that occur, so shard ``s`` starts with the row whose key is ``bounds[s - 1]``.
    The number of shards follows the rows, up to four per shuffle partition.
    """
    key = order_key(id_col)
    rows, least = docs.agg(F.count(F.lit(1)), F.min(key)).first()
    count = max(1, min(-(-rows // rows_per_shard), 4 * partitions(docs.sparkSession)))
    if count == 1:
        return (LOWEST if least is None else least), []
    cuts = docs.agg(F.percentile_approx(key, [i / count for i in range(1, count)], 20 * count)).first()[0]
    return least, sorted({c for c in cuts if c > least})


def shard_of(key: Column, bounds: list[int]) -> Column:
    """Number of bounds up to ``key``, by binary search over a literal array."""
    if not bounds:
        return F.lit(0)
    cuts = F.lit(bounds)
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))

    def step(a: Column, _: Column) -> Column:
        mid = F.shiftright(a.lo + a.hi, 1)
        right = F.get(cuts, mid) <= key
        halved = F.struct(F.when(right, mid + 1).otherwise(a.lo).alias("lo"),
                          F.when(right, a.hi).otherwise(mid).alias("hi"))
        return F.when(a.lo < a.hi, halved).otherwise(a)

    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length()))
    return F.aggregate(steps, start, step, lambda a: a.lo)


def components(edges: DataFrame) -> DataFrame:
    """Smallest reachable node for each node of an undirected graph: ``(node, component)``.

    ``edges`` has long columns ``a`` and ``b``. Each round hooks every label to the smallest
    neighbouring label, shortens the pointers until they are flat, and keeps only edges between
    different labels, written to shared storage. Labels never pass through the driver, and a node
    with very many edges only meets map-side minima and joins that AQE can split.
    """
    edges = stored(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
                   .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = stored(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
                    .withColumn("component", F.col("node")), "labels")
    while not edges.isEmpty():
        hooks = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up"))
        hooks = stored(hooks, "hooks")
        while True:
            above = hooks.select(F.col("node").alias("up"), F.col("up").alias("top"))
            jumped = stored(hooks.join(above, "up", "left").select(
                "node", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")), "jump")
            hooks = jumped.select("node", "up")
            if jumped.where("moved").isEmpty():
                break
        tops = hooks.select(F.col("node").alias("component"), "up")
        labels = stored(labels.join(tops, "component", "left")
                        .select("node", F.coalesce("up", "component").alias("component")), "labels")
        at_a = hooks.select(F.col("node").alias("a"), F.col("up").alias("ua"))
        at_b = hooks.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        moved = edges.join(at_a, "a", "left").join(at_b, "b", "left").select(
            F.coalesce("ua", "a").alias("x"), F.coalesce("ub", "b").alias("y")).where("x <> y")
        edges = stored(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
                       .distinct(), "edges")
    return labels
