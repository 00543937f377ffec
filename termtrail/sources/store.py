"""Tables written once per session in the cluster's shared folder and read back.

Layers that many reports read are written, as a warehouse would, so that a
report starts from a table instead of rebuilding its inputs, and a lost
executor costs a re-read, not a rebuild. The folder is the caller's, else
``spark.checkpoint.dir``, else a folder in the warehouse: all of them are seen
by driver and executors alike. It is removed when the session ends.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder: ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Where neither is set, the warehouse serves; on a cluster only if it is no folder of one machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    if not re.match(r"local(\[|$)", spark.sparkContext.master) and urlsplit(warehouse).scheme in ("", "file"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return warehouse.rstrip("/") + "/_tables"


class TableStore:
    """Parquet tables by name and version under one fresh folder."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.root = f"{(folder or shared_folder(spark)).rstrip('/')}/tables-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
        self._tables: dict[tuple[str, str], tuple[DataFrame, DataFrame]] = {}

    def path(self, name: str) -> str:
        """A new path for files of a caller, removed with the tables."""
        return f"{self.root}/{name}-{uuid.uuid4().hex}"

    def table(self, name: str, df: DataFrame, version: str = "") -> DataFrame:
        """Write ``df`` on first use; afterwards read what was written.

        ``version`` states what else the rows depend on, such as parameters.
        Another plan under the same name and version raises.
        """
        key = (name, version)
        if key not in self._tables:
            stamp = hashlib.sha256(version.encode()).hexdigest()[:12]
            path = f"{self.root}/{name}-{stamp}"
            df.write.option("compression", "zstd").parquet(path)
            self._tables[key] = df, self.spark.read.schema(df.schema).parquet(path)
        source, kept = self._tables[key]
        if source is not df and not source.sameSemantics(df):
            raise ValueError(f"table {name} already holds the rows of another plan")
        return kept
