"""Best-fit packing of documents into training sequences, under conflicts.

Bins of a group are kept in order of what is left in them, each with a bitmap of the sources and one
of the duplicate clusters it holds. A piece goes to the tightest bin that has room and holds neither
its source nor its cluster: the search starts at the first bin with room and goes on to successors
until one is compatible. Groups are dealt out by hash and are packed on their own, so a source or a
cluster with a third of all rows is spread over all groups.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termtrail.llm import common, near_duplicates, token_counts, token_file, words

CAPACITY = 2048
GROUP_ROWS = 2048
_BLANKS = bytes.maketrans(b"\t\n\v\f\r", b"     ")


class Packer:
    """Bins of one group. ``place`` returns the bin and the offset of a piece within it."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.left: list[tuple[int, int]] = []  # (room, bin), ascending
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """``source`` and ``cluster`` are numbers within the group; -1 conflicts with nothing."""
        own_source, own_cluster = 1 << source if source >= 0 else 0, 1 << cluster if cluster >= 0 else 0
        at = bisect_left(self.left, (size, -1))
        while at < len(self.left):
            room, number = self.left[at]
            if not (self.sources[number] & own_source or self.clusters[number] & own_cluster):
                del self.left[at]
                break
            at += 1
        else:
            room, number = self.capacity, len(self.sources)
            self.sources.append(0)
            self.clusters.append(0)
        self.sources[number] |= own_source
        self.clusters[number] |= own_cluster
        if room > size:
            entry = (room - size, number)
            self.left.insert(bisect_left(self.left, entry), entry)
        return number, self.capacity - room


def pack_group(lengths: list[int], sources: list, clusters: list, capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces ``(row, start, length, bin, offset)`` of one group, largest first.

    A row longer than a bin is cut: full bins of its own, and a rest that is packed like any other.
    A null source or cluster conflicts with nothing; a row of no tokens is a piece of length 0.
    """
    pieces = [(min(capacity, n - start), row, start) for row, n in enumerate(lengths)
              for start in (range(0, n, capacity) if n else (0,))]
    pieces.sort(key=lambda p: (-p[0], p[1], p[2]))
    number = lambda values: {v: i for i, v in enumerate(dict.fromkeys(x for x in values if x is not None))}
    source_of, cluster_of = number(sources), number(clusters)
    packer = Packer(capacity)
    out = []
    for size, row, start in pieces:
        place = packer.place(size, source_of.get(sources[row], -1), cluster_of.get(clusters[row], -1))
        out.append((row, start, size, *place))
    return out


def _plain(text: str | None) -> int | None:
    """Hash of a text without regard to case and white space; none for a text without words."""
    spelled = (text or "").lower().encode().translate(_BLANKS).strip(b" ")
    if b"  " in spelled:
        spelled = b" ".join(spelled.split())
    return xxhash.xxh64_intdigest(spelled) - (1 << 63) if spelled else None


def _sized(tokenizer: str, own_cluster: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = token_counts.counter(tokenizer).count
        for batch in batches:
            cluster = batch.column(2)
            if not own_cluster:
                cluster = pa.array([_plain(t) for lo in range(0, batch.num_rows, 256)
                                    for t in batch.column(3).slice(lo, 256).to_pylist()], pa.int64())
            yield pa.record_batch([batch.column(0), batch.column(1), cluster, pa.array(count(batch.column(3)) + 1)],
                                  ["id", "source", "cluster", "n_tokens"])
    return run


_PIECES = ("grp long, id long, source string, cluster long, start long, n_tokens long, bin long, offset long")


def _packed(capacity: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("cluster", "ascending"), ("n_tokens", "ascending"), ("source", "ascending")])
        rows = pack_group(table["n_tokens"].to_pylist(), table["source"].to_pylist(), table["cluster"].to_pylist(), capacity)
        row, start, size, number, offset = np.array(rows, dtype=np.int64).reshape(-1, 5).T
        own = table.take(pa.array(row))
        return pa.table({"grp": pa.array(np.full(len(row), key[0].as_py())), "id": own["id"], "source": own["source"],
                         "cluster": own["cluster"], "start": pa.array(start), "n_tokens": pa.array(size),
                         "bin": pa.array(number), "offset": pa.array(offset)})
    return run


def _joined(sized: DataFrame, near: DataFrame) -> DataFrame:
    """``sized`` with clusters that are joined where ``near``, as ``(id, component)``, has one component for them.

    Rows of a component and rows of a cluster are all one cluster, named by the smallest component.
    Rows without an id have no component, rows without a cluster (no text) get none.
    """
    of_id = near.where("id IS NOT NULL").groupBy("id").agg(F.min("component").alias("component"))
    rows = common.stored(sized.join(of_id, "id", "left").withColumn("component", F.when(F.col("cluster").isNotNull(), F.col("component"))),
                         "placed")
    spans = common.stored(rows.where("cluster IS NOT NULL").groupBy("cluster").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi")), "spans")
    labels = common.components(rows.join(spans.where("lo <> hi"), "cluster").select(
        F.col("component").alias("a"), F.col("lo").alias("b")))
    rows = rows.join(spans.select("cluster", "lo"), "cluster", "left").withColumn("node", F.coalesce("component", "lo", "cluster"))
    return rows.join(labels.withColumnRenamed("component", "top"), "node", "left").select(
        "id", "source", F.coalesce("top", "node").alias("cluster"), "n_tokens")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
         cluster_col: str | None = None, capacity: int = CAPACITY, tokenizer: str = token_file.TOKENIZER,
         near: DataFrame | None = None) -> DataFrame:
    """``(id, source, cluster, start, n_tokens, grp, bin, offset)``: one row for each piece.

    A piece is the tokens ``start`` to ``start + n_tokens`` of a document (its ids and one end id),
    placed at ``offset`` of bin ``(grp, bin)`` of ``capacity`` tokens. No bin holds two pieces of one
    source or of one duplicate cluster. Without ``cluster_col`` (a long), texts that are equal but
    for case and white space are a cluster; ``near``, with columns ``id`` and ``component`` (longs),
    joins clusters of one component. Null texts are empty (one end id); null sources and
    clusters conflict with nothing; repeated rows are packed as often as they come. An empty table
    gives no row. Further columns are not read.

    Lengths are found where the text lies; only ids, sources, clusters and lengths are shuffled. The
    number of groups follows the rows, about ``GROUP_ROWS`` each.
    """
    common.ship(docs.sparkSession)
    cluster = F.col(cluster_col).cast("long") if cluster_col else F.lit(None).cast("long")
    sized = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"),
                        cluster.alias("cluster"), F.col(text_col).cast("string").alias("text"))
    sized = common.stored(sized.mapInArrow(words.tidy(_sized(tokenizer, bool(cluster_col))), "id long, source string, cluster long, n_tokens long"), "sizes")
    if near is not None:
        sized = common.stored(_joined(sized, near), "clustered")
    groups = max(1, -(-sized.count() // GROUP_ROWS))
    # the row's place in the stored sizes keeps equal rows from meeting in one group
    spread = F.pmod(F.xxhash64("id", "n_tokens", F.monotonically_increasing_id()), F.lit(groups))
    done = sized.withColumn("grp", spread).groupBy("grp").applyInArrow(_packed(capacity), _PIECES)
    return done.withColumnRenamed("id", id_col).withColumnRenamed("source", source_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = near_duplicates.near_duplicates(docs).select(F.col("doc_id").alias("id"), F.col("component_id").alias("component"))
    return pack(docs, near=found)
