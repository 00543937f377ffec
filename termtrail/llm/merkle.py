"""Merkle manifest of a table: one tree for each source, and one over the roots of the sources.

A leaf is the digest of a row's columns. Within a source leaves stand by id; every ``fanout``
neighbours become the digest of their parent, level by level, until one node is left: the source's
subroot. The subroots, by source, make the root in the same way.

Each level is one slot pivot: conditional aggregates spread the children of a parent into
``fanout`` columns, and the concatenated columns are hashed to the parent. The same row holds every
child's siblings: the columns without its own slot. Proofs are handed down from the root, one join
of a level with the paths of its parents, and meet the leaves last.

Places of rows come from one range shuffle by (source, id): numbers within a partition, and sums of
rows over the partitions before it. So a source with any share of the rows is spread over
partitions, and no step sees a source as a whole. Digests are shuffled as bytes, texts never.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termtrail.llm import common

FANOUT = 3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_STEP = "array<struct<left: binary, right: binary>>"


def _nothing() -> Column:
    return F.lit("").cast("binary")


def hashed(hex_text: Column) -> Column:
    """sha256 of a text, as bytes."""
    return F.unhex(F.sha2(hex_text, 256))


def hexed(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def field(value: Column) -> Column:
    """A value with its length in bytes before it; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: list[Column]) -> Column:
    return hashed(F.concat(*map(field, values)))


def numbered(rows: DataFrame, order: list[str], group: str | None, name: str) -> DataFrame:
    """``rows`` with ``place``, their number within the group by ``order``, and ``size``, the group's rows.

    ``order`` begins with the group. The only window runs over one row for each group and partition.
    """
    count = common.partitions(rows.sparkSession)
    at = rows.repartitionByRange(count, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    at = common.stored(at, name).withColumn("part", F.shiftright("at", 33))
    keys = [group] if group else []
    spans = at.groupBy("part", *keys).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy(*keys)
    ahead = F.coalesce(F.sum("n").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select("part", *keys, (ahead - F.col("first")).alias("shift"), F.sum("n").over(own).alias("size"))
    return at.join(spans, ["part", *keys]).withColumn("place", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def climb(nodes: DataFrame, fanout: int) -> list[DataFrame]:
    """Levels above ``nodes`` (grp, place, size, digest): one row for each parent, with its children by slot.

    Each level has ``(grp, place, size, digest, c0 ...)``; a group ends with the level of ``size`` 1.
    """
    levels = []
    slots = [f"c{i}" for i in range(fanout)]
    most = nodes.agg(F.max("size")).first()[0] or 0
    while most > 1:
        wide = nodes.where("size > 1").groupBy("grp", F.expr(f"place div {fanout}").alias("place")).agg(
            F.max(F.expr(f"(size + {fanout - 1}) div {fanout}")).alias("size"),
            *[F.max(F.when(F.col("place") % fanout == i, F.col("digest"))).alias(c) for i, c in enumerate(slots)])
        digest = hashed(F.concat(*[F.coalesce(hexed(F.col(c)), F.lit("")) for c in slots]))
        nodes = common.stored(wide.withColumn("digest", digest), "level")
        levels.append(nodes)
        most = -(-most // fanout)
    return levels


def roots(nodes: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """``(grp, digest)`` of each group's last node."""
    found = nodes.where("size = 1").select("grp", "digest")
    for level in levels:
        found = found.unionAll(level.where("size = 1").select("grp", "digest"))
    return found


def _step(slot: Column, fanout: int) -> Column:
    """Siblings left and right of a slot: the slot columns without its own."""
    side = lambda keep: F.concat(*[F.coalesce(F.when(keep(F.lit(i)), F.col(f"c{i}")), _nothing()) for i in range(fanout)])
    return F.array(F.struct(side(lambda i: i < slot).alias("left"), side(lambda i: i > slot).alias("right")))


def descend(nodes: DataFrame, levels: list[DataFrame], base: DataFrame, fanout: int) -> DataFrame:
    """``nodes`` with ``path``, the siblings from the node up, and ``above``, both begun by ``base``.

    ``base`` has one row ``(grp, above, path)`` for each group: what is above the group's last node.
    """
    slots = [f"c{i}" for i in range(fanout)]
    parents = None
    for level in reversed(levels):
        below = None if parents is None else parents.select(
            "grp", "above", F.explode(F.array(*[F.struct(
                (F.col("place") * fanout + i).alias("place"), F.col(c).isNotNull().alias("there"),
                F.concat(_step(F.lit(i), fanout), F.col("path")).alias("path")) for i, c in enumerate(slots)])).alias("child")
        ).where("child.there").select("grp", "child.place", "above", "child.path")
        parents = level.where("size = 1").join(base, "grp").select("grp", "place", *slots, "above", "path")
        if below is not None:
            inner = level.where("size > 1").join(below, ["grp", "place"])
            parents = parents.unionByName(inner.select("grp", "place", *slots, "above", "path"))
    alone = nodes.where("size = 1").join(base, "grp")
    if parents is None:
        return alone
    up = parents.withColumnRenamed("place", "up")
    joined = nodes.where("size > 1").withColumn("up", F.expr(f"place div {fanout}")).join(up, ["grp", "up"])
    path = F.concat(_step(F.col("place") % fanout, fanout), F.col("path"))
    return joined.withColumn("path", path).select(alone.columns).unionByName(alone)


def fold(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest and its siblings lead to."""
    return F.aggregate(path, digest, lambda a, s: hashed(hexed(F.concat(s.left, a, s.right))))


def manifest(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", columns: tuple[str, ...] = COLUMNS,
             fanout: int = FANOUT, check: dict[str, Column] | None = None) -> DataFrame:
    """``(id, leaf, subroot, root, path)`` of every row, digests as bytes.

    ``path`` has the siblings left and right of each node from the leaf to the root; ``fold`` leads a
    leaf along it to ``root``. ``check`` gives other values for some of ``columns``; their digest is a
    further column ``other``.

    Nulls are values of their own in any column; a null source is a source (the first), null ids come
    first. Rows of one id stand by their digest, and equal rows, which are interchangeable, next to
    each other. Empty texts and texts of any length are hashed whole. An empty table gives no row.
    Columns beyond ``columns`` are not read.
    """
    spark = docs.sparkSession
    values = [F.col(c) for c in columns]
    grp = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))
    other = leaf_digest([(check or {}).get(c, F.col(c)) for c in columns]) if check else F.lit(None).cast("binary")
    leaves = docs.select(F.col(id_col).alias("id"), grp.alias("grp"), leaf_digest(values).alias("digest"),
                         other.alias("other"), F.monotonically_increasing_id().alias("row"))
    leaves = numbered(common.stored(leaves, "leaves"), ["grp", "id", "digest", "row"], "grp", "ordered")
    leaves = common.stored(leaves.select("id", "grp", "digest", "other", "place", "size"), "placed")
    levels = climb(leaves, fanout)
    subroots = numbered(common.stored(roots(leaves, levels), "subroots"), ["grp"], None, "sources")
    subroots = subroots.select(F.lit("").alias("grp"), F.col("grp").alias("source"), "digest", "place", "size")
    subroots = common.stored(subroots, "numbered")
    tops = climb(subroots, fanout)
    root = (tops[-1] if tops else subroots).select("digest").first()
    start = spark.createDataFrame([("", bytearray(root[0]), [])] if root else [], f"grp string, above binary, path {_STEP}")
    base = common.stored(descend(subroots, tops, start, fanout).select(
        F.col("source").alias("grp"), F.struct(F.col("digest").alias("subroot"), F.col("above").alias("root")).alias("above"),
        "path"), "tops")
    done = descend(leaves, levels, base, fanout)
    return done.select(F.col("id").alias(id_col), F.col("digest").alias("leaf"), "above.subroot", "above.root", "path",
                       *["other"] * bool(check))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    struck = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    done = manifest(docs, check={"text": struck})
    proof = F.array_join(F.transform("path", lambda s: hexed(F.concat(s.left, s.right))), "")
    folded = fold(F.col("other"), F.col("path"))
    return done.withColumn("folded", folded).select(
        "doc_id", hexed(F.col("leaf")).alias("leaf"), hexed(F.col("subroot")).alias("subroot"), hexed(F.col("root")).alias("root"),
        F.sha2(proof, 256).alias("proof_sha256"), hexed(F.col("folded")).alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"))


def _sql_field(value: str) -> str:
    return f"coalesce(octet_length(encode(CAST({value} AS VARCHAR)))::VARCHAR || ':' || CAST({value} AS VARCHAR), '-')"


def _sql_leaf(text: str) -> str:
    return "sha256(" + " || ".join(_sql_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


#: The same by recursion over levels; crc32 is spelled out bit by bit.
ORACLE_SQL = f"""
WITH RECURSIVE checked AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) AS crc
  FROM documents),
leaf AS (
  SELECT doc_id, coalesce('=' || source, '') AS grp, {_sql_leaf("text")} AS leaf,
    {_sql_leaf("CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END")} AS other FROM checked),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY grp) AS size
  FROM leaf),
up(grp, lvl, place, size, digest) AS (
  SELECT grp, 0, place, size, leaf FROM placed
  UNION ALL
  SELECT grp, lvl + 1, place // 3, (size + 2) // 3, sha256(string_agg(digest, '' ORDER BY place))
  FROM up WHERE size > 1 GROUP BY grp, lvl, place // 3, size),
sub AS (
  SELECT grp, digest, row_number() OVER (ORDER BY grp) - 1 AS place, count(*) OVER () AS size FROM up WHERE size = 1),
top(lvl, place, size, digest) AS (
  SELECT 0, place, size, digest FROM sub
  UNION ALL
  SELECT lvl + 1, place // 3, (size + 2) // 3, sha256(string_agg(digest, '' ORDER BY place))
  FROM top WHERE size > 1 GROUP BY lvl, place // 3, size),
steps AS (
  SELECT p.grp, p.place, u.lvl AS lvl,
    coalesce(string_agg(u.digest, '' ORDER BY u.place) FILTER (WHERE u.place < p.place // CAST(pow(3, u.lvl) AS BIGINT)), '') AS l,
    coalesce(string_agg(u.digest, '' ORDER BY u.place) FILTER (WHERE u.place > p.place // CAST(pow(3, u.lvl) AS BIGINT)), '') AS r
  FROM placed p JOIN up u ON u.grp = p.grp AND u.size > 1 AND u.place // 3 = p.place // CAST(pow(3, u.lvl + 1) AS BIGINT)
  GROUP BY p.grp, p.place, u.lvl
  UNION ALL
  SELECT p.grp, p.place, 1000 + t.lvl,
    coalesce(string_agg(t.digest, '' ORDER BY t.place) FILTER (WHERE t.place < s.place // CAST(pow(3, t.lvl) AS BIGINT)), ''),
    coalesce(string_agg(t.digest, '' ORDER BY t.place) FILTER (WHERE t.place > s.place // CAST(pow(3, t.lvl) AS BIGINT)), '')
  FROM placed p JOIN sub s ON s.grp = p.grp JOIN top t ON t.size > 1 AND t.place // 3 = s.place // CAST(pow(3, t.lvl + 1) AS BIGINT)
  GROUP BY p.grp, p.place, t.lvl),
ordered AS (SELECT *, row_number() OVER (PARTITION BY grp, place ORDER BY lvl) AS k FROM steps),
proofs AS (SELECT grp, place, count(*) AS n, sha256(string_agg(l || r, '' ORDER BY k)) AS proof FROM ordered GROUP BY grp, place),
folded(grp, place, k, acc) AS (
  SELECT grp, place, 0, other FROM placed
  UNION ALL
  SELECT f.grp, f.place, f.k + 1, sha256(o.l || f.acc || o.r)
  FROM folded f JOIN ordered o ON o.grp = f.grp AND o.place = f.place AND o.k = f.k + 1)
SELECT p.doc_id, p.leaf, s.digest AS subroot, t.digest AS root, coalesce(q.proof, sha256('')) AS proof_sha256,
  f.acc AS folded_root, f.acc = t.digest AS verified
FROM placed p JOIN sub s ON s.grp = p.grp JOIN (SELECT digest FROM top WHERE size = 1) t ON true
LEFT JOIN proofs q ON q.grp = p.grp AND q.place = p.place
JOIN folded f ON f.grp = p.grp AND f.place = p.place AND f.k = coalesce(q.n, 0)
"""
