"""Components, shards and storage."""

import random
from bisect import bisect_right

from pyspark.sql import functions as F

from termtrail.llm import common


def plain(edges):
    up = {n: n for e in edges for n in e}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {n: top(n) for n in up}


def test_components_of_paths_cycles_hubs_and_random_graphs(spark):
    rnd = random.Random(8)
    names = rnd.sample(range(-1000, 10 ** 12), 700)
    path = [(names[i], names[i + 1]) for i in range(150)]
    cycle = [(names[200 + i], names[200 + (i + 1) % 40]) for i in range(40)]
    hub = [(names[300], names[301 + i]) for i in range(100)]
    mixed = [(names[450 + rnd.randrange(200)], names[450 + rnd.randrange(200)]) for _ in range(150)]
    edges = [e for e in path + cycle + hub + mixed if e[0] != e[1]]
    rows = spark.createDataFrame(edges + [(5, 5), (None, 3), (4, None)] + path[:9] + [(b, a) for a, b in hub[:9]], "a long, b long")
    got = common.components(rows).collect()
    assert len(got) == len({r.node for r in got})
    assert {r.node: r.component for r in got} == plain(edges)
    assert common.components(rows.limit(0)).count() == 0


def test_shards_follow_the_bounds(spark):
    rnd = random.Random(4)
    ids = [rnd.randrange(-10 ** 6, 10 ** 6) for _ in range(3000)] + [None, 7, 7, 7]
    docs = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    least, bounds = common.shard_bounds(docs, "doc_id", rows_per_shard=100)
    assert least == common.LOWEST and bounds == sorted(set(bounds)) and 10 < len(bounds) < 32
    assert set(bounds) <= {i for i in ids if i is not None}
    key = common.order_key("doc_id")
    got = docs.select(key.alias("k"), common.shard_of(key, bounds).alias("s")).collect()
    assert all(r.s == bisect_right(bounds, r.k) for r in got)
    sizes = docs.groupBy(common.shard_of(key, bounds)).count().agg(F.max("count")).first()[0]
    assert sizes < 300
    assert common.shard_bounds(docs.limit(0), "doc_id") == (common.LOWEST, [])
    assert docs.select(common.shard_of(key, [])).distinct().collect()[0][0] == 0


def test_scratch_paths_are_new_and_shared(spark):
    a, b = common.scratch(spark, "x"), common.scratch(spark, "x")
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    assert a != b and a.startswith(root.rstrip("/"))
    kept = common.stored(spark.range(5).toDF("n"), "rows")
    assert kept.count() == 5 and kept.dtypes == [("n", "bigint")]
