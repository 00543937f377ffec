"""The manifest against a tree built in plain lists."""

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from termtrail.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, grp string, place int"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    size = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha(*map(size, (doc_id, source, lang, n_chars, text)))


def tree(nodes, fanout=3):
    """Root, and for each node its (left, right) siblings from below."""
    steps = [[] for _ in nodes]
    own = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, owners = [], []
        for k in range(0, len(nodes), fanout):
            run = nodes[k:k + fanout]
            for j in range(len(run)):
                for i in own[k + j]:
                    steps[i].append(("".join(run[:j]), "".join(run[j + 1:])))
            up.append(sha(*run))
            owners.append([i for o in own[k:k + fanout] for i in o])
        nodes, own = up, owners
    return nodes[0], steps


def plain(rows):
    by_source = {}
    for r in rows:
        by_source.setdefault(r[3], []).append(r)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        own = sorted(by_source[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r[:5])))
        trees[name] = (own, *tree([leaf(*r[:5]) for r in own]))
    root, top = tree([trees[n][1] for n in names])
    out = []
    for k, name in enumerate(names):
        own, subroot, steps = trees[name]
        for r, path in zip(own, steps, strict=True):
            path = path + top[k]
            struck = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None
            acc = leaf(r[0], r[1].replace("\n", "") if struck else r[1], *r[2:5])
            for left, right in path:
                acc = sha(left, acc, right)
            out.append((r[0], leaf(*r[:5]), subroot, root, sha(*(x for s in path for x in s)), acc, acc == root))
    return sorted(out, key=repr)


def rows_of(rnd, n):
    sources = [None, "", "a", "é", "z" * 40, "b", "B", "😀"] + [f"s{i}" for i in range(12)]
    rows = []
    for i in range(n):
        text = rnd.choice([None, "", "no break", "two\nlines", "\n", "é\n😀" * 30])
        source = "hot" if rnd.random() < 0.4 else rnd.choice(sources)
        rows.append((i * 3, text, rnd.choice([None, "en", ""]), source, rnd.choice([None, 0, 12345]), "x", 5))
    return rows


def test_query_against_plain_trees(spark, tmp_path):
    rnd = random.Random(1)
    rows = rows_of(rnd, 400)
    rows += [rows[3], rows[3], (rows[4][0], "another text", "en", rows[4][3], 1, None, None), (None, "no id", None, None, None, "", 0),
             (None, "no id", None, None, None, "", 0), (-5, "x\n" * 200_000, "en", "long", 1, "", 0), (2 ** 62, None, None, "alone", None, None, None)]
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, merkle.query(spark, str(tmp_path)).collect()), key=repr)
    want = plain(rows)
    assert got == want
    assert {r[6] for r in got} == {True, False}


def test_sizes_around_powers_of_the_fanout(spark, tmp_path):
    for n, sources in ((1, 1), (2, 1), (3, 1), (4, 1), (9, 3), (10, 1), (28, 2), (5, 5)):
        rows = [(i, f"t\n{i}", "en", f"s{i % sources}", i, None, None) for i in range(n)]
        path = f"{tmp_path}/{n}-{sources}"
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
        assert sorted(map(tuple, merkle.query(spark, path).collect()), key=repr) == plain(rows)


def test_empty_table_and_other_fanout(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert merkle.query(spark, str(tmp_path)).collect() == []
    docs = spark.createDataFrame([(i, "t", None, "s", None, None, None) for i in range(12)], SCHEMA)
    done = merkle.manifest(docs, fanout=5)
    back = done.select("root", merkle.fold(F.col("leaf"), F.col("path")).alias("folded"), F.size("path").alias("n")).collect()
    assert all(r.root == r.folded and r.n == 2 for r in back) and len(back) == 12
    want = tree([leaf(i, "t", None, "s", None) for i in range(12)], 5)[0]
    assert {bytes(r.root).hex() for r in back} == {want}


def test_rows_of_a_source_are_spread(spark):
    rows = spark.range(5000).select(F.col("id"), F.lit("=hot").alias("grp"), F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    done = merkle.numbered(rows, ["grp", "id"], "grp", "spread")
    places = [r.place for r in done.orderBy("id").collect()]
    assert places == list(range(5000))
    held = spark.read.parquet(done.inputFiles()[0].rsplit("/", 1)[0]).groupBy(F.shiftright("at", 33)).count()
    assert held.count() > 4 and held.agg(F.max("count")).first()[0] < 2000
