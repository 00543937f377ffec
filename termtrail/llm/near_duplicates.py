"""Near-duplicate documents: banded MinHash, odd sketches, exact confirmation, components.

A document's shingle set is hashed to 64 bits an element. Texts of equal sets are one class, held by
its smallest id. Classes that agree on a band of MinHash values are candidates. Each class also has
an odd sketch: its MinHash samples folded into a bitmap by parity. The population count of two
sketches' XOR bounds their difference from below, so it rejects most candidates below the threshold
before sets are fetched. Every link is confirmed on the full sets.

Candidates are not expanded into all pairs of a bucket. First every member meets the centre of its
bucket. Members already connected need no further test; in buckets that still hold several
components, the pairs across components are tested, in blocks and once for each pair.

``BANDS`` x ``ROWS`` values make a pair at similarity 0.8 miss all bands with probability 2.5e-7.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termtrail.llm import common, words

SHINGLE, PERCENT = 2, 80
BANDS, ROWS = 50, 6
SKETCH_BITS = 4096
SMALL_SET = 1024
BLOCK = 1024
_BAND = np.uint64(63)
_STEP, _STEP_ROWS = 1 << 21, 512
_rng = np.random.default_rng(20240229)
_FACTORS = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_BAND_SEEDS = _rng.integers(0, 1 << 63, BANDS, dtype=np.uint64)


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows, one after another, and where each row begins.

    Words are runs of anything but ASCII white space, A-Z lower-cased. A text of fewer than ``size``
    words is one shingle, a text without words has none.
    """
    data, offsets = words.text_bytes(texts)
    h, before = words.word_hashes(data, offsets, fold=words.LOWER)
    g = words.grams(h, size)[words.inside(before, size)]
    count = np.diff(before)
    at = np.concatenate(([0], np.cumsum(np.where(count < size, count > 0, count - size + 1))))
    few = np.flatnonzero((count > 0) & (count < size))
    if len(few):
        short = np.array([words.grams(h[before[i]:before[i + 1]], int(count[i]), seed=0x632BE59BD9B4E019)[0] for i in few],
                         dtype=np.uint64)
        g = np.insert(g, at[few] - np.arange(len(few)), short)
    g = words.mix(g + words.U(size))
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        g[lo:hi].sort()
    first = np.ones(len(g), dtype=bool)
    first[1:] = g[1:] != g[:-1]
    first[at[:-1][np.diff(at) > 0]] = True
    return g[first], np.concatenate(([0], np.cumsum(first)))[at]


def signatures(sets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (rows x BANDS) and odd sketches (rows x bytes) of non-empty sets.

    The samples folded into the sketch of a set of up to ``SMALL_SET`` elements are all its hashes
    (the k smallest of at most k); of a larger set, the BANDS x ROWS MinHash values with their place.
    """
    n = len(at) - 1
    short = (sets >> words.U(32)).astype(np.uint32)
    least = np.empty((n, BANDS * ROWS), dtype=np.uint32)
    for i, factor in enumerate(_FACTORS):
        least[:, i] = np.minimum.reduceat(short * factor, at[:-1])
    keys = np.zeros((n, BANDS), dtype=np.uint64)
    by_band = least.reshape(n, BANDS, ROWS).astype(np.uint64)
    for r in range(ROWS):
        keys = words.mix(keys * words.U(0x9E3779B97F4A7C15) + by_band[:, :, r] + _BAND_SEEDS)
    sizes = np.diff(at)
    owner = np.repeat(np.arange(n), sizes)
    small = (sizes <= SMALL_SET)
    bit = (sets * words.U(0xD6E8FEB86659FD93)) >> words.U(52)
    place = [(owner * SKETCH_BITS + bit.astype(np.int64))[small[owner]]]
    large = np.flatnonzero(~small)
    if len(large):
        value = least[large].astype(np.uint64) + (np.arange(BANDS * ROWS, dtype=np.uint64) << words.U(32))
        place.append((large[:, None] * SKETCH_BITS + (words.mix(value) >> words.U(52)).astype(np.int64)).ravel())
    parity = np.bincount(np.concatenate(place), minlength=n * SKETCH_BITS) & 1
    return keys, np.packbits(parity.astype(np.uint8).reshape(n, SKETCH_BITS), axis=1)


def may_link(n_a, n_b, sketch_a: np.ndarray, sketch_b: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """False where sizes or sketches rule a link out; sketches as rows of 64-bit words.

    A XOR count never exceeds the number of differing samples. For two small sets that is their
    exact difference, so no link is lost. For two large ones a link at the threshold is lost with
    a probability of 1e-9 (six standard deviations).
    """
    n_a, n_b = np.asarray(n_a, dtype=np.int64), np.asarray(n_b, dtype=np.int64)
    count = np.bitwise_count(sketch_a ^ sketch_b).sum(axis=-1, dtype=np.int64)
    near = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    small_a, small_b = n_a <= SMALL_SET, n_b <= SMALL_SET
    exact = (100 + percent) * count <= (100 - percent) * (n_a + n_b)
    k, miss = BANDS * ROWS, 1 - percent / 100
    sampled = count <= 2 * (k * miss + 6 * np.sqrt(k * miss * (1 - miss)))
    return near & np.where(small_a & small_b, exact, np.where(small_a | small_b, True, sampled))


def _parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``_STEP`` bytes of text and at most ``_STEP_ROWS`` rows each."""
    _, offsets = words.text_bytes(batch.column(column))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + _STEP, side="right")) - 1)
        hi = min(hi, lo + _STEP_ROWS)
        yield batch.slice(lo, hi - lo)
        lo = hi


_FEATURES = "id bigint, n bigint, set_a bigint, set_b bigint, bands binary, sketch binary"


def _features(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, 1):
                sets, at = shingle_sets(part.column(1), size)
                n = np.diff(at)
                a, b, full = _class_keys(sets, at)
                bands = np.empty(len(n), dtype=object)
                sketch = np.empty(len(n), dtype=object)
                if len(full):
                    keys, folded = signatures(sets, np.append(at[:-1][full], at[-1]))
                    for j, i in enumerate(full):
                        bands[i], sketch[i] = keys[j].tobytes(), folded[j].tobytes()
                yield pa.record_batch([
                    part.column(0), pa.array(n), pa.array(a), pa.array(b),
                    pa.array(bands, pa.binary()), pa.array(sketch, pa.binary())],
                    ["id", "n", "set_a", "set_b", "bands", "sketch"])
    return run


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 1000):
            part = batch.slice(lo, 1000)
            keys = np.frombuffer(b"".join(part.column(1).to_pylist()), dtype=np.uint64)
            ids = part.column(0).to_numpy()
            # the last bits of a key name its band
            keys = keys & ~_BAND | np.tile(np.arange(BANDS, dtype=np.uint64), len(ids))
            yield pa.record_batch([pa.array(keys.view(np.int64)), pa.array(np.repeat(ids, BANDS))], ["key", "rep"])


def _class_keys(sets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit keys of each set, and the rows with a set that is not empty."""
    full = np.flatnonzero(np.diff(at))
    a, b = np.zeros(len(at) - 1, dtype=np.uint64), np.zeros(len(at) - 1, dtype=np.uint64)
    if len(full):
        starts = at[:-1][full]
        a[full] = np.add.reduceat(words.mix(sets), starts)
        b[full] = np.add.reduceat(words.mix(sets ^ words.U(0x1F83D9ABFB41BD6B)), starts)
    return a.view(np.int64), b.view(np.int64), full


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, 0):
                sets, at = shingle_sets(part.column(0), size)
                a, b, _ = _class_keys(sets, at)
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [
                    None, pa.py_buffer(np.ascontiguousarray(8 * at, dtype=np.int64)), pa.py_buffer(sets)])
                yield pa.record_batch([pa.array(a), pa.array(b), raw.cast(pa.binary())], ["set_a", "set_b", "shingles"])
    return run


def _sketched(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                words_of = lambda c: np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint64).reshape(batch.num_rows, -1)
                ok = may_link(batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy(), words_of("s_a"), words_of("s_b"), percent)
                yield batch.select(["a", "b"]).filter(pa.array(ok))
    return run


def _blobs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary column as they lie in its buffer, and the offsets of its rows."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64, count=len(column) + 1, offset=8 * column.offset)
    return np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at


def _confirmed(percent: int):
    """Pairs whose full sets are similar enough; sets are read in place, one pair at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            (x, at_x), (y, at_y) = _blobs(batch.column("x")), _blobs(batch.column("y"))
            ok = np.zeros(batch.num_rows, dtype=bool)
            for i in range(batch.num_rows):
                a, b = x[at_x[i]:at_x[i + 1]].view(np.uint64), y[at_y[i]:at_y[i + 1]].view(np.uint64)
                if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
                    continue
                both = len(a) + len(b) - len(np.union1d(a, b))
                ok[i] = 100 * both >= percent * (len(a) + len(b) - both)
            yield batch.select(["a", "b"]).filter(pa.array(ok))
    return run


def _across(percent: int):
    """Pairs across components within the block pairs of a bucket; input sorted by block pair."""
    def pairs(group: pa.Table) -> pa.RecordBatch | None:
        ids, comp, n, block = (group[c].to_numpy() for c in ("rep", "component", "n", "block"))
        band, centre = group["key"][0].as_py() & int(_BAND), group["centre"][0].as_py()
        i, j = group["i"][0].as_py(), group["j"][0].as_py()
        keys = np.frombuffer(b"".join(group["bands"].to_pylist()), dtype=np.uint64).reshape(len(ids), BANDS)[:, :band]
        sketch = np.frombuffer(b"".join(group["sketch"].to_pylist()), dtype=np.uint64).reshape(len(ids), -1)
        left, right = [], []
        for m in range(len(ids) - 1) if i == j else np.flatnonzero(block == i):
            others = np.arange(m + 1, len(ids)) if i == j else np.flatnonzero(block == j)
            if ids[m] == centre:
                continue
            others = others[(comp[others] != comp[m]) & (ids[others] != centre)]
            others = others[~(keys[others] == keys[m]).any(axis=1)]  # met in an earlier band
            others = others[may_link(n[m], n[others], sketch[m], sketch[others], percent)] if len(others) else others
            left.append(np.full(len(others), ids[m]))
            right.append(ids[others])
        if not left:
            return None
        a, b = np.concatenate(left), np.concatenate(right)
        return pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("key", "i", "j")], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                key = tuple(keys[lo])
                if held and key != last:
                    found = pairs(pa.Table.from_batches(held))
                    held = []
                    if found is not None:
                        yield found
                held.append(batch.slice(lo, hi - lo))
                last = key
        if held and (found := pairs(pa.Table.from_batches(held))) is not None:
            yield found
    return run


def links(features: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Enough confirmed links ``(a, b)`` between classes to connect all that are linked.

    ``features`` has one row ``(node, id, n, set_a, set_b, bands, sketch)`` for each class, with the
    id of one of its documents; ``docs`` has the texts as ``(id, text)``.

    The centre of a bucket is its member of smallest node: near copies that meet in many bands meet
    the same centre in most of them, so a pair is sketched and confirmed once.
    """
    members = features.select("node", "bands").mapInArrow(words.tidy(_band_rows), "key bigint, rep bigint")
    buckets = common.stored(
        members.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("rep").alias("centre")).where("m > 1"), "buckets")
    members = common.stored(members.join(buckets, "key"), "members")
    active = common.stored(members.select("rep").distinct(), "active")
    known = common.stored(features.withColumnRenamed("node", "rep").join(active, "rep", "left_semi"), "known")
    texts = docs.join(known.select("id").distinct(), "id", "left_semi").select("text")
    keyed = texts.mapInArrow(words.tidy(_sets(size)), "set_a bigint, set_b bigint, shingles binary")
    sets = common.stored(keyed.join(known.select("rep", "set_a", "set_b"), ["set_a", "set_b"]).select("rep", "shingles"), "sets")
    if not sets.groupBy("rep").count().where("count > 1").isEmpty():  # rows that are equal, or equal but for order
        sets = common.stored(sets.dropDuplicates(["rep"]), "single")

    def confirm(pairs: DataFrame) -> DataFrame:
        full = pairs.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("x")), "a") \
            .join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("y")), "b")
        return full.select("a", "b", "x", "y").mapInArrow(_confirmed(percent), "a bigint, b bigint")

    stars = members.where("rep <> centre").select(F.least("rep", "centre").alias("a"),
                                                  F.greatest("rep", "centre").alias("b")).distinct()
    side = lambda x: known.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    stars = stars.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "s_a", "s_b")
    stars = common.stored(confirm(stars.mapInArrow(_sketched(percent), "a bigint, b bigint")), "stars")
    labels = common.components(stars).withColumnRenamed("node", "rep")

    members = common.stored(members.join(labels, "rep", "left")
                            .withColumn("component", F.coalesce("component", "rep")), "labelled")
    live = members.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")) \
        .where("lo <> hi").select("key")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    open_ = (members.join(live, "key", "left_semi").join(known, "rep")
             .withColumn("block", F.pmod(F.xxhash64("rep"), blocks.cast("long")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
             .withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")))
    keys = ["key", "i", "j"]
    crossed = (open_.select(*keys, "rep", "component", "n", "block", "centre", "bands", "sketch")
               .repartition(*keys).sortWithinPartitions(*keys)
               .mapInArrow(_across(percent), "a bigint, b bigint"))
    return stars.unionAll(common.stored(confirm(crossed), "crossed"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    percent: int = PERCENT) -> DataFrame:
    """``(id, n_shingles, component_id, kept)`` for every row.

    Documents whose sets of ``shingle``-word shingles have ``100 * both >= percent * either`` are
    linked; ``component_id`` is the smallest id reachable over links, ``kept`` marks that document.
    Null and empty texts have no shingles and are linked with nothing. Rows of equal id are one
    document: equal ones get equal results, different texts are each compared and then joined
    through the id (one without words stays alone). A row without an id is linked with nothing, has
    no component and is kept. An empty table gives no row. Further columns are not read.
    """
    common.ship(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    features = common.stored(docs.mapInArrow(words.tidy(_features(shingle)), _FEATURES)
                             .withColumn("row", F.monotonically_increasing_id()), "features")
    full = features.where("n > 0 AND id IS NOT NULL")
    # a class is named by one of its rows, for ids may stand for several texts
    classes = common.stored(full.groupBy("set_a", "set_b").agg(F.min("id").alias("least"), F.min("row").alias("node")), "classes")
    own = features.join(classes.select(F.col("node").alias("row")), "row", "left_semi").withColumnRenamed("row", "node")
    found = links(own, docs, shingle, percent)
    found = common.components(found.unionAll(_of_one_id(full, classes))).withColumnRenamed("component", "top")
    placed = classes.join(found, "node", "left").withColumn("top", F.coalesce("top", "node"))
    least = placed.groupBy("top").agg(F.min("least").alias("component_id"))
    of_class = placed.join(least, "top").select("set_a", "set_b", "component_id")
    rows = features.select("id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("set_a")).alias("set_a"), "set_b")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return rows.join(of_class, ["set_a", "set_b"], "left").select(
        F.col("id").alias(id_col), "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _of_one_id(full: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges between the classes of ids that stand for several texts."""
    several = full.groupBy("id").agg(F.min("set_a").alias("a1"), F.max("set_a").alias("a2"), F.min("set_b").alias("b1"),
                                     F.max("set_b").alias("b2")).where("a1 <> a2 OR b1 <> b2").select("id")
    nodes = full.join(several, "id").join(classes, ["set_a", "set_b"]).select("id", "node")
    first = nodes.groupBy("id").agg(F.min("node").alias("a"))
    return nodes.join(first, "id").where("a <> node").select("a", F.col("node").alias("b"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
