"""URL verdicts from allow and block rules and a list of blocked URLs behind a blocked Bloom filter.

DataFrame functions only: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"
BLOCK_WORDS = ("cheap-pills", "spam-farm", "casino", "payday")
BITS_PER_URL, PROBES, WORDS_PER_BLOCK = 16, 4, 8
BROADCAST_BYTES = 32 << 20
SALTS = 16


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.``, path without closing slashes, sorted query without tracking fields.

    Null for a url without a host: such a url is never on a list.
    """
    host = F.regexp_replace(host_of(url), r"^www\.", "")
    path = F.regexp_replace(path_of(url), "/+$", "")
    fields = F.split(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1), F.lit("")), "&")
    kept = F.array_join(F.array_sort(F.filter(fields, lambda f: (f != "") & ~f.rlike(TRACKING))), "&")
    return F.when(host != "", F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit(""))))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Longest fitting rule as text, and its verdict; both null where none fits."""
    text = verdict = F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        text = F.when(fits, F.lit(rule_host + rule_path)).otherwise(text)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return text, verdict


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _probe_bits(key: Column) -> list[Column]:
    """Bit positions of a key within its block of 512 bits."""
    h = F.xxhash64(key, F.lit(1))
    return [F.shiftrightunsigned(h, 9 * i).bitwiseAND(F.lit(64 * WORDS_PER_BLOCK - 1)) for i in range(PROBES)]


def bloom_filter(listed: DataFrame, blocks: int) -> DataFrame:
    """``(block, w0..w7)`` from a frame with column ``key``: one row for each block that has a key."""
    bits = F.explode(F.array(*_probe_bits(F.col("key")))).alias("bit")
    words = [F.bit_or(F.when(F.shiftright("bit", 6) == i, F.expr("shiftleft(1L, cast(bit % 64 as int))"))
                      .otherwise(F.lit(0))).alias(f"w{i}") for i in range(WORDS_PER_BLOCK)]
    return listed.select(_block(F.col("key"), blocks).alias("block"), bits).groupBy("block").agg(*words)


def _may_hold(key: Column) -> Column:
    held = F.lit(True)
    words = F.array(*[F.col(f"w{i}") for i in range(WORDS_PER_BLOCK)])
    for bit in _probe_bits(key):
        word = F.get(words, F.shiftright(bit, 6).cast("int"))
        held = held & (F.getbit(word, (bit % 64).cast("int")) == 1)
    return held


def on_list(urls: DataFrame, listed: DataFrame, url_col: str = "url") -> DataFrame:
    """``urls`` with boolean ``listed``: whether the canonical url is that of a row of ``listed``.

    ``listed`` has a column ``url``. The blocked Bloom filter of its canonical urls (512-bit blocks)
    passes possible hits; an exact join on the url then removes false positives. The filter is
    broadcast where its size, known from the number of urls, is within ``BROADCAST_BYTES``;
    otherwise it is joined by block. The url side of both joins is salted, so one url with a third
    of all rows is spread. Null urls are never listed; repeated list rows count once.
    """
    names = urls.columns
    keys = listed.select(canonical(F.col("url")).alias("key")).where("key IS NOT NULL").distinct()
    count = keys.count()
    blocks = max(1, -(-count * BITS_PER_URL // (64 * WORDS_PER_BLOCK)))
    bloom = bloom_filter(keys, blocks)
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in names]), F.lit(SALTS))
    probes = urls.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), canonical(F.col(url_col)).alias("_key"),
                         salt.alias("_salt")).withColumn("_block", _block(F.col("_key"), blocks))
    if blocks * (WORDS_PER_BLOCK + 1) * 8 <= BROADCAST_BYTES:
        probed = probes.join(F.broadcast(bloom), F.col("_block") == F.col("block"), "left")
    else:
        bloom = bloom.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        probed = probes.join(bloom, (F.col("_block") == F.col("block")) & (F.col("_salt") == F.col("salt")), "left")
    probed = probed.select("_row", "_salt", F.when(F.col("block").isNotNull() & _may_hold(F.col("_key")),
                                                   F.col("_key")).alias("_hit"))
    exact = keys.select("key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    # rows the filter stops carry no hit; their salt spreads them over the join's partitions
    found = probed.where("_hit IS NOT NULL").join(
        exact, (F.col("_hit") == F.col("key")) & (F.col("_salt") == F.col("salt")), "left")
    passed = found.select("_row.*", F.col("key").isNotNull().alias("listed"))
    stopped = probed.where("_hit IS NULL").select("_row.*", F.lit(False).alias("listed"))
    return passed.unionAll(stopped)


def verdicts(pages: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url",
             rules=RULES) -> DataFrame:
    """``(id, host, path, rule, verdict)`` of every row of ``pages``.

    The longest fitting rule decides. Where none fits, a url on the list is blocked and any other
    allowed. Null urls and urls without ``://`` have an empty host and path and are allowed.
    Repeated rows are judged alike, an empty table gives no row, further columns are not read.
    """
    urls = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    judged = on_list(urls, listed).select("id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
                                          "listed")
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    other = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"),
                         F.coalesce(verdict, other).alias("verdict"))


def blocklist(pages: DataFrame, words=BLOCK_WORDS) -> DataFrame:
    """The urls of the table whose host holds a listed word: stands in for a delivered list."""
    named = "|".join(w.replace(".", r"\.") for w in words)
    return pages.select("url").where(host_of(F.col("url")).rlike(named)).distinct()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return verdicts(pages, blocklist(pages))


ORACLE_SQL = r"""
WITH cut AS (
    SELECT page_id, url,
        translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
        coalesce(regexp_extract(url, '(?s)^.*?://[^?#]*\?([^#]*)', 1), '') AS fields
    FROM pages),
keyed AS (
    SELECT *, CASE WHEN regexp_replace(host, '^www\.', '') <> '' THEN
        regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') ||
        CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS key
    FROM (SELECT *, array_to_string(list_sort(list_filter(string_split(fields, '&'),
            lambda f: f <> '' AND NOT regexp_matches(f, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))), '&') AS q FROM cut)),
listed AS (SELECT DISTINCT key FROM keyed WHERE regexp_matches(host, 'cheap-pills|spam-farm|casino|payday')),
rules(verdict, rule_host, rule_path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'),
    ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
best AS (
    SELECT k.page_id, k.host, k.path, k.key, r.rule_host || r.rule_path AS rule, r.verdict
    FROM keyed k LEFT JOIN rules r
      ON (k.host = r.rule_host OR ends_with(k.host, '.' || r.rule_host)) AND starts_with(k.path, r.rule_path)
    QUALIFY row_number() OVER (PARTITION BY k.page_id ORDER BY length(r.rule_host || r.rule_path) DESC NULLS LAST) = 1)
SELECT page_id, host, path, rule,
    coalesce(verdict, CASE WHEN key IN (SELECT key FROM listed WHERE key IS NOT NULL) THEN 'block' ELSE 'allow' END) AS verdict
FROM best
"""
