"""URL filter over a list of (host, path) rules: a blocked Bloom filter before an exact join. DataFrame operations only.

A rule fits its host and all subdomains of it when the url's path starts with the rule's path; the longest
fitting rule (host and path together) decides. Candidate keys of a url are its host's suffixes at label
boundaries, of at most as many labels as a listed host has, times its path's prefixes of the lengths that occur in the list. Each key is
tested in one 512-bit block of the Bloom filter, inside the row. Rows without a possible hit keep a null rule and the default verdict and
are never joined; only possible hits are exploded and joined with the list, which removes false positives. Rows of very frequent keys stay where
they are, and only rows with several possible hits are grouped again to find the longest rule.

The Bloom filter is an array of ``8 * blocks`` longs made by one aggregation, of at most ``MAX_BLOCKS`` blocks (1 MB),
and becomes a constant of the plan; a longer list only raises its false positives, which the join removes.

Defined results: a null url, or one without '://', has empty host and path, which no rule with a host fits.
Repeated rows each give a row; extra columns are ignored; an empty list gives every row the default verdict.
Repeated rules count once; of rules that differ only in the verdict, block wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lyrebird.llm.common import join_dealt, materialize

#: 64-byte blocks of the Bloom filter, at most.
MAX_BLOCKS = 1 << 14
#: Listed keys that a block is meant for: 16 bits a key.
KEYS_A_BLOCK = 32
WORDS = 8

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first '://' to '/', '?', '#' or the end, A-Z lower-cased. Path: from there to '?', '#' or the end."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return host, path


def _bits(key: Column) -> tuple[Column, Column]:
    """The key's block hash, and the hash whose 6-bit parts name a bit in each of the block's words."""
    return F.xxhash64(key), F.xxhash64(key, F.lit("bits"))


def bloom_words(rules: DataFrame, blocks: int) -> DataFrame:
    """One row: ``bloom``, the filter's longs in order."""
    block, bits = _bits(F.col("key"))
    word = F.explode(F.sequence(F.lit(0), F.lit(WORDS - 1)))
    set_bits = (
        rules.select(F.pmod(block, F.lit(blocks)).alias("block"), bits.alias("h"), word.alias("w"))
        .select((F.col("block") * WORDS + F.col("w")).alias("at"), F.expr("shiftleft(1L, cast(shiftright(h, w * 7) & 63 as int))").alias("bit"))
        .groupBy("at")
        .agg(F.bit_or("bit").alias("bits"))
    )
    every = rules.sparkSession.range(blocks * WORDS).select(F.col("id").alias("at"))
    placed = every.join(set_bits, "at", "left").agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))).alias("a"))
    return placed.select(F.col("a.bits").alias("bloom"))


def possible(key: Column, bloom: Column, blocks: int) -> Column:
    """Whether a key may be in the filter; looks at one block of it."""
    block, bits = _bits(key)
    first = F.pmod(block, F.lit(blocks)) * WORDS
    ok = None
    for w in range(WORDS):
        bit = F.shiftright(bits, w * 7).bitwiseAND(F.lit(63).cast("long")).cast("int")
        one = F.call_function("getbit", F.get(bloom, first + w), bit) == 1
        ok = one if ok is None else ok & one
    return ok


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (host and path of the longest fitting one) and verdict.

    ``rules`` has host, path and verdict ('allow' or 'block').
    """
    rules = (
        rules.select(F.translate(F.col("host"), _UPPER, _LOWER).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), F.col("verdict").alias("r_verdict"))
        .filter("r_host is not null and r_verdict is not null")
        .groupBy("r_host", "r_path")
        .agg(F.max("r_verdict").alias("r_verdict"))
        .withColumn("key", F.concat_ws("\n", "r_host", "r_path"))
    )
    n = rules.count()
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id"), host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("uid"))
    if not n:
        return rows.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    blocks = 1
    while blocks * KEYS_A_BLOCK < n and blocks < MAX_BLOCKS:
        blocks *= 2
    lengths = rules.agg(F.sort_array(F.collect_set(F.length("r_path"))).alias("lengths"))
    constant = lambda df, kind: F.from_json(F.lit(df.select(F.to_json(df.columns[0])).first()[0]), kind)
    bloom, lens = constant(bloom_words(rules, blocks), "array<long>"), constant(lengths, "array<int>")
    labels, deepest = F.split("host", r"\."), rules.agg(F.max(F.size(F.split("r_host", r"\.")))).first()[0]
    first = F.greatest(F.lit(1), F.size("labels") - F.lit(deepest - 1))
    hosts = F.transform(F.sequence(first, F.size("labels")), lambda i: F.array_join(F.slice(F.col("labels"), i, F.lit(deepest)), "."))
    paths = F.transform(F.filter(lens, lambda k: k <= F.length("path")), lambda k: F.substr(F.col("path"), F.lit(1), k))
    keys = F.flatten(F.transform("hosts", lambda h: F.transform("paths", lambda p: F.concat_ws("\n", h, p))))
    rows = rows.withColumn("labels", labels).withColumn("hosts", hosts).withColumn("paths", paths)
    rows = materialize(rows.select("page_id", "host", "path", "uid", F.filter(keys, lambda k: possible(k, bloom, blocks)).alias("keys")), "urls")
    none = rows.filter(F.size("keys") == 0).select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    tested = rows.select("page_id", "host", "path", "uid", (F.size("keys") > 1).alias("several"), F.explode("keys").alias("key"))
    judged = join_dealt(tested, rules.select("key", F.concat("r_host", "r_path").alias("rule"), "r_verdict"), "key", "left")
    one = judged.filter(~F.col("several")).select("page_id", "host", "path", "rule", F.coalesce("r_verdict", F.lit(default)).alias("verdict"))
    best = F.max(F.when(F.col("rule").isNotNull(), F.struct(F.length("rule").alias("n"), F.col("rule"), F.col("r_verdict")))).alias("best")
    more = judged.filter("several").groupBy("uid").agg(F.first("page_id").alias("page_id"), F.first("host").alias("host"), F.first("path").alias("path"), best)
    more = more.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.r_verdict", F.lit(default)).alias("verdict"))
    return none.unionByName(one).unionByName(more)
