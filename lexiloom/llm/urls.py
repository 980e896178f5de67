"""URL filters by a cascade of Bloom filters (DataFrame functions only).

Rules on host and path come first. The other urls are judged by a table of listed hosts, held as a cascade:
level 1 encodes the listed keys of the corpus, level 2 the unlisted keys that pass level 1, level 3 the
listed keys that pass level 2, and so on until none is left over. Over the key universe the cascade
was built from - every host of the corpus - membership is exact: the first level that rejects a key tells on which side it is.
The list meets the corpus's distinct hosts once, to build the cascade; urls are judged in the scan's stage, without join or shuffle.

A level is an array of 64-bit words that a scalar subquery reads from the shared folder, so it stands in no plan's text and
its words never pass through Python. The levels of one cascade hold ``max_bits`` at most, about: a longer list is parted by a hash of the
hosts into as many cascades as it needs, and the urls, written by part, are judged part by part.

Defined results: a null url, or one without ``://``, has empty host and path, no rule, and the verdict allow unless the empty
host is listed; null and repeated listed hosts count as none and as one; hosts are compared as ``host_of`` gives them, in lower case;
repeated rows are judged alike; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.common import materialise, table

#: (verdict, host, path) of the rules; a rule fits its host and all subdomains where the path starts with its path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Labels of the hosts that the query lists, wherever the label stands.
LISTED_LABELS = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")


@dataclass(frozen=True)
class CascadeParams:
    bits_per_key: float = 8.0
    hashes: int = 4
    #: Bits of a cascade, about; beyond, the list is parted.
    max_bits: int = 1 << 25


DEFAULTS = CascadeParams()


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://``."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return lower_ascii(F.coalesce(host, F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """struct<rule, verdict> of the longest rule that fits, else null."""
    chosen = None
    for verdict, at, under in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == at) | F.endswith(host, F.lit("." + at))) & F.startswith(path, F.lit(under))
        value = F.struct(F.lit(at + under).alias("rule"), F.lit(verdict).alias("verdict"))
        chosen = F.when(fits, value) if chosen is None else chosen.when(fits, value)
    return chosen if chosen is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _bit(key: Column, level: int, k: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(level), F.lit(k)), F.lit(bits))


class Level:
    """One Bloom filter: its words, (word, mask) rows of a written table without gaps, as one array."""

    def __init__(self, number: int, bits: int, hashes: int, words: DataFrame):
        self.number, self.bits, self.hashes = number, bits, hashes
        self.array = words.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "mask"))), lambda w: w["mask"])).scalar()

    def passes(self, key: Column) -> Column:
        hit = None
        for k in range(self.hashes):
            at = _bit(key, self.number, k, self.bits)
            one = F.get(self.array, F.shiftright(at, 6).cast("int")).bitwiseAND(_mask_of(at)) != 0
            hit = one if hit is None else hit & one
        return hit


def _mask_of(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))


def _build(keys: DataFrame, n: int, number: int, p: CascadeParams) -> Level:
    """Filter over ``keys.key``; the words are aggregated and written by the executors."""
    size = math.ceil(n * p.bits_per_key / 64)
    at = F.explode(F.array(*[_bit(F.col("key"), number, k, 64 * size) for k in range(p.hashes)]))
    set_words = keys.select(at.alias("at")).select(F.shiftright("at", 6).alias("word"), _mask_of(F.col("at")).alias("mask"))
    every = set_words.unionByName(keys.sparkSession.range(size).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("mask")))
    return Level(number, 64 * size, p.hashes, materialise(every.groupBy("word").agg(F.bit_or("mask").alias("mask")), "words"))


def build_cascade(universe: DataFrame, p: CascadeParams = DEFAULTS) -> list[Level]:
    """Levels over (key, listed): distinct non-null keys of the whole corpus. Every level leaves a few keys in a hundred over, until none is."""
    levels: list[Level] = []
    side, other = universe.filter("listed"), universe.filter("not listed")
    n = side.count()
    while n:
        levels.append(_build(side, n, len(levels), p))
        left = materialise(other.filter(levels[-1].passes(F.col("key"))), "level")
        side, other = left, side
        n = left.count()
    return levels


def in_cascade(key: Column, levels: list[Level]) -> Column:
    """Exact membership over the universe: the first level that rejects is even for members."""
    answer = F.lit(len(levels) % 2 == 1)
    for level in reversed(levels):
        answer = F.when(~level.passes(key), F.lit(level.number % 2 == 1)).otherwise(answer)
    return answer


def filter_urls(df: DataFrame, listed: DataFrame, url_col: str = "url", keep: list[str] | None = None, rules: tuple = RULES, p: CascadeParams = DEFAULTS) -> DataFrame:
    """``row`` (the columns ``keep``, default all), host, path, rule, verdict, listed. ``listed``: a table of hosts, in its first column."""
    kept = [F.col(f"`{c}`") for c in (df.columns if keep is None else keep)]
    url = F.col(f"`{url_col}`").cast("string")
    rows = df.select(F.struct(*kept).alias("row"), host_of(url).alias("host"), path_of(url).alias("path"))
    names = listed.select(lower_ascii(F.col(f"`{listed.columns[0]}`").cast("string")).alias("key")).filter("key is not null").distinct().withColumn("on", F.lit(True))
    hosts = rows.select(F.col("host").alias("key")).distinct()
    universe = materialise(hosts.join(names, "key", "left").select("key", F.col("on").isNotNull().alias("listed")), "universe")
    # Further levels hold a tenth of the first one's keys or so.
    parts = max(1, math.ceil(universe.filter("listed").count() * p.bits_per_key * 1.25 / p.max_bits))

    def judged(part: DataFrame, levels: list[Level]) -> DataFrame:
        ruled = part.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).withColumn("listed", in_cascade(F.col("host"), levels))
        method = F.when(F.col("listed"), "block").otherwise("allow")
        return ruled.select("row", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", method).alias("verdict"), "listed")

    if parts == 1:
        return judged(rows, build_cascade(universe, p))
    spot = lambda c: F.pmod(F.xxhash64(c, F.lit(-1)), F.lit(parts)).cast("int")
    written = materialise(rows.withColumn("part", spot("host")), "urls", "part")
    keys = materialise(universe.withColumn("part", spot("key")), "universe", "part")
    return reduce(DataFrame.unionByName, [judged(written.filter(F.col("part") == k), build_cascade(keys.filter(F.col("part") == k), p)) for k in range(parts)])


def listed_hosts(df: DataFrame, url_col: str = "url", labels: tuple = LISTED_LABELS) -> DataFrame:
    """The query's list: hosts of the table that hold a label."""
    hosts = df.select(host_of(F.col(f"`{url_col}`").cast("string")).alias("host")).distinct()
    return hosts.filter(F.arrays_overlap(F.split("host", r"\."), F.array(*[F.lit(x) for x in labels])))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the url of every page, by the rules and by the hosts that hold a listed label."""
    pages = table(spark, sf_dir, "pages")
    return filter_urls(pages, listed_hosts(pages), keep=["page_id"]).select("row.page_id", "host", "path", "rule", "verdict")


def oracle(rules: tuple = RULES, labels: tuple = LISTED_LABELS) -> str:
    fits = lambda r: f"(host = '{r[1]}' OR ends_with(host, '.{r[1]}')) AND starts_with(path, '{r[2]}')"
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    rule = " ".join(f"WHEN {fits(r)} THEN '{r[1] + r[2]}'" for r in order)
    verdict = " ".join(f"WHEN {fits(r)} THEN '{r[0]}'" for r in order)
    listed = ", ".join(f"'{x}'" for x in labels)
    return rf"""
WITH parts AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)
SELECT page_id, host, path, CASE {rule} END AS rule,
  CASE {verdict} WHEN list_has_any(string_split(host, '.'), [{listed}]) THEN 'block' ELSE 'allow' END AS verdict FROM parts
"""
