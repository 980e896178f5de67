"""Sharding by jump consistent hashing (DataFrame functions only).

A row's key and the number of shards alone decide its shard, with no ring table; with one shard more, a
row stays or moves to the new shard. The generator is the published 64-bit congruential one, carried as two
32-bit halves because SQL arithmetic does not wrap. The sequence of jumps does not depend on the
number of shards, so one pass gives the shard for both counts.

Slots are numbered within (shard, input partition) and shifted by the counts of earlier partitions, so
no task holds a whole shard.

Defined results: a null key counts as 0; rows that share a key share a shard and get slots of their own; a null
text has no bytes; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom.llm.common import materialise, table

SHARDS = 40
ROW_BYTES = 16
#: The published multiplier of jump consistent hashing, a fixed value; its increment is 1.
MULTIPLIER = 2862933555777941757
_LOW, _HIGH = MULTIPLIER & 0xFFFFFFFF, MULTIPLIER >> 32


def _mask(x: Column, bits: int = 32) -> Column:
    return x.bitwiseAND(F.lit((1 << bits) - 1))


def _advance(high: Column, low: Column) -> tuple[Column, Column]:
    """(high, low) * MULTIPLIER + 1 modulo 2**64; no product reaches 2**63."""
    near = _mask(low, 16) * F.lit(_LOW) + 1
    far = F.shiftright(low, 16) * F.lit(_LOW)
    sum_low = near + F.shiftleft(_mask(far, 16), 16)
    carried = F.shiftright(sum_low, 32) + F.shiftright(far, 16)
    crossed = _mask(_mask(high, 16) * F.lit(_LOW) + F.shiftleft(_mask(F.shiftright(high, 16) * F.lit(_LOW), 16), 16))
    return _mask(carried + crossed + _mask(low * F.lit(_HIGH))), _mask(sum_low)


def jump_shards(key: Column, shards: int) -> Column:
    """struct<shard, grown>: the shard among ``shards`` and among ``shards + 1``."""
    long = lambda x: F.lit(x).cast("long")
    first = F.struct(_mask(F.shiftrightunsigned(key, 32)).alias("h"), _mask(key).alias("l"), long(0).alias("shard"), long(0).alias("grown"), long(0).alias("j"))

    def step(s: Column, _: Column) -> Column:
        # s.j is the jump taken; below the count it is the shard so far. Each jump goes up, so shards + 1 steps suffice.
        high, low = _advance(s["h"], s["l"])
        ahead = F.floor((s["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(high, 1) + 1).cast("double")))
        moved = F.struct(
            high.alias("h"),
            low.alias("l"),
            F.when(s["j"] < shards, s["j"]).otherwise(s["shard"]).alias("shard"),
            s["j"].alias("grown"),
            F.least(ahead, long(shards + 1)).alias("j"),
        )
        return F.when(s["j"] > shards, s).otherwise(moved)

    done = F.aggregate(F.sequence(F.lit(0), F.lit(shards + 1)), first, step)
    return F.struct(done["shard"].cast("int").alias("shard"), done["grown"].cast("int").alias("grown"))


def shard_rows(df: DataFrame, key_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, keep: list[str] | None = None) -> DataFrame:
    """``row`` (the columns ``keep``, default all), size, text_crc32, law, shard, slot, grown_shard."""
    kept = [F.col(f"`{c}`") for c in (df.columns if keep is None else keep)]
    body = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")
    key = F.coalesce(F.col(f"`{key_col}`").cast("long"), F.lit(0))
    placed = df.select(
        F.struct(*kept).alias("row"), (F.octet_length(body) + ROW_BYTES).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), jump_shards(key, shards).alias("s"), F.monotonically_increasing_id().alias("at")
    )
    fixed = materialise(placed, "shards").select("row", "size", "text_crc32", "s.shard", "s.grown", "at", F.shiftright("at", 33).alias("part"))
    counts = fixed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    ranked = fixed.withColumn("own", F.row_number().over(Window.partitionBy("shard", "part").orderBy("at")) - 1)
    joined = ranked.join(offsets, ["shard", "part"])
    return joined.select("row", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("own") + F.col("shift")).cast("long").alias("slot"), F.col("grown").alias("grown_shard"))


def op6_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document among 40 shards, and its shard among 41."""
    found = shard_rows(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("row.doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
