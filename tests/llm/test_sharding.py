import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lexiloom.llm import sharding


def slow_jump(key, shards):
    key &= 2**64 - 1
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_jumps_equal_the_published_loop(spark):
    keys = [0, 1, 2, -1, 2**63 - 1, -(2**63), 123456789, *range(1000, 1400)]
    frame = spark.createDataFrame([(k,) for k in keys], "k long")
    for shards in (1, 2, 7, 40):
        got = {r["k"]: (r["s"]["shard"], r["s"]["grown"]) for r in frame.select("k", sharding.jump_shards(F.col("k"), shards).alias("s")).collect()}
        assert got == {k: (slow_jump(k, shards), slow_jump(k, shards + 1)) for k in keys}


def check(rows, want):
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "key" and r["grown_shard"] in (r["shard"], 40)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) for r in rows) == want


def expected(i, text):
    data = (text or "").encode()
    return i, len(data) + 16, zlib.crc32(data), slow_jump(i or 0, 40), slow_jump(i or 0, 41)


def test_query_on_real_documents(spark):
    d = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{d}/documents.parquet").collect()
    check(sharding.op6_jump_sharding(spark, d).collect(), Counter(expected(r["doc_id"], r["text"]) for r in rows))


def test_edges(spark):
    rows = [(None, None), (None, ""), (5, "é"), (5, "é"), (5, None), (-3, "x" * 100_000)] + [(9, "same")] * 50
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).selectExpr("*", "1 as shard", "'s' as size", "2 as row")
    got = sharding.shard_rows(frame).select("row.doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard").collect()
    check(got, Counter(expected(*r) for r in rows))
    assert sharding.shard_rows(frame.limit(0)).collect() == []
