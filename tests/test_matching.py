import random
import re

import pytest
from pyspark.sql import functions as F
from tests.test_query import ask, book

from lexiloom.operators import derive, matching, names, structure


def test_names_in_texts_equal_brute_force(spark):
    rng = random.Random(21)
    words = ["a", "b", "c", "d"]
    run = lambda n: [rng.choice(words) for _ in range(n)]
    named = sorted({"-".join(run(rng.choice([1, 1, 2, 3, 4, 5, 7, 9, 12]))) for _ in range(60)})
    texts = [(s, k, run(rng.randrange(0, 30))) for k in range(40) for s in ("x", "y")]
    df = spark.createDataFrame(texts, "source_id string, k int, words array<string>")
    table = spark.createDataFrame([("x", n) for n in named], "source_id string, name string")
    got = matching.stated_runs(df, table, ["k"]).join(table, ["source_id", "name"]).select("source_id", "k", "start", "end", "name")
    want = [(s, k, i, i + n.count("-") + 1, n) for s, k, ws in texts if s == "x" for n in named for i in range(len(ws)) if ws[i : i + n.count("-") + 1] == n.split("-")]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 200


def test_places_stay_near_the_hits(spark):
    """Many widths of names that begin alike do not make many runs at every place."""
    filler = " ".join(f"w{k % 500}" for k in range(20_000)).split()
    for k in range(50, 20_000, 2000):
        filler[k : k + 4] = ["brown", "sauce", "of", "herbs"]
    named = [("b", "brown-sauce-of-herbs"), *[("b", "-".join(["brown", "sauce", "with", *["much"] * k])) for k in range(20)], ("b", "sauce")]
    texts = spark.createDataFrame([("b", 0, filler)], "source_id string, k int, words array<string>")
    table = spark.createDataFrame(named, "source_id string, name string")
    runs = matching.stated_runs(texts, table, ["k"])
    assert runs.join(table, ["source_id", "name"]).count() == 20 and runs.count() <= 3 * 20


def test_an_index_answers_as_lookups_do_and_stays_where_it_is(spark, tmp_path):
    cat = book(spark, ("A", None, ["Fine Herb Sauce", "Green Herb"], 5), ("B", None, ["Herb Sauce"], 9), ("C", None, ["Herb Sauce"], 2), ("D", None, [], 7), ("E", None, ["Brown Base"], 11), bases=["base", "herb"])
    names.store_index(cat[0], "test_runs", str(tmp_path / "runs"), 4)
    index = spark.table("test_runs")
    for concept in ("herb-sauce", "green-herb", "d", "herb", "sauce", "base", "erb", "sauce-herb"):
        wanted = spark.createDataFrame([("b", concept)], "source_id string, wanted string")
        found = names.indexed_lookups(index, cat[1], wanted).orderBy("rank").collect()
        assert [cat[0].filter(F.col("seq") == r["seq"]).first()["title"] for r in found] == ask(spark, cat, concept)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        asked = spark.createDataFrame([("b", "herb")], "source_id string, wanted string")
        keyed = asked.select(names._index_key(F.col("source_id"), F.col("wanted")).alias("key")).join(index, "key")
        plan = keyed._jdf.queryExecution().executedPlan().toString()
        below = plan[plan.index("FileScan") - 400 : plan.index("FileScan")]
        assert plan.count("Exchange hashpartitioning") == 1 and "Exchange" not in below.split("Sort")[-1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("drop table test_runs")


@pytest.mark.parametrize("stretch", [1, 2, 1 << 16])
def test_ranks_do_not_depend_on_stretches(spark, stretch):
    rng = random.Random(4)
    rows = [(f"T{k}", None, [" ".join(rng.choices(["herb", "sauce", "fine", "brown"], k=rng.randrange(1, 5))) for _ in range(2)], k + 1) for k in range(30)]
    cat = book(spark, *rows, bases=["herb"])
    wanted = spark.createDataFrame([("b", w) for w in ("herb", "sauce", "fine", "fine-herb")], "source_id string, wanted string")
    whole = sorted(map(tuple, names.lookups(*cat, wanted).collect()))
    assert sorted(map(tuple, names.lookups(*cat, wanted, block_places=stretch).collect())) == whole
    assert sorted(map(tuple, names.lookups(*cat, wanted, best=True).collect())) == [r for r in whole if r[2] == 1]


@pytest.mark.parametrize("block", [2, 1 << 16])
def test_declarations_of_random_texts(spark, block):
    rng = random.Random(2)
    parts = ["The basic sauces:", "BASIC SAUCE:", "a", "b and c", ",", " and ", ".", "..", "", " ", "x, y", "and", "\x1c", "basic sauces: "]
    texts = {f"s{k}": ["".join(rng.choice(parts) for _ in range(rng.randrange(5))) for _ in range(rng.randrange(7))] for k in range(250)}
    lines = spark.createDataFrame([(s, i, i + 1, t) for s, own in texts.items() for i, t in enumerate(own)], "source_id string, idx int, file_line int, text string")
    got = {}
    for r in structure.declared_names(lines, block_lines=block).collect():
        got.setdefault(r["source_id"], []).append(r["name"])
    for s, own in texts.items():
        m = re.search(r"basic sauces?:\s*(.+?)\.", "\n".join(own), re.I | re.S)
        want = [x for x in (p.strip() for p in re.split(r",|\band\b", m[1])) if x] if m else []
        assert sorted(got.get(s, [])) == sorted(want), own


SPANS = "source_id string, seq int, entry int, seg int, start int, end int, width int, name string, key string, records string, base boolean"


def test_shadows_of_random_sentences(spark):
    rng, rows, free = random.Random(3), [], set()
    covers = lambda s, c: c[0] <= s[0] and s[1] <= c[1] and c[1] - c[0] > s[1] - s[0] and c[2] != s[2]
    for g in range(60):
        spans = {}
        for _ in range(rng.randrange(25)):
            a = rng.randrange(12)
            b = a + rng.randrange(1, 6)
            spans[a, b] = (a, b, f"k{rng.randrange(rng.choice([2, 3, 6]))}")
        for s in spans.values():
            rows.append(("b", g, g, 0, s[0], s[1], s[1] - s[0], f"n{s[0]}-{s[1]}", s[2], "r", False))
            if not any(covers(s, c) for c in spans.values()):
                free.add((g, s[0], s[1]))
    got = derive.uncovered(spark.createDataFrame(rows, SPANS))
    assert {(r["seq"], r["start"], r["end"]) for r in got.collect()} == free and got.columns == [c.split()[0] for c in SPANS.split(", ")]


def test_a_sentence_of_very_many_statements(spark):
    big = spark.range(100_000).selectExpr(
        "'b' as source_id", "1 as seq", "1 as entry", "0 as seg", "cast(id as int) as start", "cast(id + 1 + id % 7 as int) as end", "cast(1 + id % 7 as int) as width", "concat('n', id) as name", "concat('k', id % 3) as key", "'r' as records", "false as base"
    )
    spans = [(i, i + 1 + i % 7, i % 3) for i in range(100_000)]
    near = sum(not any(e >= z and k != own for a, e, k in spans[max(0, i - 8) : i]) for i, (_, z, own) in enumerate(spans))
    assert derive.uncovered(big).count() == near
