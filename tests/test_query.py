import random

from pyspark.sql import functions as F

from lexiloom.operators import lineage, query
from lexiloom.operators.drafts import CATALOGUE
from tests.books import fold, random_book, runs  # noqa: F401


def book(spark, *rows, bases=()):
    """rows: (title, parent, surfaces, entry)."""
    made = []
    for seq, (title, parent, surfaces, entry) in enumerate(rows):
        terms = [(s, "en", fold(s)) for s in surfaces]
        made.append(("b", seq, title, terms, terms[0][2] if terms else fold(title), "", ("b", entry, entry), parent))
    return spark.createDataFrame(made, CATALOGUE), spark.createDataFrame([("b", x) for x in bases], "source_id string, concept string")


def ask(spark, cat, concept):
    wanted = spark.createDataFrame([("b", concept)], "source_id string, wanted string")
    return [r["title"] for r in query.matches(*cat, wanted).orderBy("rank").collect()]


def test_lookups(spark):
    cat = book(spark, ("A", None, ["Fine Herb Sauce", "Green Herb"], 5), ("B", None, ["Herb Sauce"], 9), ("C", None, ["Herb Sauce"], 2), ("D", None, [], 7), ("E", None, ["Brown Base"], 11), bases=["base", "herb"])
    assert ask(spark, cat, "herb-sauce") == ["B"]
    assert ask(spark, cat, "green-herb") == ["A"]
    assert ask(spark, cat, "d") == ["D"]
    assert ask(spark, cat, "herb") == ["A", "A", "B"]  # a declared base: source order, once for each name
    assert ask(spark, cat, "sauce") == ["B", "A"]  # else the shorter name first
    assert ask(spark, cat, "base") == ["E"]
    assert ask(spark, cat, "erb") == [] and ask(spark, cat, "sauce-herb") == []


def test_trees(spark):
    cat = book(
        spark, ("Root", None, ["Root"], 1), ("A", "root", ["A"], 2), ("B", "a", ["B", "B two"], 3), ("C", "b-two", ["C"], 4), ("D", "root", ["D"], 5), ("X", "y", ["X"], 6), ("Y", "x", ["Y"], 7), bases=["absent"]
    )
    roots = spark.createDataFrame([("b", "root"), ("b", "x"), ("b", "absent")], "source_id string, root string")
    got = [(r["root"], r["depth"], r["title"], r["last"]) for r in lineage.derivation_trees(*cat, roots).orderBy("root", "path").collect()]
    assert got == [("root", 1, "A", False), ("root", 2, "B", True), ("root", 3, "C", True), ("root", 1, "D", True), ("x", 1, "Y", True), ("x", 2, "X", True)]


def test_trees_deeper_than_a_hundred(spark):
    rows = [("N0", None, ["n0"], 1)] + [(f"N{k}", f"n{k - 1}", [f"n{k}"], k + 1) for k in range(1, 130)]
    roots = spark.createDataFrame([("b", "n0")], "source_id string, root string")
    assert lineage.derivation_trees(*book(spark, *rows), roots).agg(F.max("depth")).first()[0] == 129


def test_census(spark):
    cat = book(spark, ("A", None, ["A"], 1), ("B", "a", ["B"], 2), bases=["z", "a"])
    assert [tuple(r) for r in query.census(*cat).collect()] == [("b", "a, z", 2, 1, 1)]


def walked(hops):
    """Every chain step by step, up to the first repeat."""
    out = []
    for seq in hops:
        met, at = [seq], seq
        while at in hops:
            at = hops[at]
            out.append((seq, len(met), at))
            if at in met:
                break
            met.append(at)
    return sorted(out)


def test_chains_of_random_maps(spark):
    rng = random.Random(11)
    maps = {f"m{k}": {s: rng.randrange(n) for s in range(n) if rng.random() < rng.choice([0.5, 0.95, 1])} for k, n in enumerate([1, 2, 3, 5, 8, 12, 20, 30, 30, 30])}
    maps |= {"line": {s: s + 1 for s in range(40)}, "ring": {s: (s + 1) % 17 for s in range(17)}, "self": {0: 0, 1: 0, 2: 1}}
    hops = spark.createDataFrame([(m, s, t) for m, own in maps.items() for s, t in own.items()], "source_id string, seq int, target int")
    got = sorted(map(tuple, lineage.chains(hops).collect()))
    assert got == sorted((m, *r) for m, own in maps.items() for r in walked(own))


def test_no_chains(spark):
    assert lineage.chains(spark.createDataFrame([], "source_id string, seq int, target int")).collect() == []


def jobs_of(spark, run):
    group = f"jobs-{random.random()}"
    spark.sparkContext.setJobGroup(group, "")
    found = run()
    return found, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_jobs_grow_with_the_logarithm_of_the_depth(spark):
    jobs = {}
    for n in (60, 4000):
        hops = spark.range(n).selectExpr("'b' as source_id", "cast(id as int) as seq", "cast(id + 1 as int) as target")
        found, jobs[n] = jobs_of(spark, lambda hops=hops: lineage.chains(hops).selectExpr("count(*)", "max(depth)", "sum(cast(depth as long))").first())
        assert tuple(found) == (n * (n + 1) // 2, n, n * (n + 1) * (n + 2) // 6)
    assert jobs[4000] <= jobs[60] + 6 * 8  # six doublings more


def naive_trees(edges, root, concept):
    out = []

    def walk(wanted, path, seen):
        for seq in sorted(s for w, s in edges if w == wanted):
            own = concept[seq]
            last = seq == max(s for w, s in edges if w == wanted)
            out.append(("/".join(map(str, [*path, seq])), len(path) + 1, own, last))
            if own not in seen:
                walk(own, [*path, seq], seen | {own})

    walk(root, [], {root})
    return sorted(out)


def test_trees_of_random_books(spark):
    rng = random.Random(12)
    for n in (6, 12, 18):
        names = [f"n{rng.randrange(n)}" for _ in range(n)]  # some preparations share a name
        rows = [(f"T{k}", rng.choice([None, *[f"n{rng.randrange(n)}"] * 3]), [names[k]], k + 1) for k in range(n)]
        cat = book(spark, *rows, bases=["n0", "absent"])
        wanted = sorted({*names, "absent"})
        asked = spark.createDataFrame([("b", w) for w in wanted], "source_id string, wanted string")
        edges = [(r["wanted"], r["seq"]) for r in query.children(*cat, asked).collect()]
        roots = asked.withColumnRenamed("wanted", "root")
        got = {}
        for r in lineage.derivation_trees(*cat, roots).collect():
            got.setdefault(r["root"], []).append(("/".join(map(str, r["path"])), r["depth"], r["concept"], r["last"]))
        for w in wanted:
            assert sorted(got.get(w, [])) == naive_trees(edges, w, dict(enumerate(names)))


def test_walks_start_only_where_a_root_leads(spark, monkeypatch):
    """Six names that are all derived from each other have many walks, and the asked root leads to none of them."""
    names = [f"k{k}" for k in range(6)]
    rows = [("Root", None, ["root"], 1), ("A", "root", ["a"], 2), ("B", "a", ["b"], 3), *[(f"{x} of {y}", y, [x], 0) for x in names for y in names if x != y]]
    rows = [(title, parent, surfaces, k + 1) for k, (title, parent, surfaces, _) in enumerate(rows)]
    inner, written = lineage.shared_table, []

    def counted(df, name, *more):
        table = inner(df, name, *more)
        written.append((name, table.count()))
        return table

    monkeypatch.setattr(lineage, "shared_table", counted)
    asked = lambda root: spark.createDataFrame([("b", root)], "source_id string, root string")
    small = [(r["path"], r["title"], r["last"]) for r in lineage.derivation_trees(*book(spark, *rows), asked("root")).orderBy("path").collect()]
    assert small == [([1], "A", True), ([1, 2], "B", True)]
    assert max(n for name, n in written if name == "walks") <= 1
    # Asked for one of the six, every branch comes: 5 * 4 * ... open ones, each with the five children of its end.
    edges = [(y, seq) for seq, (_, y, _, _) in enumerate(rows) if y]
    whole = sorted(("/".join(map(str, r["path"])), r["depth"], r["concept"], r["last"]) for r in lineage.derivation_trees(*book(spark, *rows), asked("k0")).collect())
    assert whole == naive_trees(edges, "k0", {seq: surfaces[0] for seq, (_, _, surfaces, _) in enumerate(rows)})
    assert len(whole) == 5 * (1 + 5 + 5 * 4 + 5 * 4 * 3 + 5 * 4 * 3 * 2 + 5 * 4 * 3 * 2)


def test_reached_nodes_of_random_maps(spark):
    rng = random.Random(13)
    maps = {f"m{k}": {(rng.randrange(n), rng.randrange(n)) for _ in range(m)} for k, (n, m) in enumerate([(2, 1), (9, 7), (30, 35), (30, 60), (30, 400)])}
    maps |= {"line": {(k, k + 1) for k in range(20)}, "late": {(k, k + 1) for k in range(9)} | {(x, y) for x in range(9, 25) for y in range(9, 25)} | {(k, k + 1) for k in range(24, 33)}}
    starts = {(m, s) for m, own in maps.items() for s in ([0, 500] if m in ("line", "late") else [rng.randrange(5)])}
    expected = set(starts)
    while more := {(m, y) for m, x in expected for a, y in maps[m] if a == x} - expected:
        expected |= more
    hops = spark.createDataFrame([(m, *h) for m, own in maps.items() for h in own], "source_id string, at int, to int")
    got = [tuple(r) for r in lineage.reached(spark.createDataFrame(sorted(starts), "source_id string, node int"), hops).collect()]
    assert len(got) == len(expected) and set(got) == expected


def test_rounds_of_reached_nodes_grow_with_the_logarithm_of_a_chain(spark):
    jobs = {}
    for n in (30, 1000):
        hops = spark.range(n).selectExpr("'b' as source_id", "cast(id as int) as at", "cast(id + 1 as int) as to")
        start = spark.createDataFrame([("b", 0)], "source_id string, node int")
        found, jobs[n] = jobs_of(spark, lambda hops=hops, start=start: lineage.reached(start, hops).count())
        assert found == n + 1
    assert jobs[1000] <= 3 * jobs[30]  # twice the rounds


def test_nothing_is_reached_from_no_start(spark):
    hops = spark.createDataFrame([("b", 1, 2)], "source_id string, at int, to int")
    assert lineage.reached(spark.createDataFrame([], "source_id string, node int"), hops).collect() == []
