import os
import random
from functools import reduce

import pytest
from pyspark.sql import functions as F

from lexiloom.checkpoints import shared_folder
from lexiloom.errors import NothingExtracted, UnfoldableTerm
from lexiloom.operators import derive, lineage, query, structure
from lexiloom.plans import extraction, registry
from lexiloom.sources.numbered_text import LINES, lines_from_memory
from tests.books import evaluate, random_book


def catalogue(spark, lines, offset=0):
    return extraction.extract_one(lines_from_memory(spark, lines, "book", offset))


def parents(spark, *entries, bases="Espagnole, Velouté, and Tomato"):
    lines = [f"The basic sauces: {bases}."]
    for n, (title, body) in enumerate(entries, 1):
        lines += [f"{n}—{title}", *body.split("\n"), ""]
    rows = catalogue(spark, lines).catalogue.collect()
    return {r["ref"]["entry"]: r["parent"] for r in rows}


def test_random_books_equal_direct_evaluation(spark):
    books = {f"book{k}": random_book(k) for k in range(12)}
    lines = spark.createDataFrame([(name, i, i + 11, x) for name, text in books.items() for i, x in enumerate(text)], LINES)
    out = extraction.extract(lines)
    got = {name: [] for name in books}
    for r in out.catalogue.orderBy("source_id", "seq").collect():
        assert r["ref"]["line"] == 11 + books[r["source_id"]].index(books[r["source_id"]][r["ref"]["line"] - 11], r["ref"]["line"] - 11)
        got[r["source_id"]].append((r["ref"]["entry"], r["ref"]["line"] - 11, r["title"], r["concept"], r["parent"]))
    bases = {name: [] for name in books}
    for r in out.bases.orderBy("concept").collect():
        bases[r["source_id"]].append(r["concept"])
    for name, text in books.items():
        assert (got[name], bases[name]) == evaluate(text), name
    assert sum(p is not None for rows in got.values() for *_, p in rows) > 20
    assert query.misquoted(out.catalogue, lines).count() == 0
    chains = lineage.ancestors(out.catalogue, out.bases)
    assert chains.groupBy("source_id", "seq").agg(F.max("depth").alias("d")).filter("d > 60").count() == 0


def test_opening_paragraphs_state_parents(spark):
    got = parents(
        spark,
        ("HERB SAUCE", "Add one pint of Espagnole."),
        ("CAPER SAUCE", "Boil.\n\nAdd Espagnole."),
        ("SHRIMP SAUCE", "Use Velouté or Tomato."),
        ("LEEK SAUCE", "Crush tomatoes."),
        ("WINE SAUCE", "Add herb. Sauce it."),
        ("MARROW SAUCE", "Finish with Herb Sauce."),
        ("HORSE-RADISH SAUCE OR RADISH", "Grate the radish."),
        ("LENTEN ESPAGNOLE SAUCE", "As Espagnole, without meat."),
        ("FISH SAUCE", "Take Lenten Espagnole Sauce."),
    )
    assert got == {1: "espagnole", 2: None, 3: None, 4: None, 5: None, 6: "herb-sauce", 7: None, 8: None, 9: "espagnole"}
    # Espagnole is declared, and its first answer is the Lenten one: both names reach one preparation.


def test_mothers_bind_to_the_first_answer_and_cycles_are_cleared(spark):
    got = parents(spark, ("ONION SAUCE", "Add caper sauce."), ("CAPER SAUCE", "Add onion sauce."), ("MARROW SAUCE", "Add caper sauce."), ("BROWN ESPAGNOLE SAUCE", "Bones."), ("RED SAUCE", "Add brown Espagnole sauce."))
    assert got == {1: None, 2: None, 3: "caper-sauce", 4: None, 5: "espagnole"}


def test_long_cycles_and_chains(spark):
    edges = [("s", k, k % 150 + 1) for k in range(1, 151)] + [("s", 200 + k, 201 + k) for k in range(99)] + [("s", 299, 1), ("t", 1, 2), ("t", 2, 3)]
    got = derive.on_cycles(spark.createDataFrame(edges, "source_id string, entry int, target int")).collect()
    assert sorted((r["source_id"], r["entry"]) for r in got) == [("s", k) for k in range(1, 151)]
    assert derive.on_cycles(spark.createDataFrame([], "source_id string, entry int, target int")).collect() == []


def test_chapters(spark):
    lines = ["x", "CHAPTER I", "", "SOUPS", " CHAPTER IV", "=  =", "SAUCES", "CHAPTER 5", "Chapter V", "CHAPTER X", "", "", "", "", "", "SAUCES"]
    got = structure.chapters(lines_from_memory(spark, lines)).orderBy("start_idx").collect()
    assert [(r["start_idx"], r["end_idx"], r["title"], r["kept"]) for r in got] == [(1, 4, "SOUPS", False), (4, 9, "  ", False), (9, 16, "", False)]


def test_blocks_make_no_difference(spark):
    lines = lines_from_memory(spark, random_book(3, 120))
    for read in (structure.entries, structure.chapters, structure.marked_lines):
        whole = sorted(map(str, read(lines).collect()))
        assert sorted(map(str, read(lines, block_lines=7).collect())) == whole and whole


def test_declarations_over_several_lines(spark):
    texts = {
        "a": (["Basic Sauce: Ax and", "B, Candied", "c. D."], ["ax", "b", "candied-c"]),
        "b": (["none here: basic", "sauces: A."], []),
        "c": (["1. The BASIC SAUCES: Espagnole, Velouté,", "and", "Béchamel. The basic sauces: X."], ["bechamel", "espagnole", "veloute"]),
        "d": (["basic sauces: A, B"], []),
        "e": (["a. basic sauces: Ab", "c", "d. e. f."], ["ab-c-d"]),
        "f": (["basic sauces: .x. y."], ["x"]),
    }
    lines = reduce(lambda a, b: a.unionByName(b), [lines_from_memory(spark, text, name) for name, (text, _) in texts.items()])
    got = {name: [] for name in texts}
    for r in structure.declared_bases(lines).orderBy("concept").collect():
        got[r["source_id"]].append(r["concept"])
    assert got == {name: want for name, (_, want) in texts.items()} == {name: evaluate(text)[1] for name, (text, _) in texts.items()}


@pytest.mark.parametrize("lines,surface", [(["1—SAUCE OR ***"], "***"), (["basic sauces: Ab, —, and C.", "1—AB SAUCE"], "—"), (["CHAPTER I", "SAUCES", "1—AB SAUCE", "2—* *"], "* *")])
def test_a_name_that_folds_to_nothing_stops_the_extraction(spark, lines, surface):
    with pytest.raises(UnfoldableTerm, match="book: surface form yields an empty concept id") as fault:
        catalogue(spark, lines)
    assert repr(surface) in str(fault.value)
    out = extraction.extract(lines_from_memory(spark, lines, "book"))
    assert [r["status"] for r in out.diagnostics.collect()] == ["unfoldable"] and [r["surface"] for r in out.unfoldable.collect()] == [surface]


def test_names_outside_kept_places_need_not_fold(spark):
    assert catalogue(spark, ["1—AB SAUCE", "2—***", "3—FISH OR ***"]).catalogue.count() == 1


def test_spoilt_books_have_every_status(spark):
    got = {r["source_id"].split("/")[1]: r["status"] for r in registry.queries()["faulty_sources"](spark, "/root/testdata/sf0.001").collect()}
    assert got["headless"] == "no_entries" and got["plain"] in ("none_kept", "ok") and got["nameless"] == "unfoldable"


def test_sources_without_a_catalogue(spark):
    with pytest.raises(NothingExtracted, match="no numbered entries"):
        catalogue(spark, ["nothing", "here"])
    with pytest.raises(NothingExtracted, match="1 entries in book, none of them"):
        catalogue(spark, ["1—FISH"])
    with pytest.raises(ValueError, match="1 or greater"):
        catalogue(spark, ["0—FISH SAUCE"])
    assert extraction.extract(lines_from_memory(spark, [])).catalogue.collect() == []


def test_headings_and_wanted_bodies_are_those_of_the_entries(spark):
    lines = [*random_book(5, 40), "", "  ", "last"]
    frame = lines_from_memory(spark, lines).unionByName(lines_from_memory(spark, ["1—A", "2—B", "x", "3—C"], "other"))
    whole = {(r["source_id"], r["idx"]): r for r in structure.entries(frame).collect()}
    heads = structure.headings(frame)
    got = {(r["source_id"], r["idx"]): r for r in heads.collect()}
    assert {k: (r["entry"], r["file_line"], r["title"], r["in_kept_chapter"]) for k, r in whole.items()} == {k: (r["entry"], r["file_line"], r["title"], r["in_kept_chapter"]) for k, r in got.items()}
    wanted = heads.filter("entry % 3 <> 0")
    for stretch in (1, 2, 64):
        bodies = {(r["source_id"], r["idx"]): r["body"] for r in structure.bodies(frame, heads, wanted, stretch).collect()}
        assert all(bodies.get((r["source_id"], r["idx"]), "") == whole[r["source_id"], r["idx"]]["body"] for r in wanted.collect())
        assert len(bodies) <= wanted.count() and set(bodies.values()) != {""}


def test_lines_of_entries_left_out_are_not_gathered(spark):
    rng = random.Random(1)
    folder = os.path.dirname(shared_folder(spark, "probe")).removeprefix("file:")
    size = lambda: sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(folder) for f in files)
    lines = lines_from_memory(spark, ["The basic sauces: Ab.", "1—AB SAUCE", "Stir.", "2—FISH", *[rng.randbytes(50).hex() for _ in range(30_000)]])
    before = size()
    assert [(r["title"], r["body"]) for r in extraction.extract(lines).catalogue.collect()] == [("AB SAUCE", "Stir.")]
    assert size() - before < 500_000  # the other entry has 3 MB
    assert "text" not in str(structure.headings(lines)._jdf.queryExecution().optimizedPlan()).split("Window")[1]


def _moved(node):
    """Rows that the shuffles of a plan that has run have written."""
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return _moved(node.executedPlan())
    if kind.endswith("QueryStageExec"):
        return _moved(node.plan())
    children = node.children()
    own = node.metrics().apply("shuffleRecordsWritten").value() if kind == "ShuffleExchangeExec" else 0
    return own + sum(_moved(children.apply(k)) for k in range(children.size()))


def test_lines_beyond_the_wanted_entries_are_not_moved(spark):
    lines = lines_from_memory(spark, [*["before"] * 5_000, "1—AB SAUCE", "Stir.", "2—FISH", *["behind"] * 5_000])
    heads = structure.headings(lines)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = structure.bodies(lines, heads, heads.filter("entry = 1"))
        assert [(r["idx"], r["body"]) for r in found.collect()] == [(5_000, "Stir.")]
        assert _moved(found._jdf.queryExecution().executedPlan()) < 1_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lines_meet_declarations_where_they_stand(spark, monkeypatch):
    lines = reduce(lambda a, b: a.unionByName(b), [lines_from_memory(spark, random_book(k, 5), f"b{k}") for k in range(3)])
    sent = structure.declared_names(lines)
    assert str(sent._jdf.queryExecution().executedPlan()).count("BroadcastHashJoin") >= 3
    monkeypatch.setattr(structure, "SENT_SOURCES", 2)
    assert sorted(map(str, structure.declared_names(lines).collect())) == sorted(map(str, sent.collect()))


def test_drafts_are_written_in_few_files(spark):
    books = [(f"book{k}", i, i + 1, x) for k in range(6) for i, x in enumerate(random_book(k))]
    lines = spark.createDataFrame(books, LINES)
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "24"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    folder = os.path.dirname(shared_folder(spark, "any")).removeprefix("file:")
    earlier = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    try:
        extraction.extract(lines)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    (made,) = (d for d in set(os.listdir(folder)) - earlier if d.startswith("drafts-"))
    assert 1 <= sum(f.endswith(".parquet") for f in os.listdir(f"{folder}/{made}")) <= 2 * spark.sparkContext.defaultParallelism
