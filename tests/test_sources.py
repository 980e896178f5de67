import json

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lexiloom import cli
from lexiloom.checkpoints import shared_table
from lexiloom.errors import CatalogueUnwritable, RootNotFound, SourceUnreadable
from lexiloom.rules import RULES
from lexiloom.sources import catalogue_store, numbered_text, synthetic
from lexiloom.streaming import arrivals

BOOK = [
    "The basic sauces: Espagnole, and Tomato.", "1—BROWN SAUCE OR ESPAGNOLE", "Brown bones. " + "Long. " * 200, "", "2—HERB SAUCE", "Add Espagnole.", "", "3—CAPER SAUCE", "Add herb sauce.", "", "4—VELOUTÉ SAUCE", "Nothing.",
]


def wrap(lines):
    return "\n".join(["title", "", f"{RULES.start_marker} X ***", *lines, f"{RULES.end_marker} X ***", "licence", ""]).encode()


@pytest.fixture()
def root(tmp_path):
    (tmp_path / "corpus").mkdir()
    (tmp_path / "corpus" / "book.txt").write_bytes(wrap(BOOK))
    return tmp_path


def test_wrapped_text(spark, root):
    got = numbered_text.read_lines(spark, str(root / "corpus" / "book.txt")).orderBy("idx").collect()
    assert [(r["idx"], r["file_line"], r["text"]) for r in got] == [(i, i + 4, x) for i, x in enumerate(BOOK)]
    assert {r["source_id"] for r in got} == {"book"}


@pytest.mark.parametrize(
    "data,said",
    [(None, "cannot read"), ("é".encode("latin-1"), "not UTF-8"), (b"no markers", "no start marker"), (RULES.start_marker.encode() + b"\nx", "truncated")],
)
def test_faulty_files(spark, tmp_path, data, said):
    if data is not None:
        (tmp_path / "f.txt").write_bytes(data)
    with pytest.raises(SourceUnreadable, match=said):
        numbered_text.read_lines(spark, str(tmp_path / "f.txt"))


def test_end_before_start_gives_no_lines(spark, tmp_path):
    (tmp_path / "f.txt").write_text(f"{RULES.end_marker}\nx\n{RULES.start_marker}\ny")
    assert numbered_text.read_lines(spark, str(tmp_path / "f.txt")).collect() == []


def run(capsys, root, *argv):
    code = cli.main(["--root", str(root), "--source", "book", *argv])
    out = capsys.readouterr()
    return code, out.out, out.err


def test_commands(spark, root, capsys):
    code, out, _ = run(capsys, root, "parse")
    assert code == 0 and {tuple(x.split(None, 1)) for x in out.splitlines()} >= {("source_id", "book"), ("sauces", "4"), ("derived", "2"), ("unresolved", "2"), ("mothers", "espagnole, tomato")}
    code, out, _ = run(capsys, root, "tree", "Espagnole")
    assert code == 0 and out.splitlines() == ["BROWN SAUCE OR ESPAGNOLE  [espagnole]", "└── HERB SAUCE  (en)", "    └── CAPER SAUCE  (en)"]
    code, out, err = run(capsys, root, "show", "sauce", "--chars", "5")
    assert code == 0 and [x.split(None, 1) for x in out.splitlines()[:4]] == [["title", "BROWN SAUCE OR ESPAGNOLE"], ["entry", "1"], ["line", "5"], ["name", "BROWN SAUCE  [en]  brown-sauce"]] and "(unresolved)" in out and "more characters" in out and "HERB SAUCE" in err
    assert run(capsys, root, "tree", "tomato")[0] == 0
    assert run(capsys, root, "tree", "nowhere")[0] == 1 and run(capsys, root, "show", "nowhere")[0] == 1
    assert run(capsys, root, "show", "###")[0] == 2
    assert cli.only_source(root) == "book"
    (root / "data" / "book.json").write_text("{")
    assert run(capsys, root, "show", "herb")[0] == 2


def test_documents(spark, root, capsys):
    run(capsys, root, "parse")
    path = root / "data" / "book.json"
    assert not list((root / "data").glob("*.tmp"))
    text = path.read_text(encoding="utf-8")
    stored = json.loads(text)
    assert list(stored) == ["source_id", "mothers", "preparations"] and text.endswith("}\n") and "VELOUTÉ" in text and '  "mothers"' in text
    assert list(stored["preparations"][0]) == ["concept", "title", "parent", "terms", "ref", "body"] and stored["preparations"][0]["parent"] is None
    catalogue, bases = catalogue_store.load_document(spark, "book", str(root / "data"))
    catalogue_store.save_document(catalogue, bases, "book", str(root / "again"))
    assert (root / "again" / "book.json").read_text(encoding="utf-8") == text
    for spoil, said in (
        (lambda d: d["preparations"][1].update(parent=""), "damaged"), (lambda d: d["preparations"][0].pop("body"), "damaged"), (lambda d: d.pop("mothers"), "damaged"),
        (lambda d: d["preparations"][0]["ref"].update(entry=0), "damaged"), (lambda d: d["preparations"][0]["terms"][0].update(language="de"), "damaged"),
    ):
        bad = json.loads(text)
        spoil(bad)
        path.write_text(json.dumps(bad))
        with pytest.raises(SourceUnreadable, match=said):
            catalogue_store.load_document(spark, "book", str(root / "data"))
    moved = json.loads(text)
    moved["preparations"][0]["concept"] = "made-up"
    path.write_text(json.dumps(moved))
    assert catalogue_store.load_document(spark, "book", str(root / "data"))[0].filter("concept = 'made-up'").count() == 0
    path.unlink()
    with pytest.raises(SourceUnreadable, match="nothing is stored there"):
        catalogue_store.load_document(spark, "book", str(root / "data"))
    path.mkdir()
    with pytest.raises(SourceUnreadable, match="could not be read"):
        catalogue_store.load_document(spark, "book", str(root / "data"))


def test_paths(tmp_path):
    for bad in ("", ".", "..", "../x", "a/b"):
        with pytest.raises(CatalogueUnwritable):
            catalogue_store.document_path("d", bad)
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "corpus").mkdir()
    assert cli.find_root(str(tmp_path / "a" / "b")) == tmp_path
    with pytest.raises(RootNotFound):
        cli.find_root("/")


def test_tables_and_streams(spark, root, tmp_path):
    store = str(tmp_path / "store")
    query = arrivals.keep_catalogues(arrivals.arriving_files(spark, str(root / "corpus")), store, str(tmp_path / "ckpt"))
    query.awaitTermination(120)
    first = catalogue_store.load_table(spark, store)
    assert first.count() == 4 and first.filter("parent is null").count() == 2
    (root / "corpus" / "other.txt").write_bytes(wrap(BOOK[:6]))
    arrivals.keep_catalogues(arrivals.arriving_files(spark, str(root / "corpus")), store, str(tmp_path / "ckpt")).awaitTermination(120)
    both = catalogue_store.load_table(spark, store)
    assert {r["source_id"]: r["n"] for r in both.groupBy("source_id").agg(F.count("*").alias("n")).collect()} == {"book": 4, "other": 2}


def test_tables_are_written_in_small_row_groups_and_lines_in_few_files(spark):
    wide = shared_table(spark.range(0, 400_000, 1, 1).select(F.sha2(F.col("id").cast("string"), 512).alias("x")), "wide")
    (file,) = wide.inputFiles()
    assert pq.ParquetFile(file.removeprefix("file://")).metadata.num_row_groups > 1
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "40"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        lines = synthetic.read(spark, "/root/testdata/sf0.001")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(lines.inputFiles()) <= 2 * spark.sparkContext.defaultParallelism
