import pytest

from lexiloom.operators import lint

PAGE = """# Title
A plain line; with a semicolon.
Two — dashes — here. A powerful `robust; thing` and [a link](http://x;y).

- item one
- item two `x`
| a | table; row |
```
code; here
```
""" + " ".join(["word"] * 26) + "."


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([("a.md", PAGE), ("b.md", "Fine prose.\n```\nopen"), ("c.md", "x Salsa\nsalsa SALSA y\n")], "path string, text string")


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_terms(spark, docs):
    assert rows(lint.occurrences(docs, "salsa"), "number") == [("c.md", 1, "x Salsa", 1), ("c.md", 2, "salsa SALSA y", 2)]
    allowed = spark.createDataFrame([("c.md",), ("gone.md",)], "path string")
    assert rows(lint.term_report(docs, "salsa", allowed).select("kind", "path", "hits"), "kind") == [("allowed", "c.md", 3), ("stale", "gone.md", 0)]
    assert rows(lint.term_report(docs, "salsa", allowed.filter("path <> 'c.md'")).select("kind", "path", "number"), "kind", "number") == [("banned", "c.md", 1), ("banned", "c.md", 2), ("stale", "gone.md", None)]
    assert rows(lint.scanned(docs.limit(0)), "ok") == [(0, False)]


def test_prose(docs):
    units = [r["prose"] for r in lint.paragraphs(docs).filter("path = 'a.md'").orderBy("unit").collect()]
    assert units == ["# Title A plain line; with a semicolon. Two — dashes — here. A powerful CODE and [a link].", "- item one", "- item two CODE", " ".join(["word"] * 26) + "."]
    assert sorted((r["rule"], r["detail"].split(":")[0]) for r in lint.prose_findings(docs).collect()) == [("em dashes", "2"), ("long sentence", "26"), ("praise", "powerful"), ("semicolon", "")]
    assert rows(lint.open_fences(docs), "path") == [("b.md",)]


def test_references(spark):
    docs = spark.createDataFrame([("x.py", 'see pkg.mod.f and pkg.mod.f and pkg.bad or pkg.git\n# note\n"""doc\nstring"""\ncode = 1\n\n'), ("v.toml", 'version = "1.2"'), ("v.py", "V = '1.2'")], "path string, text string")
    known = spark.createDataFrame([("pkg.mod.f",)], "name string")
    assert rows(lint.unresolved_names(docs, "pkg", known), "name") == [("x.py", "pkg.bad"), ("x.py", "pkg.git")][:1]
    assert [r["agree"] for r in lint.versions(docs, {"v.toml": 'version = "([^"]+)"', "v.py": "V = '([^']+)'"}).collect()] == [True, True]
    assert [r["agree"] for r in lint.versions(docs, {"v.toml": 'version = "([^"]+)"', "no": "x"}).collect()] == [False, False]
    assert rows(lint.missing_quotes(docs, spark.createDataFrame([("v.py", "1.2"), ("v.py", "9"), ("no", "1")], "path string, quote string")), "path") == [("no", "1", True), ("v.py", "9", False)]
    assert rows(lint.code_lines(docs), "path")[-1] == ("x.py", 2)


def test_blocks_of_lines_make_no_difference(spark, docs):
    whole = rows(lint.paragraphs(docs), "path", "unit")
    assert all(rows(lint.paragraphs(docs, block), "path", "unit") == whole for block in (1, 2, 5))


def test_census_is_quoted_anew(spark):
    counts = spark.createDataFrame([("a", 3, 1, 2), ("b", 7, 4, 3)], "source_id string, sauces long, derived long, unresolved long")
    pages = spark.createDataFrame([("x.md", "10 sauces, 5 derived"), ("y.md", "unresolved: 4")], "path string, text string")
    found = lint.misquoted_census(pages, counts, {"x.md": ("{sauces} sauces", "{derived} derived", "{unresolved} left"), "y.md": ("unresolved: {unresolved}",), "z.md": ("{sauces}",)})
    assert rows(found, "path", "quote") == [("x.md", "5 left", False), ("y.md", "unresolved: 5", False), ("z.md", "10", True)]
