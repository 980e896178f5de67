"""Text checks over documents (path, text), as dataflows.

Every check works on any number of documents at once. One that reads none reports so (see ``scanned``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions.text import split_lines, strip
from lexiloom.operators.structure import BLOCK_LINES, running

# Fixed values of the checks: words of praise, in the order in which they are reported; the limits; and the Markdown patterns.
PRAISE = (
    "blazing", "cutting-edge", "effortless", "leverage", "leverages", "powerful", "revolutionary", "robust", "seamless", "seamlessly", "state-of-the-art", "utilize", "utilizes",
)
MAX_WORDS, MAX_DASHES = 25, 1
FENCE = r"^\s*```"
TABLE_ROW = r"^\s*\|"
LIST_ITEM = r"^\s*(?:[-*+]|\d+\.|:)\s"
SENTENCE_END = r"(?U)[.!?]+[*_`)\]\"']*(?:\s|$)"


def scanned(documents: DataFrame) -> DataFrame:
    """One row: how many documents were read, and whether that is any at all."""
    return documents.agg(F.count("*").alias("documents")).withColumn("ok", F.col("documents") > 0)


def _numbered(documents: DataFrame) -> DataFrame:
    return documents.select("path", F.posexplode(split_lines(F.col("text"))).alias("at", "line")).withColumn("number", F.col("at") + 1)


def occurrences(documents: DataFrame, term: str) -> DataFrame:
    """(path, number, line, hits) of the lines that hold a term, in any case."""
    pattern = F.lit("(?iu)" + "".join("\\" + c if not c.isalnum() and c.isascii() else c for c in term))
    return _numbered(documents).withColumn("hits", F.regexp_count("line", pattern)).filter("hits > 0").select("path", "number", strip(F.col("line")).alias("line"), "hits")


def term_report(documents: DataFrame, term: str, allowed: DataFrame) -> DataFrame:
    """(kind, path, number, line, hits): ``banned`` lines, ``allowed`` files with their hits, and ``stale`` allowances (path)."""
    found = occurrences(documents, term)
    banned = found.join(allowed.select("path"), "path", "left_anti").select(F.lit("banned").alias("kind"), "path", "number", "line", "hits")
    none = [F.lit(None).cast("int").alias("number"), F.lit(None).cast("string").alias("line")]
    excused = found.join(allowed.select("path"), "path", "left_semi").groupBy("path").agg(F.sum("hits").cast("int").alias("hits")).select(F.lit("allowed").alias("kind"), "path", *none, "hits")
    stale = allowed.select("path").distinct().join(found, "path", "left_anti").select(F.lit("stale").alias("kind"), "path", *none, F.lit(0).alias("hits"))
    return banned.unionByName(excused).unionByName(stale)


def paragraphs(documents: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """(path, unit, prose): prose of Markdown pages without code blocks and table rows; a list item is a unit of its own.

    Inline code reads ``CODE`` and link targets are dropped.
    """
    # Fences and units are counted within blocks of lines and over the blocks' totals, as chapters are.
    placed = _numbered(documents).select(F.col("path").alias("source_id"), F.col("at").alias("idx"), "line", "number").withColumn("fence", F.rlike("line", F.lit(FENCE)))
    fenced = running(placed, F.col("fence").cast("long"), "fences", block_lines=block_lines).withColumn("inside", F.col("fences") % 2 == 1)
    read = fenced.filter(F.col("fence") | ~(F.col("inside") | F.rlike("line", F.lit(TABLE_ROW))))
    masked = F.when(F.col("fence"), "").otherwise(F.regexp_replace(F.regexp_replace("line", "`[^`]*`", "CODE"), r"\]\([^)]*\)", "]"))
    lined = read.withColumn("clean", strip(masked)).withColumn("opens", (F.col("clean") == "") | F.rlike(masked, F.lit(LIST_ITEM)))
    units = running(lined, F.col("opens").cast("long"), "unit", block_lines=block_lines).filter("clean <> ''").groupBy(F.col("source_id").alias("path"), "unit")
    return units.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "clean"))), lambda x: x["clean"]), " ").alias("prose"))


def open_fences(documents: DataFrame) -> DataFrame:
    """Pages (path) whose last code block is never closed, so that their prose went unread."""
    count = F.count_if(F.rlike("line", F.lit(FENCE)))
    return _numbered(documents).groupBy("path").agg((count % 2 == 1).alias("open")).filter("open").select("path")


def prose_findings(documents: DataFrame) -> DataFrame:
    """(path, unit, rule, detail): semicolons, too many em dashes, words of praise, sentences that are too long."""
    dashes = F.length("prose") - F.length(F.replace("prose", F.lit("—"), F.lit("")))
    finding = lambda rule, detail: F.struct(F.lit(rule).alias("rule"), detail.alias("detail"))
    praised = F.filter(F.array(*map(F.lit, PRAISE)), lambda w: F.rlike("prose", F.concat(F.lit(r"(?iuU)\b"), w, F.lit(r"\b"))))
    worded = F.transform(F.split("prose", SENTENCE_END), lambda s: F.filter(F.split(s, r"(?U)\s+"), lambda w: w != ""))
    long = F.filter(worded, lambda ws: F.size(ws) > MAX_WORDS)
    said = F.concat(
        F.array_compact(F.array(F.when(F.contains("prose", F.lit(";")), finding("semicolon", F.lit(""))), F.when(dashes > MAX_DASHES, finding("em dashes", dashes.cast("string"))))),
        F.transform(praised, lambda w: finding("praise", w)),
        F.transform(long, lambda ws: finding("long sentence", F.concat(F.size(ws).cast("string"), F.lit(": "), F.array_join(F.slice(ws, 1, 8), " ")))),
    )
    return paragraphs(documents).select("path", "unit", F.explode(said).alias("f")).select("path", "unit", "f.rule", "f.detail")


def missing_quotes(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of (path, quote) whose document is absent or does not hold the quote."""
    joined = wanted.join(documents.select("path", "text"), "path", "left")
    return joined.filter(~F.coalesce(F.contains("text", F.col("quote")), F.lit(False))).select("path", "quote", F.col("text").isNull().alias("absent"))


def misquoted_census(documents: DataFrame, census: DataFrame, templates: dict[str, tuple[str, ...]]) -> DataFrame:
    """Rows of (path, quote, absent): what pages (path) should quote of a census, by templates with {sauces}, {derived} and {unresolved}, and do not.

    The counts are those of all sources together, from a catalogue that is extracted anew.
    """
    counts = census.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("string").alias(c) for c in ("sauces", "derived", "unresolved")])
    asked = documents.sparkSession.createDataFrame([(path, t) for path, own in templates.items() for t in own], "path string, quote string")
    filled = F.col("quote")
    for c in ("sauces", "derived", "unresolved"):
        filled = F.replace(filled, F.lit(f"{{{c}}}"), F.col(c))
    return missing_quotes(documents, asked.crossJoin(F.broadcast(counts)).select("path", filled.alias("quote")))  # one row of counts


def dotted_names(documents: DataFrame, root: str) -> DataFrame:
    """(path, name): distinct dotted references below a package."""
    pattern = F.lit(rf"\b{root}(?:\.[A-Za-z_][A-Za-z0-9_]*)+\b")
    return documents.select("path", F.explode(F.array_distinct(F.regexp_extract_all("text", pattern, 0))).alias("name")).distinct()


def unresolved_names(documents: DataFrame, root: str, known: DataFrame) -> DataFrame:
    """References to no known (name); clone addresses are not references."""
    return dotted_names(documents, root).filter(~F.endswith("name", F.lit(".git"))).join(known.select("name"), "name", "left_anti").select("path", "name")


def versions(documents: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """(path, version) pulled by one pattern for each path, and whether all ``agree``; a missing one disagrees."""
    spark = documents.sparkSession
    asked = spark.createDataFrame(list(patterns.items()), "path string, pattern string")
    found = asked.join(documents.select("path", "text"), "path", "left").select("path", F.coalesce(F.call_function("regexp_extract", "text", "pattern", F.lit(1)), F.lit("")).alias("version"))
    every = found.agg((F.count_distinct("version") == 1).alias("one"), F.min("version").alias("least"))
    return found.crossJoin(F.broadcast(every)).select("path", "version", (F.col("one") & (F.col("least") != "")).alias("agree"))


def code_lines(documents: DataFrame) -> DataFrame:
    """(path, code): lines of Python sources that hold more than blanks, comments and block strings.

    A line scan: block strings are told by their quotes at the start of a line.
    """
    order = Window.partitionBy("path").orderBy("number")
    quote = r'^\s*[rRbBuUfF]{0,2}(?:"""|\'\'\')'
    marks = F.regexp_count("line", F.lit(r'"""|\'\'\''))
    lined = _numbered(documents).withColumn("marks", marks).withColumn("before", F.coalesce(F.sum("marks").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    stringy = (F.col("before") % 2 == 1) | F.rlike("line", F.lit(quote))
    return lined.filter(~stringy & (strip(F.col("line")) != "") & ~F.rlike("line", F.lit(r"^\s*#"))).groupBy("path").agg(F.count("*").alias("code"))
