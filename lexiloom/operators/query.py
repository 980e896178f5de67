"""Questions to a catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.operators.names import lookups


def languages_label(terms: str = "terms") -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(terms, lambda t: t["language"]))), "/")


def census(catalogue: DataFrame, bases: DataFrame) -> DataFrame:
    """(source_id, mothers, sauces, derived, unresolved) of each source with a catalogue."""
    counts = catalogue.groupBy("source_id").agg(F.count("*").alias("sauces"), F.count("parent").alias("derived"), F.count_if(F.col("parent").isNull()).alias("unresolved"))
    named = bases.groupBy("source_id").agg(F.array_join(F.array_sort(F.collect_set("concept")), ", ").alias("mothers"))
    return counts.join(named, "source_id", "left").select("source_id", F.coalesce("mothers", F.lit("")).alias("mothers"), "sauces", "derived", "unresolved")


def diagnostics(lines: DataFrame, entries: DataFrame, drafts: DataFrame, unfoldable: DataFrame) -> DataFrame:
    """(source_id, entries, kept, status): ok, unfoldable (a name folds to nothing), no_entries or none_kept."""
    every = lines.select("source_id").distinct()
    read = entries.groupBy("source_id").agg(F.count("*").alias("entries"))
    kept = drafts.groupBy("source_id").agg(F.count("*").alias("kept"))
    nameless = unfoldable.select("source_id").distinct().withColumn("nameless", F.lit(True))
    joined = every.join(read, "source_id", "left").join(kept, "source_id", "left").join(nameless, "source_id", "left").na.fill(0, ["entries", "kept"])
    status = F.when(F.col("nameless"), "unfoldable").when(F.col("entries") == 0, "no_entries").when(F.col("kept") == 0, "none_kept").otherwise("ok")
    return joined.select("source_id", "entries", "kept", status.alias("status"))


def matches(catalogue: DataFrame, bases: DataFrame, wanted: DataFrame) -> DataFrame:
    """Every preparation that a concept could name, best first: (source_id, wanted, rank) and the catalogue's columns."""
    return lookups(catalogue, bases, wanted).select("source_id", "wanted", "rank", "seq").join(catalogue, ["source_id", "seq"])


def find(catalogue: DataFrame, bases: DataFrame, wanted: DataFrame) -> DataFrame:
    return lookups(catalogue, bases, wanted, best=True).select("source_id", "wanted", "seq").join(catalogue, ["source_id", "seq"])


def children(catalogue: DataFrame, bases: DataFrame, wanted: DataFrame) -> DataFrame:
    """(source_id, wanted, seq) of the preparations derived from each wanted concept.

    A child's parent equals the concept, or both names reach one preparation. Every name is looked up once.
    """
    derived = catalogue.filter("parent is not null").select("source_id", "seq", "parent")
    asked = wanted.select("source_id", "wanted").distinct()
    names = asked.unionByName(derived.select("source_id", F.col("parent").alias("wanted")))
    reached = lookups(catalogue, bases, names, best=True).select("source_id", "wanted", F.col("seq").alias("target"))
    by_name = derived.join(asked, (derived["source_id"] == asked["source_id"]) & (derived["parent"] == asked["wanted"])).select(derived["source_id"], "wanted", "seq")
    child = derived.join(reached.withColumnRenamed("wanted", "parent"), ["source_id", "parent"]).select("source_id", "seq", "target")
    by_target = asked.join(reached, ["source_id", "wanted"]).join(child, ["source_id", "target"]).select("source_id", "wanted", "seq")
    return by_name.unionByName(by_target).distinct()


def misquoted(catalogue: DataFrame, lines: DataFrame) -> DataFrame:
    """Catalogue rows whose cited line does not begin with their number; empty when every citation holds."""
    # A number of eleven characters at most and its dash decide; no more of a line is moved.
    cited = lines.select("source_id", F.col("file_line").alias("line"), F.left("text", F.lit(12)).alias("text"))
    joined = catalogue.select("source_id", "seq", F.col("ref.entry").alias("entry"), F.col("ref.line").alias("line")).join(cited, ["source_id", "line"], "left")
    return joined.filter(~F.coalesce(F.startswith("text", F.concat(F.col("entry").cast("string"), F.lit("—"))), F.lit(False)))
