"""Entries that belong in a catalogue, with their names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.text import fold, says_kind, terms_of
from lexiloom.operators import structure
from lexiloom.rules import RULES, RuleSet

CATALOGUE = (
    "source_id string, seq int, title string, terms array<struct<surface:string,language:string,concept:string>>, "
    "concept string, body string, ref struct<source_id:string,entry:int,line:int>, parent string"
)


def kept_entries(entries: DataFrame, bases: DataFrame, rules: RuleSet = RULES) -> DataFrame:
    """Entries whose title says the kind, or names a declared base inside a kept chapter.

    Titles are folded only where the second test needs it. Bases are a handful for each source.
    """
    known = bases.groupBy("source_id").agg(F.collect_set("concept").alias("bases"))
    words = F.split(F.coalesce(fold(F.col("title")), F.lit("")), "-")
    by_base = F.when(F.col("in_kept_chapter") & F.col("bases").isNotNull(), F.arrays_overlap(words, F.col("bases"))).otherwise(False)
    return entries.join(known, "source_id", "left").filter(says_kind(F.col("title"), rules) | by_base).drop("bases")


def drafts(headings: DataFrame, bases: DataFrame, rules: RuleSet = RULES) -> DataFrame:
    """(source_id, seq, idx, title, terms, concept, ref) of the catalogue's rows, from their headings alone; ``seq`` is the order in the source."""
    kept = kept_entries(headings, bases, rules).withColumn("terms", terms_of(F.col("title"), rules))
    # Places are found among (source_id, idx) alone; titles meet them by key.
    placed = structure.running(kept_entries(headings, bases, rules).select("source_id", "idx"), F.lit(1).cast("long"), "place")
    concept = F.when(F.size("terms") > 0, F.get("terms", F.lit(0))["concept"]).otherwise(fold(F.col("title")))
    ref = F.struct(F.col("source_id").alias("source_id"), F.col("entry").alias("entry"), F.col("file_line").alias("line"))
    return kept.join(placed, ["source_id", "idx"]).select("source_id", (F.col("place") - 1).cast("int").alias("seq"), "idx", "title", "terms", concept.alias("concept"), ref.alias("ref"))


def with_bodies(drafts: DataFrame, headings: DataFrame, lines: DataFrame) -> DataFrame:
    """The catalogue's rows before parents are known. Only lines of kept entries are gathered."""
    found = drafts.join(structure.bodies(lines, headings, drafts), ["source_id", "idx"], "left")
    return found.select("source_id", "seq", "title", "terms", "concept", F.coalesce("body", F.lit("")).alias("body"), "ref", F.lit(None).cast("string").alias("parent"))


def unfoldable(declared: DataFrame, entries: DataFrame, bases: DataFrame, rules: RuleSet = RULES) -> DataFrame:
    """(source_id, surface) of names that fold to nothing: declared bases, terms of kept entries, titles in kept chapters. A source with any gets no catalogue."""
    nameless = declared.filter(fold(F.col("name")).isNull()).select("source_id", F.col("name").alias("surface"))
    each = kept_entries(entries, bases, rules).select("source_id", F.explode(terms_of(F.col("title"), rules)).alias("t"))
    terms = each.filter("t.concept is null").select("source_id", F.col("t.surface").alias("surface"))
    titles = entries.filter(F.col("in_kept_chapter") & fold(F.col("title")).isNull()).select("source_id", F.col("title").alias("surface"))
    return nameless.unionByName(terms).unionByName(titles).distinct()


def faulty_refs(catalogue: DataFrame) -> DataFrame:
    """Rows whose reference no reader could open: blank source, or entry or line below 1."""
    return catalogue.filter((F.trim("source_id") == "") | (F.col("ref.entry") < 1) | (F.col("ref.line") < 1))
