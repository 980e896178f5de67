"""Names found in word lists as runs of words.

A name is looked for by its first word, then by its first two, four, eight, ... words. After each step only the places are left where some name
goes on, so what is joined stays near the hits, however many widths names have or however common their first words are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.text import width_of


def heads_of(names: DataFrame) -> DataFrame:
    """(source_id, level, head, widths, more) of (source_id, name): the first 2^level words of names, the widths below 2^(level + 1) of names that begin so, and whether wider ones do."""
    words, width = F.split("name", "-"), width_of(F.col("name"))
    top = F.floor(F.log2(width.cast("double"))).cast("int")
    each = names.select("source_id", words.alias("words"), width.alias("width"), top.alias("top")).withColumn("level", F.explode(F.sequence(F.lit(0), F.col("top"))))
    head = _run("words", F.pow(F.lit(2), F.col("level")).cast("int"))
    ends = F.when(F.col("level") == F.col("top"), F.col("width"))
    return each.select("source_id", "level", head.alias("head"), ends.alias("end"), (F.col("level") < F.col("top")).alias("goes_on")).groupBy("source_id", "level", "head").agg(F.collect_set("end").alias("widths"), F.max("goes_on").alias("more"))


def _run(words: str, width: Column) -> Column:
    return F.array_join(F.slice(words, F.lit(1), width), "-")


def places_of(texts: DataFrame, heads: DataFrame, levels: int, carry: list[str]) -> tuple[list[DataFrame], list[DataFrame]]:
    """(candidates, survivors) by level: places with the widths that names which begin there can have, and the places where wider ones go on.

    ``texts`` are rows of (source_id, rest, start) and ``carry``; ``rest`` holds the words from a place on, as far as names reach.
    """
    here, found, left = texts, [], []
    for level in range(levels):
        wide = F.lit(1 << level)
        known = heads.filter(F.col("level") == level).select("source_id", "head", "widths", "more")
        met = here.filter(F.size("rest") >= wide).withColumn("head", _run("rest", wide)).join(known, ["source_id", "head"]).drop("head")
        found.append(met.filter(F.size("widths") > 0).select("source_id", *carry, "start", "rest", F.explode("widths").alias("width")).filter(F.size("rest") >= F.col("width")))
        here = met.filter("more").drop("widths", "more")
        left.append(here)
    return found, left


def stated_runs(texts: DataFrame, names: DataFrame, carry: list[str]) -> DataFrame:
    """(source_id, carry..., start, end, name): each place in the ``words`` of (source_id, words, carry...) where a name of its source stands, or could by its first half.

    What is given still meets the names by a join; names are a written table, whose greatest width is asked first.
    """
    widest = names.agg(F.coalesce(F.max(width_of(F.col("name"))), F.lit(1)).alias("w")).first()["w"]
    places = F.transform("words", lambda _, i: F.struct(i.alias("start"), F.slice("words", i + 1, F.lit(widest)).alias("rest")))
    each = texts.select("source_id", *carry, F.explode(places).alias("p")).select("source_id", *carry, "p.start", "p.rest")
    found, _ = places_of(each, heads_of(names), widest.bit_length(), carry)
    runs = reduce(DataFrame.unionByName, found)
    return runs.select("source_id", *carry, "start", (F.col("start") + F.col("width")).alias("end"), _run("rest", F.col("width")).alias("name"))
