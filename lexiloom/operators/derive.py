"""Parents that the sources state.

Only the opening paragraph of an entry counts. Names are looked for in its sentences' folded words by their beginnings (``matching``), and
what is found meets the names by a hash join; no name is tried against every text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.checkpoints import shared_table
from lexiloom.functions.text import fold, holds_run, opening_of, sentences_of
from lexiloom.operators import lineage, matching
from lexiloom.rules import RULES, RuleSet


def _key() -> Column:
    return F.coalesce(F.concat(F.lit("entry "), F.col("key_entry").cast("string")), F.concat(F.lit("base "), F.col("key_concept")))


def statements(drafts: DataFrame, candidates: DataFrame, rules: RuleSet = RULES) -> DataFrame:
    """(source_id, seq, entry, seg, start, end, width, name, key, records, base, place): each place where an opening states a name.

    Left out are names that reach the entry itself, and catalogued names that stand inside one of the
    entry's own names, since those name its subject. A declared base is nobody's subject.
    """
    own = F.array_compact(F.array_union(F.transform("terms", lambda t: t["concept"]), F.array(fold(F.col("title")))))
    texts = drafts.select("source_id", "seq", F.col("ref.entry").alias("entry"), own.alias("own"), F.posexplode(sentences_of(opening_of(F.col("body"), rules), rules)).alias("seg", "words"))
    placed = matching.stated_runs(texts, candidates, ["seq", "entry", "own", "seg"])
    itself = F.coalesce(F.col("key_entry") == F.col("entry"), F.array_contains("own", F.col("key_concept")))
    subject = ~F.col("base") & F.exists("own", lambda n: holds_run(n, F.col("name")))
    place = F.struct(F.coalesce("candidates.seq", F.lit(2**31 - 1)).alias("seq"), F.coalesce("pos", F.lit(0)).alias("pos"), F.col("name").alias("name"))
    hits = placed.alias("placed").join(candidates.alias("candidates"), ["source_id", "name"]).filter(~itself & ~subject)
    return hits.select("source_id", F.col("placed.seq").alias("seq"), "entry", "seg", "start", "end", "width", "name", _key().alias("key"), "records", "base", place.alias("place"))


def uncovered(statements: DataFrame) -> DataFrame:
    """Statements not inside a strictly longer one that reaches another preparation; ``covered`` ones go.

    Covers may be covered themselves. A sentence is swept from left to right, of spans that begin together the longest first: what can
    cover a span then stands before it, and does if the furthest end there, of those that reach another preparation, is not before its own.
    Only two are kept in mind for that, the furthest and the furthest of another preparation than that one's. A name has one candidate in a source, so
    a span is stated once.
    """
    sweep = Window.partitionBy("source_id", "seq", "entry", "seg").orderBy("start", F.desc("end"), "name")
    before, now = sweep.rowsBetween(Window.unboundedPreceding, -1), sweep.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.struct("end", "key")
    first = statements.withColumn("furthest", F.max(reach).over(before)).withColumn("leader", F.max(reach).over(now)["key"])
    # A span that does not lead, and the leader that a span takes the lead from, are the next best of another preparation.
    beaten = F.when(F.col("leader") != F.col("key"), reach).when(F.col("furthest.key") != F.col("key"), F.col("furthest"))
    second = first.withColumn("beaten", beaten).withColumn("next", F.max("beaten").over(before))
    best = F.when(F.col("furthest.key") != F.col("key"), F.col("furthest.end")).otherwise(F.col("next.end"))
    return second.filter(F.coalesce(best < F.col("end"), F.lit(True))).drop("furthest", "leader", "beaten", "next")


def stated_parents(live: DataFrame) -> DataFrame:
    """(source_id, seq, parent) where all statements left reach one preparation: its smallest declared base name, else its own concept."""
    found = live.groupBy("source_id", "seq").agg(F.collect_set("key").alias("keys"), F.min(F.when(F.col("base"), F.col("records"))).alias("base"), F.min_by("records", "place").alias("plain"))
    return found.filter(F.size("keys") == 1).select("source_id", "seq", F.coalesce("base", "plain").alias("parent"))


def parents_by_entry(drafts: DataFrame, stated: DataFrame) -> DataFrame:
    """(source_id, entry, parent) of every entry; of entries that share a number the last one speaks for all."""
    every = drafts.select("source_id", "seq", F.col("ref.entry").alias("entry")).join(stated, ["source_id", "seq"], "left")
    return every.groupBy("source_id", "entry").agg(F.max_by("parent", "seq").alias("parent"))


def parent_edges(parents: DataFrame, candidates: DataFrame) -> DataFrame:
    """(source_id, entry, target): the entry that a recorded parent leads to."""
    place = F.struct(F.coalesce("seq", F.lit(2**31 - 1)), F.coalesce("pos", F.lit(0)), F.col("name"))
    reached = candidates.filter("key_entry is not null").groupBy("source_id", "records").agg(F.max_by("key_entry", place).alias("target"))
    return parents.join(reached, (parents["source_id"] == reached["source_id"]) & (parents["parent"] == reached["records"])).select(parents["source_id"], "entry", "target")


def on_cycles(edges: DataFrame) -> DataFrame:
    """(source_id, entry) of all entries on a cycle of (entry, target), each entry having one target.

    The map is composed with itself until its steps outnumber the entries of any source: every path that ends is gone
    then, and what is still reached lies on a cycle.
    """
    return lineage.on_cycles(lineage.lifted(edges.withColumnRenamed("entry", "seq"))).withColumnRenamed("seq", "entry")


def with_parents(drafts: DataFrame, candidates: DataFrame, rules: RuleSet = RULES) -> DataFrame:
    """The catalogue: drafts with the parents that their openings state, none of them on a cycle."""
    parents = shared_table(parents_by_entry(drafts, stated_parents(uncovered(statements(drafts, candidates, rules)))), "parents")
    cyclic = on_cycles(parent_edges(parents.filter("parent is not null"), candidates))
    clear = parents.join(cyclic, ["source_id", "entry"], "left_anti").select("source_id", "entry", F.col("parent").alias("found"))
    joined = drafts.withColumn("entry", F.col("ref.entry")).join(clear, ["source_id", "entry"], "left")
    return joined.select("source_id", "seq", "title", "terms", "concept", "body", "ref", F.col("found").alias("parent"))
