"""Every name a parent may be stated by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions.text import grams_of, width_of

#: Places of a source whose answers to one question are ranked together.
BLOCK_PLACES = 1 << 16


def all_names(catalogue: DataFrame) -> DataFrame:
    """(source_id, seq, entry, pos, name, concept): each alternative name of each preparation, else its own concept."""
    terms = F.when(F.size("terms") > 0, F.transform("terms", lambda t: t["concept"])).otherwise(F.array("concept"))
    each = catalogue.select("source_id", "seq", "concept", F.col("ref.entry").alias("entry"), F.posexplode(terms).alias("pos", "name"))
    return each.filter("name is not null").select("source_id", "seq", "entry", "pos", "name", "concept")


def first_names(catalogue: DataFrame) -> DataFrame:
    """The first preparation in source order owns a name."""
    order = Window.partitionBy("source_id", "name").orderBy("seq", "pos")
    return all_names(catalogue).withColumn("rn", F.row_number().over(order)).filter("rn = 1").drop("rn")


def entry_order(catalogue: DataFrame) -> DataFrame:
    """(source_id, entry, place): a repeated entry number stands at its last place."""
    return catalogue.groupBy("source_id", F.col("ref.entry").alias("entry")).agg(F.max("seq").alias("place"))


def lookups(catalogue: DataFrame, bases: DataFrame, wanted: DataFrame, best: bool = False, block_places: int = BLOCK_PLACES) -> DataFrame:
    """Ranked answers (source_id, wanted, rank, seq, entry, concept) to rows of (source_id, wanted); only rank 1 if ``best``.

    An exact name answers alone. Else every name that holds the wanted words in a row answers: in source order for a
    declared base, else the shortest name first. A preparation answers once for each name that does.
    """
    names = first_names(catalogue)
    asked = wanted.select("source_id", "wanted").filter("wanted is not null").distinct()
    exact = asked.join(names, (asked["source_id"] == names["source_id"]) & (asked["wanted"] == names["name"])).select(asked["source_id"], "wanted", "seq", "entry", "concept", F.lit(0).alias("by_width"), F.lit(0).alias("place"))
    other = asked.join(exact.select("source_id", "wanted"), ["source_id", "wanted"], "left_anti")
    declared = bases.select("source_id", F.col("concept").alias("wanted"), F.lit(True).alias("is_base"))
    placed = names.join(entry_order(catalogue), ["source_id", "entry"])
    # Names meet questions by their runs of words, of the widths that questions have: every meeting is an answer, however common a word is.
    widths = other.select("source_id", width_of(F.col("wanted")).alias("w")).groupBy("source_id").agg(F.collect_set("w").alias("widths"))
    words = F.split("name", "-")
    runs = placed.join(widths, "source_id").withColumn("w", F.explode("widths")).withColumn("wanted", F.explode(F.array_distinct(F.transform(grams_of(words, F.col("w")), lambda g: g["gram"])))).drop("widths", "w")
    loose = other.join(runs, ["source_id", "wanted"])
    ranked = loose.join(declared, ["source_id", "wanted"], "left").select(
        "source_id", "wanted", "seq", "entry", "concept", F.when(F.col("is_base"), 0).otherwise(width_of(F.col("name"))).alias("by_width"), "place", "name", "pos"
    )
    # Names of one rank stand in the order in which the source first gives them.
    both = exact.withColumn("pos", F.lit(0)).unionByName(ranked.drop("name"))
    if best:
        top = both.groupBy("source_id", "wanted").agg(F.min(F.struct("by_width", "place", "seq", "pos", "entry", "concept")).alias("top"))
        return top.select("source_id", "wanted", F.lit(1).alias("rank"), "top.seq", "top.entry", "top.concept")
    return _ranked(both, block_places)


def _ranked(answers: DataFrame, block_places: int) -> DataFrame:
    """A common word's answers are ranked within stretches of the order (by_width, place, seq, pos), and over the stretches' sizes."""
    stretch = ["source_id", "wanted", "by_width", "blk"]
    dealt = answers.withColumn("blk", F.floor(F.col("place") / block_places))
    before = Window.partitionBy("source_id", "wanted").orderBy("by_width", "blk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(*stretch).agg(F.count("*").alias("n")).withColumn("earlier", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    local = dealt.withColumn("rank", F.row_number().over(Window.partitionBy(*stretch).orderBy("place", "seq", "pos")))
    return local.join(sizes, stretch).select("source_id", "wanted", (F.col("rank") + F.col("earlier")).cast("int").alias("rank"), "seq", "entry", "concept")


def run_index(catalogue: DataFrame) -> DataFrame:
    """(key, exact, seq, pos, entry, concept, width, place): every run of words of every name, once for each name, under one key with its source."""
    names = first_names(catalogue).join(entry_order(catalogue), ["source_id", "entry"])
    words = F.split("name", "-")
    widths = F.sequence(F.lit(1), F.size(words))
    runs = F.array_distinct(F.flatten(F.transform(widths, lambda w: F.transform(grams_of(words, w), lambda g: g["gram"]))))
    each = names.withColumn("run", F.explode(runs))
    return each.select(_index_key(F.col("source_id"), F.col("run")).alias("key"), (F.col("run") == F.col("name")).alias("exact"), "seq", "pos", "entry", "concept", width_of(F.col("name")).alias("width"), "place")


def _index_key(source: Column, run: Column) -> Column:
    return F.concat(source, F.lit("\x1f"), run)


def store_index(catalogue: DataFrame, name: str, path: str, buckets: int = 64) -> None:
    """Write the run index as a table in buckets by key: questions come to it without moving it."""
    run_index(catalogue).write.mode("overwrite").option("path", path).bucketBy(buckets, "key").sortBy("key").saveAsTable(name)


def indexed_lookups(index: DataFrame, bases: DataFrame, wanted: DataFrame) -> DataFrame:
    """What ``lookups`` gives, from a stored run index: only questions are shuffled to meet it."""
    declared = bases.select("source_id", F.col("concept").alias("wanted"), F.lit(True).alias("is_base"))
    asked = wanted.select("source_id", "wanted").filter("wanted is not null").distinct().join(declared, ["source_id", "wanted"], "left")
    keyed = asked.withColumn("key", _index_key(F.col("source_id"), F.col("wanted")))
    hits = keyed.join(index, "key")
    # An exact name answers alone.
    named = hits.filter("exact").select("source_id", "wanted").distinct().withColumn("named", F.lit(True))
    live = hits.join(named, ["source_id", "wanted"], "left").filter(F.col("exact") | F.col("named").isNull())
    by_width = F.when(F.col("exact") | F.col("is_base"), 0).otherwise(F.col("width"))
    return _ranked(live.withColumn("by_width", by_width), BLOCK_PLACES)


def candidates(catalogue: DataFrame, bases: DataFrame) -> DataFrame:
    """(source_id, name, key_entry, key_concept, records, base, width, seq, pos): one row for each name.

    A name reaches an entry, or - for a declared base that no preparation answers to - the base itself. Declared
    bases take precedence over catalogued names and record themselves.
    """
    asked = bases.select("source_id", F.col("concept").alias("wanted"))
    found = lookups(catalogue, bases, asked, best=True).select("source_id", F.col("wanted").alias("concept"), F.col("entry").alias("key_entry"))
    own = first_names(catalogue).select("source_id", "name", F.col("entry").alias("key_entry"), F.col("concept").alias("records"), "seq", "pos")
    declared = bases.join(found, ["source_id", "concept"], "left").select("source_id", F.col("concept").alias("name"), "key_entry", F.col("concept").alias("records"), F.lit(True).alias("base"))
    plain = own.join(declared.select("source_id", "name"), ["source_id", "name"], "left_anti").withColumn("base", F.lit(False))
    places = own.select("source_id", "name", "seq", "pos")
    both = plain.unionByName(declared.join(places, ["source_id", "name"], "left"))
    return both.select(
        "source_id", "name", "key_entry", F.when(F.col("key_entry").isNull(), F.col("name")).alias("key_concept"), "records", "base", width_of(F.col("name")).alias("width"), "seq", "pos"
    )
