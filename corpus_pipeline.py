"""From raw documents to packed training sequences.

Every stage works on all rows that the stage before it kept, and its decisions take effect; all but
the last return the columns of ``documents``. Stages are joined by Parquet tables in the shared folder.
Near-duplicate removal keeps one row of each group, whether or not its rows share a doc_id or have none.

Defined results: a document whose text is null, empty or blank is rejected by the quality rules; of equal or similar texts the row with the
smallest id stays, ids that are null last, and of those the first row of the first file; a text that loses all its passages stays as an empty one
and packs as its end token; texts of any length are processed whole; extra columns travel along, whatever their names; an empty table gives an empty result.
Near-duplicates are found by operator 10's SimHash components, and by MinHash bands where fingerprints differ in more bits, and compared by shingles: see ``lexiloom.llm.similar``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import packing, quality, similar, substring
from lexiloom.llm.common import materialise, numbered_rows, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.judge(docs).filter("kept").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the smallest doc_id, of each group of near-duplicates: five-word shingles at similarity 0.8 or more, met in operator 10's components or in bands."""
    numbered = numbered_rows(docs, "numbered")
    found = similar.components(numbered.select("row", F.col("doc.doc_id").cast("long").alias("id"), F.col("doc.text").cast("string").alias("text")))
    return numbered.join(found.filter("row = first"), "row", "left_semi").select("doc.*")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that earlier ones hold; n_chars follows the text."""
    found = substring.dedup_substrings(docs)
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return found.select(*[new[c].alias(c) if c in new else F.col(f"rest.`{c}`") for c in docs.columns])


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of every piece of every remaining document in sequences of 2,048 tokens."""
    return packing.pack(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: Fingerprints, rolling hashes and tokens are beyond SQL; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
