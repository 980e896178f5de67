"""Books that arrive over time: each micro-batch of files is extracted and its catalogues replace older ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lexiloom.plans.extraction import extract
from lexiloom.rules import RULES, RuleSet
from lexiloom.sources.catalogue_store import save_table
from lexiloom.sources.line_ranges import RANGE_BYTES, piece_stream
from lexiloom.sources.numbered_text import scanned


def arriving_files(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Pieces of the files that come into a folder; a batch has whole files."""
    return piece_stream(spark, folder, range_bytes)


def keep_catalogues(pieces: DataFrame, store: str, checkpoint: str, rules: RuleSet = RULES) -> StreamingQuery:
    """Write the catalogue of every sound file, and drop that of one which has none any more; a batch that is repeated writes the same rows again."""

    def batch(found: DataFrame, _: int) -> None:
        lines, files = scanned(found, rules)
        save_table(extract(lines, rules).catalogue, store, files.filter("status = 'ok'"))

    return pieces.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
