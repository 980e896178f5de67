"""Numbered books as tables of lines.

The schema that every operator reads is ``source_id, idx, file_line, text``: one row for each line of
the body, ``idx`` from 0, ``file_line`` the line's number in the file it came from. Any DataFrame of this
schema is a source.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.checkpoints import shared_table
from lexiloom.errors import SourceUnreadable
from lexiloom.functions.text import split_lines
from lexiloom.rules import RULES, RuleSet
from lexiloom.sources import line_ranges

LINES = "source_id string, idx int, file_line int, text string"
#: Order of the checks on a file; the first that fails is its status.
STATUSES = ("ok", "not_utf8", "no_start", "no_end")


def lines_from_memory(spark: SparkSession, lines: Iterable[str], source_id: str = "fixture", line_offset: int = 0) -> DataFrame:
    rows = [(source_id, i, line_offset + i + 1, text) for i, text in enumerate(lines)]
    return spark.createDataFrame(rows, LINES)


def wrapped_files(files: DataFrame, rules: RuleSet = RULES) -> DataFrame:
    """(source_id, status, opening, closing, lines) for rows of (source_id, content binary).

    For contents that are in memory already; files are read by ranges. They are checked as strict UTF-8, where Spark's text reader would replace bad
    bytes, drop a byte-order mark and end lines at fewer characters. Both markers are looked for from the top of the file.
    """
    sound = F.is_valid_utf8(F.col("content").cast("string"))
    lined = files.select("source_id", sound.alias("sound"), F.when(sound, split_lines(F.col("content").cast("string"))).alias("lines"))
    first = lambda marker: F.array_position(F.transform("lines", lambda x: F.startswith(x, F.lit(marker))), True) - 1
    marked = lined.select("source_id", "sound", "lines", first(rules.start_marker).alias("opening"), first(rules.end_marker).alias("closing"))
    status = F.when(~F.col("sound"), "not_utf8").when(F.col("opening") < 0, "no_start").when(F.col("closing") < 0, "no_end").otherwise("ok")
    return marked.select("source_id", status.alias("status"), F.col("opening").cast("int"), F.col("closing").cast("int"), "lines")


def body_lines(wrapped: DataFrame) -> DataFrame:
    """Lines strictly between the markers of the files that are sound; none where the end comes first."""
    rows = wrapped.filter("status = 'ok'").select("source_id", "opening", "closing", F.posexplode("lines").alias("at", "text"))
    inside = rows.filter((F.col("at") > F.col("opening")) & (F.col("at") < F.col("closing")))
    return inside.select("source_id", (F.col("at") - F.col("opening") - 1).alias("idx"), (F.col("at") + 1).alias("file_line"), "text")


def source_of(path: Column) -> Column:
    """A file's name without its last extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def scanned(found: DataFrame, rules: RuleSet = RULES) -> tuple[DataFrame, DataFrame]:
    """(body lines, files) of the pieces that ``line_ranges`` reads: what ``body_lines`` gives, and (source_id, path, status, opening, closing) of every file."""
    lines, files = line_ranges.assembled(found)
    lines = shared_table(lines, "lines")
    first = lambda marker: F.min(F.when(F.startswith("text", F.lit(marker)), F.col("at")))
    marks = lines.groupBy("path").agg(first(rules.start_marker).alias("opening"), first(rules.end_marker).alias("closing"))
    status = F.when(~F.col("sound"), "not_utf8").when(F.col("opening").isNull(), "no_start").when(F.col("closing").isNull(), "no_end").otherwise("ok")
    told = files.join(marks, "path", "left").select(source_of(F.col("path")).alias("source_id"), "path", status.alias("status"), "opening", "closing")
    inside = lines.join(told.filter("status = 'ok'"), "path").filter((F.col("at") > F.col("opening")) & (F.col("at") < F.col("closing")))
    return inside.select("source_id", (F.col("at") - F.col("opening") - 1).alias("idx"), (F.col("at") + 1).alias("file_line"), "text"), told


def read_lines(spark: SparkSession, path: str, rules: RuleSet = RULES, range_bytes: int = line_ranges.RANGE_BYTES) -> DataFrame:
    """Lines of one wrapped text file; any fault of the file is an error that says which."""
    try:
        lines, files = scanned(line_ranges.pieces(spark, path, range_bytes), rules)
        found = files.select("status").take(2)
    except Exception as fault:
        if "PATH_NOT_FOUND" in str(fault) or "FileNotFound" in str(fault):
            raise SourceUnreadable(f"cannot read source at {path}") from fault
        raise
    if not found:
        raise SourceUnreadable(f"cannot read source at {path}")
    said = {"not_utf8": f"source at {path} is not UTF-8 text", "no_start": f"no start marker in {path}", "no_end": f"no end marker in {path}, so the file is truncated"}
    if (status := found[0]["status"]) in said:
        raise SourceUnreadable(said[status])
    return lines
