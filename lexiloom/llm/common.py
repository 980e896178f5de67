"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of the word rule: space and U+0009 to U+000D.
WORD_GAP = r"[\x20\x09-\x0D]+"
WORD_GAP_CHARS = " \t\n\x0b\x0c\r"
MAX_LONG = 2**63 - 1
#: Rows that a task writes at least, where their number is known.
ROWS_EACH = 20_000
#: Bytes of a row group of the tables written here.
GROUP_BYTES = 1 << 24
#: So many files' names are sent to every task; more are joined.
SENT_FILES = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the driver's tables through Spark."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor shares. In local mode alone, where there is one machine, a temporary one stands in for it."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir names no folder that the executors share")
        folder = tempfile.mkdtemp(prefix="shared-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Folders made within each open ``scratch``.
_scopes: list[list[str]] = []


def _store_of(spark: SparkSession, path: str) -> tuple:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, removed when its ``scratch`` closes, or else when the session ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    store, jvm_path = _store_of(spark, path)
    store.mkdirs(jvm_path)
    store.deleteOnExit(jvm_path)
    if _scopes:
        _scopes[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside go at its end, except the one that ``result`` names: nothing that outlives it may read them."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            store, jvm_path = _store_of(spark, path)
            store.delete(jvm_path, True)


def result(df: DataFrame, name: str) -> DataFrame:
    """``materialise`` a table that outlives the ``scratch`` it is made in."""
    inner = _scopes.pop()
    try:
        return materialise(df, name)
    finally:
        _scopes.append(inner)


def materialise(df: DataFrame, name: str, by: str | None = None, rows: int | None = None) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder, partitioned ``by`` a column, removed when the session ends.

    Where some ``rows`` at most are known to come, they are written by as many tasks as those are worth, not into many tiny files.
    Unlike an executor-local copy it survives lost executors, and it fixes the rows, so that
    several readers see the same ones even where the input's order is not fixed.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_EACH)))
    # A writer holds a row group in its executor's memory.
    writer = df.write.mode("append").option("compression", "zstd").option("parquet.block.size", GROUP_BYTES)
    (writer.partitionBy(by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered_rows(df: DataFrame, name: str) -> DataFrame:
    """The rows with ``row``, a number of their own that is the same whenever they are read.

    Rows of files are known by file and place, so nothing is written but the list of files; any others are written once.
    """
    columns = [F.col(f"`{c}`") for c in df.columns]
    try:
        placed = df.select(F.struct(*columns).alias("doc"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    except AnalysisException:
        return materialise(df.select(F.struct(*columns).alias("doc"), F.monotonically_increasing_id().alias("row")), name)
    files = materialise(placed.select("file").distinct().withColumn("no", F.row_number().over(Window.orderBy("file")).cast("long")), f"{name}-files")
    if files.count() <= SENT_FILES:
        files = F.broadcast(files)
    return placed.join(files, "file").select("doc", (F.shiftleft("no", 36) + F.col("at")).alias("row"))


@cache
def keep_pages() -> None:
    """Let this process use the memory of freed arrays again instead of handing it back and faulting it in anew, which costs numpy more than
    its arithmetic where arrays of about 1 MB come and go. For tasks; where the C library knows no such settings nothing changes."""
    try:
        for setting, size in ((-3, 1 << 24), (-1, 1 << 25)):  # glibc: sizes from which memory is mapped, and trimmed
            ctypes.CDLL(None).mallopt(setting, size)
    except (OSError, AttributeError):
        return


def words_of(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` of a text; empty for null and for no words."""
    trimmed = F.btrim(text, F.lit(WORD_GAP_CHARS))
    none = F.array().cast("array<string>")
    return F.when(F.coalesce(F.length(trimmed), F.lit(0)) == 0, none).otherwise(F.split(trimmed, WORD_GAP))


def crc32_of_id(doc_id: Column) -> Column:
    """CRC-32 of the id written as decimal text; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
