"""Token counts of documents in flat, unindexed token files, by a separator scan.

A token file is a plain run of ids in which every document ends with the end-of-document id; nothing
says where. Files are read in blocks of fixed size: a task seeks to a block's first byte and reads that block alone, so no task
holds a file. Each block is searched for the id by one vector comparison and yields only its number of tokens and the places of
its separators. Documents that run over block borders are stitched by a prefix scan in two levels: sums and the last separator of
groups of blocks, a scan over a file's groups, and a scan within each group.

The query writes the corpus as such files (16-bit ids where the vocabulary allows) into the shared folder, one or more for each
task, with a manifest table that only names each file's documents in order, and scans what it wrote. A task that runs again writes files of
new names, and the manifest names those of the attempt that counted. Stores are those that ``pyarrow.fs`` opens by address (local
and mounted folders, HDFS, S3, GCS). The strings of special tokens in a text are ordinary text.

Defined results: a null or empty text is a document of no tokens; repeated rows are separate documents;
tokens behind the last separator of a file form one document that is not terminated; an empty table or file gives
no rows; an id that the width cannot hold, and a file that is no whole number of ids, are errors. Extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom.llm.common import materialise, shared_path, table
from lexiloom.llm.tokens import default_path, encoder

VOCABULARY = "byte_bpe_50k.json"
END_ID = 50256
BLOCK_TOKENS = 1 << 18
GROUP_BLOCKS = 4096
#: Bytes after which a writing task begins another file.
FILE_BYTES = 1 << 28


def id_type(vocab_size: int) -> str:
    return "<u2" if vocab_size <= 1 << 16 else "<u4"


def packed(ids: np.ndarray, dtype: str) -> bytes:
    """The ids in their width; one that it cannot hold is an error."""
    if len(ids) and int(ids.max()) > np.iinfo(dtype).max:
        raise ValueError(f"id {int(ids.max())} does not fit {dtype}")
    return ids.astype(dtype).tobytes()


def write_token_files(df: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, dtype: str | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the texts as flat token files; (path, first, ids): the documents of each file, numbered from ``first`` on, in their order."""
    path = path or default_path(VOCABULARY)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, True)
        width = dtype or id_type(own.vocab_size)
        end = packed(np.array([END_ID]), width)
        store, root = fs.FileSystem.from_uri(folder)
        out, name, written, first = None, "", 0, 0
        try:
            for b in batches:
                ids: list[int | None] = []

                def manifest() -> pa.RecordBatch:
                    return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([first], pa.int64()), pa.array([ids], pa.list_(pa.int64()))], ["path", "first", "ids"])

                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if out is None:
                        name, written, first = f"tokens-{TaskContext.get().partitionId()}-{uuid.uuid4().hex}.bin", 0, 0
                        out = store.open_output_stream(f"{root}/{name}")
                    data = packed(own.encode(text or ""), width) + end
                    out.write(data)
                    ids.append(doc_id)
                    written += len(data)
                    if written >= file_bytes:
                        out.close()
                        out = None
                        yield manifest()
                        ids = []
                if ids:
                    yield manifest()
                    first += len(ids)
        finally:
            if out is not None:
                out.close()

    kept = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return kept.mapInArrow(run, "path string, first long, ids array<long>")


def blocks_of(spark: SparkSession, files: str, dtype: str = "<u2", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(path, file, block, at, size) of the blocks of flat token files, found by their lengths alone; ``file`` numbers the paths."""
    width = np.dtype(dtype).itemsize
    step = block_tokens * width
    found = spark.read.format("binaryFile").load(files).select("path", F.col("length").alias("bytes"))
    wrong = F.raise_error(F.concat(F.lit("no whole number of ids: "), F.col("path"))).cast("long")
    sound = found.select("path", F.xxhash64("path").alias("file"), F.when(F.col("bytes") % width == 0, F.col("bytes")).otherwise(wrong).alias("bytes")).filter("bytes > 0")
    each = sound.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("bytes") - 1) / step))))
    at = F.col("block") * step
    return each.select("path", "file", "block", at.alias("at"), F.least(F.lit(step), F.col("bytes") - at).alias("size"))


def scan_blocks(blocks: DataFrame, end_id: int = END_ID, dtype: str = "<u2") -> DataFrame:
    """(file, block, n, ends): tokens of each block and the places behind its separators."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stores: dict[str, tuple] = {}
        for b in batches:
            counts, ends = [], []
            for path, at, size in zip(*(b.column(c).to_pylist() for c in ("path", "at", "size")), strict=True):
                if path not in stores:
                    for _, file in stores.values():
                        file.close()
                    store, inner = fs.FileSystem.from_uri(path)
                    stores = {path: (store, store.open_input_file(inner))}
                tokens = np.frombuffer(stores[path][1].read_at(size, at), dtype)
                counts.append(len(tokens))
                ends.append(np.flatnonzero(tokens == end_id) + 1)
            yield pa.RecordBatch.from_arrays([b.column("file"), b.column("block"), pa.array(counts, pa.int64()), pa.array(ends, pa.list_(pa.int64()))], ["file", "block", "n", "ends"])

    # Blocks are shared out by their numbers, as one file's are on one task so far.
    dealt = blocks.select("path", "file", "block", "at", "size").repartition("file", "block")
    return dealt.mapInArrow(run, "file long, block long, n long, ends array<long>")


def count_tokens(blocks: DataFrame, end_id: int = END_ID, dtype: str = "<u2", group_blocks: int = GROUP_BLOCKS) -> DataFrame:
    """(file, ordinal, start, n_tokens, terminated) of every document of the files."""
    scanned = materialise(scan_blocks(blocks, end_id, dtype), "separators").withColumn("grp", F.floor(F.col("block") / group_blocks))
    k = F.size("ends").cast("long")
    inside = Window.partitionBy("file", "grp").orderBy("block")
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    # Within its group: tokens and separators before a block, and where the last separator before it ends.
    local = scanned.withColumn("pos", F.coalesce(F.sum("n").over(earlier), F.lit(0))).withColumn("ord", F.coalesce(F.sum(k).over(earlier), F.lit(0)))
    local = local.withColumn("own_end", F.when(k > 0, F.col("pos") + F.element_at("ends", -1))).withColumn("last_end", F.max("own_end").over(earlier))
    sums = scanned.groupBy("file", "grp").agg(F.sum("n").alias("n"), F.sum(k).alias("k"))
    ends = local.groupBy("file", "grp").agg(F.max("own_end").alias("own_end"))
    before = Window.partitionBy("file").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    groups = sums.join(ends, ["file", "grp"]).withColumn("g_pos", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("g_ord", F.coalesce(F.sum("k").over(before), F.lit(0)))
    groups = groups.withColumn("g_end", F.coalesce(F.max(F.col("g_pos") + F.col("own_end")).over(before), F.lit(0))).select("file", "grp", "g_pos", "g_ord", "g_end")
    placed = local.join(groups, ["file", "grp"]).select(
        "file", (F.col("g_pos") + F.col("pos")).alias("at"), (F.col("g_ord") + F.col("ord")).alias("ord"), F.coalesce(F.col("g_pos") + F.col("last_end"), "g_end").alias("since"), "n", "ends"
    )
    each = placed.select("file", "at", "ord", "since", "ends", F.posexplode("ends").alias("i", "end"))
    start = F.when(F.col("i") == 0, F.col("since")).otherwise(F.col("at") + F.get("ends", F.col("i") - 1))
    closed = each.select("file", (F.col("ord") + F.col("i")).alias("ordinal"), start.alias("start"), (F.col("at") + F.col("end") - start - 1).alias("n_tokens"), F.lit(True).alias("terminated"))
    last = placed.groupBy("file").agg(F.max(F.col("at") + F.col("n")).alias("size"), F.max(F.greatest("since", F.coalesce(F.col("at") + F.try_element_at("ends", F.lit(-1)), F.lit(0)))).alias("since"), F.sum(k).alias("ordinal"))
    rest = last.filter(F.col("size") > F.col("since")).select("file", "ordinal", F.col("since").alias("start"), (F.col("size") - F.col("since")).alias("n_tokens"), F.lit(False).alias("terminated"))
    return closed.unionByName(rest)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted in flat token files of the corpus."""
    folder = shared_path(spark, "tokens")
    manifest = materialise(write_token_files(table(spark, sf_dir, "documents"), folder), "manifest")
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, file long, ordinal long, start long, n_tokens long")
    counts = count_tokens(blocks_of(spark, f"{folder}/*.bin"))
    # The address as the reader gives it ends with the file's name.
    named = spark.read.format("binaryFile").load(f"{folder}/*.bin").select(F.element_at(F.split("path", "/"), -1).alias("path"), F.xxhash64("path").alias("file"))
    ordered = manifest.join(named, "path").select("file", "first", F.posexplode("ids").alias("i", "doc_id")).select("file", (F.col("first") + F.col("i")).alias("ordinal"), "doc_id")
    return ordered.join(counts, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "start", "n_tokens")
