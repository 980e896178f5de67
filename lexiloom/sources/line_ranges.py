"""Text files as a Spark data source, read by byte ranges.

``spark.read.format("numbered_text").load(path)`` gives the pieces of lines that each range of each file holds; a stream of the same format gives those of
new files. A range is read with the byte before it and three behind it. That is enough to tell which characters and line ends
begin in it: a character or a CRLF that runs over a border belongs to the range where it begins. So ranges know nothing of each other, and no task
holds a file; large files are split and small ones read together.

``assembled`` numbers the lines by a scan over the ranges' counts and puts together those that run over borders; only their pieces are grouped.
"""

from __future__ import annotations

import fnmatch
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from lexiloom.checkpoints import shared_table
from lexiloom.functions.text import LINE_END

FORMAT = "numbered_text"
#: Pieces of a file's range, numbered from 0; ``sound`` is false, and the text null, where the range is no UTF-8.
PIECES = "path string, range long, piece int, pieces int, sound boolean, text string"
RANGE_BYTES = 1 << 25
_NAMES = [f.split()[0] for f in PIECES.split(", ")]
_ENDS = re.compile(LINE_END)
_ROWS = 4096


def _is_inner(byte: bytes) -> bool:
    """A byte that no UTF-8 character begins with."""
    return len(byte) == 1 and byte[0] & 0xC0 == 0x80


def range_pieces(read: Callable[[int, int], bytes], size: int, at: int, length: int) -> list[str] | None:
    """Texts between the line ends that begin in a range of a file; None if it is no UTF-8. ``read`` takes a place and a number of bytes."""
    low = max(0, at - 1)
    data = read(low, min(size, at + length + 3) - low)

    def border(place: int) -> int:
        """Where the first character at or behind a place of the file begins; the file's own ends are borders."""
        k = place - low
        if 0 < place < size:
            for _ in range(3):
                k += _is_inner(data[k : k + 1])
        return k

    first, last = border(at), border(min(size, at + length))
    try:
        text = data[first:last].decode()
    except UnicodeDecodeError:
        return None
    if text[:1] == "\n" and first > 0 and data[first - 1 : first] == b"\r":
        text = text[1:]  # its line end began before
    return _ENDS.split(text)


@dataclass(frozen=True)
class _Range:
    path: str
    size: int
    number: int
    at: int
    length: int


class Ranges(InputPartition):
    """Byte ranges that one task reads."""

    def __init__(self, ranges: list[_Range]):
        super().__init__(0)
        self.ranges = ranges


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address, and the path in it; without a scheme it is a local one."""
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]+:", path) else (fs.LocalFileSystem(), path)


def listed(path: str) -> list[tuple[int, str, int]]:
    """(time of change, address, bytes) of a file, of a folder's files or of those that fit a pattern; hidden ones are left out."""
    head, _, tail = path.rstrip("/").rpartition("/")
    pattern = tail if set("*?[") & set(tail) else None
    base = path if pattern is None else head or "."
    store, root = store_of(base)
    # Addresses of files begin as that of their folder does.
    prefix = base[: -len(root)] if base.endswith(root) else ""
    top = store.get_file_info(root)
    if top.type == fs.FileType.NotFound:
        raise FileNotFoundError(f"PATH_NOT_FOUND: {path}")
    found = [top] if top.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root))
    fit = lambda f: f is top or (not f.base_name.startswith(("_", ".")) and (pattern is None or fnmatch.fnmatchcase(f.base_name, pattern)))
    return sorted((f.mtime_ns or 0, prefix + f.path, f.size) for f in found if f.type == fs.FileType.File and fit(f))


def planned(files: list[tuple[int, str, int]], range_bytes: int) -> list[Ranges]:
    """Ranges of all files, dealt out by ``range_bytes`` at most to a task."""
    out: list[Ranges] = []
    held: list[_Range] = []
    room = range_bytes
    for _, path, size in files:
        for number in range(max(1, -(-size // range_bytes))):
            at = number * range_bytes
            own = _Range(path, size, number, at, min(range_bytes, size - at))
            if held and own.length > room:
                out.append(Ranges(held))
                held, room = [], range_bytes
            held.append(own)
            room -= max(own.length, 4096)  # a file costs its opening
    return [*out, Ranges(held)] if held else out


def read_ranges(partition: Ranges) -> Iterator[pa.RecordBatch]:
    """Pieces of a partition's ranges; a file is opened once for what stands together of it."""
    kinds = pa.schema([("path", pa.string()), ("range", pa.int64()), ("piece", pa.int32()), ("pieces", pa.int32()), ("sound", pa.bool_()), ("text", pa.string())])
    for own in partition.ranges:
        store, inner = store_of(own.path)
        with store.open_input_file(inner) as file:
            pieces = range_pieces(lambda place, n, file=file: file.read_at(n, place), own.size, own.at, own.length)
        texts = [None] if pieces is None else pieces
        for a in range(0, len(texts), _ROWS):
            some = texts[a : a + _ROWS]
            n = len(some)
            yield pa.RecordBatch.from_arrays(
                [pa.array([own.path] * n), pa.array([own.number] * n, pa.int64()), pa.array(range(a, a + n), pa.int32()), pa.array([len(texts)] * n, pa.int32()), pa.array([pieces is not None] * n), pa.array(some, pa.string())], schema=kinds
            )


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.range_bytes = options["path"], int(options.get("range_bytes", RANGE_BYTES))

    def partitions(self) -> list[Ranges]:
        return planned(listed(self.path), self.range_bytes) or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        return read_ranges(partition)


class _StreamReader(_Reader, DataSourceStreamReader):
    """Files in the order of their changes; an offset is the last one read. A file counts once it is in the folder, so writers move whole files there."""

    def initialOffset(self) -> dict:  # noqa: N802
        return {"changed": -1, "path": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        files = listed(self.path)
        return {"changed": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        low, high = ((o["changed"], o["path"]) for o in (start, end))
        return planned([f for f in listed(self.path) if low < (f[0], f[1]) <= high], self.range_bytes)

    def commit(self, end: dict) -> None:
        json.dumps(end)  # nothing is kept but the offset itself


class NumberedText(DataSource):
    """Options: ``path`` (a file, a folder, or a pattern in one), ``range_bytes``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return PIECES

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema: object) -> DataSourceStreamReader:  # noqa: N802
        return _StreamReader(self.options)


def pieces(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    spark.dataSource.register(NumberedText)
    return spark.read.format(FORMAT).option("range_bytes", range_bytes).load(path)


def piece_stream(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    spark.dataSource.register(NumberedText)
    return spark.readStream.format(FORMAT).option("range_bytes", range_bytes).option("path", folder).load()


def assembled(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines, files) of pieces: (path, at, text), numbered from 0 in their file, and (path, sound) of every file."""
    held = shared_table(found, "pieces")
    ranges = held.groupBy("path", "range").agg((F.max("pieces") - 1).alias("ends"), F.min("sound").alias("sound"))
    before = Window.partitionBy("path").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    earlier = ranges.select("path", "range", F.coalesce(F.sum("ends").over(before), F.lit(0)).alias("earlier"))
    files = ranges.groupBy("path").agg(F.min("sound").alias("sound"), F.sum("ends").alias("ends"))
    placed = held.join(earlier, ["path", "range"]).select("path", (F.col("earlier") + F.col("piece")).cast("int").alias("at"), "range", "text", ((F.col("piece") == 0) | (F.col("piece") == F.col("pieces") - 1)).alias("edge"))
    inner = placed.filter(~F.col("edge")).select("path", "at", "text")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("range", "text"))), lambda x: x["text"]), "")
    lines = inner.unionByName(placed.filter("edge").groupBy("path", "at").agg(joined.alias("text")))
    # A line end at the very end opens no further line.
    final = lines.join(files.select("path", F.col("ends").cast("int").alias("at"), F.lit(True).alias("final")), ["path", "at"], "left")
    return final.filter(~(F.coalesce("final", F.lit(False)) & (F.col("text") == ""))).select("path", "at", "text"), files.select("path", "sound")
