"""Substring deduplication by content-defined chunking.

A gear rolling hash over the UTF-8 bytes proposes cuts that depend only on the 16 bytes before
them, so an insertion shifts no later chunk. The hash is evaluated for all bytes of an Arrow batch at
once: h(i) = sum of gear[byte(i-k)] << k is built by doubling the window (1, 2, 4, 8, 16 bytes). A cut
moves on behind the next white space (space, U+0009 to U+000D) where that is near, so that words are not split, else to the
next character's start, so text of scripts without spaces is cut by its content as well. Chunks meet by a 128-bit digest; the
row with the smallest doc_id keeps a chunk, every later one is a repeat. Repeats are removed in runs: a run of
neighbouring repeated chunks goes when it holds at least ``min_run_words`` words or ``min_run_bytes`` bytes, so that short
phrases that happen to recur stay.

A task compares chunks on its own first and leaves one row of each digest to be compared with other tasks, so a
passage that a third of all documents share is one row for each task (or ``held_chunks`` of one), rows that a task finds to repeat are spread by
their own ranks, and the chunk table is shuffled once. Texts
are cut up again in the Arrow batches that bring them together with their repeats.

Defined results: a null text stays null and an empty one empty, with no chunks; rows that share doc_id
share its rank, so identical rows get identical results; rows without a doc_id rank after all others, among themselves by
a 63-bit digest of their texts, so of different ones with a common passage one keeps it; an empty
table gives an empty result. Columns of the input travel in a struct and never clash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.llm.common import table


@dataclass(frozen=True)
class ChunkParams:
    """Sizes in bytes; a cut is proposed once in 2**mask_bits bytes."""

    min_bytes: int = 16
    max_bytes: int = 256
    mask_bits: int = 4
    gear_seed: int = 7
    #: A task compares chunks on its own until it holds so many digests.
    held_chunks: int = 400_000
    #: Repeats are removed in runs of at least so many words, or bytes (for scripts without spaces).
    min_run_words: int = 20
    min_run_bytes: int = 256
    #: How far a cut may move to the next white space.
    reach: int = 64


DEFAULTS = ChunkParams()
_WINDOW = 16
#: An odd number, by which ranks are spread.
_SPREAD = np.int64(0x9E3779B97F4A7C15 - (1 << 64))


@cache
def gear_table(seed: int = DEFAULTS.gear_seed) -> np.ndarray:
    """256 pseudo-random words: XXH64 of each byte under the seed."""
    return np.array([xxhash.xxh64_intdigest(bytes([b]), seed) & 0xFFFFFFFF for b in range(256)], np.uint32)


def gear_hash(data: np.ndarray, seed: int = DEFAULTS.gear_seed) -> np.ndarray:
    """The gear hash of the last 16 bytes at every position (fewer at the start), in its low 16 bits."""
    h = gear_table(seed)[data]
    width = 1
    while width < _WINDOW:
        h[width:] += h[:-width] << np.uint32(width)
        width *= 2
    return h & np.uint32(0xFFFF)


def _proposals(data: np.ndarray, p: ChunkParams) -> np.ndarray:
    """Sorted positions after which a chunk may end: behind the white space next to a mark, or the next character's start."""
    # The top bits of the 16 depend on the whole window.
    mask = np.uint32(((1 << p.mask_bits) - 1) << (_WINDOW - p.mask_bits))
    marks = np.flatnonzero((gear_hash(data, p.gear_seed) & mask) == 0)
    if not len(marks):
        return marks
    gaps = np.append(np.flatnonzero((data == 32) | (data - np.uint8(9) < 5)), len(data) + p.reach + 1)
    gap = gaps[np.searchsorted(gaps, marks)]
    near = gap - marks <= p.reach
    cuts = np.where(near, gap, marks) + 1
    lone = np.flatnonzero(~near)
    for _ in range(3):  # a character has four bytes at most
        at = cuts[lone]
        lone = lone[(at < len(data)) & (data[np.minimum(at, len(data) - 1)] & 0xC0 == 0x80)]
        cuts[lone] += 1
    return np.unique(cuts)


def _char_end(data: np.ndarray, end: int) -> int:
    """``end`` moved back to the start of a character."""
    while data[end] & 0xC0 == 0x80:
        end -= 1
    return end


def chunk_ends(data: np.ndarray, p: ChunkParams = DEFAULTS, cuts: np.ndarray | None = None) -> list[int]:
    """Ends of the chunks of one text. No chunk but the last is under ``min_bytes``; none is over ``max_bytes``."""
    cuts = _proposals(data, p) if cuts is None else cuts
    ends, start = [], 0
    for cut in cuts.tolist():
        while cut - start > p.max_bytes:
            start = _char_end(data, start + p.max_bytes)
            ends.append(start)
        if cut - start >= p.min_bytes:
            ends.append(cut)
            start = cut
    while len(data) - start > p.max_bytes:
        start = _char_end(data, start + p.max_bytes)
        ends.append(start)
    if start < len(data):
        ends.append(len(data))
    return ends


def _texts(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()


def chunks_of(text: bytes, p: ChunkParams = DEFAULTS) -> tuple[list[int], list[bytes]]:
    """(ends, digests) of one text."""
    ends = chunk_ends(np.frombuffer(text, np.uint8), p)
    digest = xxhash.xxh3_128_digest
    return ends, [digest(text[a:b]) for a, b in zip([0, *ends], ends, strict=False)]


def text_key(text: bytes | None) -> int:
    """63 bits that tell texts apart."""
    return 0 if text is None else xxhash.xxh3_64_intdigest(text) >> 1


def repeat_runs(ends: list[int], repeated: Iterable[bool], text: bytes, p: ChunkParams = DEFAULTS) -> list[tuple[int, int]]:
    """(start, length) in bytes of the runs of repeated chunks that are long enough to go."""
    runs, start, run = [], 0, None
    for end, again in zip([*ends, None], [*repeated, False], strict=True):
        if again and run is None:
            run = start
        elif not again and run is not None:
            if start - run >= p.min_run_bytes or len(text[run:start].split()) >= p.min_run_words:
                runs.append((run, start - run))
            run = None
        start = end
    return runs


_CHUNK_COLUMNS = "d1 long, d2 long, none boolean, rank long, key long, number int, repeat boolean"


def chunk_table(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: ChunkParams = DEFAULTS) -> DataFrame:
    """(d1, d2, none, rank, key, number, repeat): chunks by digest; ``none`` and ``rank`` order the rows, ``key`` tells texts of one rank apart.

    A task knows that a chunk repeats if it has met the digest in the same text or under a smaller rank. Such rows are
    marked; of each digest only the row with the smallest rank is left to be compared with other tasks.
    """
    names = [c.split()[0] for c in _CHUNK_COLUMNS.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple[bool, int, int, int]] = {}
        marked: set[tuple[bool, int, int, int]] = set()
        # Rows of one rank that hold a digest: (digest, place); each text of theirs once.
        equals: set[tuple[bytes, tuple[bool, int, int, int]]] = set()

        def out(digests: np.ndarray, rows: Iterable[tuple[bool, int, int, int]], repeat: bool) -> pa.RecordBatch:
            none, rank, key, number = np.array(list(rows), np.int64).reshape(-1, 4).T
            columns = [digests[:, 0].copy(), digests[:, 1].copy(), none.astype(bool), rank.copy(), key.copy(), number.astype(np.int32), np.full(len(rank), repeat)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                yield out(np.frombuffer(b"".join(held.keys()), np.int64).reshape(-1, 2), held.values(), False)
                held.clear()
            if equals:
                yield out(np.frombuffer(b"".join(d for d, _ in equals), np.int64).reshape(-1, 2), [m for _, m in equals], False)
                equals.clear()

        for b in batches:
            for rank, text in zip(b.column(0).to_pylist(), _texts(b.column(1)), strict=True):
                if not text:
                    continue
                key, seen = text_key(text), set()
                place = (False, rank) if rank is not None else (True, key)
                for number, digest in enumerate(chunks_of(text, p)[1]):
                    mine = (*place, key, number)
                    before = held.get(digest)
                    if digest in seen:
                        marked.add(mine)
                        continue
                    seen.add(digest)
                    if before is None:
                        held[digest] = mine
                    elif before[:2] < place:
                        marked.add(mine)
                    elif before[:2] > place:
                        marked.add(before)
                        held[digest] = mine
                    elif before != mine:  # another row with this rank: neither repeats the other
                        equals.add((digest, mine))
            if marked:
                # No other chunk is looked for: they are spread by rank and number, so that copies of one text part.
                spread = np.array(list(marked), np.int64)
                apart = spread[:, 1] * _SPREAD + spread[:, 3]
                yield out(np.stack((apart, spread[:, 2]), axis=1), list(marked), True)
                marked.clear()
            if len(held) + len(equals) >= p.held_chunks:
                yield from flush()
        yield from flush()

    return df.select(F.col(f"`{id_col}`").cast("long").alias("rank"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, _CHUNK_COLUMNS)


def repeated_chunks(chunks: DataFrame) -> DataFrame:
    """(none, rank, key, repeats): numbers of the chunks of each text that an earlier document or place holds."""
    # A digest has one row from each task (or each ``held_chunks`` of one), however many documents hold it.
    spot = F.struct("none", "rank")
    owner = F.min(F.when(~F.col("repeat"), spot)).over(Window.partitionBy("d1", "d2"))
    repeated = chunks.withColumn("owner", owner).filter(F.col("repeat") | (spot > F.col("owner")))
    # A set, as rows that repeat with doc_id and text name the same chunks again; bounded by one text's chunks.
    return repeated.groupBy("none", "rank", "key").agg(F.collect_set("number").alias("repeats"))


def dedup_substrings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: ChunkParams = DEFAULTS) -> DataFrame:
    """``row`` (the input columns), ``kept_text``, ``spans`` (removed byte ranges), ``n_chunks``, ``n_repeats``, ``removed_bytes``."""
    repeats = repeated_chunks(chunk_table(df, id_col, text_col, p))

    def keyed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = pa.array([text_key(t) for t in _texts(b.column("text"))], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, keys], [*b.schema.names, "key"])

    own_id = F.col(f"`{id_col}`").cast("long").alias("own_id")
    others = [F.col(f"`{c}`") for c in df.columns if c != text_col] or [F.lit(0).alias("none")]
    rows = df.select(F.struct(*others).alias("rest"), own_id, F.col(f"`{text_col}`").cast("string").alias("text"))
    rest = rows.schema["rest"].dataType
    schema = T.StructType([*rows.schema.fields, T.StructField("key", T.LongType())])
    ranked = rows.mapInArrow(keyed, schema).select("rest", "text", "key", F.col("own_id").isNull().alias("none"), F.coalesce("own_id", "key").alias("rank"))
    joined = ranked.join(repeats, ["none", "rank", "key"], "left").select("rest", "text", "repeats")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, spans, n_chunks, n_repeats, removed = [], [], [], [], []
            for text, numbers in zip(_texts(b.column("text")), b.column("repeats").to_pylist(), strict=True):
                ends = chunk_ends(np.frombuffer(text, np.uint8), p) if text else []
                gone = set(numbers or ())
                runs = repeat_runs(ends, [k in gone for k in range(len(ends))], text, p) if gone else []
                parts, at = [], 0
                for start, length in runs:
                    parts.append(text[at:start])
                    at = start + length
                kept.append(None if text is None else text if not runs else b"".join([*parts, text[at:]]))
                spans.append([{"start": s, "length": n} for s, n in runs])
                n_chunks.append(len(ends))
                n_repeats.append(len(gone))
                removed.append(sum(n for _, n in runs))
            span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [b.column("rest"), pa.array(kept, pa.large_binary()).cast(pa.large_string()).cast(pa.string()), pa.array(spans, span), *(pa.array(x, pa.int64()) for x in (n_chunks, n_repeats, removed))],
                ["rest", "kept_text", "spans", "n_chunks", "n_repeats", "removed_bytes"],
            )

    longs = [T.StructField(name, T.LongType()) for name in ("n_chunks", "n_repeats", "removed_bytes")]
    spans = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]))
    out = T.StructType([T.StructField("rest", rest), T.StructField("kept_text", T.StringType()), T.StructField("spans", spans), *longs])
    return joined.mapInArrow(cut, out)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that earlier documents hold, and where they were."""
    found = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("rest.doc_id", F.col("kept_text").alias("text"), "n_chunks", "removed_bytes", "spans")
