"""Best-fit packing by linear grouping.

A document's ids and one end id form a sequence; longer ones than ``capacity`` are cut into pieces.
Packing needs only how many pieces have each length, at most ``capacity`` numbers however large
the corpus is, so it is solved on the driver in bounded memory:

1. large lengths are sorted and rounded up within ``groups`` groups of equal cardinality;
2. the few rounded sizes are packed by configurations: a linear program, solved by column generation
   with a knapsack for pricing, of whose basis a share is opened in whole copies;
3. actual lengths take the places of the rounded ones, so each sequence gets its true free room;
4. what is left of the large pieces, then all small ones, longest first, go where they fit best.

Sequences of equal make-up stay one run (first sequence, count), so the plan holds some thousand runs.
Pieces are numbered within their length without gaps from counts by input partition, and find their
sequence by a broadcast join with the plan: length equal, number within the run.

Defined results: a null text counts as empty, and a document without ids is its end id alone; repeated
rows are packed as often as they occur; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom.llm.common import materialise, table
from lexiloom.llm.tokens import default_path, encoder

VOCABULARY = "byte_bpe_50k.json"
CAPACITY, END_ID, GROUPS = 2048, 0, 64
#: Share of the configured sequences that is opened; the rest would stay part empty, since rounding up asks for too many.
CONFIGURED = 0.95


@dataclass(frozen=True)
class Run:
    """Pieces of one length: piece ``first + k`` lies in sequence ``sequence + k`` at ``offset``, for k below ``count``."""

    length: int
    first: int
    count: int
    sequence: int
    offset: int


def linear_groups(sizes: list[tuple[int, int]], groups: int = GROUPS) -> list[tuple[int, list[tuple[int, int]]]]:
    """(length, count) in falling order -> (rounded length, its (length, count)) with equal counts."""
    share = max(1, -(-sum(n for _, n in sizes) // groups))
    out: list[tuple[int, list[tuple[int, int]]]] = []
    room = 0
    for length, n in sizes:
        while n:
            if not room:
                out.append((length, []))
                room = share
            take = min(n, room)
            out[-1][1].append((length, take))
            n, room = n - take, room - take
    merged: dict[int, list[tuple[int, int]]] = defaultdict(list)  # groups of one rounded length are one size
    for length, items in out:
        merged[length] += items
    return sorted(merged.items(), reverse=True)


def configurations(lengths: np.ndarray, demand: np.ndarray, capacity: int = CAPACITY, rounds: int = 3000) -> list[tuple[np.ndarray, float]]:
    """Basis of the configuration program: (pieces of each size in a sequence, number of sequences)."""
    k = len(lengths)
    most = capacity // lengths
    columns = np.diag(most).astype(float)
    inverse = np.diag(1.0 / most)
    amount = inverse @ demand
    deepest = int(most.max())
    for turn in range(rounds):
        duals = inverse.sum(axis=0)
        # best[n, w]: largest value of at most n pieces within w
        best = np.zeros((deepest + 1, capacity + 1))
        choice = np.full((deepest + 1, capacity + 1), -1, np.int32)
        for n in range(1, deepest + 1):
            best[n] = best[n - 1]
            for g in np.flatnonzero(duals > 1e-12):
                value = best[n - 1, : capacity + 1 - lengths[g]] + duals[g]
                at = best[n, lengths[g] :]
                better = value > at + 1e-15
                at[better] = value[better]
                choice[n, lengths[g] :][better] = g
        if best[deepest, capacity] <= 1 + 1e-7:
            break
        column, w = np.zeros(k), capacity
        for n in range(deepest, 0, -1):
            if (g := choice[n, w]) >= 0:
                column[g] += 1
                w -= lengths[g]
        step = inverse @ column
        ratio = np.where(step > 1e-10, amount / np.where(step > 1e-10, step, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        columns[:, out] = column
        if turn % 50 == 49:
            inverse = np.linalg.inv(columns)
        else:
            pivot = inverse[out] / step[out]
            inverse = inverse - np.outer(step, pivot)
            inverse[out] = pivot
        amount = np.maximum(inverse @ demand, 0)
    return [(columns[:, j].astype(int), float(amount[j])) for j in range(k)]


class _Plan:
    def __init__(self, capacity: int):
        self.capacity = capacity
        self.runs: list[Run] = []
        self.sequences = 0
        self.taken: dict[int, int] = defaultdict(int)
        self.open: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free room -> (first sequence, count)

    def place(self, length: int, count: int, sequence: int, offset: int) -> None:
        self.runs.append(Run(length, self.taken[length], count, sequence, offset))
        self.taken[length] += count

    def leave(self, room: int, sequence: int, count: int) -> None:
        if count and room:
            self.open[room].append((sequence, count))

    def new(self, count: int) -> int:
        self.sequences += count
        return self.sequences - count

    def best_fit(self, length: int, count: int) -> None:
        """Put pieces where the least room is left; sequences of one make-up are filled together."""
        while count:
            room = min((r for r, found in self.open.items() if found and r >= length), default=None)
            if room is None:
                fit = self.capacity // length
                self.open[self.capacity].append((self.new(-(-count // fit)), -(-count // fit)))
                room = self.capacity
            sequence, n = self.open[room].pop()
            fit = room // length
            full, rest = divmod(count, fit)
            if full >= n:
                full, rest = n, 0
            for k in range(fit if full else 0):
                self.place(length, full, sequence, self.capacity - room + k * length)
            self.leave(room - fit * length, sequence, full)
            used = full
            if rest:
                for k in range(rest):
                    self.place(length, 1, sequence + full, self.capacity - room + k * length)
                self.leave(room - rest * length, sequence + full, 1)
                used += 1
            self.leave(room, sequence + used, n - used)
            count -= full * fit + rest


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> tuple[list[Run], int]:
    """(runs, number of sequences) for so many pieces of each length."""
    plan = _Plan(capacity)
    if n := counts.get(capacity, 0):
        plan.place(capacity, n, plan.new(n), 0)
    sizes = sorted(((length, n) for length, n in counts.items() if length < capacity and n), reverse=True)
    small = capacity // 8
    large = [(length, n) for length, n in sizes if length > small]
    left = dict(sizes)
    if large:
        grouped = linear_groups(large, groups)
        pools = [[list(item) for item in items] for _, items in grouped]
        demand = np.array([sum(n for _, n in items) for _, items in grouped], float)
        for column, amount in configurations(np.array([length for length, _ in grouped]), demand, capacity):
            copies = int(amount * CONFIGURED + 1e-6)
            if not copies:
                continue
            base = plan.new(copies)
            segments = [(0, copies, 0)]  # (first, count, used) within the copies
            *earlier, _ = [g for g in np.flatnonzero(column) for _ in range(column[g])]
            for g in earlier:
                segments = _substitute(plan, base, segments, pools[g], left)
            segments = _close(plan, base, segments, left, small)
            for first, count, used in segments:
                plan.leave(capacity - used, base + first, count)
    for length, _ in sizes:
        plan.best_fit(length, left[length])
    return plan.runs, plan.sequences


def _substitute(plan: _Plan, base: int, segments: list[tuple[int, int, int]], pool: list[list[int]], left: dict[int, int]) -> list[tuple[int, int, int]]:
    """Give each of the sequences one actual piece of the pool, longest first; stop where the pool is empty."""
    out = []
    for first, count, used in segments:
        while count:
            while pool and not min(pool[0][1], left[pool[0][0]]):
                pool.pop(0)
            if not pool:
                out.append((first, count, used))
                break
            length = pool[0][0]
            take = min(pool[0][1], left[length], count)
            plan.place(length, take, base + first, used)
            left[length] -= take
            pool[0][1] -= take
            out.append((first, take, used + length))
            first, count = first + take, count - take
    return out


def _close(plan: _Plan, base: int, segments: list[tuple[int, int, int]], left: dict[int, int], small: int) -> list[tuple[int, int, int]]:
    """The last place of a configuration takes the longest actual large piece that fits, as the others were rounded up."""
    out = []
    for first, count, used in segments:
        while count:
            length = next((n for n in range(plan.capacity - used, small, -1) if left.get(n)), None)
            if length is None:
                out.append((first, count, used))
                break
            take = min(left[length], count)
            plan.place(length, take, base + first, used)
            left[length] -= take
            if plan.capacity - used - length > small:
                out += _close(plan, base, [(first, take, used + length)], left, small)
            else:
                out.append((first, take, used + length))
            first, count = first + take, count - take
    return out


def cut_pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): every document's ids, cut where longer than ``capacity``."""
    path = path or default_path(VOCABULARY)
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for b in batches:
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for r, text in enumerate(b.column(1).to_pylist()):
                data = own.encode_bytes(text or "") + end
                n = len(data) // 4
                cuts = [0, *range(n % capacity or capacity, n, capacity), n]
                for k, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    row.append(r)
                    piece.append(k)
                    start.append(a)
                    length.append(z - a)
                    crc.append(zlib.crc32(data[4 * a : 4 * z]))
                    if with_ids:
                        ids.append(np.frombuffer(data[4 * a : 4 * z], "<i4"))
            columns = [b.column(0).take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def numbered(df: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` (written once) with ``number``: gapless from 0 within each value of ``key``.

    Rows are numbered within (key, input partition) and shifted by the counts of earlier partitions, so no task
    holds more of a key than one input partition had.
    """
    fixed = materialise(df.withColumn("at", F.monotonically_increasing_id()), name).withColumn("part", F.shiftright("at", 33))
    counts = fixed.groupBy(key, "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(key, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    own = F.row_number().over(Window.partitionBy(key, "part").orderBy("at")) - 1
    ranked = fixed.withColumn("own", own)
    return ranked.join(offsets, [key, "part"]).withColumn("number", F.col("own") + F.col("shift")).drop("own", "shift", "part", "at")


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, groups: int = GROUPS, with_ids: bool = False) -> DataFrame:
    """Every piece with its ``sequence_id`` and ``offset``."""
    spark = df.sparkSession
    pieces = numbered(cut_pieces(df, id_col, text_col, path, capacity, with_ids), "length", "pieces")
    # Bounded: one row for each length up to the capacity.
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs, _ = plan_packing(counts, capacity, groups)
    plan = spark.createDataFrame([(r.length, r.first, r.first + r.count, r.sequence, r.offset) for r in runs], "length long, first long, behind long, sequence long, offset long")
    # Bounded by the lengths and groups, not by the corpus (see the module's text).
    joined = pieces.join(F.broadcast(plan), "length").filter((F.col("number") >= F.col("first")) & (F.col("number") < F.col("behind")))
    return joined.withColumn("sequence_id", F.col("sequence") + F.col("number") - F.col("first")).drop("number", "first", "behind", "sequence")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in sequences of 2,048 tokens."""
    return pack(table(spark, sf_dir, "documents")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
