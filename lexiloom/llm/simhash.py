"""SimHash near-duplicate detection with bit-sliced comparison.

Fingerprints are computed in Arrow batches. Equal fingerprints become one class first, so copies
cost nothing further. Two fingerprints within ``radius`` bits agree on at least
``blocks - radius`` of ``blocks`` bit blocks, so classes meet in cells keyed by every choice of
that many blocks: no link is lost. A cell above ``cell_rows`` is cut into parts that meet pairwise, so
no task holds an unbounded group. Inside a cell, fingerprints lie as vertical bit planes: one
uint64 word holds one bit of 64 candidates, distances of all of them are counted in carry-save
bitwise counters, and a word is abandoned once all its candidates exceed the radius. A cell emits
a star for each group it finds, never all pairs; components follow in ``graph``.

Defined results: null and empty texts have fingerprint zero and link like any other; rows without an id
take part, and a component's id is null only if no row in it has one; repeated rows are returned
as often as they occur; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.common import materialise, table
from lexiloom.llm.graph import star_forest

SHINGLE = 4
RADIUS = 4
SEED = 42
CELL_ROWS = 4096
#: Shingles whose bits are counted at once, and queries compared at once.
_CHUNK, _BATCH, _SMALL = 65_536, 256, 256


def fingerprint(text: bytes | None, width: int = SHINGLE) -> int:
    """Majority bits of the XXH64 values of all word shingles; zero without words."""
    words = (text or b"").lower().split()  # bytes: only A-Z change and only U+0009-U+000D and space part words
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    last = ends[width - 1 :] if len(words) >= width else ends[-1:]
    for at in range(0, n, _CHUNK):
        spans = zip(starts[at : min(n, at + _CHUNK)].tolist(), last[at : at + _CHUNK].tolist(), strict=True)
        values = np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)
        counts += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) for every row; fp holds the unsigned value's bits in a long."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = np.array([fingerprint(t, width) for t in b.column(1).cast(pa.large_binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(values.view(np.int64))], ["doc_id", "fp"])

    kept = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return kept.mapInArrow(run, "doc_id long, fp long")


def _bits(values: np.ndarray) -> np.ndarray:
    """(64, n) of 0 and 1."""
    return np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T


def _planes(bits: np.ndarray) -> np.ndarray:
    """(64, words): bit i of word w in plane b is bit b of candidate 64 w + i."""
    n = bits.shape[1]
    words = -(-n // 64)
    padded = np.zeros((64, words * 64), np.uint8)
    padded[:, :n] = bits
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


def within(queries: np.ndarray, candidates: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (query, candidate) at most ``radius`` bits apart, by bit-sliced carry-save counting."""
    none = np.zeros(0, np.int64)
    if not len(queries) or not len(candidates):
        return none, none
    planes = _planes(_bits(candidates))
    flips = _bits(queries).astype(bool)
    n_words = planes.shape[1]
    at_q, at_w = np.divmod(np.arange(len(queries) * n_words), n_words)
    # counters[k] holds the distances' bits of weight 2 ** k; ``over`` marks those that passed them all.
    depth = max(3, radius.bit_length())
    counters = [np.zeros(len(at_q), np.uint64) for _ in range(depth)]
    over = np.zeros(len(at_q), np.uint64)
    # Bits on which the candidates differ most come first, so that blocks are abandoned early.
    order = np.argsort(np.abs(_bits(candidates).mean(axis=1) - 0.5), kind="stable")
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    for at in range(0, 64, 4):
        x = [planes[b][at_w] ^ np.where(flips[b][at_q], ones, np.uint64(0)) for b in order[at : at + 4]]
        c0, c1, *higher = counters
        u = c0 ^ x[0]
        carry_a = (c0 & x[0]) | (u & x[1])
        c0 = u ^ x[1]
        u = c0 ^ x[2]
        carry_b = (c0 & x[2]) | (u & x[3])
        c0 = u ^ x[3]
        u = c1 ^ carry_a
        carry = (c1 & carry_a) | (u & carry_b)
        c1 = u ^ carry_b
        counters = [c0, c1]
        for c in higher:
            counters.append(c ^ carry)
            carry = c & carry
        over |= carry
        above, level = over.copy(), np.full(len(over), ones)
        for k in reversed(range(depth)):
            if radius >> k & 1:
                level &= counters[k]
            else:
                above |= level & counters[k]
                level &= ~counters[k]
        if at >= 12:
            alive = above != ones
            if not alive.all():
                at_q, at_w, over, above, *counters = (v[alive] for v in (at_q, at_w, over, above, *counters))
                if not len(at_q):
                    return none, none
    lanes = np.unpackbits((~above).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    i, lane = np.nonzero(lanes)
    j = at_w[i] * 64 + lane
    real = j < len(candidates)
    return at_q[i][real], j[real]


class _Groups:
    """Union-find over one cell; ``label`` always holds each member's root."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def merge(self, a: np.ndarray, b: np.ndarray) -> None:
        pairs = np.stack((self.label[a], self.label[b]))
        pairs = pairs[:, pairs[0] != pairs[1]]
        if not pairs.shape[1]:
            return
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = y
            return x

        for x, y in np.unique(pairs, axis=1).T.tolist():
            x, y = root(x), root(y)
            if x != y:
                up[max(x, y)] = min(x, y)
        target = np.arange(len(self.label))
        for x in list(up):
            target[x] = root(x)
        self.label = target[self.label]


def link_cell(left: np.ndarray, right: np.ndarray | None, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (value, smallest value) of the groups that links inside a cell form.

    ``right`` None: all of ``left`` with each other; else only ``left`` with ``right``. Each pair
    is compared once, and members of a group found already are not compared with each other: a
    dense group costs little more than reading it.
    """
    values = left if right is None else np.concatenate((left, right))
    n = len(left)
    groups = _Groups(len(values))
    open_q = np.ones(n, bool)  # not yet asked
    while open_q.any():
        waiting = np.flatnonzero(open_q)
        roots, sizes = np.unique(groups.label[waiting], return_counts=True)
        biggest = roots[sizes.argmax()] if sizes.max() > min(_BATCH, len(waiting) // 4) else None
        asked = waiting[groups.label[waiting] == biggest] if biggest is not None else waiting
        asked = asked[:_BATCH]
        lanes = waiting if right is None else np.arange(n, len(values))
        if biggest is not None:
            lanes = lanes[groups.label[lanes] != biggest]
            if not len(lanes):
                open_q &= groups.label[:n] != biggest
                continue
        i, j = within(values[asked], values[lanes], radius)
        groups.merge(asked[i], lanes[j])
        open_q[asked] = False
    smallest = np.full(len(values), np.iinfo(np.int64).max)
    signed = values.view(np.int64)
    np.minimum.at(smallest, groups.label, signed)
    to = smallest[groups.label]
    own = to != signed
    return signed[own], to[own]


def _block_masks(blocks: int) -> list[tuple[int, int]]:
    """(first bit, width) of each of ``blocks`` near-equal blocks."""
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def choose_blocks(n_classes: int, radius: int = RADIUS, cell_rows: int = CELL_ROWS) -> int:
    """Fewest blocks whose cells stay under ``cell_rows`` on average; exact for any choice."""
    for blocks in range(radius + 1, 2 * radius + 1):
        if n_classes >> ((64 // blocks) * (blocks - radius)) <= cell_rows // 2:
            return blocks
    return 2 * radius


def split_cells(keyed: DataFrame, member: str, cell_rows: int = CELL_ROWS, weight: Column | None = None) -> DataFrame:
    """Rows with a ``key``, dealt out cell by cell with ``i``, ``j`` and ``right``.

    A cell above ``cell_rows`` (rows, or sums of their ``weight``) is cut by a hash of its ``member`` into parts that meet pairwise: in (i, i) a part meets itself, in
    (i, j) only the rows with ``right`` meet those without. So each pair of members meets exactly once.
    """
    hot = keyed.groupBy("key").agg(F.sum(F.lit(1.0) if weight is None else weight).alias("n")).filter(F.col("n") > cell_rows).select("key", F.ceil(F.col("n") / cell_rows).cast("int").alias("parts"))
    split = keyed.join(hot, "key", "left").withColumn("part", F.pmod(F.xxhash64(member), F.col("parts")).cast("int"))
    cells = F.when(F.col("parts").isNull(), F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least("part", j).alias("i"), F.greatest("part", j).alias("j")))
    )
    placed = split.select(*keyed.columns, "part", F.explode(cells).alias("c")).select(*keyed.columns, "c.i", "c.j", (F.coalesce("part", F.lit(0)) != F.col("c.i")).alias("right"))
    return placed.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def links(classes: DataFrame, radius: int = RADIUS, blocks: int | None = None, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Edges (u, v) that connect all fingerprints ``classes.fp`` within ``radius`` bits, directly or by way of others."""
    n = classes.count()
    blocks = blocks or choose_blocks(n, radius, cell_rows)
    parts = _block_masks(blocks)
    keys = [F.concat_ws("-", F.lit(str(t)), *[F.shiftrightunsigned("fp", parts[b][0]).bitwiseAND(F.lit((1 << parts[b][1]) - 1)).cast("string") for b in chosen]) for t, chosen in enumerate(combinations(range(blocks), blocks - radius))]
    keyed = classes.select("fp", F.explode(F.array(*keys)).alias("key")).select("fp", F.xxhash64("key").alias("key"))
    dealt = split_cells(keyed, "fp", cell_rows)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pooled: list[np.ndarray] = []  # small cells are compared together: what they link across cells is a true link too

        def out(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        def flush() -> Iterator[pa.RecordBatch]:
            if pooled:
                yield out(*link_cell(np.unique(np.concatenate(pooled)), None, radius))
                pooled.clear()

        def cell(fp: np.ndarray, right: np.ndarray, across: bool) -> Iterator[pa.RecordBatch]:
            if across:
                yield out(*link_cell(fp[~right], fp[right], radius))
            elif len(fp) > _SMALL:
                yield out(*link_cell(fp, None, radius))
            elif len(fp) > 1:
                pooled.append(fp)
                if sum(map(len, pooled)) >= _SMALL:
                    yield from flush()

        held: list[np.ndarray] = []
        for b in batches:
            rows = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(5)])
            held.append(rows)
            rows = np.concatenate(held, axis=1) if len(held) > 1 else rows
            cuts = np.flatnonzero((rows[1:4, 1:] != rows[1:4, :-1]).any(axis=0)) + 1
            for a, z in zip(np.concatenate(([0], cuts[:-1])).astype(int), cuts, strict=False):
                yield from cell(rows[0, a:z].view(np.uint64), rows[4, a:z].astype(bool), rows[2, a] != rows[3, a])
            held = [rows[:, cuts[-1] :] if len(cuts) else rows]
        if held and held[0].shape[1]:
            rows = held[0]
            yield from cell(rows[0].copy().view(np.uint64), rows[4].astype(bool), rows[2, 0] != rows[3, 0])
        yield from flush()

    return dealt.select("fp", "key", "i", "j", F.col("right").cast("int")).mapInArrow(run, "u long, v long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id): the smallest id that links within ``radius`` bits reach."""
    marked = materialise(fingerprints(df, id_col, text_col, width), "fingerprints")
    classes = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes", rows=marked.count())
    star = star_forest(links(classes, radius))
    linked = star.select(F.col("u").alias("fp"), F.col("v").alias("root")).unionByName(star.select(F.col("v").alias("fp"), F.col("v").alias("root")).distinct())
    named = linked.join(classes, "fp")
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    grouped = named.join(least, "root").select("fp", "component_id", F.lit(True).alias("linked"))
    of_class = classes.join(grouped, "fp", "left").select("fp", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("rep")).alias("component_id"))
    # Written, so that the last join has a plain shuffle on both sides and a fingerprint that many rows share can be split.
    return marked.join(materialise(of_class, "components"), "fp", "left").select("doc_id", "fp", "component_id")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
