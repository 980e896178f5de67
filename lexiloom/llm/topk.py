"""Exact top-k inner products by no-random-access aggregation over sorted lists.

Candidates lie in blocks of about ``block_rows`` vectors. A block is sorted once, into one list for each dimension, and written.
A query with a positive weight reads a list from the top, one with a negative weight from the bottom, so
contributions only fall. All lists are read on in turn to growing depths, entry after entry; a candidate's components are known
from nowhere else. After each depth its score is bounded below by what was read plus the least that its unread lists can
give, and above by what was read plus the contributions at the reading heads. Candidates whose upper bound is under the k-th
lower bound of every query left drop out of the reading. A query stops when the candidates that can still qualify have been met
in every list: their scores are final then. The queries of a chunk read together. Blocks send their best k of each query to
one grouped top-k.

Queries lie in blocks as well: a cell joins one query block with one candidate block by key, so neither side is
collected or broadcast, and memory in a task is bounded by the two block sizes.

Defined results: vectors that are null or hold null or non-finite components take no part; of vectors of different lengths the
positions that both have count, so an empty vector has score 0 with every other; rows that repeat with vec_id and vector stand in
the ranking as often as they occur, and a query id that repeats with another vector is ranked over the scores of both; a null
vec_id is no query and no candidate; an empty table gives an empty result. Extra columns are ignored. Scores are exact for all finite
components: where products could pass 2**53 the block is reckoned in whole Python numbers, and a best score that a long cannot
hold is an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom.llm.common import MAX_LONG, materialise, table

TOP, EVERY, SCALE = 5, 50, 256
#: Vectors of a list block, and queries of a query block. Every list block meets every query block, so what is shuffled is the lists once for each
#: query block: these are as large as a task can hold with ease (16 MB for 64 dimensions), since a query is but one vector.
BLOCK_ROWS, QUERY_ROWS = 4096, 1 << 16
#: Queries that read together.
_CHUNK = 128


class SortedLists:
    """One list for each dimension: ``members`` (places of the block's rows) by rising ``values``. Lists are only read in order, from either end."""

    def __init__(self, members: np.ndarray, values: np.ndarray):
        self._members, self._values = members, values
        self.length, self.width = values.shape
        self.reads = 0
        #: The values at both ends, which bound what a list can hold.
        self.least, self.most = (values[0], values[-1]) if self.length else (None, None)

    def read(self, j: int, falling: bool, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        """Entries ``start`` to ``stop`` of a list, from its top or from its bottom."""
        self.reads += stop - start
        z = slice(self.length - stop, self.length - start) if falling else slice(start, stop)
        return self._members[z, j], self._values[z, j]

    def heads(self, falling: bool, depth: int) -> np.ndarray:
        """The values last read."""
        return self._values[self.length - depth] if falling else self._values[depth - 1]


def sort_lists(vectors: np.ndarray) -> SortedLists:
    members = np.argsort(vectors, axis=0, kind="stable")
    return SortedLists(members, np.take_along_axis(vectors, members, axis=0))


def no_random_access(lists: SortedLists, ids: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, top: int = TOP) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query index, vec_id, score) of each query's best ``top`` among the block's rows ``ids``, own id left out. Both sides hold exact whole numbers of one type."""
    n, kind = lists.length, queries.dtype
    live = np.arange(len(queries))
    kept = np.ones(n, bool)
    known = np.zeros((n, len(live)), kind)  # sums of the contributions read, by candidate and query
    met = {falling: np.zeros((n, lists.width), bool) for falling in (True, False)}
    depth, stop = 0, max(1, n // 16)
    while len(live):
        stop = min(n, stop)
        weights = {True: np.maximum(queries[live], 0), False: np.minimum(queries[live], 0)}
        for falling, weight in weights.items():
            for j in np.flatnonzero((weight != 0).any(axis=0)).tolist():
                member, value = lists.read(j, falling, depth, stop)
                use = kept[member]
                member, value = member[use], value[use]
                known[member] += value[:, None] * weight[:, j]
                met[falling][member, j] = True
        depth = stop
        rows = np.flatnonzero(kept)
        lower, upper = known[rows], known[rows]
        for falling, weight in weights.items():
            unread = (~met[falling][rows]).astype(kind)
            upper = upper + unread @ (weight * lists.heads(falling, depth)).T
            lower = lower + unread @ (weight * (lists.least if falling else lists.most)).T
        final = upper == lower
        own = ids[rows][:, None] == query_ids[live]
        lower = np.where(own, -np.inf, lower)
        bar = np.full(len(live), -np.inf) if len(rows) <= top else np.partition(lower, len(rows) - top, axis=0)[len(rows) - top]
        rivals = ~own & (upper >= bar)
        ready = (final | ~rivals).all(axis=0) | (depth == n)
        for c in np.flatnonzero(ready):
            found = rows[rivals[:, c]]
            score = known[found, c]
            best = np.lexsort((ids[found], -score))[:top] if kind != object else sorted(range(len(found)), key=lambda r: (-score[r], ids[found[r]]))[:top]
            for x in score[best]:
                if not -MAX_LONG - 1 <= int(x) <= MAX_LONG:
                    raise ValueError(f"a score is beyond 64 bits: {int(x)}")
            yield np.full(len(best), live[c]), ids[found[best]], np.array([int(x) for x in score[best]], np.int64)
        if ready.any():
            live, known, rivals = live[~ready], known[:, ~ready], rivals[:, ~ready]
        kept[rows] = rivals.any(axis=1)
        stop = 2 * depth


def _valid(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v, m): distinct valid vectors, rounded down to multiples of 1 / SCALE, and how often each occurs."""
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    # Cut to whole multiples of 1 / SCALE, which doubles hold exactly; from 2 ** 53 on they are whole anyway.
    cut = lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x * SCALE).cast("double") / SCALE).otherwise(x)
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), vector.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    return rows.filter(F.forall("v", finite)).select("vec_id", F.transform("v", cut).alias("v")).groupBy("vec_id", "v").agg(F.count("*").alias("m"))


def whole_numbers(vectors: np.ndarray) -> np.ndarray:
    """floor(256 * x) of every component, which are 32-bit whole numbers already or doubles: as doubles where they are small enough, else as Python numbers."""
    if vectors.dtype != np.float64:
        return vectors.astype(np.float64)
    if not vectors.size or float(np.abs(vectors).max()) < 2.0**40:
        return np.floor(vectors * SCALE)
    return np.array([int(x) * SCALE if abs(x) >= 2.0**53 else math.floor(x * SCALE) for x in vectors.ravel().tolist()], object).reshape(vectors.shape)


def _packed(rows: DataFrame, key: str, width: int, top: int, as_lists: bool, kind: str) -> DataFrame:
    """One row for each value of ``key`` with all of its vectors: (key, ids, vectors, members); sorted into lists if ``as_lists``. ``kind`` is how a component is kept."""
    names = [key, "ids", "vectors", "members"]

    def block(spot: int, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        ids, times, vectors = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.repeat(np.argsort(ids, kind="stable"), np.minimum(times, top)[np.argsort(ids, kind="stable")] if as_lists else 1)
        ids, vectors = ids[order], vectors[order]
        # Scaling keeps the order, so the lists of the vectors are those of their whole numbers.
        members = np.argsort(vectors, axis=0, kind="stable").astype("<u2" if len(ids) <= 1 << 16 else "<i4") if as_lists else np.zeros(0, "<u2")
        if as_lists:
            vectors = np.take_along_axis(vectors, members.astype(np.int64), axis=0)
        return pa.RecordBatch.from_arrays([pa.array([spot], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (ids, vectors, members))], names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        last = None
        for b in batches:
            spots = b.column(0).to_numpy()
            sizes = np.diff(b.column(2).offsets.to_numpy())
            row = np.repeat(np.arange(len(sizes)), sizes)
            vectors = np.zeros((len(sizes), width))
            vectors[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = b.column(2).flatten().to_numpy()
            vectors = np.floor(vectors * SCALE).astype("<i4") if kind == "<i4" else vectors
            edges = [0, *(np.flatnonzero(np.diff(spots)) + 1).tolist(), len(spots)]
            for a, z in pairwise(edges):
                if a == z:
                    continue
                if held and spots[a] != last:
                    yield block(last, held)
                    held.clear()
                last = int(spots[a])
                held.append((b.column(1).to_numpy()[a:z], b.column(3).to_numpy()[a:z], vectors[a:z]))
        if held:
            yield block(last, held)

    dealt = rows.select(key, "vec_id", "v", "m").repartition(key).sortWithinPartitions(key)
    return dealt.mapInArrow(run, f"{key} int, ids binary, vectors binary, members binary")


def top_products(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", top: int = TOP, every: int = EVERY, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` best candidates of each row whose id ``every`` divides."""
    rows = materialise(_valid(df, id_col, vector_col), "vectors")
    is_query = F.pmod("vec_id", F.lit(every)) == 0
    size = rows.agg(F.count("*").alias("n"), F.count_if(is_query).alias("q"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("w"), F.coalesce(F.max(F.array_max(F.transform("v", lambda x: F.abs(x)))), F.lit(0.0)).alias("most")).first()
    width = max(1, size["w"])
    kind = "<i4" if size["most"] * SCALE < 2**31 - 1 else "<f8"
    # The longest block cannot hold two rows of one (vec_id, vector), so a hash of both spreads any group.
    blocks, query_blocks = max(1, math.ceil(size["n"] / block_rows)), max(1, math.ceil(size["q"] / query_rows))
    spot = lambda k: F.pmod(F.xxhash64("vec_id", "v"), F.lit(k)).cast("int")
    both = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    lists = materialise(_packed(rows.withColumn("c", spot(blocks)), "c", width, top, True, kind), "lists")
    asked = materialise(_packed(rows.filter(is_query).withColumn("q", spot(query_blocks)), "q", width, top, False, kind), "queries")
    cells = lists.withColumn("q", both(query_blocks)).withColumn("asks", F.lit(False)).unionByName(asked.withColumn("c", both(blocks)).withColumn("asks", F.lit(True)))
    dealt = cells.select("c", "q", "asks", "ids", "vectors", "members").repartition("c", "q").sortWithinPartitions("c", "q", "asks")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = None
        for b in batches:
            for c, q, asks, ids, vectors, members in zip(*(column.to_pylist() for column in b.columns), strict=True):
                ids, vectors = np.frombuffer(ids, np.int64), np.frombuffer(vectors, kind).reshape(-1, width)
                if not asks:
                    lists = (c, q), ids, vectors, np.frombuffer(members, "<u2" if len(ids) <= 1 << 16 else "<i4").astype(np.int64).reshape(-1, width)
                    continue
                if lists is None or lists[0] != (c, q):
                    continue  # a block without rows
                values, weights = whole_numbers(lists[2]), whole_numbers(vectors)
                sound = values.dtype != object and weights.dtype != object and width * float(np.abs(values).max()) * float(np.abs(weights).max()) < 2**53
                if not sound:
                    values, weights = (np.array([[int(x) for x in row] for row in m.tolist()], object).reshape(m.shape) for m in (values, weights))
                for a in range(0, len(ids), _CHUNK):
                    asking = ids[a : a + _CHUNK]
                    for k, found, score in no_random_access(SortedLists(lists[3], values), lists[1], asking, weights[a : a + _CHUNK], top):
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (asking[k], found, score)], ["query_id", "vec_id", "score"])

    best = dealt.mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best candidates of every fiftieth vector."""
    return top_products(table(spark, sf_dir, "embeddings"))


def oracle(top: int = TOP, every: int = EVERY) -> str:
    """Every query vector against every other row; positions that both have count, so an empty vector scores 0."""
    return f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
asked AS (SELECT DISTINCT vec_id, e FROM v WHERE vec_id % {every} = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, coalesce(list_sum(list_transform(range(1, least(len(q.e), len(c.e)) + 1), lambda i: q.e[i] * c.e[i])), 0)::BIGINT AS score
  FROM asked q JOIN v c ON q.vec_id <> c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= {top}
"""
