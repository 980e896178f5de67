"""Vector code compression: product quantisation with whole numbers, fitted by tree aggregation.

Vectors are cut to whole multiples of 1 / SCALE and written once as columnar blocks: a row of the block table is up to
``BLOCK_ROWS`` vectors, laid out dimension after dimension. Each of the equal parts of a vector has a codebook of its own. A fitting round
is one ``treeAggregate`` over the blocks: a task adds up the squared distances of a part to all entries dimension by dimension,
takes the nearest entry (the lower of equals), and adds its vectors to whole-number sums and counts with ``np.add.at``; those
tensors, a few KB each, merge in a tree, so neither the driver nor a task ever holds vectors of more than one block. A last pass
over the blocks gives every vector its code and error. The block table lies in the shared folder, so a lost executor costs its
running tasks alone.

Defined results: a vector that is null or holds null or non-finite components is dropped; vectors shorter than the longest, or than
a multiple of the number of parts, count as filled up with zeros, so an empty one is all zeros; the first codebook entries come
from the smallest ids, each id once with its smallest vector, a null id behind all others; fewer ids than entries make a smaller
codebook; a row with a null id is encoded like any other, and repeated rows each count; null labels are one label; an empty
table gives an empty result. Extra columns are ignored. Where squared distances could pass 64 bits whole Python numbers are used,
and an error that a long cannot hold stops the query.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.common import MAX_LONG, materialise, table

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
BLOCK_ROWS = 4096
#: So many labels' sums are sent to every task; more are joined.
SENT_LABELS = 100_000


@dataclass(frozen=True)
class Layout:
    """How blocks hold vectors: ``width`` components in ``parts`` parts, as scaled 32-bit numbers where all are ``small``, else as doubles."""

    width: int
    parts: int
    scale: int
    small: bool

    def pack(self, vectors: np.ndarray) -> bytes:
        """Vectors (rows) to a columnar block."""
        columns = np.ascontiguousarray(vectors.T)
        return np.floor(columns * self.scale).astype("<i4").tobytes() if self.small else columns.astype("<f8").tobytes()

    def unpack(self, data: bytes, rows: int) -> np.ndarray:
        """(part, dimension, row): floor(scale * x) of every component, in 64 bits or as Python numbers."""
        shape = self.parts, self.width // self.parts, rows
        if self.small:
            return np.frombuffer(data, "<i4").astype(np.int64).reshape(shape)
        whole = [int(x) * self.scale if abs(x) >= 2.0**40 else math.floor(x * self.scale) for x in np.frombuffer(data, "<f8").tolist()]
        return np.array(whole, object).reshape(shape)


def nearest(part: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry for every vector of a part (dimension, row); entries are (entry, dimension)."""
    distance = np.zeros((part.shape[1], len(entries)), part.dtype)
    for column, values in zip(part, entries.T, strict=True):
        apart = column[:, None] - values
        distance += apart * apart
    index = distance.argmin(axis=1)
    return index, distance[np.arange(len(index)), index]


def first_entries(held: dict, ids: list, parts: np.ndarray, entries: int) -> dict:
    """The smallest ``entries`` ids seen so far with their smallest vectors; nulls last."""
    flat = parts.reshape(-1, parts.shape[2])
    order = lambda x: (x is None, 0 if x is None else x)
    wanted = set(sorted(set(ids), key=order)[:entries])
    for row, own in enumerate(ids):
        if own in wanted:
            vector = tuple(flat[:, row].tolist())
            held[own] = min(held.get(own, vector), vector)
    return {own: held[own] for own in sorted(held, key=order)[:entries]}


def moved(books: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Entries at the rounded-down means of their parts; unused ones stay."""
    means = sums // np.maximum(counts, 1)[:, :, None]
    return np.where((counts > 0)[:, :, None], means, books)


def blocks_of(df: DataFrame, layout: Layout, block_rows: int) -> DataFrame:
    """(ids, labels, data) of (vec_id, label, v): columnar blocks of up to ``block_rows`` vectors."""
    kind = df.schema["label"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, block_rows):
                b = whole.slice(at, block_rows)
                v = b.column(2)
                sizes = np.diff(v.offsets.to_numpy())
                row = np.repeat(np.arange(len(sizes)), sizes)
                vectors = np.zeros((len(sizes), layout.width))
                vectors[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = v.flatten().to_numpy()
                one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                yield pa.RecordBatch.from_arrays([one(b.column(0)), one(b.column(1)), pa.array([layout.pack(vectors)])], ["ids", "labels", "data"])

    return df.select("vec_id", "label", "v").mapInArrow(run, f"ids array<long>, labels array<{kind}>, data binary")


def fit(blocks: DataFrame, layout: Layout, entries: int, rounds: int) -> np.ndarray:
    """Codebooks (part, entry, dimension)."""
    held = blocks.select("ids", "data").rdd.treeAggregate(
        {},
        lambda acc, b: first_entries(acc, b["ids"], layout.unpack(b["data"], len(b["ids"])), entries),
        lambda x, y: {own: min(z[own] for z in (x, y) if own in z) for own in sorted({**x, **y}, key=lambda i: (i is None, i or 0))[:entries]},
    )
    kind = np.int64 if layout.small else object
    books = np.array(list(held.values()), kind).reshape(len(held), layout.parts, layout.width // layout.parts).transpose(1, 0, 2).copy()
    zero = np.zeros(books.shape, kind), np.zeros(books.shape[:2], np.int64)

    def add(acc: tuple, b: tuple, books: np.ndarray) -> tuple:
        sums, counts = acc
        parts = layout.unpack(b["data"], b["n"])
        for p, part in enumerate(parts):
            index, _ = nearest(part, books[p])
            np.add.at(sums[p], index, part.T)
            np.add.at(counts[p], index, 1)
        return sums, counts

    for _ in range(rounds):
        rows = blocks.select("data", F.size("ids").alias("n")).rdd
        sums, counts = rows.treeAggregate(zero, lambda acc, b, books=books: add(acc, b, books), lambda x, y: (x[0] + y[0], x[1] + y[1]))
        books = moved(books, sums, counts)
    return books


def encode(blocks: DataFrame, layout: Layout, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of every vector of the blocks."""
    kind = blocks.schema["labels"].dataType.elementType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                ids, labels = b.column(0).slice(k, 1).flatten(), b.column(1).slice(k, 1).flatten()
                found = [nearest(part, book) for part, book in zip(layout.unpack(b.column(2)[k].as_py(), len(ids)), books, strict=True)]
                spelled = np.array([index for index, _ in found], np.uint8).T.tobytes().hex()
                error = sum(distance for _, distance in found)
                if not layout.small and max(error) > MAX_LONG:
                    raise ValueError(f"an error is beyond 64 bits: {max(error)}")
                step = 2 * layout.parts
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array([spelled[i : i + step] for i in range(0, len(spelled), step)]), pa.array(error.tolist(), pa.int64())], ["vec_id", "label", "code", "error"])

    return blocks.select("ids", "labels", "data").mapInArrow(run, f"vec_id long, label {kind}, code string, error long")


def compress(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, block_rows: int = BLOCK_ROWS
) -> tuple[DataFrame, np.ndarray]:
    """(codes, codebooks): (vec_id, label, code, error) of every sound vector, and the fitted whole-number entries (part, entry, dimension)."""
    if not 0 < entries <= 256:
        raise ValueError(f"a code of two digits names 1 to 256 entries, not {entries}")
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").alias("label"), vector.alias("v")).filter(F.col("v").isNotNull() & F.forall("v", finite))
    size = rows.agg(F.coalesce(F.max(F.size("v")), F.lit(0)).alias("width"), F.coalesce(F.max(F.array_max(F.transform("v", lambda x: F.abs(x)))), F.lit(0.0)).alias("most")).first()
    width = parts * max(1, -(-size["width"] // parts))
    layout = Layout(width, parts, scale, scale * size["most"] < 2**26 and width <= 256)
    blocks = materialise(blocks_of(rows, layout, block_rows), "vectors")
    books = fit(blocks, layout, entries, rounds)
    return materialise(encode(blocks, layout, books), "codes"), books


def spelled_books(books: np.ndarray) -> str:
    """All entries' components by part, entry and dimension."""
    return ",".join(map(str, books.ravel().tolist()))


def restore(codes: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """The codes' rows with ``vector``, what the codebooks keep of it."""
    spelled = F.array(*[F.array(*[F.array(*[F.lit(float(x) / scale) for x in entry]) for entry in book]) for book in books])
    places = F.sequence(F.lit(0), F.lit(len(books) - 1))
    index = lambda p: F.conv(F.substr("code", 2 * p + 1, F.lit(2)), 16, 10).cast("int")
    return codes.withColumn("vector", F.flatten(F.transform(places, lambda p: F.get(F.get(spelled, p), index(p)))))


def with_label_error(codes: DataFrame) -> DataFrame:
    """The codes with ``label_error``, the sum of the errors of a label's rows."""
    sums = materialise(codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "labels")
    if sums.count() <= SENT_LABELS:
        sums = F.broadcast(sums)
    return codes.join(sums, F.col("label").eqNullSafe(F.col("of")), "left").drop("of")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of every vector, the error of its label, and the codebooks' checksum."""
    codes, books = compress(table(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(spelled_books(books).encode()).hexdigest()
    return with_label_error(codes).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def oracle() -> str:
    """The same rounds, one after the other, over one row for each component."""
    rounds = []
    for r in range(ROUNDS + 1):
        rounds.append(f"""near{r} AS MATERIALIZED (
  SELECT rid, part, min(s) AS best FROM (
    SELECT rid, part, {{'d': sum((f.x - c.x) * (f.x - c.x))::BIGINT, 'k': k}} AS s FROM flat f JOIN book{r} c USING (part, pos) GROUP BY rid, part, k) GROUP BY rid, part)""")
        if r < ROUNDS:
            rounds.append(f"""mean{r} AS (
  SELECT part, best.k AS k, pos, sum(x)::BIGINT AS s, count(*) AS n FROM flat JOIN near{r} USING (rid, part) GROUP BY ALL),
book{r + 1} AS MATERIALIZED (
  SELECT part, k, pos, CASE WHEN n IS NULL THEN x ELSE (s - ((s % n) + n) % n) // n END AS x FROM book{r} LEFT JOIN mean{r} USING (part, k, pos))""")
    return f"""
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
flat AS MATERIALIZED (SELECT rid, d // (len(e) // {PARTS}) AS part, d % (len(e) // {PARTS}) AS pos, e[d + 1] AS x FROM v, unnest(range(len(e))) AS t(d)),
seeds AS (SELECT rid, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM v QUALIFY k < {ENTRIES}),
book0 AS MATERIALIZED (SELECT part, k, pos, x FROM flat JOIN seeds USING (rid)),
{", ".join(rounds)},
codes AS (SELECT rid, string_agg(printf('%02x', best.k), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM near{ROUNDS} GROUP BY rid)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, k, pos)) FROM book{ROUNDS}) AS codebooks_sha256 FROM v JOIN codes USING (rid)
"""
