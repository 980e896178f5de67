"""Near-duplicates by exact Jaccard similarity of word shingles, for the stages of the pipeline.

Candidates come from operator 10 first: texts in one of its components, linked by SimHash fingerprints within 4 bits, meet.
But texts at similarity 0.8 differ in some 10 of a fingerprint's 64 bits, and up to 17 were seen, too many for the block
combinations of ``simhash``. Those are found by MinHash bands besides: two texts at similarity s share none of
the bands with probability (1 - s ** BAND) ** BANDS, 3 in a million at 0.8. Each candidate pair is then compared by
its shingles themselves, so a link always means the stated similarity.

Texts of the same words become one class first, so copies cost nothing further. Classes of one component, or that share a band, meet in
a cell. In a first pass every member is compared with the smallest of its cell. Cells whose members this does not join are then
settled each in one place, with the texts at hand: the SimHash fingerprints of operator 10, over the same shingles, are compared
bit-sliced, and pairs within ``NEAR`` bits are compared by their shingles, the nearest first and only while they are not joined
yet. At similarity 0.8 the mean is 9.7 of 64 bits and the deviation 2.9, so one pair in a million is farther. So a cell gives a few links
that join its groups, never all pairs; one above ``simhash.CELL_ROWS`` members or ``CELL_SHINGLES`` shingles is cut into parts.

Defined results: null, empty and blank texts are one class; a text shorter than a shingle is one shingle; only A-Z change case.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm import simhash
from lexiloom.llm.common import materialise, result, scratch
from lexiloom.llm.graph import star_forest
from lexiloom.llm.simhash import CELL_ROWS, split_cells, within

SHINGLE = 5
#: Least similarity of a link, as a fraction.
SIMILAR = (4, 5)
BANDS, BAND = 32, 5
#: Bits in which fingerprints of texts at that similarity may differ.
NEAR = 24
SEED = 42
#: Shingles of a cell's texts that meet in one place.
CELL_SHINGLES = 1 << 21
#: Members of a cell that are compared with all others at once.
_BATCH = 256
#: Shingles whose hashes are permuted at once, and shingles of the sets that a task keeps.
_CHUNK, _KEPT = 4096, 100_000

_rng = np.random.default_rng(SEED)
_TIMES = _rng.integers(0, 1 << 63, BANDS * BAND, np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _rng.integers(0, 1 << 63, BANDS * BAND, np.uint64) * np.uint64(2)


def shingles(text: bytes | None, width: int = SHINGLE) -> set[bytes]:
    """All runs of ``width`` words; the whole text if it has fewer, none without words."""
    words = (text or b"").lower().split()
    return {b" ".join(words[a : a + width]) for a in range(max(1, len(words) - width + 1))} if words else set()


def marks_of(found: set[bytes]) -> tuple[list[int], int]:
    """(one key for each band of the set's MinHash values, SimHash fingerprint); none and zero for the empty set."""
    if not found:
        return [], 0
    values = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in found), np.uint64, len(found))
    least, counts = np.full(BANDS * BAND, np.iinfo(np.uint64).max), np.zeros(64, np.int64)
    for at in range(0, len(values), _CHUNK):
        part = values[at : at + _CHUNK]
        np.minimum(least, (part[:, None] * _TIMES + _PLUS).min(axis=0), out=least)
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    keys = [xxhash.xxh64_intdigest(least[k * BAND : (k + 1) * BAND].tobytes(), k) for k in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64).tolist(), int(np.packbits(2 * counts > len(values), bitorder="little").view(np.int64)[0])


def alike(a: set[bytes], b: set[bytes]) -> bool:
    """Whether the similarity reaches SIMILAR."""
    both = len(a & b)
    return both * SIMILAR[1] >= (len(a) + len(b) - both) * SIMILAR[0]


def _marks(rows: DataFrame) -> DataFrame:
    """(row, id, words, size, keys, fp) of (row, id, text): digest of the words, number of shingles, band keys, fingerprint."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, sizes, marks = [], [], []
            for text in b.column(2).cast(pa.large_binary()).to_pylist():
                found = shingles(text)
                words.append(hashlib.blake2b(b" ".join((text or b"").lower().split()), digest_size=16).digest())
                sizes.append(len(found))
                marks.append(marks_of(found))
            keys, prints = pa.array([k for k, _ in marks], pa.list_(pa.int64())), pa.array([f for _, f in marks], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(words, pa.binary()), pa.array(sizes, pa.int64()), keys, prints], ["row", "id", "words", "size", "keys", "fp"])

    return rows.mapInArrow(run, "row long, id long, words binary, size long, keys array<long>, fp long")


def _links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the (u, v) pairs of classes whose texts are alike."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, set[bytes]] = {}
        held = 0

        def of(key: int, text: bytes | None) -> set[bytes]:
            nonlocal held
            if (found := kept.get(key)) is None:
                found = shingles(text)
                if held + len(found) > _KEPT:
                    kept.clear()
                    held = 0
                kept[key] = found
                held += len(found)
            return found

        for b in batches:
            u, v = b.column(0).to_pylist(), b.column(1).to_pylist()
            left, right = (b.column(c).cast(pa.large_binary()).to_pylist() for c in (2, 3))
            near = pa.array([alike(of(i, x), of(j, y)) for i, j, x, y in zip(u, v, left, right, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(near), b.column(1).filter(near)], ["u", "v"])

    first, second = (texts.select(F.col("class").alias(c), F.col("text").alias(f"text_{c}")) for c in "uv")
    both = pairs.join(first, "u").join(second, "v").select("u", "v", "text_u", "text_v")
    return materialise(both.mapInArrow(run, "u long, v long"), "similar")


def hashes_of(text: bytes | None) -> np.ndarray:
    """The set of a text's shingles by their 64-bit hashes, rising."""
    found = shingles(text)
    return np.sort(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in found), np.uint64, len(found)))


def alike_hashes(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * SIMILAR[1] >= (len(a) + len(b) - both) * SIMILAR[0]


def join_members(size: np.ndarray, label: np.ndarray, prints: np.ndarray, right: np.ndarray | None, texts: list[bytes | None]) -> list[tuple[int, int]]:
    """Pairs of places that join all members of a cell which links of similar texts reach; members of one label are joined already.

    ``right`` None: all meet each other; else only its members meet the others.
    """
    group = np.unique(label, return_inverse=True)[1]
    counts = np.bincount(group)
    if len(counts) < 2:
        return []
    # Members of the largest group ask nobody: all others ask them.
    asking = np.flatnonzero(group != counts.argmax()) if right is None else np.flatnonzero(~right)
    lanes = np.arange(len(group)) if right is None else np.flatnonzero(right)
    members = {g: [int(k) for k in np.flatnonzero(group == g)] for g in range(len(counts))}
    sets: dict[int, np.ndarray] = {}
    joined: list[tuple[int, int]] = []

    def of(k: int) -> np.ndarray:
        if k not in sets:
            sets[k] = hashes_of(texts[k])
        return sets[k]

    for a in range(0, len(asking), _BATCH):
        i, j = within(prints[asking[a : a + _BATCH]], prints[lanes], NEAR)
        i, j = asking[a + i], lanes[j]
        open_yet = (group[i] != group[j]) & (np.minimum(size[i], size[j]) * SIMILAR[1] >= np.maximum(size[i], size[j]) * SIMILAR[0])
        i, j = i[open_yet], j[open_yet]
        order = np.argsort(np.bitwise_count(prints[i] ^ prints[j]), kind="stable")
        for u, v in zip(i[order].tolist(), j[order].tolist(), strict=True):
            g, h = int(group[u]), int(group[v])
            if g != h and alike_hashes(of(u), of(v)):
                joined.append((u, v))
                if len(members[g]) < len(members[h]):
                    g, h = h, g
                group[members[h]] = g
                members[g] += members.pop(h)
    return joined


def _settled(cells: DataFrame) -> DataFrame:
    """(u, v) links that join the members of ``cells`` (key, class, size, label, fp, text), cell by cell."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def cell() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            klass, size, label, prints = (t[c].to_numpy().astype(np.int64) for c in ("class", "size", "label", "fp"))
            right = None if t["i"][0].as_py() == t["j"][0].as_py() else t["right"].to_numpy().astype(bool)
            found = join_members(size, label, prints.view(np.uint64), right, t["text"].cast(pa.large_binary()).to_pylist())
            pairs = klass[np.array(found, np.int64).reshape(-1, 2)]
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["u", "v"])

        last = None
        for b in batches:
            spots = np.stack([b.column(c).to_numpy().astype(np.int64) for c in ("key", "i", "j")], axis=1)
            for part in np.split(np.arange(b.num_rows), np.flatnonzero((spots[1:] != spots[:-1]).any(axis=1)) + 1):
                if len(part):
                    spot = tuple(spots[part[0]])
                    if held and spot != last:
                        yield cell()
                        held.clear()
                    last = spot
                    held.append(b.slice(int(part[0]), len(part)))
        if held:
            yield cell()

    # A cell's parts are of so many members, or of texts of so many shingles.
    weight = F.greatest(F.lit(1.0), F.col("size") * (CELL_ROWS / CELL_SHINGLES))
    dealt = split_cells(cells, "class", weight=weight).withColumn("right", F.col("right").cast("int"))
    return dealt.mapInArrow(run, "u long, v long")


def components(rows: DataFrame) -> DataFrame:
    """The components of ``_components``, written; the tables on the way to them go."""
    with scratch(rows.sparkSession):
        return result(_components(rows), "components")


def _components(rows: DataFrame) -> DataFrame:
    """(row, first) of (row, id, text), row a number of its own for each: the row with the smallest id, null last, that links of similar texts reach; of equal ids the smallest row."""
    marked = materialise(_marks(rows.select("row", "id", "text")), "marks")
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    grouped = marked.groupBy("words").agg(F.min(rank).alias("rep"), F.any_value("size").alias("size"), F.any_value("keys").alias("keys"), F.any_value("fp").alias("fp"))
    classes = materialise(grouped.withColumn("class", F.monotonically_increasing_id()), "classes", rows=marked.count())
    n = classes.count()
    # A component of operator 10 is a cell as a band is.
    linked = simhash.near_duplicates(rows, "row", "text").select(F.col("doc_id").alias("row"), F.xxhash64(F.lit("simhash"), "component_id").alias("key"))
    near = materialise(classes.select("class", "size", F.col("rep.row").alias("row")).join(linked, "row").select("class", "size", "key"), "near", rows=n)
    # A band that very many classes share is counted map-side, and the join with what it counts can split it.
    dealt = classes.select("class", "size", F.explode("keys").alias("key")).unionByName(near)
    least = dealt.groupBy("key").agg(F.min("class").alias("least"), F.min_by("size", "class").alias("least_size"), F.count("*").alias("members")).filter("members > 1")
    cells = materialise(dealt.join(least, "key"), "cells")
    near_size = lambda a, b: F.least(a, b) * SIMILAR[1] >= F.greatest(a, b) * SIMILAR[0]  # noqa: E731 (no set is alike one of another size)

    involved = classes.join(cells.select("class").distinct(), "class", "left_semi").select("class", F.col("rep.row").alias("row"))
    texts = materialise(rows.select("row", "text").join(involved, "row").select("class", "text"), "texts", rows=n)
    pairs = cells.filter((F.col("class") != F.col("least")) & near_size(F.col("size"), F.col("least_size"))).select(F.col("least").alias("u"), F.col("class").alias("v")).distinct()
    direct = _links(pairs, texts)
    label = star_forest(direct).select(F.col("u").alias("class"), F.col("v").alias("to"))
    # Only cells whose members have several labels still.
    labelled = cells.filter("members > 2").join(label, "class", "left").select("key", "class", F.coalesce("to", "class").alias("label"))
    several = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("key")
    rest = labelled.join(several, "key", "left_semi").join(classes.select("class", "size", "fp"), "class")
    across = materialise(_settled(rest.join(texts, "class")), "similar")

    star = star_forest(direct.unionByName(across)).select(F.col("u").alias("class"), F.col("v").alias("root"))
    rooted = classes.join(star, "class", "left").select("words", "rep", F.coalesce("root", "class").alias("root"))
    of_class = rooted.join(rooted.groupBy("root").agg(F.min("rep").alias("first")), "root").select("words", F.col("first.row").alias("first"))
    return marked.select("row", "words").join(materialise(of_class, "firsts", rows=n), "words").select("row", "first")
