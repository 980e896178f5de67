import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from lexiloom.llm import codes

SMALL = "/root/testdata/sf0.001"


def slow(rows, parts=8, entries=16, rounds=6, scale=4096):
    """rows of (vec_id, label, vector), one by one; (rows, books)."""
    kept = [(i, label, [math.floor(scale * x) if abs(x) < 2**53 else int(x) * scale for x in v]) for i, label, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return [], []
    width = parts * max(1, -(-max(len(v) for _, _, v in kept) // parts))
    kept = [(i, label, v + [0] * (width - len(v))) for i, label, v in kept]
    d = width // parts
    cut = lambda v, p: v[p * d : (p + 1) * d]
    first = {}
    for i, _, v in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2])):
        first.setdefault(i, v)
    books = [[cut(v, p) for v in list(first.values())[:entries]] for p in range(parts)]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda v, p: min((apart(cut(v, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        fresh = []
        for p in range(parts):
            near = [[cut(v, p) for _, _, v in kept if best(v, p)[1] == k] for k in range(len(books[p]))]
            fresh.append([[sum(column) // len(own) for column in zip(*own, strict=True)] if own else old for own, old in zip(near, books[p], strict=True)])
        books = fresh
    found = [(i, label, "".join(f"{best(v, p)[1]:02x}" for p in range(parts)), sum(best(v, p)[0] for p in range(parts))) for i, label, v in kept]
    return found, books


def same(spark, rows, schema="vec_id long, label string, embedding array<double>", **more):
    df = spark.createDataFrame(rows, schema).selectExpr("*", "1 as v", "'x' as code", "2 as ids").repartition(3)
    got, books = codes.compress(df, **more)
    want, want_books = slow(rows, **{k: v for k, v in more.items() if k != "block_rows"})
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert books.tolist() == want_books
    return got, want


@pytest.mark.parametrize("width,block_rows", [(16, 7), (13, 4096)])
def test_equals_brute_force(spark, width, block_rows):
    rng = random.Random(width)
    rows = [(i, rng.choice(["a", "b", None]), [rng.gauss(0, 1) for _ in range(width)]) for i in range(90)]
    rows += [(200 + i, "c", rows[3][2]) for i in range(20)] + [rows[5]] * 3 + [(None, None, rows[7][2]), (2, "a", [0.0] * width)]
    rows += [(300, "a", None), (301, "a", [None] * width), (302, "a", [float("nan")] * width), (303, "a", [float("-inf")] + [0.0] * (width - 1)), (304, "a", []), (305, "b", [1.0])]
    got, want = same(spark, rows, block_rows=block_rows)
    totals = {label: sum(e for _, own, _, e in want if own == label) for label in {r[1] for r in want}}
    told = codes.with_label_error(got).collect()
    assert len(told) == len(want) and all(r["label_error"] == totals[r["label"]] for r in told)


def test_few_rows_and_none(spark):
    same(spark, [(3, "a", [1.0, 2.0]), (None, "a", [4.0, 5.0])], parts=2)
    same(spark, [(None, None, [-1.0, 0.5, 3.0])], parts=2, entries=4, rounds=2)
    df = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    got, books = codes.compress(df)
    assert got.collect() == [] and codes.with_label_error(got).columns == ["vec_id", "label", "code", "error", "label_error"]


def test_large_components_are_exact_or_an_error(spark):
    rng = random.Random(2)
    same(spark, [(i, "a", [rng.gauss(0, 2e4) for _ in range(4)]) for i in range(12)], parts=2, entries=3)
    same(spark, [(i, "a", [1e12 * (i % 3), float(i)]) for i in range(9)], parts=2, entries=3)
    with pytest.raises(Exception, match="beyond 64 bits"):
        codes.compress(spark.createDataFrame([(i, "a", [1e30 * i]) for i in range(5)], "vec_id long, label string, embedding array<double>"), parts=1, entries=1)


def test_many_labels_are_joined(spark, monkeypatch):
    monkeypatch.setattr(codes, "SENT_LABELS", 1)
    df = spark.createDataFrame([(i, i % 5 if i % 7 else None, "00", i) for i in range(50)], "vec_id long, label int, code string, error long")
    got = {r["vec_id"]: r["label_error"] for r in codes.with_label_error(df).collect()}
    key = lambda i: i % 5 if i % 7 else None
    assert got == {i: sum(j for j in range(50) if key(j) == key(i)) for i in range(50)}


def test_restored_vectors_are_near(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    found, books = codes.compress(rows)
    near = {r["vec_id"]: r["vector"] for r in codes.restore(found, books).collect()}
    errors = {r["vec_id"]: r["error"] for r in found.collect()}
    for r in rows.limit(40).collect():
        scaled = np.floor(np.array(r["embedding"], float) * 4096)
        assert ((scaled - np.array(near[r["vec_id"]]) * 4096) ** 2).sum() == errors[r["vec_id"]]


def test_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SMALL}/embeddings.parquet'")
    df = codes.op13_vector_codes(spark, SMALL)
    result = con.execute(codes.oracle())
    columns = [c[0] for c in result.description]
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(result.fetchall())
    assert len(hashlib.sha256(b"").hexdigest()) == len(df.first()["codebooks_sha256"])
