import math

import duckdb
import numpy as np
import pytest

from lexiloom.llm import topk


def slow(rows, top=5, every=50):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in kept if i % every == 0}):
        for v in {tuple(v) for i, v in kept if i == q}:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in kept if i != q)
            out += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores[:top])]
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("block,ask", [(2048, 512), (40, 3)])
def test_equals_brute_force(spark, block, ask):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).round(3).tolist()) for i in range(400)]
    rows += [(1000 + i, [0.25] * 8) for i in range(60)] + [(7, rows[7][1])] * 3 + [(None, [0.1] * 8), (2000, None), (2050, [None] * 8), (2100, [float("nan")] * 8), (2150, [float("inf")] * 8), (2200, [1.0]), (2250, []), (2251, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as m", "'v' as v", "2 as c")
    assert result(topk.top_products(frame, block_rows=block, query_rows=ask)) == slow(rows)


def test_large_components_and_few_rows(spark):
    rows = [(0, [1e6, -1e6]), (50, [1e6, 3.0]), (1, [2e6, 1e6])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert result(topk.top_products(frame)) == slow(rows)
    assert topk.top_products(frame.limit(0)).collect() == []
    assert topk.top_products(frame.filter("vec_id = 0")).collect() == []


def test_query_on_real_vectors(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    assert result(topk.op5_exact_top_k(spark, d)) == slow(rows)


def test_components_beyond_32_bits_score_exactly(spark):
    rows = [(0, [1e7, 1.0]), (1, [1.1e7, 2.0]), (2, [-1e7, 3.0])]
    got = [tuple(r) for r in topk.top_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()]
    whole = {i: [math.floor(256 * x) for x in v] for i, v in rows}
    assert got == [(0, k + 1, i, sum(x * y for x, y in zip(whole[0], whole[i], strict=True))) for k, i in enumerate((1, 2))]


def test_a_large_weight_meets_a_small_one(spark):
    frame = spark.createDataFrame([(0, [1e7, 1.0]), (1, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert result(topk.top_products(frame)) == [(0, 1, 1, 655360000000)]


def test_scores_beyond_64_bits_are_an_error_and_huge_components_are_exact(spark):
    rows = [(0, [1e300, 0.5]), (1, [0.0, 3.0]), (2, [-0.0, 1e14])]
    assert result(topk.top_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))) == slow(rows)
    rows = [(0, [1e300]), (1, [1.0])]
    with pytest.raises(Exception, match="beyond 64 bits"):
        topk.top_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()


def run_block(vectors, queries, ids=None, top=5):
    lists = topk.sort_lists(vectors)
    ids = np.arange(len(vectors)) if ids is None else ids
    found = {}
    for q, i, s in topk.no_random_access(lists, ids, np.full(len(queries), -1), queries, top):
        found[int(q[0])] = list(zip(i.tolist(), s.tolist(), strict=True))
    return lists, found


def test_lists_are_read_in_order_and_only_as_far_as_needed(monkeypatch):
    rng = np.random.default_rng(4)
    n, d = 4096, 6
    vectors = np.floor(rng.normal(0, 40, (n, d)))
    vectors[:5] += 4000  # five that stand out in every dimension
    seen = []
    read = topk.SortedLists.read
    monkeypatch.setattr(topk.SortedLists, "read", lambda self, j, falling, start, stop: seen.append((j, falling, start, stop)) or read(self, j, falling, start, stop))
    lists, found = run_block(vectors, np.ones((1, d)))
    assert found[0] == sorted(((k, int(vectors[k].sum())) for k in range(5)), key=lambda x: (-x[1], x[0]))
    # Every list is read from its top without a gap; the stop comes long before the ends.
    for j in range(d):
        spans = [(a, z) for i, falling, a, z in seen if i == j]
        assert all(falling for i, falling, _, _ in seen if i == j) and spans[0][0] == 0 and all(a == z for (_, z), (a, _) in zip(spans, spans[1:], strict=False))
    assert lists.reads == sum(z - a for _, _, a, z in seen) <= n * d // 8
    # Without such rows no list is read twice, and the scores are still exact.
    vectors = np.floor(rng.normal(0, 40, (300, d)))
    queries = np.floor(rng.normal(0, 9, (20, d)))
    lists, found = run_block(vectors, queries)
    assert lists.reads <= 2 * 300 * d
    for q, row in enumerate(queries):
        score = vectors @ row
        assert found[q] == [(int(k), int(score[k])) for k in np.lexsort((np.arange(300), -score))[:5]]


def test_ties_go_to_the_smaller_id():
    vectors = np.array([[1.0, 0.0], [1.0, 0.0], [1.0, 0.0], [0.0, 1.0]])
    _, found = run_block(vectors, np.array([[2.0, 2.0]]), ids=np.array([9, 4, 7, 5]), top=2)
    assert found[0] == [(4, 2), (5, 2)]


def test_sql_and_query_agree_on_repeated_rows_and_empty_vectors(spark, tmp_path):
    rows = [(0, [1.0, -2.0]), (0, [1.0, -2.0]), (50, [0.5]), (50, [0.5]), (100, []), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, []), (3, [-1.0, 0.25]), (4, None), (None, [1.0]), (150, [-3.0, 1.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(topk.oracle()).fetchall()
    assert result(topk.op5_exact_top_k(spark, str(tmp_path))) == sorted(want) == slow(rows)


@pytest.mark.parametrize("kind", [1.0, 2.0**24])
def test_blocks_keep_whole_numbers_in_either_width(spark, kind):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(150)]
    rows[70][1][2] = kind
    assert result(topk.top_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block_rows=30, query_rows=2)) == slow(rows)
