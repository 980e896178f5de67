import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from lexiloom.llm import packing
from lexiloom.llm.tokens import default_path

LIBRARY = Tokenizer.from_file(default_path(packing.VOCABULARY))


def check_plan(counts, capacity=2048):
    runs, n = packing.plan_packing(dict(counts), capacity)
    seen, used = defaultdict(list), defaultdict(list)
    for r in runs:
        for k in range(r.count):
            seen[r.length].append(r.first + k)
            used[r.sequence + k].append((r.offset, r.length))
    assert {length: sorted(s) for length, s in seen.items()} == {length: list(range(c)) for length, c in counts.items() if c}
    assert len(used) == n and all(0 <= s < n for s in used)
    for items in used.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
    return n


@pytest.mark.parametrize("counts", [{}, {1: 1}, {2048: 3}, {2047: 5, 1: 5}, {1024: 7}, {257: 10}, {700: 100, 600: 90, 90: 30, 3: 1}, {1025: 4, 1023: 4}])
def test_plans_are_packings(counts):
    n = check_plan(counts)
    assert n >= -(-sum(length * c for length, c in counts.items()) // 2048)


def test_known_optimum():
    assert check_plan({1500: 40, 548: 40}) == 40
    assert check_plan({1024: 10, 512: 20, 256: 8}) == 11


def test_close_to_the_bound():
    rng = random.Random(5)
    counts = Counter(min(2047, int(rng.lognormvariate(5.5, 1))) + 1 for _ in range(4000))
    bound = -(-sum(length * c for length, c in counts.items()) // 2048)
    assert check_plan(counts) <= 1.01 * bound + 2


def test_linear_groups_have_equal_counts():
    grouped = packing.linear_groups([(900, 5), (800, 1), (700, 10), (600, 4)], 4)
    assert [sum(n for _, n in items) for _, items in grouped] == [5, 5, 10]  # two groups of 700 are one size
    for length, items in grouped:
        assert all(size <= length for size, _ in items)
    assert sum(n for _, items in grouped for _, n in items) == 20


def check_rows(rows, texts):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(texts)
    for i, own in pieces.items():
        ids = [*LIBRARY.encode(texts[i] or "", add_special_tokens=False).ids, 0]
        at = 0
        for k, r in enumerate(sorted(own, key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            assert r["length"] == 2048 or k == 0
            at += r["length"]
        assert at == len(ids) and (len(own) == 1 or len(ids) > 2048)
    for items in sequences.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 2048
    return len(sequences), sum(r["length"] for r in rows)


def test_query_on_real_documents(spark):
    d = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    n, total = check_rows(packing.op9_best_fit_packing(spark, d).collect(), texts)
    assert n <= 1.02 * total / 2048 + 2


def test_edges(spark):
    texts = {1: None, 2: "", 3: "word " * 2047, 4: "word " * 2048, 5: "word " * 9000, 6: "a"}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").selectExpr("*", "1 as length", "'z' as part", "2 as number")
    rows = packing.pack(frame, with_ids=True).collect()
    check_rows(rows, texts)
    assert all(len(r["ids"]) == r["length"] for r in rows)
    twice = packing.pack(spark.createDataFrame([(None, "b"), (None, "b"), (7, "b")], "doc_id long, text string")).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in twice}) == 3
    assert packing.pack(frame.limit(0)).collect() == []
