import numpy as np
import pytest
import xxhash

from lexiloom.llm import simhash


def slow_fingerprint(text, width=4):
    words = [w for w in _split(_lower(text or ""))]
    if not words:
        return 0
    grams = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def _split(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text)


def slow_components(rows, radius=4):
    fps = [(i, slow_fingerprint(t)) for i, t in rows]
    up = list(range(len(fps)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= radius:
                up[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(fps):
        r = root(k)
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return sorted(((i, f"{f:016x}", least.get(root(k))) for k, (i, f) in enumerate(fps)), key=str)


TEXTS = [
    None, "", "  \t\n", "One two", "ONE two", "a b c d e f g h", "a b c d e f g h", "a b c d e f g h i",
    "É é  x", "É x y z w", " ".join(f"w{i}" for i in range(300)), " ".join(f"w{i}" for i in range(299)),
    " ".join(f"w{i}" for i in range(298)) + " other", "x " * 5000,
]


def test_fingerprint_follows_the_rule():
    for text in TEXTS:
        assert simhash.fingerprint(None if text is None else text.encode()) == slow_fingerprint(text)


@pytest.mark.parametrize("radius", [0, 3, 4, 6, 7, 8, 13, 24, 31])
def test_within_equals_popcount(radius):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 150, dtype=np.uint64)
    near = base ^ (np.uint64(1) << rng.integers(0, 64, 150, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 150, dtype=np.uint64))
    values = np.concatenate((base, near, base[:3]))
    i, j = simhash.within(values, values, radius)
    want = {(a, b) for a in range(len(values)) for b in range(len(values)) if (int(values[a]) ^ int(values[b])).bit_count() <= radius}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want


def test_links_are_exact_for_every_block_count(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    values = [base]
    for _ in range(6):
        flips = np.zeros(40, np.uint64)
        for _ in range(3):
            flips ^= np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)
        values.append(values[-1] ^ flips)
    # a dense group that overfills its cell
    dense = np.unique(np.uint64(12345) ^ (np.uint64(1) << rng.integers(20, 64, 400, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(20, 64, 400, dtype=np.uint64)))
    values = np.unique(np.concatenate([*values, dense]))
    frame = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    up = {int(v): int(v) for v in values}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in map(int, values):
        for b in map(int, values):
            if a < b and (a ^ b).bit_count() <= 4:
                up[root(b)] = root(a)
    want = {}
    for v in up:
        want.setdefault(root(v), set()).add(v)
    want = sorted(sorted(g) for g in want.values() if len(g) > 1)
    for blocks in (5, 6, 8):
        star = simhash.star_forest(simhash.links(frame, blocks=blocks, cell_rows=32)).collect()
        got = {}
        for r in star:
            got.setdefault(r["v"], {r["v"] % 2**64}).add(r["u"] % 2**64)
        assert sorted(sorted(g) for g in got.values()) == want


def test_components_equal_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "a b c d e f g h"), (None, "only here without an id"), (3, "One two"), (3, "One two")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as fp", "1 as component_id", "2 as u")
    got = simhash.near_duplicates(frame)
    found = sorted([(r["doc_id"], f"{r['fp'] % 2**64:016x}", r["component_id"]) for r in got.collect()], key=str)
    assert found == slow_components(rows)


def test_query_on_real_documents(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = sorted([tuple(r) for r in simhash.op10_simhash_near_dedup(spark, d).collect()], key=str)
    assert got == slow_components(rows)


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
