import random

import numpy as np

import corpus_pipeline
from pyspark.sql import functions as F
from lexiloom.llm import similar


def slow_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def slow_first(rows):
    """row -> first row, by all pairs; rows are (row, id, text)."""
    sets = [slow_shingles(t) for _, _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if (not sets[a] and not sets[b]) or (sets[a] and sets[b] and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both)):
                group = [group[b] if g == group[a] else g for g in group]
    rank = lambda k: (rows[k][1] is None, rows[k][1] or 0, rows[k][0])
    return {rows[k][0]: rows[min((j for j in range(len(rows)) if group[j] == group[k]), key=rank)][0] for k in range(len(rows))}


def edited(rng, words, n):
    out = list(words)
    for k in rng.sample(range(len(out)), n):
        out[k] = f"x{rng.randrange(10**6)}"
    return out


def near_copies(seed):
    """(row, id, text): texts with copies of one to twelve changed words, on both sides of the threshold, in small and large groups."""
    rng, texts = random.Random(seed), [None, "", " \t", "one", "One", "a b c", "a b c d"]
    for n in (1, 2, 3, 12):
        for _ in range(6):
            base = [f"w{rng.randrange(5000)}" for _ in range(200)]
            texts += [" ".join(base)] + [" ".join(edited(rng, base, rng.randint(1, 12))) for _ in range(n)]
    rng.shuffle(texts)
    return [(k, rng.choice((None, *range(300))), t) for k, t in enumerate(texts)]


def test_components_equal_all_pairs(spark):
    for seed in (1, 2):
        rows = near_copies(seed)
        got = similar.components(spark.createDataFrame(rows, "row long, id long, text string")).collect()
        assert {r["row"]: r["first"] for r in got} == slow_first(rows) and len(got) == len(rows)


def groups_of(n, links):
    group = list(range(n))
    for u, v in links:
        group = [group[v] if g == group[u] else g for g in group]
    return sorted(sorted(k for k in range(n) if group[k] == g) for g in set(group))


def test_cells_are_split_and_joined_exactly(spark, monkeypatch):
    """Whole cells and cut ones join what all pairs of similar texts join, with fewer links than members."""
    texts = sorted({t for _, _, t in near_copies(7) if t and len(t.split()) > 9})
    sets = [similar.shingles(t.encode()) for t in texts]
    label = [k % 5 if k < 10 else k for k in range(len(texts))]
    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if similar.alike(sets[a], sets[b])] + [(a, b) for a in range(10) for b in range(a) if label[a] == label[b]]
    want = groups_of(len(texts), pairs)
    rows = [(key, k, len(sets[k]), label[k], similar.marks_of(sets[k])[1], t) for key in (3, 4) for k, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "key long, class long, size long, label long, fp long, text string")
    for shingles in (similar.CELL_SHINGLES, 2000):
        monkeypatch.setattr(similar, "CELL_SHINGLES", shingles)
        found = [(r["u"], r["v"]) for r in similar._settled(frame.repartition(3)).collect()]
        same = [(a, b) for a in range(10) for b in range(a) if label[a] == label[b]]
        assert groups_of(len(texts), found + same) == want
        assert shingles == 2000 or len(found) < 2 * len(texts)


def test_a_dense_group_needs_few_comparisons(monkeypatch):
    """Copies of copies: comparisons by shingles grow with the members, not with their pairs."""
    rng, base, asked = random.Random(9), [f"w{k}" for k in range(150)], []
    texts = [" ".join(edited(rng, base, 2)).encode() for _ in range(400)]
    sets = [similar.shingles(t) for t in texts]
    alike = similar.alike_hashes
    monkeypatch.setattr(similar, "alike_hashes", lambda a, b: asked.append(1) or alike(a, b))
    prints = np.array([similar.marks_of(s)[1] for s in sets], np.int64).view(np.uint64)
    found = similar.join_members(np.array([len(s) for s in sets]), np.arange(400), prints, None, texts)
    assert len(groups_of(400, found)) == 1 and len(asked) < 400 * 20


def test_fingerprints_of_similar_texts_are_near():
    rng, far = random.Random(6), 0
    for _ in range(300):
        base = [f"w{rng.randrange(5000)}" for _ in range(120)]
        a, b = (similar.shingles(" ".join(w).encode()) for w in (base, edited(rng, base, 2)))
        far += similar.alike(a, b) and ((similar.marks_of(a)[1] ^ similar.marks_of(b)[1]) & (1 << 64) - 1).bit_count() > similar.NEAR
    assert far == 0


def test_stage_drops_near_copies_and_keeps_others(spark):
    rng = random.Random(3)
    base = [f"w{k}" for k in range(200)]
    near, far = edited(rng, base, 3), edited(rng, base, 20)
    rows = [(i, " ".join(w), "en", "s", 0) for i, w in enumerate((base, near, far))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [0, 2]


def test_stage_keeps_one_row_of_each_group(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(50)) for x in "abc")
    rows = [(1, a), (1, a), (1, b), (None, b), (None, c), (None, c), (2, c), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert sorted(x for x in got if x[1]) == [(1, a), (1, b), (2, c)] and len(got) == 4


def test_stage_finds_near_copies_by_fingerprints(spark, monkeypatch):
    """Without any band, operator 10's components still bring near copies together, and shingles decide."""
    marks = similar._marks
    monkeypatch.setattr(similar, "_marks", lambda rows: marks(rows).withColumn("keys", F.array().cast("array<long>")))
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(3000)]
    near = [*base[:1500], "changed", *base[1501:]]
    assert (similar.simhash.fingerprint(" ".join(base).encode()) ^ similar.simhash.fingerprint(" ".join(near).encode())).bit_count() <= 4
    other = [f"v{k}" for k in range(300)]
    rows = [(i, " ".join(w), "en", "s", 0) for i, w in enumerate((base, near, other))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [0, 2]
