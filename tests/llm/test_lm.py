import math
import re
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from lexiloom.llm import lm
from lexiloom.llm.tokens import default_path, encoder

SMALL = lm.LmParams(width=4, window=6, context=2, buckets=12, classes=7, own_classes=3, spell_classes=5)
PATH = default_path(lm.VOCABULARY)


class Entries:
    """A lexicon of 30 made-up words, of one to three buckets each."""

    def __init__(self, rng, p=SMALL):
        self.sizes = rng.choice([1, 2, 3, 9], 32)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = rng.integers(0, p.buckets, self.sizes.sum())
        self.klass = rng.integers(0, p.classes, 32)
        self.inside = -rng.random(32)

    def of(self, numbers):
        parts = [self.flat[self.starts[k] : self.starts[k] + self.sizes[k]] for k in numbers]
        return np.concatenate(parts), self.sizes[numbers]

    def show(self, w):
        self.vectors = np.array([w["E"][self.of([k])[0]].mean(axis=0) for k in range(32)], np.float32)
        return self

    def score(self, w, documents, **how):
        return lm.score_tokens(w, self.vectors, self.klass, self.inside, documents, SMALL, **how)


def small_params(seed=0, spread=0.5):
    rng = np.random.default_rng(seed)
    n = lm.END_ID + 1
    start = lm.first_model(np.ones(n), np.ones(n), [(b" ", 3)], SMALL).params
    return {k: rng.normal(0, spread, v.shape).astype(np.float32) for k, v in start.items()}


def slow_score(w, entries, numbers, p=SMALL):
    """One token after the other, each with the context its window gives, in double precision."""
    w = {k: v.astype(float) for k, v in w.items()}
    total, starts = 0.0, lm.spans(len(numbers), p)
    for t, i in enumerate(numbers):
        s = next(s for k, s in enumerate(starts) if t < s + p.window and (k == 0 or t >= s + p.context))
        seen = [lm.START if j == 0 else numbers[j - 1] for j in range(s, t + 1)]
        x = np.array([w["E"][entries.of([k])[0]].mean(axis=0) for k in seen]) + w["P"][: len(seen)]
        q, k, v = x[-1] @ w["Wq"], x @ w["Wk"], x @ w["Wv"]
        a = k @ q / math.sqrt(p.width)
        a = np.exp(a - a.max())
        h = x[-1] + (a / a.sum()) @ v @ w["Wo"]
        logits = h @ w["U"] + w["b"]
        total += logits[entries.klass[i]] - logits.max() - np.log(np.exp(logits - logits.max()).sum()) + entries.inside[i]
    return total / math.log(10)


@pytest.mark.parametrize("spread", [0.5, 3.0, 12.0])
def test_each_token_is_scored_once_with_its_window(spread):
    """With the larger spreads logits and attention scores pass what exp can hold: the rows' maxima are taken out."""
    rng = np.random.default_rng(1)
    w, entries = small_params(spread=spread), Entries(rng)
    documents = [rng.integers(2, 32, n) for n in (1, 2, 5, 6, 7, 10, 11, 40, 3)]
    got = entries.show(w).score(w, documents, at_once=4)
    want = [slow_score(w, entries, d.tolist()) for d in documents]
    assert np.allclose(got, want, atol=1e-3, rtol=1e-3)


def test_classes_add_up_to_one():
    w, entries = small_params(2), Entries(np.random.default_rng(3))
    entries.show(w).inside[:] = 0
    entries.klass[2:9] = np.arange(7)
    for before in (20, 21):
        total = sum(10 ** (entries.score(w, [np.array([before, k])])[0] - entries.score(w, [np.array([before])])[0]) for k in range(2, 9))
        assert total == pytest.approx(1, abs=1e-4)


def test_sums_of_classes_need_no_search_of_their_values(monkeypatch):
    rng = np.random.default_rng(5)
    h, weights, want = rng.normal(0, 1, (50, 4)), rng.normal(0, 1, (4, 7)), rng.integers(0, 7, 50)
    for spread in (0.1, 30, 3000):  # exp of float32 fails beyond 88
        values, total, right = lm.class_sums((h * spread).astype(np.float32), weights.astype(np.float32), want)
        direct = (h * spread).astype(np.float32).astype(float) @ weights.astype(np.float32).astype(float)
        top = direct.max(axis=1, keepdims=True)
        expected = direct[np.arange(50), want] - top[:, 0] - np.log(np.exp(direct - top).sum(axis=1))
        assert np.allclose(right - np.log(total), expected, rtol=1e-3, atol=1e-3 * spread)
        assert np.allclose(values.sum(axis=1) / total, 1, atol=1e-4)
    searched = []
    monkeypatch.setattr(lm, "_near_zero", lambda a, mask=None: searched.append(a.shape))
    w = small_params()
    entries = Entries(rng).show(w)
    entries.score(w, [rng.integers(2, 32, 40)])
    assert searched and all(shape[-1] == SMALL.window for shape in searched)


def test_gradients_equal_differences():
    rng = np.random.default_rng(4)
    w = {k: v.astype(np.float64) for k, v in small_params(3).items()}
    entries = Entries(rng)
    x = rng.integers(0, 32, (3, 6))
    flat, sizes = entries.of(x.ravel())
    y, ok = rng.integers(0, 7, (3, 6)), rng.random((3, 6)) < 0.8
    _, g = lm.gradients(w, flat, sizes, y, ok)
    for k, v in w.items():
        for _ in range(3):
            at = tuple(int(rng.integers(0, s)) for s in v.shape) if k != "E" else (int(rng.choice(flat)), 1)
            old = v[at]
            v[at] = old + 1e-4
            up = lm.gradients(w, flat, sizes, y, ok)[0]
            v[at] = old - 1e-4
            down = lm.gradients(w, flat, sizes, y, ok)[0]
            v[at] = old
            assert abs((up - down) / 2e-4 - g[k][at]) < 1e-4, k


def tokens_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), lm.END_WORD]


def slow_base(rows):
    held = {i: zlib.crc32(str(i if i is not None else "").encode()) % 5 == 1 for i, _ in rows}
    c = Counter(t for i, text in rows if not held[i] for t in tokens_of(text))
    n, v = sum(c.values()), len(c)
    out = []
    for i, text in rows:
        ts = tokens_of(text)
        out.append((i, held[i], len(ts), sum(c[t] > 0 for t in ts), n, sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts)))
    return out


def check(got, rows):
    a = sorted((tuple(r)[:6] for r in got), key=str)
    b = sorted(slow_base(rows), key=str)
    key = lambda x: (str(x[:5]), x[5])
    for x, y in zip(sorted(a, key=key), sorted(b, key=key), strict=True):
        assert x[:5] == y[:5] and x[5] == pytest.approx(y[5], rel=1e-9)

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def real(spark):
    parts = lm._documents(spark.read.parquet(f"{D}/documents.parquet"), "doc_id", "text")
    return parts, lm.train(parts.filter("not held_out"))


def test_query_on_real_documents(spark):
    got = lm.op4_lm_scoring(spark, D).collect()
    check(got, [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{D}/documents.parquet").collect()])
    held = [r for r in got if r["held_out"]]
    assert all(r["score"] < 0 for r in got)
    assert np.corrcoef([r["score"] for r in held], [r["base_score"] for r in held])[0, 1] > 0.97


def test_scores_equal_a_direct_evaluation(real):
    """The query's score, token by token: spelling, word shares and attention all reckoned anew."""
    parts, trained = real
    m, p = trained.model, lm.DEFAULTS
    counts = {r["word"].encode(): r["c"] for r in trained.words.collect() if r["word"] != lm.END_WORD}
    ids = {w: np.frombuffer(encoder(PATH, True).word(w), "<u4").astype(int).tolist() for w in counts}
    klass = lambda w, i: m.own.get(w, int(m.first_class[i[0]]))
    mass = Counter()
    for w, i in ids.items():
        mass[klass(w, i)] += counts[w]
    w = {k: v.astype(float) for k, v in m.params.items()}
    rows = parts.filter("held_out").limit(6).collect() + parts.filter("not held_out").limit(2).collect()
    got = {(r["doc_id"], r["n_tokens"]): r["score"] for r in lm.score(parts, trained).collect()}
    for row in rows:
        words = [x.encode() for x in tokens_of(row["text"])]
        coded = [[lm.END_ID] if x == b" " else np.frombuffer(encoder(PATH, True).word(x), "<u4").astype(int).tolist() for x in words]
        total, starts = 0.0, lm.spans(len(words), p)
        for t, (x, i) in enumerate(zip(words, coded, strict=True)):
            s = max(z for k, z in enumerate(starts) if z <= t and (k == 0 or t >= z + p.context))
            seen = [[p.buckets - 2] if j == 0 else m.bucket[coded[j - 1]].tolist() for j in range(s, t + 1)]
            v = np.array([w["E"][b].mean(axis=0) for b in seen]) + w["P"][: len(seen)]
            a = np.exp(v @ w["Wk"] @ (v[-1] @ w["Wq"]) / math.sqrt(p.width))
            logits = (v[-1] + (a / a.sum()) @ v @ w["Wv"] @ w["Wo"]) @ w["U"] + w["b"]
            k = klass(x, i)
            total += logits[k] - math.log(np.exp(logits).sum())
            if x not in m.own:
                spelt = m.first_log[i[0]] + sum(m.spell[m.bucket[b], m.inner_class[c]] + m.inner_log[c] for b, c in zip(i, i[1:], strict=False)) + m.spell[m.bucket[i[-1]], -1]
                share = counts.get(x, 0) / mass[k] if mass[k] else 0
                total += math.log(m.spelt * math.exp(spelt) + (1 - m.spelt) * share)
        assert got[row["doc_id"], len(words)] == pytest.approx(total / math.log(10), rel=1e-4)


def test_words_of_a_class_add_up_to_one_at_most(real):
    m = real[1].model
    for k in range(len(m.own), lm.DEFAULTS.classes):
        assert np.exp(m.first_log[m.first_class == k].astype(float)).sum() == pytest.approx(1, abs=1e-3)
    by_inner = np.bincount(m.inner_class, np.exp(m.inner_log.astype(float)))
    assert np.allclose(by_inner, 1, atol=1e-3) and np.allclose(np.exp(m.spell.astype(float)).sum(axis=1), 1, atol=1e-3)


def test_training_helps_on_held_out_text(real):
    """On one footing, the same tokens and the same spelling: better than the frequencies of the words alone."""
    parts, trained = real
    held = lambda t: lm.score(parts, t).filter("held_out").agg({"score": "sum"}).first()[0]
    weights = Counter()
    for r in lm.with_ids(trained.words, PATH).collect():
        weights[trained.model.own.get(r["word"].encode(), int(trained.model.first_class[r["head"]]))] += r["c"]
    frequencies = np.log(np.array([weights[k] + 0.5 for k in range(lm.DEFAULTS.classes)])).astype(np.float32)
    plain = {k: v * 0 if k != "b" else frequencies for k, v in trained.model.params.items()}
    unigram = lm.replace(trained, model=lm.replace(trained.model, params=plain))
    assert held(trained) > held(unigram)


def test_forgetting_rare_words_changes_nothing(spark):
    rows = [(k, False, " ".join(f"w{(k * 31 + j * 7) % 97}" for j in range(90))) for k in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, held_out boolean, text string")
    models = [lm.train(frame, p=lm.LmParams(head_words=5, kept_words=kept, batch=4, shard_tokens=700)).model.flat() for kept in (10, 10**6)]
    assert np.array_equal(*models)


def test_the_input_s_partitions_make_no_difference(spark, real):
    parts, trained = real
    again = lm.train(parts.filter("not held_out").orderBy("text").repartition(7))
    assert np.array_equal(again.model.flat(), trained.model.flat())
    one = {(r["doc_id"], r["score"]) for r in lm.score(parts, trained).collect()}
    other = {(r["doc_id"], r["score"]) for r in lm.score(parts.repartition(3), again).collect()}
    assert np.allclose([s for _, s in sorted(one)], [s for _, s in sorted(other)], rtol=1e-5)


def test_every_training_token_is_a_target_once(spark):
    rows = [(k % 7, f"t{k} t{k % 9}") for k in range(60)] + [(None, None), (3, ""), (3, "t3"), (3, "t3")]
    frame = lm._documents(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    for p, shards in ((lm.LmParams(), 1), (lm.LmParams(rounds=3, head_words=2), 5)):
        learned = lm.learn_words(frame, PATH, p)
        coded = lm.code_documents(frame, learned, p)
        got = lm.dealt(coded, p, shards).collect()
        assert len(got) == len(rows) and {r["turn"] for r in got} == set(range(p.rounds)) and {r["shard"] for r in got} == set(range(shards))
        # The codes hold every token of every text.
        by_place = {}
        for r in learned.words.collect():
            place = learned.model.head.places[learned.model.head.hashes == lm.xxhash.xxh64_intdigest(r["word"], 42)]
            if len(place):
                by_place[int(place[0]) + lm.FIRST] = r["word"]
        said = []
        for r in got:
            codes = np.frombuffer(r["codes"], "<i4").tolist()
            assert codes[-1] == lm.END
            said.append(" ".join(by_place[c] if c >= 0 else bytes(r["rare"][-1 - c]).decode() for c in codes[:-1]))
        assert sorted(said) == sorted(t or "" for _, t in rows)
    for n in (1, 2, 31, 32, 33, 64, 200):
        numbers = np.arange(2, 2 + n)
        inputs, targets = lm.windows_of(numbers)
        valid = targets != lm.PAD
        assert targets[valid].tolist() == numbers.tolist() and inputs[valid].tolist() == [lm.START, *numbers[:-1]]


def test_words_encoded_together_equal_words_one_by_one():
    rng = np.random.default_rng(5)
    marks = ["a", "Z", "é", "'", "'s", ".", "7", "\u00a0", "\u2003", "字", "\u0301", "|", "🙂", "\x1c", "über"]
    for odd in (False, True):
        pool = [m for m in marks if odd or not m.isspace()]
        words = ["".join(rng.choice(pool, rng.integers(1, 9))).encode() for _ in range(400)]
        own = encoder(PATH, True)
        for sample in (words, words[:1], [lm.END_WORD.encode()], [*words[:7], lm.END_WORD.encode(), *words[7:9]], [*words[:3], lm.END_WORD.encode()], []):
            ids, sizes = lm.ids_of(sample, own.words)
            want = [[lm.END_ID] if w == b" " else np.frombuffer(own.word(w), "<u4").tolist() for w in sample]
            assert np.split(ids, np.cumsum(sizes)[:-1])[0].tolist() == (want[0] if want else [])
            assert ids.tolist() == [i for x in want for i in x] and sizes.tolist() == [len(x) for x in want]


def test_long_texts_are_parted_in_slices():
    text = b"Ab  cd\tEF " * 50 + b"x" * 99 + b" y"
    assert [w for part in lm.words_in(text, 20) for w in part] == text.lower().split()
    assert [w for part in lm.words_in(None) for w in part] == []


def test_texts_are_parted_together_and_each_word_is_looked_up_once(monkeypatch):
    texts = [None, "", " \t\n", "Ab  cd\x1cE\u00a0F\n", " x ", "ÀB y " * 30, "x Ab", "z"]
    want = [(t or "").encode().lower().split() for t in texts]
    asked = []
    monkeypatch.setattr(lm, "xxhash", SimpleNamespace(xxh64_intdigest=lambda w, seed, f=lm.xxhash.xxh64_intdigest: asked.append(w) or f(w, seed)))
    hashes = np.array([lm.xxhash.xxh64_intdigest(w, 42) for w in (b"x", b"y")], np.uint64)
    order = np.argsort(hashes)
    head = lm.Head(hashes[order], order.astype(np.int32), np.array([7, 3]))
    for at_once, alone in ((1 << 20, 0), (20, 1), (0, 6)):
        got, n_alone = [], 0
        for n, sizes, slices in lm.grouped_words(pa.array(texts), at_once):
            asked.clear()
            codes, logs, rare = lm.Coder(head).coded(slices)
            assert len(asked) == len(set(asked))
            n_alone += sizes is None
            ends = [len(codes)] if sizes is None else np.cumsum(sizes).tolist()
            assert len(ends) == n and ends[-1] == len(codes)
            assert np.allclose(logs, [{lm.FIRST: np.log10(7.5), lm.FIRST + 1: np.log10(3.5)}.get(c, 0) for c in codes.tolist()])
            words = [{lm.FIRST: b"x", lm.FIRST + 1: b"y"}[c] if c >= 0 else rare[-1 - c] for c in codes.tolist()]
            got += [words[a:z] for a, z in zip([0, *ends], ends, strict=False)]
        assert got == want and n_alone == alone


def test_rare_words_are_looked_up(spark):
    rows = [(i, " ".join(f"W{(i * 7 + k) % 40}" for k in range(30))) for i in range(30)] + [(None, None), (None, ""), (5, "W1 unseen unseen"), (5, "W1 unseen unseen")]
    frame = lm._documents(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'w' as word", "1 as row"), "doc_id", "text")
    for p in (lm.LmParams(head_words=3), lm.LmParams(kept_words=10), lm.LmParams(head_words=3, kept_words=10, batch=2)):
        got = lm.score(frame, lm.train(frame.filter("not held_out"), p=p), p=p).collect()
        check(got, rows)
        assert all(math.isfinite(r["score"]) for r in got)
    none = frame.limit(0)
    assert lm.score(none, lm.train(none, p=p), p=p).collect() == []
    only_held = frame.filter("held_out")
    assert all(r["train_tokens"] == 0 and math.isfinite(r["score"]) for r in lm.score(only_held, lm.train(none)).collect())


def test_attention_adds_to_the_same_spelling_without_it(spark):
    """All held-out documents, scored twice with the same words, spelling and shares: classes by attention, and by their frequency alone."""
    path = lm.default_path(lm.VOCABULARY)
    documents = lm._documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id", "text")
    learned = lm.learn_words(documents.filter("not held_out"), path)
    coded = lm.code_documents(documents, learned)
    trained = lm.fit(coded.filter("not held_out"), learned, path)
    head = trained.model.head
    mass = np.bincount(head.klass, head.counts, lm.DEFAULTS.classes) + 0.5
    mass[trained.model.own[lm.END_WORD.encode()]] += learned.ends
    params = {**trained.model.params, "U": np.zeros_like(trained.model.params["U"]), "b": np.log(mass / mass.sum()).astype(np.float32)}
    without = lm.replace(trained, model=lm.replace(trained.model, params=params))

    def each(model):
        row = lm.score_coded(coded.filter("held_out"), model, path).selectExpr("sum(score) / sum(n_tokens) as s", "count(*) as n").first()
        return row["s"], row["n"]

    (attention, n), (frequency, same) = each(trained), each(without)
    assert n == same == documents.filter("held_out").count() > 150
    print(f"log10 a token: attention {attention:.3f}, frequency {frequency:.3f}")
    assert attention > frequency + 0.05
