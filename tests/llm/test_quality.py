import re
from collections import Counter

from pyspark.sql import functions as F

from lexiloom.llm import quality

LOREM = "the quick brown fox jumps over a lazy dog near some quiet river bank today".split()


def slow(text):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(ws[i : i + 8]) for i in range(len(ws) - 7)]
    count = Counter(grams)
    inside = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside), len(ws) < 20 or 100 * len(inside) > 30 * len(ws)


def texts():
    prose = " ".join(f"{w}{i}" for i, w in enumerate(LOREM * 4))
    return [
        None, "", " \n\t ", "one", "\n".join(["same line here"] * 12), prose, prose + "\n" + prose, prose + " " + " ".join(LOREM) + " x " + " ".join(LOREM), "a " * 40, "a " * 3000, "é ü\x0bñ\x1cz " * 9,
        "# * $ % & | < > " * 5, "A\nB\nA\n\nB\n \nC", " ".join(["w"] * 8), " ".join(["w"] * 9), "漢字 " * 30, "x" * 50_000,
    ]


def test_statistics_equal_direct_counts(spark):
    rows = list(enumerate(texts()))
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'a' as n_words", "1 as row", "2 as votes")
    got = quality.judge(frame).selectExpr("row.doc_id as id", "*").collect()
    want = {i: slow(t) for i, t in rows}
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want[r["id"]], rows[r["id"]]
        assert r["kept"] is not None and not (r["base_failed"] and r["kept"])


def test_ties_nulls_and_empty_tables(spark):
    frame = spark.createDataFrame([(None, "one two"), (None, "one two"), (1, None)], "doc_id long, text string")
    assert [r["kept"] for r in quality.judge(frame).collect()] == [False] * 3
    assert quality.judge(frame.limit(0)).collect() == []


def slow_em(patterns, p):
    acc = [p.first_accuracy] * quality.N_RULES

    def good(v):
        odds = p.prior / (1 - p.prior)
        for a, x in zip(acc, v, strict=True):
            odds *= (a / (1 - a)) ** x
        return odds / (1 + odds)

    for _ in range(p.iterations):
        g = {v: good(v) for v in patterns}
        acc_next = []
        for j in range(quality.N_RULES):
            votes = sum(n for v, n in patterns.items() if v[j])
            right = sum(n * (g[v] if v[j] > 0 else 1 - g[v]) for v, n in patterns.items() if v[j])
            acc_next.append(min(max(right / votes, p.accuracy_bounds[0]), p.accuracy_bounds[1]) if votes else p.first_accuracy)
        acc = acc_next
    return {v: good(v) for v in patterns}


def test_em_equals_direct_em(spark):
    patterns = {(0, 0, 0, 0, 0, 0, 1): 900, (-1, 0, 0, 0, 0, 0, 0): 50, (0, -1, -1, 0, 0, 0, 0): 30, (0, 0, 0, -1, -1, 0, 1): 25, (0, 0, 0, -1, 0, 0, 1): 40, (0, 0, 0, 0, 0, 0, 0): 10}
    frame = spark.createDataFrame([(list(v), n) for v, n in patterns.items()], "votes array<int>, n long")
    got = {tuple(r["votes"]): r["posterior"] for r in quality.fit_posteriors(frame).collect()}
    want = slow_em(patterns, quality.DEFAULTS)
    assert set(got) == set(want) and all(abs(got[v] - want[v]) < 1e-9 for v in want)


def test_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    found = quality.op1_quality_rules(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter(~F.col("base_failed"))
    good = found.filter("quality = 1").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    bad = found.filter("quality = 0").agg(F.avg((~F.col("kept")).cast("int"))).first()[0]
    assert good > 0.98 and bad > 0.9
