import corpus_pipeline
from tests.llm.test_packing import check_rows
from tests.llm.test_quality import slow as slow_stats
from tests.llm.test_similar import slow_first
from tests.llm.test_substring import slow_dedup

from lexiloom.llm import quality


def test_every_stage_equals_brute_force(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d)
        if name == "best_fit_packing":
            n, total = check_rows(out.collect(), rows)
            assert n <= 1.02 * total / 2048 + 2
            break
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns
        got = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "quality_rules":
            kept = {r["row"]["doc_id"] for r in quality.judge(spark.read.parquet(f"{d}/documents.parquet")).collect() if r["kept"]}
            assert set(got) == kept and not any(slow_stats(rows[i])[5] for i in kept)
        elif name == "near_dedup":
            assert set(got) == set(slow_first([(i, i, t) for i, t in rows.items()]).values())
        else:
            assert got == {i: t for i, t, _, _ in slow_dedup(list(rows.items()))}
            assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
        rows = got
    assert sorted(map(tuple, (r[:4] for r in corpus_pipeline.run(spark, d).select("doc_id", "piece", "start", "length").collect()))) == sorted(
        map(tuple, (r[:4] for r in out.select("doc_id", "piece", "start", "length").collect()))
    )


def test_nulls_and_empty_tables(spark):
    frame = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    for docs in (frame, frame.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, "").collect()


def test_odd_rows_and_clashing_columns(spark, tmp_path):
    word = lambda k: f"w{k % 997}a{k % 13}"
    plain = lambda a: ". ".join(" ".join(word(a * 7919 + 31 * k + j * j) for j in range(9)) for k in range(12))
    long = " ".join(word(k * k % 7907 + k) for k in range(60_000))
    rows = [(1, plain(1)), (1, plain(1)), (2, plain(1)), (None, plain(1)), (None, plain(2)), (None, plain(2)), (3, None), (4, ""), (5, " \n"), (6, long), (7, long + " tail"), (8, plain(3))]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' as lang", "'s' as source", "cast(length(text) as long) as n_chars", *[f"'{c}' as {c}" for c in ("doc", "row", "words", "file", "at", "no", "key", "class")])
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 3:
            assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = sorted((r["doc_id"] for r in docs.collect()), key=str)
    assert seen["near_dedup"] == sorted([1, 6, 8, None], key=str) == seen["substring_dedup"]
    assert set(seen["best_fit_packing"]) == {1, 6, 8, None}
    empty = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).collect() == []
