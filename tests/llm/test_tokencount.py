import numpy as np
import pytest
from tokenizers import Tokenizer

from lexiloom.llm import tokencount
from lexiloom.llm.tokens import default_path


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(default_path(tokencount.VOCABULARY))
    t.encode_special_tokens = True
    return t


def slow(tokens, end):
    out, start = [], 0
    for at, t in enumerate(tokens):
        if t == end:
            out.append((len(out), start, at - start, True))
            start = at + 1
    return out + ([(len(out), start, len(tokens) - start, False)] if start < len(tokens) else [])


@pytest.mark.parametrize("block,group", [(1, 2), (7, 3), (64, 4096)])
def test_scan_of_flat_files(spark, tmp_path, block, group):
    rng = np.random.default_rng(1)
    files = {
        "a": rng.integers(0, 9, 500), "b": np.full(5, 3), "c": np.full(40, 0), "d": rng.integers(0, 60, 300),
        "e": np.concatenate((np.full(200, 1), [0], np.full(100, 2), [0, 0])), "f": np.zeros(0, np.int64),
    }
    for name, tokens in files.items():
        (tmp_path / name).write_bytes(tokens.astype("<u2").tobytes())
    blocks = tokencount.blocks_of(spark, str(tmp_path), block_tokens=block)
    names = {r["file"]: r["path"].rsplit("/", 1)[-1] for r in blocks.select("file", "path").distinct().collect()}
    got = {}
    for r in tokencount.count_tokens(blocks, 0, group_blocks=group).collect():
        got.setdefault(names[r["file"]], []).append((r["ordinal"], r["start"], r["n_tokens"], r["terminated"]))
    assert {n: sorted(x) for n, x in got.items()} == {n: slow(t.tolist(), 0) for n, t in files.items() if len(t)}


def test_query_on_real_documents(spark, library):
    d = "/root/testdata/sf0.001"
    want = {r["doc_id"]: len(library.encode(r["text"], add_special_tokens=False).ids) for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = tokencount.op3_token_counts(spark, d).collect()
    assert len(got) == len(want) and {r["doc_id"]: r["n_tokens"] for r in got} == want


def counted(spark, frame, folder, **how):
    """Token numbers of the files that a manifest names, by document in the manifest's order."""
    folder.mkdir()
    manifest = tokencount.write_token_files(frame, f"file://{folder}", **how).collect()
    if not manifest:
        return [], []
    blocks = tokencount.blocks_of(spark, f"{folder}/*.bin", how.get("dtype", "<u2"), block_tokens=50)
    names = {r["file"]: r["path"].rsplit("/", 1)[-1] for r in blocks.select("file", "path").distinct().collect()}
    counts = {(names[r["file"]], r["ordinal"]): r["n_tokens"] for r in tokencount.count_tokens(blocks, dtype=how.get("dtype", "<u2")).collect()}
    return [(i, counts[r["path"], r["first"] + k]) for r in manifest for k, i in enumerate(r["ids"])], manifest


def test_edges(spark, library, tmp_path):
    texts = [None, "", "a", "x<|endoftext|>y", "word " * 3000, "a", "日本"]
    rows = [(None if k == 5 else k % 4, t) for k, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as file", "'b' as block", "'p' as path")
    want = sorted((str(i), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    for k, how in enumerate(({}, {"file_bytes": 10}, {"dtype": "<u4"})):
        got, manifest = counted(spark, frame.coalesce(2), tmp_path / str(k), **how)
        assert sorted((str(i), n) for i, n in got) == want
    assert len({r["path"] for r in manifest}) <= 2
    assert counted(spark, frame.limit(0), tmp_path / "none") == ([], [])


def test_files_and_ids_that_do_not_fit_are_errors(spark, tmp_path):
    (tmp_path / "odd").write_bytes(b"abc")
    with pytest.raises(Exception, match="no whole number of ids"):
        tokencount.blocks_of(spark, str(tmp_path)).collect()
    with pytest.raises(ValueError, match="does not fit"):
        tokencount.packed(np.array([65536]), "<u2")
    assert tokencount.id_type(50257) == "<u2" and tokencount.id_type(70000) == "<u4"


def test_a_block_is_read_alone(spark, tmp_path):
    """Blocks of a large sparse file: tasks read the bytes of their blocks, wherever those lie."""
    size = 3_000_000_000
    with open(tmp_path / "large", "wb") as file:
        file.seek(size - 4)
        file.write(np.array([7, 7], "<u2").tobytes())
    blocks = tokencount.blocks_of(spark, str(tmp_path), block_tokens=1 << 18)
    assert blocks.count() == -(-size // (1 << 19))
    got = tokencount.scan_blocks(blocks.filter("block in (0, 5721, 5722)"), 7).collect()
    assert sorted((r["block"], r["n"], r["ends"]) for r in got) == [(0, 1 << 18, []), (5721, 1 << 18, []), (5722, (size - 5722 * (1 << 19)) // 2, [(size - 5722 * (1 << 19)) // 2 - 1, (size - 5722 * (1 << 19)) // 2])]
