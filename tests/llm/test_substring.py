import re

import numpy as np
import pytest
import xxhash

from lexiloom.llm import substring as sub


def words(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(n))


def slow_gear(data):
    table, h, out = sub.gear_table(), 0, []
    for b in data:
        h = ((h << 1) + int(table[b])) & 0xFFFF
        out.append(h)
    return out


def slow_chunks(data, p=sub.DEFAULTS):
    """Ends of the chunks, byte by byte from the rules alone."""
    white = b" \t\n\x0b\x0c\r"
    whole = lambda k: k >= len(data) or data[k] & 0xC0 != 0x80
    cuts = set()
    for k, h in enumerate(slow_gear(data)):
        if h >> (16 - p.mask_bits) == 0:
            gap = next((g for g in range(k, min(len(data), k + p.reach + 1)) if data[g] in white), None)
            cuts.add(gap + 1 if gap is not None else next(c for c in range(k + 1, k + 5) if whole(c)))
    ends, start = [], 0
    for cut in [*sorted(cuts), None]:
        while (len(data) if cut is None else cut) - start > p.max_bytes:
            start += p.max_bytes
            while not whole(start):
                start -= 1
            ends.append(start)
        if cut is not None and cut - start >= p.min_bytes:
            ends.append(cut)
            start = cut
    return [*ends, len(data)] if start < len(data) else ends


def slow_runs(ends, flags, data, p=sub.DEFAULTS):
    """Maximal runs of repeated chunks that hold enough words or bytes."""
    starts, out, k = [0, *ends[:-1]], [], 0
    while k < len(ends):
        z = k
        while z < len(ends) and flags[z]:
            z += 1
        if z > k:
            part = data[starts[k] : ends[z - 1]]
            if len(part) >= p.min_run_bytes or len([w for w in re.split(rb"[\x20\x09-\x0d]+", part) if w]) >= p.min_run_words:
                out.append((starts[k], len(part)))
        k = max(z, k + 1)
    return out


def slow_dedup(rows, p=sub.DEFAULTS):
    """Direct reading of the rules, one row after the other; chunks are compared as they are."""
    owner, cut = {}, []
    for i, text in rows:
        data = (text or "").encode()
        ends = slow_chunks(data, p) if data else []
        chunks = [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        rank = (i is None, xxhash.xxh3_64_intdigest(data) >> 1 if i is None else i)
        cut.append((i, text, data, ends, chunks, rank))
        for c in chunks:
            owner[c] = min(owner.get(c, rank), rank)
    out = []
    for i, text, data, ends, chunks, rank in cut:
        seen, flags = set(), []
        for c in chunks:
            flags.append(c in seen or rank > owner[c])
            seen.add(c)
        kept, at = b"", 0
        for s, n in slow_runs(ends, flags, data, p):
            kept += data[at:s]
            at = s + n
        out.append((i, None if text is None else (kept + data[at:]).decode(), len(ends), sum(flags)))
    return sorted(out, key=str)


def result(df):
    return sorted([(r["row_id"], r["kept_text"], r["n_chunks"], r["n_repeats"]) for r in df.selectExpr("rest.doc_id as row_id", "*").collect()], key=str)


def test_gear_hash_is_the_rolling_hash():
    data = words(1, 200).encode()
    assert sub.gear_hash(np.frombuffer(data, np.uint8)).tolist() == slow_gear(data)


def test_chunks_cover_the_text_and_keep_characters_whole():
    for text in (words(2, 400), "é" * 3000, "日本語" * 500, "x" * 5000, "a", " ", "\n" * 700, words(3, 50) + "\n" + "ü" * 900):
        data = text.encode()
        ends = sub.chunk_ends(np.frombuffer(data, np.uint8))
        assert ends == sorted(set(ends)) and ends[-1] == len(data)
        parts = [data[a:b].decode() for a, b in zip([0, *ends], ends, strict=False)]
        assert "".join(parts) == text and max(len(p.encode()) for p in parts) <= sub.DEFAULTS.max_bytes


def test_insertions_shift_no_later_chunk():
    text = words(4, 800)
    before = sub.chunks_of(text.encode())[1]
    after = sub.chunks_of(("inserted words here " + text).encode())[1]
    assert len(set(before) - set(after)) <= 4


CHINESE = "".join(chr(0x4E00 + k) for k in np.random.default_rng(8).integers(0, 3000, 5000))
UNSPACED = "".join(chr(97 + k) for k in np.random.default_rng(9).integers(0, 26, 6000))


@pytest.mark.parametrize("text", [CHINESE, UNSPACED, words(2, 600), words(2, 600).replace(" ", "\t"), words(2, 600).replace(" ", "\x0b"), "ab " + UNSPACED[:900] + "\n" + CHINESE[:700] + words(3, 90), "é" * 900, "x" * 700])
def test_chunks_equal_a_byte_by_byte_reading(text):
    assert sub.chunk_ends(np.frombuffer(text.encode(), np.uint8)) == slow_chunks(text.encode())


@pytest.mark.parametrize("text,put", [(CHINESE, "字"), (UNSPACED, "q"), (words(4, 900).replace(" ", "\t"), "q")])
def test_one_inserted_character_leaves_nearly_all_chunks(text, put):
    before = set(sub.chunks_of(text.encode())[1])
    after = set(sub.chunks_of((put + text).encode())[1])
    assert len(before & after) > 0.9 * len(before)


def test_copies_without_spaces_go(spark):
    rows = [(1, CHINESE[:3000]), (2, CHINESE[:3000]), (3, "前" + CHINESE[1000:2000]), (4, UNSPACED[:3000]), (5, UNSPACED[:3000]), (6, CHINESE[4000:])]
    got = sub.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"))
    assert result(got) == slow_dedup(rows)
    left = {r["doc_id"]: len(r["kept_text"]) for r in got.selectExpr("rest.doc_id", "kept_text").collect()}
    assert left[1] == 3000 and left[2] == 0 and left[3] < 100 and left[4] == 3000 and left[5] == 0 and left[6] == 1000


def test_rows_without_ids_share_passages_too(spark):
    passage = words(11, 70)
    rows = [(None, words(500 + k, 40) + " " + passage + " " + words(600 + k, 40)) for k in range(5)] + [(None, passage), (None, passage), (None, None), (7, words(700, 50))]
    got = result(sub.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == slow_dedup(rows)
    middle = " ".join(passage.split()[15:45])
    assert sum(middle in (t or "") for _, t, _, _ in got) in (1, 2)  # the two equal rows get equal results


def test_passages_go_once_and_clean_texts_stay(spark):
    passage = words(5, 60)
    rows = [(i, words(100 + i, 80) + " " + passage + " " + words(200 + i, 80)) for i in range(6)] + [(50 + i, words(300 + i, 150)) for i in range(4)]
    got = {r[0]: r[1] for r in result(sub.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")))}
    middle = " ".join(passage.split()[15:40])
    assert middle in got[0] and all(middle not in got[i] for i in range(1, 6))
    assert all(got[i] == t for i, t in rows if i >= 50)


def test_equals_direct_reading(spark):
    a, b = words(6, 200), words(7, 90)
    rows = [(3, a), (1, b + " " + a), (2, a), (None, a), (None, None), (4, None), (5, ""), (6, "short"), (7, "short"), (2, b), (2, b), (8, b + "\n" + b), (9, "y" * 2000), (10, "y" * 2000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'c' as rest", "1 as rank", "'k' as repeats")
    assert result(sub.dedup_substrings(frame)) == slow_dedup(rows)
    few = sub.ChunkParams(held_chunks=5)
    assert result(sub.dedup_substrings(frame.repartition(3), p=few)) == slow_dedup(rows)


def test_query_on_real_documents(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = sub.op2_substring_dedup(spark, d).collect()
    assert sorted([(r["doc_id"], r["text"], r["n_chunks"]) for r in got], key=str) == sorted([r[:3] for r in slow_dedup(rows)], key=str)
    texts = dict(rows)
    for r in got:
        data, at, kept = texts[r["doc_id"]].encode(), 0, b""
        for s in r["spans"]:
            kept += data[at : s["start"]]
            at = s["start"] + s["length"]
        assert (kept + data[at:]).decode() == r["text"] and r["removed_bytes"] == sum(s["length"] for s in r["spans"])


def test_empty_table(spark):
    assert sub.dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_copies_leave_no_large_digest_group(spark):
    passage = " ".join(f"word{k}" for k in range(60))
    rows = [(i, passage) for i in range(10_000)] + [(None, passage)] * 2_000 + [(20_000, passage + " tail")] * 500
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    chunks = sub.chunk_table(df)
    largest = chunks.groupBy("d1", "d2").count().agg({"count": "max"}).first()[0]
    assert largest <= 3 * 4  # a row from each task for each kind of rank
    kept = sub.dedup_substrings(df).groupBy("rest.doc_id").agg({"removed_bytes": "max"}).collect()
    gone = dict(map(tuple, kept))
    assert gone[0] == 0 and all(gone[i] == len(passage) for i in range(1, 10_000))
