import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexiloom.llm import bpe, tokens

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
NASTY = [
    "", " ", "\n\n", "Hello, World! It's 2024.", "a\x1cb \x85c\xa0d", "<|endoftext|>x<|startoftext|> <|endoftext", "ΑΣ ΟΔΟΣ Σ", "İstanbul ǅ ﬁ", "é café", "日本語 テスト",
    "x" * 3000, "ab" * 2000, " lead", "trail ", "two  spaces", "a\nb\n\nc\n", "tab\tand\r\nmore", "it's they'll 'S 's", "… — “quotes” €5", "🙂🙂 x", "﻿bom ​ zero", "a \n b",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORDS), Tokenizer.from_file(BYTES)


def same(library, text):
    want = library[0].encode(text, add_special_tokens=False).ids
    own = bpe.codec(WORDS)
    assert own.encode(text) == want
    ids, decoded, n = own.encode_and_decode(text)
    assert (ids, decoded.decode(), n) == (" ".join(map(str, want)).encode(), library[0].decode(want, skip_special_tokens=False), len(want))
    assert tokens.encoder(BYTES).encode(text).tolist() == library[1].encode(text, add_special_tokens=False).ids


def test_nasty_texts(library):
    for text in NASTY:
        same(library, text)


@settings(max_examples=150, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\n  'stlvedm.,!<|é"), st.characters(max_codepoint=0x24F), st.characters(codec="utf-8", max_codepoint=0x2FFF, exclude_categories=("Cn", "Cs"))), max_size=60))
def test_any_text(text):
    same((Tokenizer.from_file(WORDS), Tokenizer.from_file(BYTES)) if not hasattr(test_any_text, "both") else test_any_text.both, text)


test_any_text.both = (Tokenizer.from_file(WORDS), Tokenizer.from_file(BYTES))


def test_tree_merge_equals_scanning():
    own, rng = bpe.codec(WORDS), random.Random(3)
    for _ in range(300):
        word = "".join(rng.choice("aabcdehinortu") for _ in range(rng.randint(1, 40)))
        symbols = [own.vocab[c] for c in word[:-1]] + [own.vocab[word[-1] + own.suffix]]
        slow = list(symbols)
        while found := min(((own.merges[p][0], i) for i, p in enumerate(zip(slow, slow[1:], strict=False)) if p in own.merges), default=None):
            i = found[1]
            slow[i : i + 2] = [own.merges[slow[i], slow[i + 1]][1]]
        assert own.merge(symbols) == slow


def test_query_and_operator(spark, library):
    d = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = bpe.op7_bpe_round_trip(spark, d).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library[0].encode(texts[r["doc_id"]], add_special_tokens=False).ids
        decoded = library[0].decode(ids, skip_special_tokens=False)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
        assert tokens.encoder(BYTES).encode(texts[r["doc_id"]]).tolist() == library[1].encode(texts[r["doc_id"]], add_special_tokens=False).ids
    frame = spark.createDataFrame([(1, None), (1, None), (None, "")], "doc_id long, text string").selectExpr("*", "'a' as ids", "1 as row")
    assert [(r["ids"], r["decoded"]) for r in bpe.encode_texts(frame).collect()] == [([], "")] * 3
    assert bpe.digest_texts(frame.limit(0)).collect() == []
