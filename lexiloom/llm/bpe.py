"""BPE encoding and decoding for word-end vocabularies, by a segment tree over pair ranks.

Leaves hold the ranks of adjacent pairs, each node the smaller of its children with ties to the
left, so the root names the leftmost pair of lowest rank. A merge replaces three leaves, each in
logarithmic time; encoding ends when the root is empty. White-space parted pieces of a text do not
influence each other, so their ids are kept and found again.

Defined results: a null text counts as empty and has no ids; special-token strings in a text become
their ids, as the tokenizers library has it; decoding joins token strings by one space (these files
have no decoder). Repeated rows are encoded alike; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.common import table
from lexiloom.llm.tokens import byte_characters, default_path

VOCABULARY = "word_bpe_49k.json"
#: Longer pieces are not kept; so many are, in each of two generations.
_MAX_PIECE, _MAX_KEPT = 60, 400_000
_EMPTY = 1 << 62
_GAP = regex.compile(r"\p{White_Space}+")


class PairTree:
    """Smallest key (rank * n + position) over the adjacent pairs of n symbols, with point updates."""

    def __init__(self, keys: list[int]):
        size = 1
        while size < len(keys):
            size *= 2
        node = [_EMPTY] * size + keys + [_EMPTY] * (size - len(keys))
        for at in range(size - 1, 0, -1):
            left, right = node[2 * at], node[2 * at + 1]
            node[at] = left if left < right else right
        self.size, self.node = size, node

    def set(self, position: int, key: int) -> None:
        """Change one leaf and the nodes above it, as far up as they change."""
        node, at = self.node, self.size + position
        if node[at] == key:
            return
        node[at] = key
        while at > 1:
            other = node[at ^ 1]
            low = key if key < other else other
            at >>= 1
            if node[at] == low:
                return
            node[at] = key = low


class _Kept(dict):
    """piece -> what ``make`` gives; two generations, so that frequent pieces outlive a full table."""

    def __init__(self, make: Callable[[str], tuple[bytes, bytes, int]]):
        super().__init__()
        self._make, self._older = make, {}

    def __missing__(self, piece: str) -> tuple[bytes, bytes, int]:
        found = self._older.get(piece) or self._make(piece)
        if len(piece) <= _MAX_PIECE:
            if len(self) >= _MAX_KEPT:
                self._older = dict(self)
                self.clear()
            self[piece] = found
        return found


class WordBpe:
    """Encoder and decoder of one vocabulary file of the tokenizers library (BPE with a word-end suffix)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = {(self.vocab[a], self.vocab[b]): (rank, self.vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        split = next(s["pattern"]["Regex"] for s in spec["pre_tokenizer"]["pretokenizers"] if s["type"] == "Split")
        self._words = regex.compile(split.replace(r"\s", r"\p{White_Space}"))
        self._specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self._bytes = byte_characters()
        self._kept = _Kept(self._piece)

    def merge(self, symbols: list[int]) -> list[int]:
        """Merge the leftmost pair of lowest rank until no pair can be merged."""
        n = len(symbols)
        if n < 2:
            return symbols
        find, after, before = self.merges.get, list(range(1, n + 1)), list(range(-1, n - 1))
        keys = [found[0] * n + i if (found := find(pair)) else _EMPTY for i, pair in enumerate(zip(symbols, symbols[1:], strict=False))]
        tree = PairTree(keys)
        node, put = tree.node, tree.set
        while (low := node[1]) != _EMPTY:
            i = low % n
            j = after[i]
            merged = symbols[i] = find((symbols[i], symbols[j]))[1]
            symbols[j] = -1
            if j < n - 1:
                put(j, _EMPTY)
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                put(i, found[0] * n + i if (found := find((merged, symbols[k]))) else _EMPTY)
            else:
                put(i, _EMPTY)
            if (h := before[i]) >= 0:
                put(h, found[0] * n + h if (found := find((symbols[h], merged))) else _EMPTY)
        return [s for s in symbols if s >= 0]

    def word_ids(self, word: str) -> list[int]:
        chars = [self._bytes[b] for b in word.encode()]
        chars[-1] += self.suffix
        return self.merge([self.vocab[c] for c in chars if c in self.vocab])

    def _word(self, word: str) -> tuple[bytes, bytes, int]:
        ids = self.word_ids(word)
        return " ".join(map(str, ids)).encode(), self.decode(ids).encode(), len(ids)

    def _piece(self, piece: str) -> tuple[bytes, bytes, int]:
        """(decimal ids, token strings, count) of a piece in lower case, each joined by spaces."""
        words = self._words.findall(piece)
        if words == [piece]:
            return self._word(piece)
        parts = [p for p in map(self._kept.__getitem__, words) if p[2]]
        return b" ".join([p[0] for p in parts]), b" ".join([p[1] for p in parts]), sum([p[2] for p in parts])

    def _parts(self, text: str) -> list[tuple[bytes, bytes, int]]:
        found, at = [], 0
        for m in [*self._specials.finditer(text), None] if "<" in text else [None]:
            part = text[at : m.start() if m else len(text)]
            part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()  # lower case by single characters
            separators = any(c in part for c in "\x1c\x1d\x1e\x1f")  # str.split takes these for white space
            found += map(self._kept.__getitem__, filter(None, _GAP.split(part)) if separators else part.split())
            if m:
                found.append((str(self.special[m[0]]).encode(), m[0].encode(), 1))
                at = m.end()
        return found

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids, _, _ in self._parts(text) for i in ids.split()]

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join(self.token[i] for i in ids)

    def encode_and_decode(self, text: str) -> tuple[bytes, bytes, int]:
        """(decimal ids joined by spaces, decoded text in UTF-8, number of ids) in one pass."""
        parts = self._parts(text)
        if not parts:
            return b"", b"", 0
        ids, decoded, counts = zip(*parts, strict=True)
        return b" ".join(ids), b" ".join(decoded), sum(counts)


@lru_cache(maxsize=2)
def codec(path: str) -> WordBpe:
    """One codec for each worker process."""
    return WordBpe(path)


def encode_texts(df: DataFrame, text_col: str = "text", path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """``row`` (the columns ``keep``, default all), ``ids`` (array<int>) and ``decoded`` of every row."""
    path = path or default_path(VOCABULARY)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for b in batches:
            ids = [own.encode(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(map(own.decode, ids), pa.string())], ["row", "ids", "decoded"])

    rows = _rows(df, text_col, keep)
    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, ids array<int>, decoded string")


def _rows(df: DataFrame, text_col: str, keep: list[str] | None) -> DataFrame:
    kept = [F.col(f"`{c}`") for c in (df.columns if keep is None else keep)]
    return df.select(F.struct(*kept).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))


def digest_texts(df: DataFrame, text_col: str = "text", path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """``row``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``: what encode_texts gives, as digests."""
    path = path or default_path(VOCABULARY)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for b in batches:
            found = [own.encode_and_decode(t or "") for t in b.column(1).to_pylist()]
            columns = [pa.array([n for _, _, n in found], pa.int64()), pa.array([sha(i) for i, _, _ in found]), pa.array([sha(d) for _, d, _ in found])]
            yield pa.RecordBatch.from_arrays([b.column(0), *(c.cast(pa.string()) if k else c for k, c in enumerate(columns))], ["row", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = _rows(df, text_col, keep)
    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    found = digest_texts(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
