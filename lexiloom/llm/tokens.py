"""Byte-level BPE ids at speed, exactly as the tokenizers library gives them.

The pre-tokeniser cuts before every space that a non-space follows, and around every single
newline, so a text falls into pieces whose ids do not depend on their neighbours. Ids of a piece are
computed once by the library and kept; texts with other white space take the pre-tokeniser's own
pattern, and texts with special-token strings or rarer characters take the library whole.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import regex

#: The pre-tokeniser's published pattern; a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters whose classes are the same in every Unicode version in use.
_COMMON = r" -~\n¡-ɏ‐-‧‰-⁞€"
_ODD_GAPS = regex.compile(r"[ \n](?=[ \n]|\Z)|[^" + _COMMON + "]")
_RARE = regex.compile(r"[^\t\r" + _COMMON + "]")
_PRETOKENS = regex.compile(PATTERN)
_ODD_SPACE = regex.compile(r"[^\S ]")
_MAX_PIECE, _MAX_KEPT = 200, 400_000


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    moved = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(moved)) for b in range(256)]


class _Kept(dict):
    """piece -> its ids as little-endian unsigned 32-bit bytes; emptied when it grows too large."""

    def __init__(self, encode: Callable[[str], list[int]]):
        super().__init__({"": b""})
        self._encode = encode

    def __missing__(self, piece: str) -> bytes:
        value = array("I", self._encode(piece)).tobytes()
        if len(piece) <= _MAX_PIECE:
            if len(self) >= _MAX_KEPT:
                self.clear()
                self[""] = b""
            self[piece] = value
        return value


def _piece_encoders(path: str) -> tuple[Callable[[str], list[int]], Callable[[bytes], list[int]] | None, Callable[[str], list[int]]] | None:
    """The same vocabulary in tiktoken, quicker for short pieces: for any piece, for one pre-token's bytes, and for any text.

    None unless ids follow the merges' order.
    """
    import tiktoken

    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    to_byte = {c: b for b, c in enumerate(byte_characters())}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    merged = [model["vocab"][a + b] for a, b in pairs]
    if merged != sorted(merged) or merged[0] < 256 or len(model["vocab"]) != 256 + len(merged):
        return None
    ranks = {bytes(to_byte[c] for c in token): i for token, i in model["vocab"].items()}
    encoding = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    whole, single = encoding.encode_ordinary, getattr(encoding, "_encode_single_piece", None)
    if single is None:
        return whole, None, whole
    # Letters behind at most one space are one pre-token, and need no pattern; rarer letters are left to it.
    plain = regex.compile("[ ]?(?:[A-Za-zÀ-ÖØ-öø-ɏ])+").fullmatch
    return (lambda piece: single(piece) if plain(piece) else whole(piece)), single, whole


class ByteLevelEncoder:
    """Ids of texts under a byte-level BPE file of the tokenizers library.

    Strings of special tokens in a text become their ids, as is the library's default, or
    with ``special_as_text`` ordinary text.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        self.vocab_size = self._tokenizer.get_vocab_size()
        self._tokenizer.encode_special_tokens = special_as_text
        self._special = [] if special_as_text else [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        library = lambda piece: self._tokenizer.encode(piece, add_special_tokens=False).ids
        self._pieces, self._single, self._whole = _piece_encoders(path) or (library, None, None)
        self._begins: np.ndarray | None = None
        self._kept = _Kept(self._pieces)

    def encode_bytes(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if any(s in text for s in self._special):
            return self._library(text)
        if _ODD_GAPS.search(text) is None:
            return b"".join(map(self._kept.__getitem__, text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")))
        if _RARE.search(text) is None:
            return b"".join(map(self._kept.__getitem__, _PRETOKENS.findall(text)))
        return self._library(text)

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_bytes(text), "<u4")

    def word(self, word: bytes) -> bytes:
        """Ids of a word behind a space, which the caller keeps."""
        if self._single is not None and word.isalpha():
            return array("I", self._single(b" " + word)).tobytes()
        return array("I", self._pieces(" " + word.decode())).tobytes()

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after the other, how many each has) of words behind a space each.

        In a text of words parted by single spaces each word's first id, and no other, begins with the space; so the words
        are encoded together. Words that hold rarer white space, which pieces could span, are encoded one by one.
        """
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if self._single is not None:
            if self._begins is None:
                self._begins = np.array([s.startswith("Ġ") for s in self.strings()])
            text = " " + b" ".join(words).decode()
            if _ODD_SPACE.search(text) is None:
                ids = np.array(self._whole(text), np.int64)
                starts = np.flatnonzero(self._begins[ids])
                if len(starts) == len(words):
                    return ids, np.diff(starts, append=len(ids))
        coded = [self.word(w) for w in words]
        return np.frombuffer(b"".join(coded), "<u4").astype(np.int64), np.array([len(x) // 4 for x in coded], np.int64)

    def strings(self) -> list[str]:
        """The token string of every id, in id order."""
        return [self._tokenizer.id_to_token(i) or "" for i in range(self.vocab_size)]

    def _library(self, text: str) -> bytes:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@lru_cache(maxsize=2)
def encoder(path: str, special_as_text: bool = False) -> ByteLevelEncoder:
    """One encoder for each worker process."""
    return ByteLevelEncoder(path, special_as_text)
