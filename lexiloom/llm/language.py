"""Language identification by cross-parsing entropy.

A text is parsed against the sample text of each learned language: it is cut into phrases, each the longest match with any place of the
sample, and the next phrase begins behind it. The suffix automaton of a sample follows such matches letter by letter and gives their lengths.
Phrases are normalised by what pointing at one costs, the logarithm of the sample's length, and the language that needs the fewest wins;
of equals the smaller name does. The score is the winner's share when every phrase costs that many nats.

Texts are read as lower-case letters, with one gap in place of whatever stands between them, so digits, marks and markup do not vote.
They are parsed in segments of ``SEGMENT`` letters, each from its beginning, so that one long text is as parallel as many short ones:
the automata are laid out as tables, in which a letter that no match goes on with leads to where the next phrase stands behind that letter,
and all segments of a batch take a step together. Whole texts are parsed.

Learning takes a bounded sample of the labelled rows: for each language the ``docs_each`` different texts of smallest hash, the first
``chars_of_doc`` characters of each, up to ``chars_each`` in all and to ``chars_in_all`` over all languages, which share that alike.
The hash depends on nothing but the text, so the sample does not depend on partitions or ids. Only it is sent to the tasks; each Python worker
builds its automata from it once. Hashes are cut down to the smallest before and after they are shuffled, so a language that has most of
the rows is no hot group.

Defined results: a null text, or one without a letter, is ``und`` with score 0; letters that no sample holds are phrases of their own, and
a text of such letters alone goes to the language whose phrases cost least; rows with null ``lang`` or null text teach nothing; where there
is nothing to learn from every text is ``und``; repeated rows are judged alike, and a null id counts as the empty id in the split. An empty
table gives an empty result. Input columns travel in a struct.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom.llm.common import crc32_of_id, keep_pages, table

UNKNOWN = "und"
SEGMENT = 256
#: The bounds of the sample.
DOCS_EACH, CHARS_OF_DOC, CHARS_EACH, CHARS_IN_ALL = 64, 2048, 32_768, 1 << 18
#: Classes of characters: gap, the most frequent letters, all other letters, and what fills up a segment.
_CLASSES = 64
_GAP, _OTHER, _FILL = 0, _CLASSES - 2, _CLASSES - 1
#: Segments that step together.
_TOGETHER = 4096
#: Parts of a language whose hashes are ranked on their own first.
_PARTS = 32
#: Rows whose texts are held at once as letters.
_ROWS = 256
Sample = tuple[tuple[str, str], ...]


class SuffixAutomaton:
    """All substrings of a sequence of small numbers: ``follow[state]`` maps a number to the next state; state 0 is empty."""

    def __init__(self, sequence: Iterable[int]):
        self.follow: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in sequence:
            new = len(self.follow)
            self.follow.append({})
            length.append(length[last] + 1)
            link.append(0)
            at = last
            while at >= 0 and c not in self.follow[at]:
                self.follow[at][c] = new
                at = link[at]
            if at >= 0:
                other = self.follow[at][c]
                if length[at] + 1 == length[other]:
                    link[new] = other
                else:
                    clone = len(self.follow)
                    self.follow.append(dict(self.follow[other]))
                    length.append(length[at] + 1)
                    link.append(link[other])
                    while at >= 0 and self.follow[at].get(c) == other:
                        self.follow[at][c] = clone
                        at = link[at]
                    link[other] = link[new] = clone
            last = new


@lru_cache(maxsize=1)
def _lower_letters() -> np.ndarray:
    """Code point of the lower-case letter of every code point; 0 for what is no letter."""
    found = np.zeros(0x110000, np.uint32)
    for code in range(0x110000):
        c = chr(code)
        if c.isalpha():
            found[code] = ord(c.lower()[0])
    return found


def letters_of(text: str) -> np.ndarray:
    """Lower-case letters of a text, a 0 for each stretch of anything else between them."""
    found = _lower_letters()[np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")]
    if not len(found):
        return found
    kept = found != 0
    kept[1:] |= found[:-1] != 0
    found = found[kept]
    return found[(1 if found[:1].tolist() == [0] else 0) : (-1 if len(found) > 1 and found[-1] == 0 else None)]


class CrossParser:
    """Counts phrases of texts against the samples of all languages at once."""

    def __init__(self, sample: Sample):
        self.languages = sorted({lang for lang, _ in sample})
        texts = {lang: [letters_of(t) for own, t in sample if own == lang] for lang in self.languages}
        codes, counts = np.unique(np.concatenate([np.zeros(0, np.uint32), *(x for own in texts.values() for x in own)]), return_counts=True)
        known = sorted((-n, c) for c, n in zip(codes.tolist(), counts.tolist(), strict=True) if c)
        self._class_of = np.full(0x110000, _OTHER, np.uint8)
        self._class_of[0] = _GAP
        for k, (_, c) in enumerate(known[: _OTHER - 1]):
            self._class_of[c] = k + 1
        tables, at = [], len(self.languages) * _CLASSES
        # The first states of the table, _CLASSES for each language, stand behind the first letter of a phrase: reaching one counts a phrase.
        fresh = np.zeros((at, _CLASSES), np.int64)
        self.costs = np.zeros(len(self.languages))
        for k, lang in enumerate(self.languages):
            classes = [self._class_of[x] for x in texts[lang]]
            self.costs[k] = math.log(sum(map(len, classes)) + 2)
            automaton = SuffixAutomaton(c for x in classes for c in [*x.tolist(), _FILL])
            follow, base = automaton.follow, k * _CLASSES
            own = np.empty((len(follow), _CLASSES), np.int64)
            own[:] = base + np.arange(_CLASSES)
            own[:, _FILL] = at + np.arange(len(follow))
            for s, steps in enumerate(follow):
                for c, t in steps.items():
                    if c < _OTHER:
                        own[s, c] = at + t
            for c in range(_FILL):
                reached = follow[0].get(c) if c < _OTHER else None
                fresh[base + c] = own[reached] if reached is not None else base + np.arange(_CLASSES)
                fresh[base + c, _FILL] = at + (reached or 0)
            # From the empty state every letter begins a phrase.
            own[0, :_FILL] = base + np.arange(_FILL)
            tables.append(own)
            at += len(follow)
        self._table = (np.concatenate([fresh, *tables]) * _CLASSES).astype(np.int32).ravel()
        self._counted = len(self.languages) * _CLASSES * _CLASSES
        self._starts = np.cumsum([0, *map(len, tables)][:-1])[:, None] * _CLASSES + self._counted

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """(text, language): phrases of each text, given as its letters."""
        sizes = np.array([len(x) for x in texts])
        pieces = -(-sizes // SEGMENT)
        ends = np.cumsum(pieces)
        laid = np.full((int(pieces.sum()), SEGMENT), _FILL, np.uint8)
        for x, end, k in zip(texts, ends.tolist(), pieces.tolist(), strict=True):
            laid[end - k : end].ravel()[: len(x)] = self._class_of[x]
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        owner = np.repeat(np.arange(len(texts)), pieces)
        for a in range(0, len(owner), _TOGETHER):
            np.add.at(out, owner[a : a + _TOGETHER], self._count(np.ascontiguousarray(laid[a : a + _TOGETHER].T)))
        return out

    def _count(self, columns: np.ndarray) -> np.ndarray:
        state = np.repeat(self._starts, columns.shape[1], axis=1)
        count = np.zeros(state.shape, np.int32)
        for column in columns:
            moved = column != _FILL
            state = self._table[state + column]
            count += (state < self._counted) & moved
        return count.T

    def judge(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the language, score) for rows of phrases."""
        cost = phrases * self.costs
        best = cost.argmin(axis=1)
        least = cost[np.arange(len(best)), best]
        return best, 1 / np.exp(np.maximum(least[:, None] - cost, -700)).sum(axis=1)


@lru_cache(maxsize=2)
def parser(sample: Sample) -> CrossParser:
    return CrossParser(sample)


def learn(df: DataFrame, text_col: str, lang_col: str, docs_each: int = DOCS_EACH, chars_of_doc: int = CHARS_OF_DOC, chars_each: int = CHARS_EACH, chars_in_all: int = CHARS_IN_ALL) -> Sample:
    """The bounded sample of (language, text) that automata are built from."""
    text = F.col(f"`{text_col}`").cast("string")
    rows = df.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), text.alias("text")).filter(F.col("lang").isNotNull() & F.rlike("text", F.lit(r"\p{L}"))).withColumn("h", F.xxhash64("text"))
    order = Window.partitionBy("lang").orderBy("h")
    # Copies of a text are one hash before anything is ranked, and the ranking keeps its smallest map-side, in parts of a language first.
    part = F.pmod("h", F.lit(_PARTS))
    first = rows.select("lang", "h").distinct().withColumn("k", F.row_number().over(Window.partitionBy("lang", part).orderBy("h"))).filter(F.col("k") <= docs_each)
    least = first.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= docs_each).select("lang", "h")
    # At most docs_each rows for each language.
    drawn = rows.join(F.broadcast(least), ["lang", "h"], "left_semi").groupBy("lang", "h").agg(F.min(F.left("text", F.lit(chars_of_doc))).alias("text")).orderBy("lang", "h").collect()
    languages = {r["lang"] for r in drawn}
    share = min(chars_each, max(chars_in_all // max(1, len(languages)), 256))
    left = dict.fromkeys(languages, share)
    sample = []
    for r in drawn:
        if left[r["lang"]] > 0:
            sample.append((r["lang"], r["text"][: left[r["lang"]]]))
            left[r["lang"]] -= len(sample[-1][1])
    return tuple(sample)


def identify(df: DataFrame, sample: Sample, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row`` (the input row, or its columns ``keep``), ``lang_pred`` and ``score``."""
    row = F.struct(*[F.col(f"`{c}`") for c in (df.columns if keep is None else keep)])
    rows = df.select(row.alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    sent = df.sparkSession.sparkContext.broadcast(sample)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_pages()
        own = parser(sent.value)
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                b = whole.slice(at, _ROWS)
                texts = [letters_of(t or "") for t in b.column(1).to_pylist()]
                told = np.array([len(x) > 0 for x in texts], bool) & (len(own.languages) > 0)
                names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
                if told.any():
                    best, score = own.judge(own.phrases([x for x, t in zip(texts, told.tolist(), strict=True) if t]))
                    scores[told] = score
                    for place, k in zip(np.flatnonzero(told).tolist(), best.tolist(), strict=True):
                        names[place] = own.languages[k]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores)], ["row", "lang_pred", "score"])

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    return crc32_of_id(doc_id) % 5 == 0


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    sample = learn(docs.filter(~held_out(F.col("doc_id"))), "text", "lang")
    return identify(docs, sample, keep=["doc_id"]).select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score")
