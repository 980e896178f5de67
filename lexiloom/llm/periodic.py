"""Periodic runs of words, by matching of aligned blocks.

A run is a stretch of words that repeats itself with some smallest period q for at least four periods and six words, and that no
neighbouring word extends. Let b be a power of two. Every run whose period lies between (2b - 1) / 3 and (4b - 1) / 3 holds a
block of b words that begins at a multiple of b and stands again q words further on, still within the run. So, for each b, an
Aho-Corasick automaton of the document's aligned blocks is led over the document; an occurrence at such a distance from the
block seeds a comparison of words in both directions, which gives the whole stretch of that period exactly. Of stretches of
one extent the smallest period counts, which is the run's.

Three or more occurrences of one block at such distances stand a fixed step apart, as the block is periodic itself. The only distance
that can be a run's smallest period is then the one that lays the end of the block's own stretch of that step on the end of
the occurrences' stretch. So a block seeds two comparisons at most, and one that a known stretch already answers is not made again:
a document of n words takes some n log n steps, however repetitive it is. Blocks that occur once in a document, by a hash of their words,
cannot seed and stay out of the automaton. The automaton's letters are words, and from blocks of 16 words on hashes of an eighth of a block, so that
a block is eight integers at most; the document is then read once for each remainder of places by that length. The comparison of words
decides in any case. Long documents are searched part by part, so that an automaton holds the blocks of ``PART`` words, or four blocks where these
are longer.

Every text is a row of its own: there is no shuffle, and a task that is lost runs again. A task's memory grows with its longest
text, by some 200 bytes a word.

Defined results: a null or empty text has no runs and collapses to the empty text; repeated rows are treated alike; an empty
table gives an empty result. Input columns travel in a struct and clash with nothing. Words are compared by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.common import table, words_of

#: A run has at least so many periods and so many words.
PERIODS, LEAST = 4, 6
#: Words whose blocks one automaton holds.
PART = 1 << 16
#: Letters of a block in the automaton; longer blocks have longer letters, so that no chain of fallbacks grows with them.
LETTERS = 8
_NO_LETTER = 1 << 31
_RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def scale(b: int) -> tuple[int, int]:
    """Least and greatest period whose runs hold an aligned block of b words that recurs one period on."""
    return -(-(2 * b - 1) // 3), -(-(4 * b - 1) // 3) - 1


def repeated_blocks(w: np.ndarray) -> Iterator[tuple[int, np.ndarray, int, np.ndarray]]:
    """(b, starts, stride, letters): aligned blocks that may occur more than once, for each b that a run of this many words can need.

    ``letters`` are numbers for the windows of ``stride`` words at every place: the words themselves, or 31 bits of the windows' hashes.
    A window that recurs has halves that recur, so only what is left of one size is looked at for the next.
    """
    n, b = len(w), 2
    if n < LEAST:
        return
    x = w.astype(np.uint64)
    h = (x[:-1] * _MIX + x[1:] + np.uint64(1)) * _MIX
    letters = {1: w}
    at = np.arange(n - 1)
    bits = max(8, n.bit_length() + 3)
    while scale(b)[0] * PERIODS <= n:
        slot = (h[at] >> np.uint64(64 - bits)).astype(np.int64)
        at = at[np.bincount(slot, minlength=1 << bits)[slot] > 1]
        if not len(at):
            return
        stride = max(1, b // LETTERS)
        letters.pop(stride // 2, None)
        letters[b] = (h >> np.uint64(33)).astype(np.int64)
        yield b, at[at % b == 0], stride, letters[stride]
        again = np.zeros(n, bool)
        again[at] = True
        at = at[at + 2 * b <= n]
        at = at[again[at + b]]
        h = (h[:-b] * _MIX + (h[b:] ^ (h[b:] >> np.uint64(29)))) * _MIX
        b *= 2


def seeds(b: int, starts: np.ndarray, stride: int, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(block start, distance) of the occurrences of blocks of b words at distances of their scale; by start, then distance."""
    low, high = scale(b)
    first, last = int(starts[0]), int(starts[-1])
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    size = b // stride
    names: dict[tuple[int, ...], int] = {}
    blocks = list(map(tuple, letters[starts[:, None] + stride * np.arange(size)].tolist()))
    named = np.full((last - first) // b + 1, -1)
    named[(starts - first) // b] = [names.setdefault(block, len(names)) for block in blocks]
    for block, k in names.items():
        automaton.add_word(block, k)
    automaton.make_automaton()
    # Letters that stand a stride apart follow each other: one row for each remainder, ended by a letter of no block.
    there = letters[first : last + high + b]
    rows = -(-len(there) // stride) + 1
    laid = np.full(rows * stride, _NO_LETTER)
    laid[: len(there)] = there
    found = np.array(list(automaton.iter(tuple(laid.reshape(rows, stride).T.ravel().tolist()))), np.int64).reshape(-1, 2)
    rest, row = np.divmod(found[:, 0], rows)
    place, name = (row - size + 1) * stride + rest, found[:, 1]
    # At most one multiple of b lies so far before an occurrence: the scale spans fewer than b distances.
    home = (place - low) // b
    fits = (home >= 0) & (place - home * b <= high) & (home < len(named))
    place, name, home = place[fits], name[fits], home[fits]
    own = named[home] == name
    place, home = place[own], home[own]
    order = np.argsort(place)
    return home[order] * b + first, (place - home * b)[order]


class Stretches:
    """Stretches of given periods around given words; the last of each period is known again."""

    def __init__(self, w: np.ndarray):
        self._w = w
        self._known: dict[tuple[int, int], tuple[int, int]] = {}

    def around(self, q: int, i: int, role: int) -> tuple[int, int, bool]:
        """(start, end, new) of the longest stretch of period q that holds words i and i + q, which are equal."""
        known = self._known.get((q, role))
        if known and known[0] <= i < known[1] - q:
            return *known, False
        w, n = self._w, len(self._w) - q
        end, step = i, 32
        while end < n:
            stop = min(n, end + step)
            differs = w[end:stop] != w[end + q : stop + q]
            k = int(differs.argmax())
            if differs[k]:
                end += k
                break
            end, step = stop, min(4 * step, 1 << 16)
        start, step = i, 32
        while start > 0:
            stop = max(0, start - step)
            differs = w[stop:start][::-1] != w[stop + q : start + q][::-1]
            k = int(differs.argmax())
            if differs[k]:
                start -= k
                break
            start, step = stop, min(4 * step, 1 << 16)
        self._known[q, role] = start, end + q
        return start, end + q, True


def find_runs(w: np.ndarray, part: int = PART) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of word numbers, by start, then period."""
    runs: dict[tuple[int, int], int] = {}
    stretches = Stretches(w)

    def keep(q: int, i: int) -> None:
        start, end, new = stretches.around(q, i, 0)
        if new and end - start >= max(LEAST, PERIODS * q) and runs.get((start, end), q) >= q:
            runs[start, end] = q

    for b, starts, stride, letters in repeated_blocks(w):
        low, high = scale(b)
        wide = max(part, 4 * b)
        cuts = np.searchsorted(starts, np.arange(0, len(w) + wide, wide))
        for some in (starts[a:z] for a, z in pairwise(cuts.tolist()) if z > a):
            home, distance = seeds(b, some, stride, letters)
            edges = [0, *(np.flatnonzero(np.diff(home)) + 1).tolist(), len(home)]
            distance = distance.tolist()
            for a, z in pairwise(edges):
                if a == z:
                    continue
                i, own = int(home[a]), distance[a:z]
                steps = {y - x for x, y in pairwise(own)}
                if len(own) > 2 and len(steps) == 1:
                    step = steps.pop()
                    q = stretches.around(step, i + own[0], 2)[1] - stretches.around(step, i, 1)[1]
                    own = [q] if low <= q <= high else []
                for q in own:
                    keep(q, i)
    return sorted(((start, end - start, q) for (start, end), q in runs.items()), key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that stand in a run behind its first period."""
    if not runs:
        return words
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return [w for w, k in zip(words, kept.tolist(), strict=True) if k]


def periodic_runs(df: DataFrame, text_col: str = "text", keep: list[str] | None = None, part: int = PART) -> DataFrame:
    """``row`` (the input row, or its columns ``keep``), ``runs`` (start, length and period in words) and ``collapsed``, the text's words without repetitions."""
    row = F.struct(*[F.col(f"`{c}`") for c in (df.columns if keep is None else keep)])
    rows = df.select(row.alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    names = ["row", "runs", "collapsed"]
    kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, left = [], []
            for text in b.column(1).cast(pa.binary()).to_pylist():
                words = (text or b"").split()  # ASCII white space parts words
                known: dict[bytes, int] = {}
                runs = find_runs(np.array([known.setdefault(x, len(known)) for x in words], np.int32), part)
                found.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                left.append(b" ".join(collapse(words, runs)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind), pa.array(left, pa.binary()).cast(pa.string())], names)

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, runs {_RUNS}, collapsed string")


def with_planted_run(text: Column, doc_id: Column) -> Column:
    """The text, where the id's checksum says so, with its words from some place on replaced by repetitions; an id that is null plants none."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def planted(ws: Column) -> Column:
        n = F.size(ws).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        at = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
        spelled = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(ws, at(i))), " ")
        return F.when(n > 0, spelled).otherwise("")

    # The array binds the words once for all places.
    return F.when(F.coalesce(h % 10 == 0, F.lit(False)), F.get(F.transform(F.array(words_of(text)), planted), F.lit(0))).otherwise(text)


def run_digests(found: DataFrame) -> DataFrame:
    """``row`` and the digest columns of ``periodic_runs``: number of runs, the one with most periods, and checksums of runs and text."""
    # Exponents are compared by cross multiplication, as fractions; runs come by start, then period, and the first of equals stays.
    better = lambda x, y: y["length"] * x["period"] > x["length"] * y["period"]
    top = F.aggregate("runs", F.get("runs", F.lit(0)), lambda x, y: F.when(better(x, y), y).otherwise(x))
    line = lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))
    told = found.select("row", F.size("runs").cast("long").alias("n_runs"), top.alias("top"), F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    return told.select("row", "n_runs", "top.start", "top.length", "top.period", F.floor(1000 * F.col("top.length") / F.col("top.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, some of which carry a planted one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", with_planted_run(F.col("text"), F.col("doc_id")).alias("text"))
    found = run_digests(periodic_runs(docs, keep=["doc_id"]))
    return found.select("row.doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def oracle() -> str:
    """Equal words at equal distances, gathered into islands; the checksum of ids is reckoned from its table."""
    return rf"""
WITH RECURSIVE bits(i, k, c) AS (
  SELECT i, 0, i FROM range(256) AS t(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
docs AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
hashed AS (
  SELECT rid, doc_id, ws, len(ws) AS n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h
  FROM docs, crc),
placed AS (SELECT *, h % 10 = 0 AND n > 0 AS planted, CASE WHEN n > 0 THEN (h // 10) % n END AS a FROM hashed),
each AS (
  SELECT rid, n, i, CASE WHEN planted AND i >= a THEN ws[a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) + 1] ELSE ws[i + 1] END AS w
  FROM placed, unnest(range(n)) AS t(i)),
same AS (SELECT u.rid, v.i - u.i AS q, u.i FROM each u JOIN each v ON u.rid = v.rid AND u.w = v.w AND v.i > u.i AND {PERIODS} * (v.i - u.i) <= u.n),
islands AS (SELECT rid, q, i, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island FROM same),
spans AS (SELECT rid, q, min(i) AS s, count(*) + q AS l FROM islands GROUP BY rid, q, island HAVING count(*) + q >= greatest({LEAST}, {PERIODS} * q)),
runs AS (SELECT rid, s, l, min(q) AS q FROM spans GROUP BY ALL),
listed AS (SELECT rid, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS runs FROM runs GROUP BY rid),
tops AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY l / q DESC, s, q) AS k FROM runs) WHERE k = 1),
kept AS (SELECT rid, string_agg(w, ' ' ORDER BY i) AS words FROM each e WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.rid = e.rid AND e.i >= r.s + r.q AND e.i < r.s + r.l) GROUP BY rid)
SELECT p.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, s::BIGINT AS start, l::BIGINT AS length, q::BIGINT AS period, (1000 * l // q)::BIGINT AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(words, '')) AS collapsed_sha256
FROM placed p LEFT JOIN listed USING (rid) LEFT JOIN tops USING (rid) LEFT JOIN kept USING (rid)
"""
