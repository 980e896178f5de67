"""Language-model scores: a causal self-attention model on subword ids, trained in numpy.

Text is lower-cased (A-Z) and parted into tokens: its words, and one end. A word's subword ids are those of the word behind a
space. A token enters the model as the mean of the trained vectors of its subword ids (frequent ids have their own, the
rest share one), attention looks back over the tokens of a window, and its output predicts the class of the next token. The
end and the most frequent words are classes of their own; other words belong to the class of their first subword id. What is learnt:

1. word counts of all training documents, counted in groups of texts and summed within each task and by a shuffle;
2. from the word counts, and so from the whole training text: the probability of a word within its class, a mixture of the
   word's own share (of the ``head_words`` most frequent words, a fixed number that is broadcast) and of its spelling in
   subword ids, neighbour by neighbour. The weight of spelling is the share of words seen once or beyond the head (Good-Turing);
3. the attention model, over windows of ``window`` tokens. The training documents are dealt by a hash of id and text to
   ``rounds`` rounds and to shards of a round; windows of a document lie back to back, so every training token is a target
   exactly once. Each shard trains from the same start, in the order of the hash; the parameters (some 80 kB) are averaged
   with the tokens as weights, summed in a fixed order. So the model does not depend on how the input is partitioned.

Scoring cuts each document into windows that overlap by ``context`` tokens; a window scores only tokens that no window before it
scored, so each token is scored once, with at least ``context`` tokens before it. Windows of many documents run as one batch
under a causal mask. The probabilities of all words, spelt-out ones included, add up to 1 at most, so scores of texts compare.

Texts are read twice: to count words, and to write each document as one number for each token (its place among the head
words, by frequency), with the words beyond the head beside it. Training and scoring read these numbers. Neighbouring texts are parted into
words together, and each different word of theirs is counted or looked up once.

Memory is bounded: the head is a fixed number of words, a worker in training keeps ``kept_words`` more, long texts are parted in slices, words
beyond the head are looked up by a shuffled join, and the tables of the model have the vocabulary's size.

Defined results: a null text counts as empty and has the end token alone; a null doc_id is hashed as the empty text and so
trains; repeated rows are scored alike; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.common import crc32_of_id, keep_pages, materialise, table
from lexiloom.llm.tokens import default_path, encoder

VOCABULARY = "byte_bpe_50k.json"
END_ID = 50256
#: Stands for the end token among words, which hold no space.
END_WORD = " "
#: Numbers of what stands before a text, of what fills up a window, of the end and of the most frequent word.
START, PAD, END, FIRST = range(4)
#: The seed of Spark's xxhash64.
_HASH_SEED = 42
_GAP = re.compile(rb"[\x20\x09-\x0D]")
#: Bytes of a text's slice and of texts that are parted together, and words whose vectors are reckoned at once.
_SLICE, _TOGETHER, _AT_ONCE = 1 << 20, 1 << 22, 1 << 14


@dataclass(frozen=True)
class LmParams:
    width: int = 16
    #: Tokens of a window, and of the overlap of neighbouring windows in scoring.
    window: int = 32
    context: int = 8
    #: Vectors of subword ids; the last two are for the start and for all rarer ids.
    buckets: int = 1024
    classes: int = 128
    own_classes: int = 24
    spell_classes: int = 512
    rounds: int = 2
    batch: int = 64
    rate: float = 0.01
    seed: int = 11
    head_words: int = 1 << 20
    #: Words beyond the head that a worker keeps in training to find them again.
    kept_words: int = 200_000
    #: Training tokens of a shard in a round, and the most shards of a round.
    shard_tokens: int = 1 << 20
    most_shards: int = 4096


DEFAULTS = LmParams()


@dataclass
class Head:
    """The most frequent words, the most frequent first, as arrays; ``hashes`` rise and ``places`` are their words' places."""

    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    places: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    klass: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int16))
    inside: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))  # log P(word | class)
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    flat: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int16))  # buckets of the words' ids, word after word


@dataclass
class Model:
    """Tables over subword ids and frequent words, and the trained parameters by name. Logs are natural."""

    bucket: np.ndarray
    first_class: np.ndarray  # class of the words that begin with an id
    first_log: np.ndarray  # log P(first id | class)
    inner_class: np.ndarray
    inner_log: np.ndarray  # log P(id | inner class)
    spell: np.ndarray  # log P(inner class, or the word's end | bucket before)
    own: dict[bytes, int]  # words that are classes
    spelt: float = 0.5  # weight of spelling
    head: Head = field(default_factory=Head)
    params: dict[str, np.ndarray] = field(default_factory=dict)
    vectors: np.ndarray | None = None  # of the head words, with room behind; made by a worker that scores, for all its tasks

    def flat(self) -> np.ndarray:
        return np.concatenate([self.params[k].ravel() for k in sorted(self.params)])

    def with_flat(self, flat: np.ndarray) -> Model:
        out, at = {}, 0
        for k in sorted(self.params):
            shape = self.params[k].shape
            n = math.prod(shape)
            out[k] = flat[at : at + n].reshape(shape).astype(np.float32)
            at += n
        return replace(self, params=out)

    def without_lookup(self) -> Model:
        """What training and scoring of coded documents need."""
        return replace(self, head=replace(self.head, hashes=self.head.hashes[:0], places=self.head.places[:0], counts=self.head.counts[:0]))

    def spelling(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """log P(word | class) by spelling: the first id within its class, each further id by the one before it, then the word's end."""
        starts, buckets = np.cumsum(sizes) - sizes, self.bucket[ids]
        step = self.inner_log[ids] + self.spell[np.concatenate(([0], buckets[:-1])), self.inner_class[ids]]
        step[starts] = self.first_log[ids[starts]]
        return np.add.reduceat(step.astype(np.float64), starts) + self.spell[buckets[starts + sizes - 1], -1]


def _levels(counts: np.ndarray, classes: int, single: int) -> np.ndarray:
    """Class of each id: the ``single`` most frequent ones alone, the others together by levels of equal mass."""
    order = np.lexsort((np.arange(len(counts)), -counts))
    out = np.empty(len(counts), np.int16)
    alone, rest = order[:single], order[single:]
    out[alone] = np.arange(len(alone))
    mass = np.cumsum(counts[rest] + 0.01)
    out[rest] = single + np.minimum((mass / mass[-1] * (classes - single)).astype(int), classes - single - 1) if len(rest) else 0
    return out


def first_model(total: np.ndarray, first: np.ndarray, own: list[tuple[bytes, int]], p: LmParams = DEFAULTS) -> Model:
    """Classes and start values from counts of ids at all places and at the heads of words without a class of their own.

    ``own``: (word, count) of the words that are classes. The bias starts from the frequencies of the classes.
    """
    n = len(total)
    order = np.lexsort((np.arange(n), -total))[: p.buckets - 2]
    bucket = np.full(n, p.buckets - 1, np.int16)
    bucket[order] = np.arange(len(order))
    shared = p.classes - p.own_classes
    first_class = p.own_classes + _levels(first, shared, shared - max(1, shared // 4))
    smooth = first + 0.01
    mass = np.bincount(first_class, smooth, p.classes)
    inner = np.maximum(total - first, 0)
    inner_class = _levels(inner, p.spell_classes, p.spell_classes - max(1, p.spell_classes // 16))
    inner_mass = np.bincount(inner_class, inner + 0.01, p.spell_classes)
    weights = mass.copy()
    for k, (_, c) in enumerate(own):
        weights[k] = c
    prior = np.log((weights + 0.5) / (weights + 0.5).sum()).astype(np.float32)
    rng = np.random.default_rng(p.seed)
    d = p.width
    normal = lambda *shape: rng.normal(0, 1, shape).astype(np.float32)
    params = {
        "E": normal(p.buckets, d) * 0.3, "P": normal(p.window, d) * 0.05, "U": normal(d, p.classes) * 0.05, "b": prior,
        **{w: normal(d, d) / math.sqrt(d) for w in ("Wq", "Wk", "Wv")}, "Wo": normal(d, d) * 0.1,
    }
    even = np.full((p.buckets, p.spell_classes + 1), -math.log(p.spell_classes + 1), np.float32)
    return Model(
        bucket, first_class, np.log(smooth / mass[first_class]).astype(np.float32), inner_class, np.log((inner + 0.01) / inner_mass[inner_class]).astype(np.float32), even, {w: k for k, (w, _) in enumerate(own)},
        params=params,
    )


def _near_zero(a: np.ndarray, mask: np.ndarray | None = None) -> None:
    """Take each row's maximum (among unmasked places) out of ``a`` wherever any value is so far from 0 that exp could fail."""
    if a.size and (a.max() > 40 or a.min() < -40):
        if mask is not None:
            a[:, mask == 0] = -np.inf
        a -= a.max(axis=-1, keepdims=True)


def forward(w: dict[str, np.ndarray], x: np.ndarray) -> dict[str, np.ndarray]:
    """Batched masked attention over (batch, window, width) vectors; padding lies behind and so is never seen."""
    x = x + w["P"]
    b, t, d = x.shape
    # Three products are cheaper than one that has to be parted.
    rows = x.reshape(-1, d)
    q, k, v = ((rows @ m).reshape(b, t, d) for m in (w["Wq"] * x.dtype.type(1 / math.sqrt(d)), w["Wk"], w["Wv"]))
    a = q @ np.ascontiguousarray(k.transpose(0, 2, 1))
    mask = np.tri(t, dtype=x.dtype)
    _near_zero(a, mask)
    np.exp(a, out=a)
    a *= mask
    total = (a @ np.ones(t, x.dtype))[:, :, None]
    o = a @ v
    o /= total
    return {"x": x, "q": q, "k": k, "v": v, "a": a, "total": total, "o": o, "h": x + np.dot(o.reshape(-1, d), w["Wo"]).reshape(b, t, d)}


def class_sums(h: np.ndarray, weights: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(exp of ``h @ weights``, its sums by row, the wanted columns' values before exp).

    The sums show whether exp went well, so the values need no search of their own; if it did not, each row's maximum is taken out first.
    """
    at, ones = np.arange(len(h)), np.ones(weights.shape[1], weights.dtype)
    values = h @ weights
    right = values[at, want]
    with np.errstate(over="ignore", invalid="ignore"):
        np.exp(values, out=values)
        total = values @ ones
    if len(h) and not (total.min() > 1e-30 and total.max() < 1e30):
        values = h @ weights
        values -= values.max(axis=-1, keepdims=True)
        right = values[at, want]
        np.exp(values, out=values)
        total = values @ ones
    return values, total, right


def _sums(vectors: np.ndarray, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sum of ``vectors`` at each run of ``flat``: the first places of all runs at once, and so on; long runs one by one."""
    out = vectors.take(flat[starts], axis=0)
    for k in range(1, 6):
        at = np.flatnonzero(sizes > k)
        if not len(at):
            return out
        out[at] += vectors.take(flat[starts[at] + k], axis=0)
    for i in np.flatnonzero(sizes > 6).tolist():
        out[i] += vectors.take(flat[starts[i] + 6 : starts[i] + sizes[i]], axis=0).sum(axis=0)
    return out


def gradients(w: dict[str, np.ndarray], flat: np.ndarray, sizes: np.ndarray, targets: np.ndarray, valid: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """(mean loss, gradients) of the class predictions at valid places; ``flat`` and ``sizes``: buckets of the input tokens, place by place."""
    d, kind = w["Wq"].shape[0], w["E"].dtype
    part = (1 / sizes).astype(kind)[:, None]
    starts = np.cumsum(sizes) - sizes
    f = forward(w, (_sums(w["E"], flat, starts, sizes) * part).reshape(*targets.shape, d))
    wide = lambda m: m.reshape(-1, d)
    h, want, ok = wide(f["h"]), targets.ravel(), valid.ravel()
    at, n = np.arange(len(h)), max(1, int(ok.sum()))
    # A column of ones, so that the classes' own weights are a row of the same matrix.
    h = np.concatenate((h, np.ones((len(h), 1), kind)), axis=1)
    prob, total, right = class_sums(h, np.concatenate((w["U"], w["b"][None])), want)
    loss = -float((right - np.log(total))[ok].sum()) / n
    # The rows' factor is applied to what is narrow.
    prob[at, want] -= total
    scale = (ok.astype(kind) / kind.type(n) / total)[:, None]
    both = (prob.T @ (h * scale)).T
    g = {"U": both[:d], "b": both[d]}
    dh = (prob @ w["U"].T) * scale
    g["Wo"] = wide(f["o"]).T @ dh
    do = (dh @ w["Wo"].T).reshape(f["o"].shape)
    a = f["a"] / f["total"]
    ds = do @ np.ascontiguousarray(f["v"].transpose(0, 2, 1))
    ds -= np.einsum("bij,bij->bi", ds, a)[:, :, None]
    ds *= a
    # f["q"] holds the scale already.
    three = np.concatenate((wide(ds @ f["k"]), wide(ds.transpose(0, 2, 1) @ f["q"]), wide(a.transpose(0, 2, 1) @ do)), axis=1)
    scale = kind.type(1 / math.sqrt(d))
    mixed = wide(f["x"]).T @ three
    g["Wq"], g["Wk"], g["Wv"] = mixed[:, :d] * scale, mixed[:, d : 2 * d], mixed[:, 2 * d :]
    dx = dh + three @ np.concatenate((w["Wq"] * scale, w["Wk"], w["Wv"]), axis=1).T
    g["P"] = dx.reshape(f["x"].shape).sum(axis=0)
    order = np.argsort(flat, kind="stable")
    known = flat[order]
    first = np.flatnonzero(np.concatenate(([True], known[1:] != known[:-1])))
    g["E"] = np.zeros_like(w["E"])
    g["E"][known[first]] = np.add.reduceat((dx * part).take(np.repeat(at, sizes)[order], axis=0), first, axis=0)
    return loss, g


class Trainer:
    """Adam over batches of windows."""

    def __init__(self, model: Model, p: LmParams):
        self.p, self.steps, self.tokens, self.params = p, 0, 0, {}
        self._names = sorted(model.params)
        self._flat = np.concatenate([model.params[k].ravel() for k in self._names])
        self._m, self._v, self._work = (np.zeros_like(self._flat) for _ in range(3))
        at = 0
        for k in self._names:  # views of the flat vector
            old = model.params[k]
            self.params[k] = self._flat[at : at + old.size].reshape(old.shape)
            at += old.size

    def step(self, flat: np.ndarray, sizes: np.ndarray, targets: np.ndarray, valid: np.ndarray) -> float:
        loss, found = gradients(self.params, flat, sizes, targets, valid)
        self.steps += 1
        self.tokens += int(valid.sum())
        g, m, v, work = np.concatenate([found[k].ravel() for k in self._names]), self._m, self._v, self._work
        np.subtract(g, m, out=work)
        work *= np.float32(0.1)
        m += work
        g *= g
        g -= v
        g *= np.float32(0.001)
        v += g
        np.sqrt(v, out=work)
        work += np.float32(1e-8)
        np.divide(m, work, out=work)
        work *= np.float32(self.p.rate * math.sqrt(1 - 0.999**self.steps) / (1 - 0.9**self.steps))
        self._flat -= work
        return loss

    def flat(self) -> np.ndarray:
        return self._flat.astype(np.float64)


def ids_of(words: list[bytes], encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(subword ids one after the other, how many each word has); the end has its own."""
    end = END_WORD.encode()
    at = [k for k, w in enumerate(words) if w == end]
    ids, sizes = encode([w for w in words if w != end] if at else words)
    if at:
        places = (np.cumsum(sizes) - sizes)[at[0] :][:1]
        ids = np.insert(ids, places[0] if len(places) else len(ids), END_ID)
        sizes = np.insert(sizes, at[0], 1)
    return ids, sizes


class Coder:
    """Finds words among the head words, a group of texts at a time."""

    def __init__(self, head: Head):
        self._head, self._logs = head, np.log10(head.counts + 0.5)

    def found(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number among the head words, or -1 beyond; log10(count + 0.5), or 0 beyond) of each of some words."""
        codes, logs, known = np.full(len(words), -1, np.int32), np.zeros(len(words)), self._head.hashes
        if len(known):
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(_HASH_SEED)), np.uint64, len(words))
            order = np.argsort(hashes)  # rising, so that neighbours are looked for in turn
            hashes = hashes[order]
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            hit = known[at] == hashes
            place = self._head.places[at[hit]]
            codes[order[hit]], logs[order[hit]] = place + FIRST, self._logs[place]
        return codes, logs

    def coded(self, slices: Iterable[pa.Array]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """(codes, logs, rare words) of words, one slice after the other; the codes of rare words count down from -1."""
        rare: dict[bytes, int] = {}
        codes, logs = [np.zeros(0, np.int32)], [np.zeros(0)]
        for s in slices:
            each = s.dictionary_encode()
            words = each.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)
            code, log = self.found(words)
            for k in np.flatnonzero(code < 0).tolist():
                code[k] = -1 - rare.setdefault(words[k], len(rare))
            place = each.indices.to_numpy()
            codes.append(code[place])
            logs.append(log[place])
        return np.concatenate(codes), np.concatenate(logs), list(rare)


def _put(array: np.ndarray, at: int, new: np.ndarray) -> np.ndarray:
    """``array`` with ``new`` at ``at``; grown by half where it is too short, so that many small additions cost little."""
    if at + len(new) > len(array):
        array = np.concatenate((array, np.zeros((at + len(new)) // 2 + 1024, array.dtype)))
    array[at : at + len(new)] = new
    return array


class Entries:
    """What training and scoring need of words, by number: ``klass``, ``inside`` (log P(word | class)) and the buckets of their ids.

    The head words stand first. Words beyond it are given numbers as they are met, until ``forget``.
    """

    def __init__(self, model: Model, path: str):
        self._model, self._encode, head = model, encoder(path, True).words, model.head
        marks = len(model.params["E"]) - 2
        end = model.own.get(END_WORD.encode(), 0)
        self.klass = np.concatenate((np.array([0, 0, end], np.int16), head.klass))
        self.inside = np.concatenate((np.zeros(3, np.float32), head.inside))
        self.sizes = np.concatenate((np.ones(3, np.int32), head.sizes))
        self.flat = np.concatenate((np.array([marks, marks + 1, model.bucket[END_ID]], np.int16), head.flat))
        self.starts = (np.cumsum(self.sizes, dtype=np.int64) - self.sizes).astype(np.int32)
        self.n = self._fixed = len(self.sizes)
        self._n_flat = self._fixed_flat = len(self.flat)
        self._rare: dict[bytes, int] = {}

    def numbers(self, codes: bytes, rare: list[bytes] | None) -> np.ndarray:
        """Numbers of a document's tokens; the codes of its rare words count down from -1."""
        numbers = np.frombuffer(codes, "<i4")
        if rare:
            own = np.array([self._rare.setdefault(w, self._fixed + len(self._rare)) for w in rare], np.int32)
            numbers = numbers.copy()
            beyond = numbers < 0
            numbers[beyond] = own[-1 - numbers[beyond]]
        return numbers

    def settle(self) -> None:
        """Make the entries of words met since."""
        if self._fixed + len(self._rare) > self.n:
            new = list(islice(self._rare, self.n - self._fixed, None))
            ids, sizes = ids_of(new, self._encode)
            starts = np.cumsum(sizes) - sizes
            self.starts = _put(self.starts, self.n, starts + self._n_flat)
            self.klass = _put(self.klass, self.n, self._model.first_class[ids[starts]].astype(np.int16))
            self.inside = _put(self.inside, self.n, (self._model.spelling(ids, sizes) + math.log(self._model.spelt)).astype(np.float32))
            self.sizes, self.flat = _put(self.sizes, self.n, sizes), _put(self.flat, self._n_flat, self._model.bucket[ids])
            self.n, self._n_flat = self.n + len(new), self._n_flat + len(ids)

    def met(self) -> int:
        return len(self._rare)

    def forget(self, numbers: np.ndarray) -> np.ndarray:
        """Drop the rare words but those among ``numbers``, which are given back as they are numbered now."""
        kept = np.unique(numbers[numbers >= self._fixed])
        words = list(self._rare) if len(kept) else []
        self._rare = {words[k - self._fixed]: self._fixed + n for n, k in enumerate(kept.tolist())}
        self.n, self._n_flat = self._fixed, self._fixed_flat
        out = numbers.copy()
        out[numbers >= self._fixed] = self._fixed + np.searchsorted(kept, numbers[numbers >= self._fixed])
        return out

    def buckets_of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(flat buckets, sizes) of entries, one after the other."""
        sizes = self.sizes[numbers]
        ends = np.cumsum(sizes, dtype=np.int64)
        return self.flat[np.repeat(self.starts[numbers] - (ends - sizes), sizes) + np.arange(ends[-1])], sizes

    def vectors(self, first: int = 0) -> np.ndarray:
        """The mean of its ids' vectors for every entry from ``first`` on."""
        table = self._model.params["E"]
        out = np.empty((self.n - first, table.shape[1]), np.float32)
        for a in range(first, self.n, _AT_ONCE):
            starts, sizes = self.starts[a : min(self.n, a + _AT_ONCE)], self.sizes[a : min(self.n, a + _AT_ONCE)]
            each = table.take(self.flat[starts[0] : starts[-1] + sizes[-1]], axis=0)
            out[a - first : a - first + len(sizes)] = np.add.reduceat(each, starts - starts[0], axis=0) / sizes[:, None].astype(np.float32)
        return out


def spans(n: int, p: LmParams) -> np.ndarray:
    """Starts of the windows over n targets: the first scores all of its tokens, each later one ``window - context`` more."""
    return np.arange(0, max(1, n - p.context), p.window - p.context)


def score_tokens(w: dict[str, np.ndarray], vectors: np.ndarray, klass: np.ndarray, inside: np.ndarray, documents: list[np.ndarray], p: LmParams = DEFAULTS, at_once: int = 64) -> np.ndarray:
    """log10 probability of each sequence of numbers (the end included), which ``vectors``, ``klass`` and ``inside`` are indexed by."""
    if not documents:
        return np.zeros(0)
    sizes = np.array([len(d) for d in documents], np.int64)
    first = np.cumsum(sizes) - sizes
    targets = np.concatenate(documents)
    inputs = np.full(len(targets) + p.window, PAD, np.int32)
    inputs[1 : len(targets) + 1] = targets
    inputs[first] = START  # nothing before the first token
    counts = np.array([len(spans(n, p)) for n in sizes.tolist()], np.int64)
    owner = np.repeat(np.arange(len(sizes)), counts)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = number * (p.window - p.context)
    # At the head of a window come ``context`` tokens that the window before it scored.
    low, high = np.where(number == 0, 0, p.context), np.minimum(p.window, sizes[owner] - start)
    place = np.arange(p.window)
    both = np.concatenate((w["U"], w["b"][None]))
    # Window by window, the scored places are the tokens in their order: what belongs to them are plain slices.
    ends = np.cumsum(np.maximum(high - low, 0))
    klass, values, done = klass[targets], inside[targets].astype(np.float64), 0
    for a in range(0, len(owner), at_once):
        z = slice(a, a + at_once)
        at = (first[owner[z]] + start[z])[:, None] + place
        scored = (place >= low[z, None]) & (place < high[z, None])
        to = int(ends[min(a + at_once, len(owner)) - 1])
        h = np.ones((to - done, len(both)), np.float32)
        h[:, :-1] = forward(w, vectors.take(inputs[np.minimum(at, len(inputs) - 1)], axis=0))["h"][scored]
        _, total, right = class_sums(h, both, klass[done:to])
        values[done:to] += right - np.log(total)
        done = to
    return np.add.reduceat(values, first) / math.log(10)


def words_in(text: bytes | None, at_once: int = _SLICE) -> Iterator[list[bytes]]:
    """Words in lower case, a slice of the text at a time: bytes change and part at ASCII only."""
    text, start = text or b"", 0
    while len(text) - start > at_once:
        gap = _GAP.search(text, start + at_once)
        end = gap.start() if gap else len(text)
        yield text[start:end].lower().split()
        start = end
    yield text[start:].lower().split()


def grouped_words(texts: pa.Array, at_once: int = _TOGETHER) -> Iterator[tuple[int, np.ndarray | None, Iterable[pa.Array]]]:
    """(number of texts, words of each, their words in lower case) of neighbouring texts that are ``at_once`` bytes together at most.

    A longer text stands alone; its words come in slices and are not counted.
    """
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), dtype=np.int64)
    a = 0
    while a < len(texts):
        before = int(ends[a - 1]) if a else 0
        z = max(a + 1, int(np.searchsorted(ends, before + at_once, side="right")))
        part = texts.slice(a, z - a)
        if ends[z - 1] - before > at_once:
            yield 1, None, (pa.array(words, pa.binary()).cast(pa.string()) for words in words_in(_bytes(part)[0]))
        else:
            clean = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(part.cast(pa.string()), "")))
            words = pc.ascii_split_whitespace(clean)
            sizes, filled = pc.list_value_length(words).to_numpy(), pc.binary_length(clean).to_numpy() > 0
            flat = words.flatten()
            # Of a text without words an empty one is left.
            yield z - a, sizes * filled, [flat if filled.all() else flat.filter(pc.not_equal(flat, ""))]
        a = z


def _documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, held_out, text)."""
    doc_id = F.col(f"`{id_col}`").cast("long")
    return df.select(doc_id.alias("doc_id"), (crc32_of_id(doc_id) % 5 == 1).alias("held_out"), F.col(f"`{text_col}`").cast("string").alias("text"))


def _bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()


def word_counts(training: DataFrame, p: LmParams = DEFAULTS) -> DataFrame:
    """(word, c) over all texts; END_WORD counts the texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, slices in grouped_words(b.column(0)):
                for words in slices:
                    counts = words.value_counts()  # added up by Spark, first within this task
                    yield pa.RecordBatch.from_arrays([counts.field(0), counts.field(1)], ["word", "c"])
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([END_WORD]), pa.array([b.num_rows])], ["word", "c"])

    return training.select("text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def with_ids(words: DataFrame, path: str) -> DataFrame:
    """(word, c, ids, head): the subword ids of each word as bytes, and the first of them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, True).words
        for b in batches:
            if b.num_rows:
                ids, sizes = ids_of(_bytes(b.column(0)), encode)
                ends = np.cumsum(sizes)
                data, head = ids.astype("<u4").tobytes(), ids[ends - sizes].astype(np.int32)
                coded = [data[4 * a : 4 * z] for a, z in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(coded, pa.binary()), pa.array(head)], ["word", "c", "ids", "head"])

    return words.select("word", "c").mapInArrow(run, "word string, c long, ids binary, head int")


def _summed(words: DataFrame, count: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Sum over all words of ``count(ids one after the other, their numbers, counts)``, an array of ``size``: so many rows come to the driver at most."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(size)
        for b in batches:
            if b.num_rows:
                coded = b.column(1).to_pylist()
                totals += count(np.frombuffer(b"".join(coded), "<u4").astype(np.int64), np.array([len(i) // 4 for i in coded]), b.column(0).to_numpy())
        seen = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int64)), pa.array(totals[seen])], ["id", "c"])

    out = np.zeros(size)
    found = words.select("c", "ids").mapInArrow(run, "id long, c double").groupBy("id").agg(F.sum("c").alias("c")).toArrow()
    out[found["id"].to_numpy()] = found["c"].to_numpy()
    return out


def id_counts(words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences of each id at all places, and as a word's first."""
    n = END_ID + 1

    def count(ids: np.ndarray, sizes: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.concatenate((np.bincount(ids, np.repeat(c, sizes), n), np.bincount(ids[np.cumsum(sizes) - sizes], c, n)))

    return tuple(_summed(words, count, 2 * n).reshape(2, n))


def spell_table(words: DataFrame, model: Model, p: LmParams = DEFAULTS, spread: float = 2.0) -> np.ndarray:
    """log P(inner class of the next id, or the word's end | bucket before), as counted within words."""
    wide, bucket, inner = p.spell_classes + 1, model.bucket, model.inner_class

    def count(ids: np.ndarray, sizes: np.ndarray, c: np.ndarray) -> np.ndarray:
        nxt = np.concatenate((inner[ids[1:]], [0])).astype(np.int64)
        nxt[np.cumsum(sizes) - 1] = wide - 1
        return np.bincount(bucket[ids].astype(np.int64) * wide + nxt, np.repeat(c, sizes), p.buckets * wide)

    found = _summed(words.filter(F.col("word") != END_WORD), count, p.buckets * wide).reshape(p.buckets, wide)
    back = found.sum(axis=0) + 1e-3
    found += spread * back / back.sum()
    return np.log(found / found.sum(axis=1, keepdims=True)).astype(np.float32)


def frequent_words(words: DataFrame, most: int) -> tuple[pa.Table, int]:
    """((h, c, ids) of all words from some count on, ``most`` at most; occurrences of the others).

    Counts are graded in eighths of an octave, some 500 grades; the lowest grade is chosen by their sizes.
    """
    graded = words.filter(F.col("word") != END_WORD).select(F.xxhash64("word").alias("h"), "c", "ids", F.floor(F.log2("c") * 8).alias("grade"))
    taken, lowest, beyond = 0, math.inf, 0
    for r in graded.groupBy("grade").agg(F.count("*").alias("n"), F.sum("c").alias("c")).orderBy(F.desc("grade")).collect():
        taken += r["n"]
        if taken > most:
            beyond += r["c"]
        else:
            lowest = r["grade"]
    return graded.filter(F.col("grade") >= F.lit(lowest)).select("h", "c", "ids").toArrow(), beyond


def with_head(model: Model, words: DataFrame, p: LmParams = DEFAULTS) -> Model:
    """The model with the frequent words and the weight of spelling."""
    found, beyond = frequent_words(words, p.head_words)
    if not found.num_rows:
        return model
    hashes, counts = found["h"].to_numpy().view(np.uint64), found["c"].to_numpy()
    order = np.lexsort((hashes, -counts))
    hashes, counts = hashes[order], counts[order]
    coded = found["ids"].combine_chunks().take(pa.array(order))
    sizes = pc.binary_length(coded).to_numpy().astype(np.int64) // 4
    ids = np.frombuffer(b"".join(coded.to_pylist()), "<u4").astype(np.int64)
    klass = model.first_class[ids[np.cumsum(sizes) - sizes]].astype(np.int16)
    owned = np.zeros(len(klass), bool)
    for w, k in model.own.items():
        same = hashes == np.uint64(xxhash.xxh64_intdigest(w, _HASH_SEED))
        klass[same], owned[same] = k, True
    rare, shared = int(counts[counts == 1].sum()) + beyond, int(counts[~owned].sum()) + beyond
    mass = np.bincount(klass, counts, p.classes)
    spelt = min(0.5, max(0.02, rare / shared)) if shared else 0.5
    inside = np.where(owned, 0.0, np.logaddexp(model.spelling(ids, sizes) + math.log(spelt), np.log(counts / mass[klass]) + math.log1p(-spelt)))
    by_hash = np.argsort(hashes)
    head = Head(hashes[by_hash], by_hash.astype(np.int32), counts, klass, inside.astype(np.float32), sizes.astype(np.int32), model.bucket[ids])
    return replace(model, spelt=spelt, head=head)


def windows_of(numbers: np.ndarray, p: LmParams = DEFAULTS) -> tuple[np.ndarray, np.ndarray]:
    """(inputs, targets) of a text's windows, back to back: each token is a target once; its input is the token before it."""
    n = -(-len(numbers) // p.window) * p.window
    pair = np.full((2, n), PAD, np.int32)
    pair[0, 0], pair[0, 1 : len(numbers)], pair[1, : len(numbers)] = START, numbers[:-1], numbers
    return pair[0].reshape(-1, p.window), pair[1].reshape(-1, p.window)


def dealt(coded: DataFrame, p: LmParams, shards: int) -> DataFrame:
    """(turn, shard, mark, codes, rare): the round and the shard in which each document trains, and its place there by its hash."""
    spot = F.pmod("mark", F.lit(p.rounds * shards))
    return coded.select((spot % p.rounds).cast("int").alias("turn"), F.floor(spot / p.rounds).cast("int").alias("shard"), "mark", "codes", "rare")


def train_round(coded: DataFrame, model: Model, path: str, p: LmParams, turn: int, shards: int) -> Model:
    """One local pass over each shard's documents of this round, then the mean of the parameters."""
    shared = coded.sparkSession.sparkContext.broadcast(model.without_lookup())

    def local(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_pages()
        start, at, trainer, waiting = shared.value, None, None, 0
        entries = Entries(start, path)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def steps(least: int) -> None:
            """Train on full batches of the windows held, and with ``least`` 1 on the rest too."""
            inputs, targets = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            entries.settle()
            done = 0
            while len(inputs) - done >= least:
                x, y = inputs[done : done + p.batch], targets[done : done + p.batch]
                trainer.step(*entries.buckets_of(x.ravel()), entries.klass[y].astype(np.int64), y != PAD)
                done += len(x)
            if done < len(inputs):
                held.append((inputs[done:], targets[done:]))

        def result() -> pa.RecordBatch:
            flat = trainer.flat() * trainer.tokens
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([trainer.tokens], pa.int64()), pa.array([flat.tobytes()], pa.binary())], ["shard", "n", "flat"])

        for b in batches:
            for shard, codes, rare in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if shard != at:
                    if trainer is not None:
                        if held:
                            steps(1)
                        yield result()
                    at, trainer, waiting = shard, Trainer(start, p), 0
                held.append(windows_of(entries.numbers(codes, rare), p))
                waiting += len(held[-1][0])
                if waiting >= p.batch:
                    steps(p.batch)
                    waiting = len(held[0][0]) if held else 0
                    if entries.met() > p.kept_words:
                        again = entries.forget(np.concatenate([np.stack(x) for x in held], axis=1) if held else np.zeros((2, 0, p.window), np.int32))
                        held[:] = [(again[0], again[1])] if held else []
        if trainer is not None:
            if held:
                steps(1)
            yield result()

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, n, total = None, 0, None
        out = lambda: pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["grp", "n", "flat"])
        for b in batches:
            for g, tokens, data in zip(*(b.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                if g != group and group is not None:
                    yield out()
                if g != group:
                    group, n, total = g, 0, 0.0
                n, total = n + tokens, total + np.frombuffer(data)
        if group is not None:
            yield out()

    rows = dealt(coded, p, shards).filter(F.col("turn") == turn).select("shard", "mark", "codes", "rare")
    ordered = rows.repartition("shard").sortWithinPartitions("shard", "mark").select("shard", "codes", "rare")
    trained = ordered.mapInArrow(local, "shard int, n long, flat binary")
    # At most 16 sums come to the driver, however many shards have trained; all are added up in the order of the shards.
    grouped = trained.select((F.col("shard") % 16).alias("grp"), "shard", "n", "flat").repartition("grp").sortWithinPartitions("grp", "shard")
    sums = sorted(grouped.mapInArrow(add, "grp int, n long, flat binary").collect(), key=lambda r: r["grp"])
    if not sums:
        return model
    return model.with_flat(sum(np.frombuffer(r["flat"]) for r in sums) / sum(r["n"] for r in sums))


@dataclass
class Trained:
    """What scoring needs; ``words`` stays a distributed table."""

    words: DataFrame
    total: int
    distinct: int
    ends: int
    model: Model


def learn_words(training: DataFrame, path: str, p: LmParams = DEFAULTS) -> Trained:
    """Counts, classes, spelling and head words of (text) rows; the attention model stands at its start."""
    words = materialise(with_ids(word_counts(training, p), path), "words")
    row = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(F.max(F.when(F.col("word") == END_WORD, F.col("c"))), F.lit(0)).alias("ends")).first()
    frequent = words.filter(F.col("word") != END_WORD).orderBy(F.desc("c"), "word").limit(p.own_classes - 1).select("word", "c", "head").collect()
    total, first = id_counts(words)
    first[END_ID] -= row["ends"]
    for r in frequent:
        first[r["head"]] -= r["c"]
    model = first_model(total, np.maximum(first, 0), [(END_WORD.encode(), row["ends"]), *((r["word"].encode(), r["c"]) for r in frequent)], p)
    model.spell = spell_table(words, model, p)
    return Trained(words.select("word", "c"), row["n"], row["v"], row["ends"], with_head(model, words, p))


def code_documents(documents: DataFrame, learned: Trained, p: LmParams = DEFAULTS) -> DataFrame:
    """Rows of (doc_id, held_out, text), written as (doc_id, held_out, mark, row, n_tokens, known, base, codes, rare, times).

    ``codes``: the tokens' numbers, 32 bits each; ``rare`` and ``times``: words beyond the head and how often the document has them;
    ``known`` and ``base`` (sum of log10(count + 0.5)) leave them out.
    """
    shared = documents.sparkSession.sparkContext.broadcast(learned.model.head)
    end_log, ends_known = math.log10(learned.ends + 0.5), int(learned.ends > 0)
    types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64())]
    names = ["doc_id", "held_out", "mark", "row", "n_tokens", "known", "base", "codes", "rare", "times"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_pages()
        coder, row = Coder(shared.value), TaskContext.get().partitionId() << 33
        none, last = np.zeros(0, np.int64), np.array([END], "<i4").tobytes()
        for b in batches:
            start = 0
            for n, sizes, slices in grouped_words(b.column(3)):
                every, each_log, words = coder.coded(slices)
                ends, out = np.cumsum([len(every)] if sizes is None else sizes).tolist(), []
                for a, z in zip([0, *ends], ends, strict=False):
                    codes, rare, times = every[a:z], [], none
                    beyond = np.flatnonzero(codes < 0) if words else none
                    if len(beyond):
                        own, place, times = np.unique(-1 - codes[beyond], return_inverse=True, return_counts=True)
                        codes[beyond], rare = -1 - place, [words[k] for k in own.tolist()]
                    out.append((row, z - a + 1, z - a - len(beyond) + ends_known, float(each_log[a:z].sum()) + end_log, codes.astype("<i4", copy=False).tobytes() + last, rare, times))
                    row += 1
                columns = [*b.slice(start, n).columns[:3], *zip(*out, strict=True)]
                start += n
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    marked = documents.select("doc_id", "held_out", F.xxhash64("doc_id", "text").alias("mark"), "text")
    schema = "doc_id long, held_out boolean, mark long, row long, n_tokens long, known long, base double, codes binary, rare array<binary>, times array<long>"
    return materialise(marked.mapInArrow(run, schema), "coded")


def fit(coded: DataFrame, learned: Trained, path: str, p: LmParams = DEFAULTS) -> Trained:
    """The attention model trained on all of ``coded``."""
    model = learned.model
    shards = max(1, min(p.most_shards, round(learned.total / (p.rounds * p.shard_tokens))))
    for turn in range(p.rounds):
        model = train_round(coded, model, path, p, turn, shards)
    return replace(learned, model=model)


def train(documents: DataFrame, path: str | None = None, p: LmParams = DEFAULTS) -> Trained:
    """Learn from (doc_id, held_out, text) rows, all of them."""
    path = path or default_path(VOCABULARY)
    learned = learn_words(documents, path, p)
    return fit(code_documents(documents, learned, p), learned, path, p)


def score_coded(coded: DataFrame, trained: Trained, path: str, p: LmParams = DEFAULTS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of coded documents."""
    shared = coded.sparkSession.sparkContext.broadcast(trained.model.without_lookup())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_pages()
        model, none = shared.value, np.zeros(0, np.int32)
        entries = Entries(model, path)
        fixed = entries.n
        if model.vectors is None:
            model.vectors = entries.vectors()
        for b in batches:
            size = min(64, max(1, b.num_rows))
            for a in range(0, b.num_rows, size):
                part = b.slice(a, size)
                texts = [entries.numbers(codes, rare) for codes, rare in zip(part.column(7).to_pylist(), part.column(8).to_pylist(), strict=True)]
                entries.settle()
                if entries.n > len(model.vectors):  # room for rare words, used again by every slice
                    model.vectors = np.concatenate((model.vectors[:fixed], np.empty((2 * (entries.n - fixed), p.width), np.float32)))
                model.vectors[fixed : entries.n] = entries.vectors(fixed)
                scores = score_tokens(model.params, model.vectors, entries.klass, entries.inside, texts, p)
                entries.forget(none)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in (0, 1, 3, 4, 5, 6)), pa.array(scores, pa.float64()), part.column(8), part.column(9)], names)

    names = ["doc_id", "held_out", "row", "n_tokens", "known", "base", "score", "rare", "times"]
    schema = "doc_id long, held_out boolean, row long, n_tokens long, known long, base double, score double, rare array<binary>, times array<long>"
    written = materialise(coded.mapInArrow(run, schema), "scores")
    each = written.filter(F.size("rare") > 0).select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("row", F.col("r.rare").cast("string").alias("word"), "r.times")
    c = F.coalesce("c", F.lit(0))
    found = each.join(trained.words, "word", "left").groupBy("row").agg(F.sum(F.col("times") * F.log10(c + 0.5)).alias("rare_base"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("rare_known"))
    whole = written.drop("rare", "times").join(found, "row", "left")
    below = math.log10(trained.total + 0.5 * (trained.distinct + 1))
    return whole.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(trained.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0)) - F.col("n_tokens") * F.lit(below)).alias("base_score"), "score",
    )


def score(documents: DataFrame, trained: Trained, path: str | None = None, p: LmParams = DEFAULTS) -> DataFrame:
    """Scores of (doc_id, held_out, text) rows: see ``score_coded``."""
    return score_coded(code_documents(documents, trained, p), trained, path or default_path(VOCABULARY), p)


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document by models of the documents that are not held out."""
    documents, path = _documents(table(spark, sf_dir, "documents"), "doc_id", "text"), default_path(VOCABULARY)
    learned = learn_words(documents.filter(~F.col("held_out")), path)
    coded = code_documents(documents, learned)
    return score_coded(coded, fit(coded.filter(~F.col("held_out")), learned, path), path)
