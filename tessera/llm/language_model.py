"""Log probabilities of texts by a hashed maximum-entropy model.

A token is a lower-cased word, or the end of a text. The ``MODELLED`` most
frequent tokens form classes of 64 by frequency; all others are the last
class. P(token) = P(class | history) * P(token | class, history), both softmax
models over hashed features of the history: the last three tokens, near
and skipped ones as words and the last two as a bigram. Within the last class a token has its smoothed
share of the training count. The biases start as log frequencies.

Counts of all words, exact, come from packs of (hash, counts) that tasks send
to the hash's bucket; the most frequent ``DICTIONARY`` in training are broadcast.
Learning takes ``ROUNDS`` synchronous rounds over all training documents: every
task counts, for each weight, the tokens seen and those the shared weights expect;
the counts are added up over all tasks, and each weight takes one step by the
log of their ratio. A task sorts its tokens by history, so what is expected after one
history is computed once for all of a run of ``HELD`` tokens. So neither files nor partitions matter. Scoring goes
through every text in sparse batches; words outside the dictionary are sent to
their bucket, where their count is known, and add to their document's sums.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import text_kernels as K
from tessera.llm.tables import pack_text, packs_by_bucket, unpack_columns, unpack_text, unused, with_keys
from tessera.llm.text_kernels import tidy

DICTIONARY = 250_000
WIDTH = 64
CLASSES = 64
MODELLED = (CLASSES - 1) * WIDTH
#: Bits of the rows of a table of features, at least; see ``row_bits``.
ROW_BITS = 13
#: Tokens whose expected counts are added up together, 65536 at most; the more, the seldomer each row of a table is read and written.
BATCH = 1 << 15
#: Rows whose arithmetic is done together, so that they stay in a core's own cache.
PART = 1024
#: Training tokens that a task holds, as 8 bytes each, and sorts by history before it adds up what the weights expect of them.
HELD = 1 << 21
ROUNDS = 2
RATE = 0.6
#: Tokens in agreement with the weights that are added to each weight's counts.
PRIOR = 2.0
BLOCK = 1 << 14
ALPHA = 0.1
#: Text that a task gathers before it sends its packs.
GATHER = 1 << 23
U = np.uint64
END = U(0xE5D0C1B2A3948576)
_BEGIN = MODELLED + 1024
_SYMBOL_BITS = 13
_CLASS_BITS = 6
_INDEX_BITS = 18
_N_FEATURES = 4
#: Powers of logits up to this, and sums of 64 of them, are within single precision.
MOST_LOGIT = 80.0


class Dictionary(NamedTuple):
    """Frequent tokens by ascending hash: rank by frequency and training count; the corpus' training totals; and where
    the hashes with each of the leading bits start."""

    hashes: np.ndarray
    rank: np.ndarray
    count: np.ndarray
    n_tokens: int
    n_distinct: int
    starts: np.ndarray | None = None

    @classmethod
    def of(cls, h: np.ndarray, count: np.ndarray, n_tokens: int, n_distinct: int) -> Dictionary:
        """From words by falling frequency."""
        order = np.argsort(h, kind="stable")
        return cls(h[order], np.arange(len(h))[order], count[order], n_tokens, n_distinct, _starts(h[order]))

    def rest(self) -> float:
        """The last class' denominator."""
        modelled = self.rank < MODELLED
        return self.n_tokens - self.count[modelled].sum() + ALPHA * (self.n_distinct - (self.count[modelled] > 0).sum() + 1)


def _starts(h: np.ndarray) -> np.ndarray:
    """Where in ascending hashes those with each of the leading bits start, and their end."""
    return np.append(np.searchsorted(h, np.arange(1 << _INDEX_BITS, dtype=U) << U(64 - _INDEX_BITS)), len(h))


class Weights(NamedTuple):
    classes: np.ndarray
    words: np.ndarray
    class_bias: np.ndarray
    word_bias: np.ndarray

    @classmethod
    def unpack(cls, flat: np.ndarray) -> Weights:
        table = (len(flat) - CLASSES - CLASSES * WIDTH) // 2
        parts = np.split(flat, [table, 2 * table, 2 * table + CLASSES])
        return cls(parts[0].reshape(-1, CLASSES), parts[1].reshape(-1, WIDTH), parts[2], parts[3].reshape(CLASSES, WIDTH))

    def small(self) -> bool:
        """Whether no logits' powers, as they are, can pass a float's range, nor all of a token's fall below it."""
        most = _N_FEATURES * max(max(-float(t.min()), float(t.max())) for t in (self.classes, self.words))
        bias = np.append(self.word_bias.max(1), self.class_bias.max())
        return most + max(float(bias.max()), -float(bias.min())) < MOST_LOGIT

    def factors(self) -> Factors | None:
        """The weights' own powers if logits are small: a token's probabilities are then products of its rows, without powers of their own."""
        if not self.small():
            return None
        return Factors(np.exp(self.classes + self.class_bias / _N_FEATURES), np.exp(self.words), np.exp(self.word_bias))


class Factors(NamedTuple):
    """Powers of weights; those of the classes hold their share of the bias."""

    classes: np.ndarray
    words: np.ndarray
    word_bias: np.ndarray


def row_bits(n_tokens: int) -> int:
    """Rows grow with the root of the training tokens."""
    return max(ROW_BITS, math.ceil(math.log2(n_tokens + 1) / 2))


def start_weights(d: Dictionary) -> np.ndarray:
    """Weights of the model without features: log frequencies."""
    flat = np.zeros(2 * (WIDTH << row_bits(d.n_tokens)) + CLASSES + CLASSES * WIDTH, np.float32)
    w = Weights.unpack(flat)
    count = np.zeros(CLASSES * WIDTH)
    modelled = d.rank < MODELLED
    count[d.rank[modelled]] = d.count[modelled] + ALPHA
    share = count.reshape(CLASSES, WIDTH)
    total = share.sum(1)
    total[-1] = max(d.rest(), ALPHA)
    w.class_bias[:] = np.log(np.maximum(total, 1e-9) / total.sum())
    w.word_bias[:] = np.log(np.maximum(share, 1e-9) / np.maximum(share.sum(1, keepdims=True), 1e-9))
    return flat


class Tokens(NamedTuple):
    """Tokens of a slice: hash, document, place in the dictionary (-1 outside), rank (at least MODELLED in the last class), features."""

    hash: np.ndarray
    doc: np.ndarray
    place: np.ndarray
    rank: np.ndarray
    features: np.ndarray


def token_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of each token; every document ends with END."""
    w = K.words(data, offsets)
    h = K.run_hashes(data, w.start, w.end, lower=True)
    n = len(w.count)
    out = np.full(len(h) + n, END)
    out[np.arange(len(h)) + w.doc()] = h
    return out, np.repeat(np.arange(n), w.count + 1)


def places(h: np.ndarray, d: Dictionary) -> np.ndarray:
    """The place of each hash in the dictionary, -1 outside: few steps from the first one with the same leading bits."""
    starts, shift = _starts(d.hashes) if d.starts is None else d.starts, U(64 - _INDEX_BITS)
    first = (h >> shift).astype(np.int64)
    at, left = np.take(starts, first), np.take(starts, first + 1)
    out = np.full(len(h), -1)
    some = np.flatnonzero(at < left)
    while len(some):
        found = np.take(d.hashes, at[some]) == h[some]
        out[some[found]] = at[some[found]]
        some = some[~found]
        at[some] += 1
        some = some[at[some] < left[some]]
    return out


def histories(data: np.ndarray, offsets: np.ndarray, d: Dictionary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``Tokens``, with the symbols of the last three tokens, last one in the highest bits, in place of features."""
    h, doc = token_hashes(data, offsets)
    at = places(h, d)
    rank = np.where(at >= 0, np.take(d.rank, at, mode="clip"), DICTIONARY) if len(d.hashes) else np.full(len(h), DICTIONARY)
    symbol = np.where(rank < MODELLED, rank, MODELLED + (h >> U(54)).astype(np.int64)).astype(U)
    starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
    history, last = np.zeros(len(h), U), symbol
    for _ in range(3):
        last = np.concatenate([[U(_BEGIN)], last[:-1]]).astype(U)
        last[starts] = U(_BEGIN)
        history = history << U(_SYMBOL_BITS) | last
    return h, doc, at, rank, history


def features_of(history: np.ndarray) -> np.ndarray:
    most = U((1 << _SYMBOL_BITS) - 1)
    a, b, c = history >> U(2 * _SYMBOL_BITS), history >> U(_SYMBOL_BITS) & most, history & most
    keys = [a, b, c, a * U(8191) + b * U(131_071)]
    return np.stack([K.mix(k * U(_N_FEATURES) + U(j + 1)) for j, k in enumerate(keys)], 1)


def tokens(data: np.ndarray, offsets: np.ndarray, d: Dictionary) -> Tokens:
    *columns, history = histories(data, offsets, d)
    return Tokens(*columns, features_of(history))


#: Buffers of a batch, made once: fresh pages for each batch would cost more than the arithmetic.
_OUT, _ONE, _TWO, _THREE = (np.empty((BATCH, WIDTH), np.float32) for _ in range(4))
_COLUMN_OF_ONES, _ROW_OF_ONES = np.ones((WIDTH, 1), np.float32), np.ones(BATCH, np.float32)
#: From so many tokens of a batch on, a row's expected counts are added up at once.
MANY = 48


def _powers(
    table: np.ndarray, bias: np.ndarray, rows: np.ndarray, of_class: np.ndarray | None = None, factors: Factors | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """exp(logits), up to a factor for each token, and their sums, for rows (token, feature); in a buffer of the module.
    ``bias`` is that of all tokens, or has a row for each class. Without ``factors`` logits are shifted by their maximum."""
    n, own = len(rows), np.ascontiguousarray(rows.T)
    for at in range(0, n, PART):
        columns, z = own[:, at : at + PART], _OUT[at : min(n, at + PART)]
        part = _ONE[: len(z)]
        kind = None if of_class is None else of_class[at : at + PART]
        if factors:
            powers = factors.classes if kind is None else factors.words
            np.take(powers, columns[0], axis=0, out=z, mode="clip")
            for column in columns[1:]:
                z *= np.take(powers, column, axis=0, out=part, mode="clip")
            if kind is not None:
                z *= np.take(factors.word_bias, kind, axis=0, out=part, mode="clip")
            continue
        np.take(table, columns[0], axis=0, out=z, mode="clip")
        for column in columns[1:]:
            z += np.take(table, column, axis=0, out=part, mode="clip")
        z += bias if kind is None else np.take(bias, kind, axis=0, out=part, mode="clip")
        top, width = z, WIDTH
        while width > 8:  # narrower by halves, which is faster than one maximum along the rows
            width //= 2
            top = np.maximum(top[:, :width], top[:, width:], out=part[:, :width])
        z -= top.max(1, keepdims=True)
        np.exp(z, out=z)
    return _OUT[:n], _OUT[:n] @ _COLUMN_OF_ONES


def _changes(x: np.ndarray) -> np.ndarray:
    """Whether a value differs from the one before it; the first does."""
    out = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=out[1:])
    return out


def _sorted(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A batch's rows in ascending order, and their places before; wider rows than 16 bits are sorted with their places in one number, which is faster."""
    if own.dtype == np.uint16:
        order = np.argsort(own, kind="stable")
        return own[order], order
    both = np.sort(own << 16 | np.arange(len(own)))
    return both >> 16, both & 0xFFFF


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ones of ascending values, and how often each occurs."""
    first = np.flatnonzero(_changes(x))
    return x[first], np.diff(first, append=len(x)).astype(np.float32)


def _class_rows(features: np.ndarray, table: np.ndarray) -> np.ndarray:
    return (features >> U(65 - len(table).bit_length())).astype(np.int64)


def _word_rows(features: np.ndarray, of_class: np.ndarray, table: np.ndarray) -> np.ndarray:
    return (K.mix(features + of_class[:, None].astype(U)) >> U(65 - len(table).bit_length())).astype(np.int64)


def log_probabilities(t: Tokens, w: Weights, factors: Factors | None = None) -> np.ndarray:
    """log10 of each token's probability; of tokens in the last class, the class' probability. ``factors``: those of ``w``."""
    out = np.empty(len(t.hash))
    for at in range(0, len(t.hash), 2 * PART):
        part = slice(at, at + 2 * PART)
        of_class = np.minimum(t.rank[part] >> 6, CLASSES - 1)
        p, total = _powers(w.classes, w.class_bias, _class_rows(t.features[part], w.classes), factors=factors)
        got = p[np.arange(len(p)), of_class] / total[:, 0].astype(float)
        inner = np.flatnonzero(of_class < CLASSES - 1)
        q, total = _powers(w.words, w.word_bias, _word_rows(t.features[part][inner], of_class[inner], w.words), of_class[inner], factors)
        got[inner] *= q[np.arange(len(inner)), t.rank[part][inner] & (WIDTH - 1)] / total[:, 0]
        out[part] = np.log10(np.maximum(got, 1e-30))
    return out


class _Counts:
    """For each weight of both tables, the tokens seen with it or, after the first step, those that the weights expect.

    Before the first step the expectation is the tokens of a row (of the words' table: of a row and
    a class) times frequencies; then only those tokens are counted, and ``steps`` multiplies.
    """

    def __init__(self, flat: np.ndarray, first: bool) -> None:
        self.w, self.first = Weights.unpack(flat), first
        self.factors = self.w.factors()
        self.table = self.w.classes.size
        self.held: list[np.ndarray] = []
        self.seen, self.expected = (np.zeros((2, self.table), np.float32) for _ in range(2))

    def _bins(self, to: np.ndarray, rows: np.ndarray, column: np.ndarray) -> None:
        np.add.at(to, (rows * WIDTH + column[:, None]).reshape(-1), np.float32(1))

    def _expect(
        self, to: np.ndarray, table: np.ndarray, bias: np.ndarray, rows: np.ndarray, of_class: np.ndarray | None = None, times: np.ndarray | None = None
    ) -> None:
        """Adds the probabilities of each token of a batch, which occurs so many ``times`` (once, by default), to its rows.

        If a feature's rows come in long runs, these are summed up where they are. For others the tokens are sorted by row.
        Rows of ``MANY`` tokens are summed up one by one; of the others, by falling number of tokens, the first token of each
        row is taken, then the second of each that has one is added, and so on; each row of the table is then read and
        written once.
        """
        p, total = _powers(table, bias, rows, of_class, self.factors)
        p *= (1 if times is None else times[:, None]) / total
        to = to.reshape(-1, WIDTH)
        for own in np.ascontiguousarray(rows.T, np.uint16 if len(to) <= 1 << 16 else np.int64):
            runs = np.flatnonzero(_changes(own))
            if len(runs) * MANY <= len(own):
                for a, b in zip(runs.tolist(), [*runs[1:].tolist(), len(own)], strict=True):
                    to[own[a]] += _ROW_OF_ONES[: b - a] @ p[a:b]
                continue
            own, order = _sorted(own)
            first = np.flatnonzero(_changes(own))
            size = np.diff(first, append=len(own))
            falling = np.argsort((len(own) - size).astype(np.uint16), kind="stable")
            first, size = first[falling], size[falling]
            many = int(np.count_nonzero(size >= MANY))
            for a, n in zip(first[:many].tolist(), size[:many].tolist(), strict=True):
                to[own[a]] += _ROW_OF_ONES[:n] @ np.take(p, order[a : a + n], axis=0, out=_ONE[:n], mode="clip")
            at, size = first[many:], size[many:]
            longer = len(at) - np.cumsum(np.bincount(size, minlength=MANY + 1)) if len(size) else size
            sums = np.take(p, order[at], axis=0, out=_TWO[: len(at)], mode="clip")
            for j in range(1, int(size[0]) if len(size) else 0):
                n = int(longer[j])
                sums[:n] += np.take(p, order[at[:n] + j], axis=0, out=_ONE[:n], mode="clip")
            row = own[at]
            sums += np.take(to, row, axis=0, out=_THREE[: len(at)], mode="clip")
            to[row] = sums

    def count(self, t: Tokens) -> None:
        """What is counted before the first step."""
        w = self.w
        of_class = np.minimum(t.rank >> _CLASS_BITS, CLASSES - 1)
        inner = np.flatnonzero(of_class < CLASSES - 1)
        rows, word_rows = _class_rows(t.features, w.classes), _word_rows(t.features[inner], of_class[inner], w.words)
        self._bins(self.seen[0], rows, of_class)
        self._bins(self.seen[1], word_rows, t.rank[inner] & (WIDTH - 1))
        self._bins(self.expected[1], word_rows, of_class[inner])

    def add(self, history: np.ndarray, rank: np.ndarray) -> None:
        """Holds tokens; ``expect`` is due at the end too."""
        self.held.append(history << U(_CLASS_BITS) | np.minimum(rank >> _CLASS_BITS, CLASSES - 1).astype(U))
        if sum(map(len, self.held)) >= HELD:
            self.expect()

    def expect(self) -> None:
        """Adds what the weights expect of the held tokens; those of one history, and in the words' table of one class, only once, times their number."""
        if not self.held:
            return
        w, key = self.w, np.concatenate(self.held)
        self.held = []
        key.sort()
        history, times = _distinct(key >> U(_CLASS_BITS))
        for at in range(0, len(history), BATCH):
            rows = _class_rows(features_of(history[at : at + BATCH]), w.classes)
            self._expect(self.expected[0], w.classes, w.class_bias, rows, None, times[at : at + BATCH])
        of_class = key & U(CLASSES - 1)
        inner = of_class < U(CLASSES - 1)
        key = of_class[inner] << U(3 * _SYMBOL_BITS) | key[inner] >> U(_CLASS_BITS)
        key.sort()
        key, times = _distinct(key)
        of_class, history = (key >> U(3 * _SYMBOL_BITS)).astype(np.int64), key & U((1 << 3 * _SYMBOL_BITS) - 1)
        for at in range(0, len(key), BATCH):
            own = of_class[at : at + BATCH]
            rows = _word_rows(features_of(history[at : at + BATCH]), own, w.words)
            self._expect(self.expected[1], w.words, w.word_bias, rows, own, times[at : at + BATCH])


def steps(seen: np.ndarray, expected: np.ndarray, w: Weights, of_words: bool, first: bool) -> np.ndarray:
    """The weights' changes, for whole rows of one table, from the sums over all tasks."""
    if first:
        p = np.exp(w.word_bias if of_words else w.class_bias).astype(float)
        p /= p.sum(-1, keepdims=True)
        expected = expected @ p if of_words else seen.sum(1, keepdims=True) * p
    prior = PRIOR * expected / (expected + 1e-3) + 1e-6
    return RATE * np.log((seen + prior) / (expected + prior))


def _bucket_of(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> U(64 - bits)).astype(np.int64)


def _pack_rows(rows: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(rows), 1000):
        part = rows[a : a + 1000]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.binary())], ["bucket", "pack"])


def _held(batches: Iterator[pa.RecordBatch]) -> dict[int, list[bytes]]:
    held: dict[int, list[bytes]] = {}
    for batch in batches:
        for b, x in zip(batch.column("bucket").to_pylist(), batch.column("pack").to_pylist(), strict=True):
            held.setdefault(b, []).append(x)
    return held


def _sums(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, ascending, and the sums of their values."""
    if not len(key):
        return key, *values
    order = np.argsort(key, kind="stable")
    k = key[order]
    cut = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[cut], *(np.add.reduceat(v[order], cut) for v in values)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        ids, train = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "train"))
        for i, data, offsets in K.slices(batch.column("text"), 1 << 19):
            n = len(offsets) - 1
            yield data, offsets, ids[i : i + n], train[i : i + n].astype(bool)


def _count(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        size = 0

        def sent() -> Iterator[pa.RecordBatch]:
            h, n, n_train = _sums(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            yield from _pack_rows(list(packs_by_bucket(_bucket_of(h, bits), [h, n, n_train])))

        for data, offsets, _, train in _slices(batches):
            h, doc = token_hashes(data, offsets)
            parts.append(_sums(h, np.ones(len(h), np.int64), train[doc].astype(np.int64)))
            size += len(data)
            if size >= GATHER:
                yield from sent()
                parts, size = [], 0
        if parts:
            yield from sent()

    return run


def _frequent(most: int):
    """Each bucket's ``most`` most frequent words in training, and one row with hash null: the partition's tokens and distinct words in training."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops, n, v = [], 0, 0
        for packs in _held(batches).values():
            h, total, train = _sums(*unpack_columns(packs, [U, np.int64, np.int64]))
            n, v = n + int(train.sum()), v + int((train > 0).sum())
            best = np.lexsort((h, -train))[: min(most, int((train > 0).sum()))]  # words of other texts count nowhere
            tops.append((h[best], total[best], train[best]))
        if not tops:
            return
        h, total, train = (np.concatenate(x) for x in zip(*tops, strict=True))
        columns = [pa.array([*h.view(np.int64).tolist(), None], pa.int64()), pa.array([*total.tolist(), v]), pa.array([*train.tolist(), n])]
        yield pa.RecordBatch.from_arrays(columns, ["hash", "total", "train"])

    return run


def _observe(dictionary, weights, first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, counts = Dictionary(*dictionary.value), None
        for data, offsets, _, train in _slices(batches):
            if not train.any():
                continue
            counts = counts or _Counts(weights.value, first)
            h, doc, at, rank, history = histories(data, offsets, d)
            keep = train[doc]
            if first:
                counts.count(Tokens(h[keep], doc[keep], at[keep], rank[keep], features_of(history[keep])))
            else:
                counts.add(history[keep], rank[keep])
        if counts:
            counts.expect()
            seen, expected = counts.seen.reshape(-1), counts.expected.reshape(-1)
            for i, a in enumerate(range(0, len(seen), BLOCK)):
                own = slice(a, a + BLOCK)
                if seen[own].any() or expected[own].any():
                    yield from _pack_rows([(i, pack_text(seen[own].tobytes() + expected[own].tobytes()))])

    return run


def _change(weights, seen_first):
    """The steps of whole blocks, and the tokens seen; these come from the first round in the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, x in zip(batch.column("bucket").to_pylist(), batch.column("pack").to_pylist(), strict=True):
                total[b] = total.get(b, 0.0) + np.frombuffer(unpack_text(x), np.float32).astype(float)
        if not total:
            return
        w = Weights.unpack(weights.value)
        for b in sorted(total):
            seen, expected = total[b].reshape(2, -1, WIDTH)
            if seen_first is not None:
                seen = seen_first.value[b * BLOCK : (b + 1) * BLOCK].reshape(seen.shape).astype(float)
            change = steps(seen, expected, w, b * BLOCK >= w.classes.size, seen_first is None)
            yield from _pack_rows([(b, change.astype(np.float32).tobytes() + seen.astype(np.float32).tobytes())])

    return run


def _score(dictionary, weights, bits: int):
    """Sums of the dictionary's tokens (bucket -1 - doc bucket) and occurrences of all other words (by hash bucket)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, w = Dictionary(*dictionary.value), Weights.unpack(weights.value)
        factors = w.factors()
        log_rest = math.log10(max(d.rest(), ALPHA))
        sums: list[tuple] = []
        rare: list[tuple] = []
        size = 0

        def sent() -> Iterator[pa.RecordBatch]:
            yield from _pack_rows(_doc_packs(bits, *(np.concatenate(x) for x in zip(*sums, strict=True))))
            h, doc, n = (np.concatenate(x) for x in zip(*rare, strict=True))
            order = np.argsort(h, kind="stable")
            h = h[order]
            yield from _pack_rows(list(packs_by_bucket(_bucket_of(h, bits), [h, doc[order], n[order]])))

        for data, offsets, ids, train in _slices(batches):
            t = tokens(data, offsets, d)
            n_docs = len(ids)
            inside = t.place >= 0
            count = np.where(inside, d.count[t.place], 0) if len(d.count) else np.zeros(len(t.hash))
            log_count = np.where(inside, np.log10(count + ALPHA), 0.0)
            last = t.rank >= MODELLED
            score = log_probabilities(t, w, factors) + np.where(last, log_count - log_rest, 0.0)
            by_doc = lambda v: np.bincount(t.doc, v, n_docs)  # noqa: B023, E731
            sums.append((ids, by_doc(np.ones(len(t.hash))).astype(np.int64), by_doc(inside & (count > 0)).astype(np.int64), by_doc(log_count), by_doc(score)))
            out = np.flatnonzero(~inside)
            order = out[np.lexsort((t.hash[out], t.doc[out]))]
            h, doc = t.hash[order], t.doc[order]
            cut = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])) if len(order) else order
            n = np.diff(np.append(cut, len(order))).astype(np.int32)
            rare.append((h[cut], ids[doc[cut]], np.where(train[doc[cut]], n, -n).astype(np.int32)))
            size += len(data)
            if size >= GATHER:
                yield from sent()
                sums, rare, size = [], [], 0
        if sums:
            yield from sent()

    return run


def _doc_packs(bits: int, doc: np.ndarray, *columns: np.ndarray) -> list[tuple[int, bytes]]:
    """Packs of documents' sums, by -1 - bucket of the id."""
    bucket = _bucket_of(K.mix(doc.view(U)), bits)
    order = np.argsort(bucket, kind="stable")
    return [(-1 - b, x) for b, x in packs_by_bucket(bucket[order], [c[order] for c in (doc, *columns)])]


def _rare_sums(bits: int):
    """Document sums of the rare words of whole buckets; sums that are known already pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _held(batches)
        yield from _pack_rows([(b, x) for b, packs in held.items() if b < 0 for x in packs])
        found = []
        for b, packs in held.items():
            if b < 0:
                continue
            h, doc, n = unpack_columns(packs, [U, np.int64, np.int32])
            order = np.argsort(h, kind="stable")
            h, doc, n = h[order], doc[order], n[order].astype(np.int64)
            first = np.concatenate([[True], h[1:] != h[:-1]])
            count = np.add.reduceat(np.maximum(n, 0), np.flatnonzero(first))[np.cumsum(first) - 1]
            n = np.abs(n)
            found.append(_sums(doc, n * (count > 0), n * np.log10(count + ALPHA)))
        if found:
            doc, known, logs = _sums(*(np.concatenate(x) for x in zip(*found, strict=True)))
            yield from _pack_rows(_doc_packs(bits, doc, np.zeros(len(doc), np.int64), known.astype(np.int64), logs, logs))

    return run


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for packs in _held(batches).values():
        columns = _sums(*unpack_columns(packs, [np.int64, np.int64, np.int64, np.float64, np.float64]))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["id", "n_tokens", "n_known", "logs", "score"])


def score_texts(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, training, n_tokens, n_known, train_tokens, base_score, score), one row for each row of ``docs``.

    The model learns from the rows for which ``training`` (an expression over the id's column) holds and
    scores all of them. ``base_score`` is the log10 probability under the smoothed frequencies
    (count + 0.1) / (train_tokens + 0.1 * (distinct + 1)), ``score`` under the model; ``n_known``
    are tokens that occur in training. Null and empty texts have one token, their end; very long texts
    are scored as a whole. Each row is a document of its own, whether it shares its id, has none, or
    a string; an empty table gives an empty one. Other columns of ``docs`` are left aside.
    """
    spark = docs.sparkSession
    train = unused("train", docs)
    keyed = with_keys(docs.select(id_col, text_col).withColumn(train, F.coalesce(training, F.lit(False))), id_col)
    source = keyed.texts(text_col, F.col(train).alias("train"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = max(8, (4 * partitions).bit_length())
    packs = "bucket long, pack binary"

    most = (2 * DICTIONARY >> bits) + 200  # hashes deal words evenly
    counted = source.mapInArrow(tidy(_count(bits)), packs).repartition("bucket").mapInArrow(tidy(_frequent(most)), "hash long, total long, train long")
    top = counted.toArrow()  # bounded by the dictionary, whatever the input
    words = top.filter(pa.compute.is_valid(top["hash"]))
    totals = top.filter(pa.compute.is_null(top["hash"]))
    h, total, train = words["hash"].to_numpy().view(U), words["total"].to_numpy(), words["train"].to_numpy().astype(float)
    best = np.lexsort((h, -train))[:DICTIONARY]
    d = Dictionary.of(h[best], train[best], int(totals["train"].to_numpy().sum()), int(totals["total"].to_numpy().sum()))
    dictionary = spark.sparkContext.broadcast(tuple(d))

    flat = start_weights(d)
    weights = spark.sparkContext.broadcast(flat)
    seen, seen_first = np.zeros(2 * Weights.unpack(flat).classes.size, np.float32), None
    for i in range(ROUNDS):
        counts = source.filter("train").mapInArrow(tidy(_observe(dictionary, weights, i == 0)), packs)
        changes = counts.repartition("bucket").mapInArrow(tidy(_change(weights, seen_first)), packs).collect()  # the size of the model
        flat = flat.copy()
        for row in changes:
            change, own = np.frombuffer(row["pack"], np.float32).reshape(2, -1)
            place = slice(row["bucket"] * BLOCK, row["bucket"] * BLOCK + len(change))
            flat[place] += change
            seen[place] = own
        weights, seen_first = spark.sparkContext.broadcast(flat), spark.sparkContext.broadcast(seen)

    sums = source.mapInArrow(tidy(_score(dictionary, weights, bits)), packs).repartition("bucket").mapInArrow(tidy(_rare_sums(bits)), packs)
    out = sums.repartition("bucket").mapInArrow(tidy(_totals), "id long, n_tokens long, n_known long, logs double, score double")
    log_z = math.log10(d.n_tokens + ALPHA * (d.n_distinct + 1))
    training_of = keyed.named(out, "id").withColumn("training", F.coalesce(training, F.lit(False)))
    return training_of.select(
        id_col,
        "training",
        "n_tokens",
        "n_known",
        F.lit(d.n_tokens).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * F.lit(log_z)).alias("base_score"),
        "score",
    )
