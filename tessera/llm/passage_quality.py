"""Quality of whole texts by attention over their passages (multiple-instance learning).

A text is a bag of passages of ``PASSAGE`` words; only the whole text has a label. Each passage is encoded as numbers: the mean,
least and greatest evidence of its words, word shapes and runs of three characters, and shares of kinds of
characters, of repeated words and the like. A layer, a gated attention over the passages (tanh and sigmoid branches, softmax
within the text) and a logistic output are learned together from the labels of texts; a text's score is that of the
attention-weighted sum of its passages.

Evidence and network are fitted on at most ``TRAINING_ROWS`` labelled rows of together ``TRAINING_BYTES`` at most, chosen by a hash.
The evidence of a feature is its shrunken log-odds among them; a training text's own count is left out of its own
encoding, so that the network meets training and other texts alike. Scoring reads every passage of all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import text_kernels as K
from tessera.llm.quality import NOT_WORD, character_runs, short_hashes
from tessera.llm.tables import bounded_batches, discard, saved
from tessera.llm.text_kernels import tidy

#: Bounds on the labelled rows that are learned from.
TRAINING_ROWS, TRAINING_BYTES = 8000, 64_000_000
PASSAGE = 64
BITS = 18
#: Made-up rows, dealt to the classes by their shares, that the counts of a feature are mixed with.
SHRINK = 4.0
#: Bytes of text whose features are held at once.
SLICE = 1 << 18
HIDDEN, GATES, EPOCHS, BATCH, RATE, PENALTY = 24, 12, 30, 64, 0.01, 1e-4

_CLASS = np.full(256, 4, np.uint8)  # capitals, small letters, digits, marks of prose, other signs, beyond ASCII, white space, line ends
for _i, _of in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".,;:!?'\"()-")):
    _CLASS[list(_of)] = _i
_CLASS[128:], _CLASS[K.SPACE], _CLASS[10] = 5, 6, 7
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[48:58], _SHAPE[128:], _SHAPE[K.SPACE] = 65, 97, 48, 97, 32


class Passages(NamedTuple):
    """A slice's passages: the number of each text, their borders in bytes, the passage of each byte, and its words."""

    count: np.ndarray
    borders: np.ndarray
    of_byte: np.ndarray
    words: K.Runs

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)


def cut_passages(data: np.ndarray, offsets: np.ndarray) -> Passages:
    """Every ``PASSAGE`` words of a text begin a passage; a text without words is one passage."""
    w = K.words(data, offsets)
    count = np.maximum(-(-w.count // PASSAGE), 1)
    first = np.cumsum(count) - count
    borders = np.empty(int(count.sum()) + 1, np.int64)
    borders[-1] = len(data)
    nth = np.arange(len(borders) - 1) - np.repeat(first, count)
    borders[first] = offsets[:-1]
    inner = np.flatnonzero(nth)
    borders[inner] = w.start[np.repeat(w.first, count)[inner] + nth[inner] * PASSAGE]
    marks = np.bincount(borders[:-1], minlength=len(data) + 1)
    return Passages(count, borders, np.cumsum(marks)[: len(data)] - 1, w)


def features(data: np.ndarray, offsets: np.ndarray, words: K.Runs) -> list[tuple[np.ndarray, np.ndarray]]:
    """(first byte, feature) of lower-cased words of letters and digits, of word shapes, and of runs of three characters."""
    bare = K.words(K.LOWER[data], offsets, NOT_WORD)
    shape = _SHAPE[data]
    stays = np.ones(len(data), bool)
    stays[1:] = shape[1:] != shape[:-1]
    stays[words.start] = True
    moved = np.concatenate([[0], np.cumsum(stays)])
    short = shape[stays]
    spaced = np.where(K.SPACE[data], np.uint8(32), data)
    start, end, _ = next(character_runs(data, offsets, [3]))
    parts = [
        (bare.start, K.run_hashes(data, bare.start, bare.end, lower=True)),
        (words.start, K.run_hashes(short, moved[words.start], moved[words.end])),
        (start, short_hashes(spaced, start, end)),
    ]
    return [(at, ((x + K.U(i * 0x9E3779B97F4A7C15 % 2**64)) >> K.U(64 - BITS)).astype(np.int64)) for i, (at, x) in enumerate(parts)]


def _within(values: np.ndarray, passage: np.ndarray, n: int) -> list[np.ndarray]:
    """Mean, least and greatest value of each passage, whose rows follow each other; 0 without rows."""
    size = np.bincount(passage, minlength=n)
    some = np.flatnonzero(size)
    out = [np.zeros(n) for _ in range(3)]
    if len(some):
        first = (np.cumsum(size) - size)[some]
        out[0][some] = np.add.reduceat(values, first) / size[some]
        out[1][some], out[2][some] = np.minimum.reduceat(values, first), np.maximum.reduceat(values, first)
    return out


def encode(data: np.ndarray, offsets: np.ndarray, counts: np.ndarray, rows: np.ndarray, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(passages of each text, their numbers). ``counts``: rows of label 0 and 1 with each feature; ``rows``: all rows of
    label 0 and 1; ``own``: the texts' labels, where the texts are among those counted."""
    p = cut_passages(data, offsets)
    n, w = len(p.borders) - 1, p.words
    n_words = np.diff(np.searchsorted(w.start, p.borders))
    columns: list[np.ndarray] = [np.log1p(n_words)]
    kind = _CLASS[data]
    n_bytes = np.maximum(np.diff(p.borders), 1)
    columns += [K.counts(kind == c, p.borders) / n_bytes for c in range(8)]

    passage = p.of_byte[w.start]
    columns += _within(np.log((w.end - w.start).astype(float)), passage, n)
    h = K.run_hashes(data, w.start, w.end)
    same = np.zeros(len(h))
    same[1:] = (h[1:] == h[:-1]) & (passage[1:] == passage[:-1])
    pairs, at = K.gram_hashes(h, w, 2)
    order, first, _ = K.distinct_in_doc(w.doc()[at], pairs)
    again = np.zeros(len(h))
    again[at[order[~first]]] = 1
    order, first, _ = K.distinct_in_doc(passage, h)
    twice = np.zeros(len(h))
    twice[order[~first]] = 1
    columns += [_within(x, passage, n)[0] for x in (same, again, twice)]

    prior = SHRINK * rows / max(rows.sum(), 1)
    base = np.log(max(prior[1], 1e-9) / max(prior[0], 1e-9))
    table = np.log((counts[1] + prior[1] + 1e-9) / (counts[0] + prior[0] + 1e-9)) - base if own is None else None
    for start, feature in features(data, offsets, w):
        passage = p.of_byte[start]
        if own is None:
            values = table[feature]
        else:
            label = own[p.doc()[passage]]
            values = np.log((counts[1][feature] - label + prior[1] + 1e-9) / (counts[0][feature] - (1 - label) + prior[0] + 1e-9)) - base
        columns += _within(values, passage, n)
    return p.count, np.stack(columns, 1).astype(np.float32)


class Network(NamedTuple):
    """Layer, gates, attention and output; ``mean`` and ``spread`` scale the passages' numbers, ``slope`` and ``shift`` calibrate."""

    mean: np.ndarray
    spread: np.ndarray
    layer: np.ndarray
    layer_bias: np.ndarray
    tanh: np.ndarray
    tanh_bias: np.ndarray
    gate: np.ndarray
    gate_bias: np.ndarray
    attention: np.ndarray
    output: np.ndarray
    output_bias: np.ndarray
    slope: float
    shift: float

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -8, 8)

    def run(self, x: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
        """(margin, attention weights, hidden passages, tanh, gates, weighted sums) of scaled passages of texts."""
        first = np.cumsum(count) - count
        hidden = np.tanh(x @ self.layer + self.layer_bias)
        t, s = np.tanh(hidden @ self.tanh + self.tanh_bias), _sigmoid(hidden @ self.gate + self.gate_bias)
        raw = (t * s) @ self.attention
        power = np.exp(raw - np.repeat(np.maximum.reduceat(raw, first), count))
        weight = power / np.repeat(np.add.reduceat(power, first), count)
        summed = np.add.reduceat(weight[:, None] * hidden, first, axis=0)
        return summed @ self.output + self.output_bias[0], weight, hidden, t, s, summed

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * margin + self.shift)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def gradients(net: Network, x: np.ndarray, count: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Of the mean log loss of a batch of texts, in the order of the nine weights from ``layer`` to ``output_bias``."""
    margin, weight, hidden, t, s, summed = net.run(x, count)
    first = np.cumsum(count) - count
    error = (_sigmoid(margin) - y) / len(y)
    d_sum = np.repeat(error, count)[:, None] * net.output
    d_weight = (d_sum * hidden).sum(1)
    d_raw = weight * (d_weight - np.repeat(np.add.reduceat(weight * d_weight, first), count))
    both = d_raw[:, None] * net.attention
    d_t, d_s = both * s * (1 - t * t), both * t * s * (1 - s)
    d_pre = (weight[:, None] * d_sum + d_t @ net.tanh.T + d_s @ net.gate.T) * (1 - hidden * hidden)
    return [x.T @ d_pre, d_pre.sum(0), hidden.T @ d_t, d_t.sum(0), hidden.T @ d_s, d_s.sum(0), (t * s).T @ d_raw, summed.T @ error, error.sum(keepdims=True)]


def _temperature(margin: np.ndarray, y: np.ndarray) -> float:
    """The factor, 0.05 to 1, under which margins of texts not learned from give the least log loss, to a hundredth in size."""
    factors = 0.05 ** np.linspace(0, 1, 301)
    return float(min(factors, key=lambda f: np.logaddexp(0, f * margin).sum() - f * (y * margin).sum()))


def fit(x: np.ndarray, count: np.ndarray, y: np.ndarray, seed: int = 11) -> Network:
    """Adam over batches of texts; every fifth text only calibrates. Texts of one class give that class's certainty, no texts 0.5."""
    rng = np.random.default_rng(seed)
    width = x.shape[1]
    shapes = [(width, HIDDEN), (HIDDEN,), (HIDDEN, GATES), (GATES,), (HIDDEN, GATES), (GATES,), (GATES,), (HIDDEN,), (1,)]
    weights = [rng.normal(0, s[0] ** -0.5, s) if len(s) == 2 or s[0] > 1 and i > 5 else np.zeros(s) for i, s in enumerate(shapes)]
    held = np.arange(len(y)) % 5 == 4
    if len(set(y[~held].tolist())) < 2:
        shift = 0.0 if not len(y) else 20.0 if y.any() else -20.0
        return Network(np.zeros(width), np.ones(width), *weights, 0.0, shift)
    net = Network(x.mean(0), x.std(0) + 1e-3, *weights, 1.0, 0.0)
    x = net.scaled(x)
    first = np.cumsum(count) - count
    train = np.flatnonzero(~held)
    slow, fast = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]
    step = 0
    for epoch in range(EPOCHS):
        rng.shuffle(train)
        rate = RATE * (1 - epoch / EPOCHS)
        for i in range(0, len(train), BATCH):
            part = train[i : i + BATCH]
            at = np.concatenate([np.arange(first[j], first[j] + count[j]) for j in part])
            step += 1
            for j, g in enumerate(gradients(net, x[at], count[part], y[part])):
                g = g + PENALTY * weights[j]
                slow[j] = 0.9 * slow[j] + 0.1 * g
                fast[j] = 0.99 * fast[j] + 0.01 * g * g
                weights[j] -= rate * slow[j] / (1 - 0.9**step) / (np.sqrt(fast[j] / (1 - 0.99**step)) + 1e-8)
    some = held if len(set(y[held].tolist())) == 2 else ~held
    return net._replace(slope=_temperature(net.run(x, count)[0][some], y[some]))


class QualityNetwork(NamedTuple):
    counts: np.ndarray
    rows: np.ndarray
    net: Network


def _sample(docs: DataFrame, labels: DataFrame, learned: Column, id_col: str, text_col: str, rows: int, most_bytes: int) -> DataFrame:
    """(id, text, label) of labelled rows with ids in the order of a hash, as many as the bounds let in."""
    tags = labels.filter(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min((F.col("quality") > 0).cast("int")).alias("label"))
    tags = tags.filter(learned).withColumn("draw", F.xxhash64("id", F.lit(29)))
    n = tags.count()
    some = tags.filter(F.pmod("draw", F.lit(1_000_000)) < int(1_000_000 * min(1.0, 2 * rows / max(n, 1)))) if n > 4 * rows else tags
    some = some.orderBy("draw", "id").limit(rows)
    sizes = docs.select(F.col(id_col).alias("id"), F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).alias("size"))
    held = sizes.join(F.broadcast(some), "id").groupBy("id", "label", "draw").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).collect()  # ``rows`` at most
    chosen, n_rows, n_bytes = [], 0, 0
    for r in sorted(held, key=lambda r: (r.draw, str(r.id))):
        if n_rows + r.n <= rows and n_bytes + r.bytes <= most_bytes:
            chosen.append((r.id, r.label))
            n_rows, n_bytes = n_rows + r.n, n_bytes + r.bytes
    chosen = docs.sparkSession.createDataFrame(chosen, T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("label", T.IntegerType())]))
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "id")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, rows = np.zeros((2, 1 << BITS), np.int64), np.zeros(2, np.int64)
    for batch in batches:
        label = batch.column("label").to_numpy().astype(np.int64)
        rows += np.bincount(label, minlength=2)
        for i, data, offsets in K.slices(batch.column("text"), SLICE):
            doc_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
            parts = features(data, offsets, K.words(data, offsets))
            key = np.unique(np.concatenate([(doc_of[at] << BITS) | f for at, f in parts]))
            own = label[i + (key >> BITS)]
            for y in (0, 1):
                counts[y] += np.bincount(key[own == y] & ((1 << BITS) - 1), minlength=1 << BITS)
    some = np.flatnonzero(counts.any(0))
    some_and_rows = np.append(some, -1)
    values = [np.append(counts[y][some], rows[y]) for y in (0, 1)]
    yield pa.RecordBatch.from_arrays([pa.array(some_and_rows), pa.array(values[0]), pa.array(values[1])], ["feature", "n0", "n1"])


def _encoded(counts: np.ndarray, rows: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column("label").to_numpy().astype(np.int64)
            packed = []
            for i, data, offsets in K.slices(batch.column("text"), SLICE):
                count, x = encode(data, offsets, counts, rows, label[i : i + len(offsets) - 1])
                cut = np.concatenate([[0], np.cumsum(count)])
                packed += [x[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.string()), batch.column("label"), pa.array(packed, pa.binary())], ["id", "label", "passages"])

    return run


def train_passage_quality(docs: DataFrame, labels: DataFrame, learned: Column | None = None, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAINING_ROWS, most_bytes: int = TRAINING_BYTES) -> QualityNetwork:
    """Fits evidence and network on labelled rows (``quality`` above 0 is label 1) whose id passes ``learned``, a condition on
    the column ``id``: at most ``rows`` of them, with ``most_bytes`` of text.

    Of several labels of an id the least counts; ids that are null or have no text take no part; rows
    that share an id all do, or none if they are more than the bounds let in. Null and empty texts are one passage without words.
    """
    bounded_batches(docs.sparkSession)
    sample = saved(_sample(docs, labels, F.lit(True) if learned is None else learned, id_col, text_col, rows, most_bytes), "labelled")
    found = sample.select("text", "label").mapInArrow(tidy(_counted), "feature long, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    counts, totals = np.zeros((2, 1 << BITS), np.float32), np.zeros(2)
    feature = found["feature"].to_numpy()
    for y in (0, 1):
        n = found[f"n{y}"].to_numpy()
        counts[y][feature[feature >= 0]] = n[feature >= 0]
        totals[y] = n[feature < 0].sum()
    rows_of = sample.mapInArrow(tidy(_encoded(counts, totals)), "id string, label int, passages binary").toArrow()
    discard(sample)
    rows_of = rows_of.sort_by([("id", "ascending"), ("passages", "ascending")])
    width = 8 + 1 + 3 + 3 + 9
    bags = [np.frombuffer(x.as_buffer(), np.float32).reshape(-1, width) for x in rows_of["passages"]]
    y = rows_of["label"].to_numpy().astype(float)
    x = np.concatenate(bags).astype(np.float64) if bags else np.zeros((0, width))
    return QualityNetwork(counts, totals, fit(x, np.array([len(b) for b in bags], np.int64), y))


def score_passage_quality(docs: DataFrame, model: QualityNetwork, text_col: str = "text", threshold: float = 0.3, prefix: str = "", with_text: bool = True) -> DataFrame:
    """Every row of ``docs`` with ``score``, the probability of label 1; ``predicted``, 1 from ``threshold`` on;
    ``n_passages``; and ``top_passage`` and ``top_attention``, the passage, from 0, with the largest weight, the first of equal ones.

    Null and empty texts are one passage without words; very long texts count as a whole; repeated rows get equal
    results, null ids are of no account, and an empty table gives an empty one. Columns of ``docs`` with the new
    names raise ValueError; give a ``prefix`` then. Without ``with_text`` the text stays behind.
    """
    added = ["score", "predicted", "n_passages", "top_passage", "top_attention"]
    names = [prefix + n for n in added]
    columns = [c for c in docs.columns if with_text or c != text_col]
    if clash := [n for n in names if n in columns]:
        raise ValueError(f"columns exist already: {clash}")
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.counts, model.rows, tuple(model.net)))
    kinds = [T.DoubleType(), T.IntegerType(), T.LongType(), T.LongType(), T.DoubleType()]
    schema = T.StructType([*(docs.schema[c] for c in columns), *(T.StructField(n, kind) for n, kind in zip(names, kinds, strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rows, net = shared.value[0], shared.value[1], Network(*shared.value[2])
        for batch in batches:
            for i, data, offsets in K.slices(batch.column(text_col), SLICE):
                count, x = encode(data, offsets, counts, rows)
                margin, weight, *_ = net.run(net.scaled(x), count)
                first = np.cumsum(count) - count
                most = np.maximum.reduceat(weight, first)
                at = np.flatnonzero(weight == np.repeat(most, count))
                top = at[np.searchsorted(at, first)] - first
                score = net.probability(margin)
                part = batch.slice(i, len(count))
                values = [pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(count.astype(np.int64)), pa.array(top.astype(np.int64)), pa.array(most)]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in columns] + values, [*columns, *names])

    return docs.mapInArrow(tidy(run), schema)
