"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

Every position with ``threshold`` bytes after it is a suffix; suffixes are
ordered only through those bytes, by most-significant-digit passes, and the
groups that are still equal after the last digit are exactly the repeated
windows. The first digit is one that the window's content determines: the hash
of its least ``GRAM``-byte gram. Suffixes that share one such gram form an
anchor, so the first pass moves about one record for 40 bytes, and anchors
whose gram occurs once leave before any text moves. What is left is dealt out
by the gram with its context, and the next passes sort the windows by quarters
of their bytes; groups of one leave at each pass. Equal windows are confirmed
byte by byte. In each group all but the first (by id, then start) are removed.

Both shuffles are pre-aggregated: an anchor or context that a task meets again
is settled there, so a passage in a third of all documents sends one record
from each task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm import text_kernels as K
from tessera.llm.tables import Keyed, pack_text, packed, packs_by_bucket, unpack_columns, unpack_text, with_keys
from tessera.llm.text_kernels import tidy

GRAM = 24
#: Positions fit in so many bits of a slice; longer documents are cut into overlapping pieces.
PLACE_BITS = 22
PIECE = 1 << 19
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
U = np.uint64
#: Text that a task gathers before it sends its records.
GATHER = 1 << 23


def _loads(data: np.ndarray) -> np.ndarray:
    """A scrambled 64-bit word of the 8 bytes from each position on."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return K.mix(np.ndarray((len(data),), "<u8", padded, strides=(1,)).astype(U))


def string_hashes(loads: np.ndarray, at: np.ndarray | slice, size: int) -> np.ndarray:
    """Hashes of the ``size`` (8 or more) bytes from ``at`` on, from the words of _loads."""
    steps = [*range(0, size - 8, 8), size - 8]
    out = np.full(1, size, U)
    for j, step in enumerate(steps):
        part = loads[at.start + step : at.stop + step] if isinstance(at, slice) else loads[at + step]
        out = out * U(0xD1342543DE82EF95) + part * MULTIPLIERS[j % 4]
    return K.mix(out)


class Anchors:
    """The anchors of a slice: gram hash, first window, number of windows, document; windows never cross documents."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, threshold: int) -> None:
        reach = threshold - GRAM + 1
        n_windows = np.maximum(np.diff(offsets) - threshold + 1, 0)
        total = int(n_windows.sum())
        self.hash, self.start, self.count, self.doc = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not total:
            return
        grams = string_hashes(_loads(data), slice(0, len(data) - GRAM + 1), GRAM)
        least = (grams & ~U((1 << PLACE_BITS) - 1)) | np.arange(len(grams), dtype=U)
        span = 1
        while span * 2 <= reach:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < reach:
            least = np.minimum(least[: len(least) - (reach - span)], least[reach - span :])
        docs = np.repeat(np.arange(len(n_windows)), n_windows)
        windows = ragged(offsets[:-1], n_windows)
        place = (least[windows] & U((1 << PLACE_BITS) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        self.hash, self.start, self.doc = grams[place[first]], windows[first], docs[first]
        self.count = np.diff(np.append(first, total))


def ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for count[0] numbers, then the same for start[1], and so on."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - count), count)


def _pieces(ids: np.ndarray, texts: list[bytes], threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, borders, id, place in the text) of slices; a long text comes in pieces that overlap by threshold - 1."""
    parts: list[tuple[int, int, bytes]] = []
    size = 0

    def slice_of() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        data = np.frombuffer(b"".join(p[2] for p in parts), np.uint8)
        return data, np.cumsum([0, *(len(p[2]) for p in parts)]), np.array([p[0] for p in parts], np.int64), np.array([p[1] for p in parts], np.int64)

    for i, text in zip(ids.tolist(), texts, strict=True):
        for a in range(0, max(len(text) - threshold + 1, 0), PIECE):
            piece = text[a : a + PIECE + threshold - 1]
            parts.append((i, a, piece))
            size += len(piece)
            if size >= PIECE:
                yield slice_of()
                parts, size = [], 0
    if parts:
        yield slice_of()


def _rows(names: list[str], rows: list[tuple], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)


def _repeated(key: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by (key, doc, start); masks in that order: first of its key, alone with its key."""
    order = np.lexsort((start, doc, key))
    k = key[order]
    first = np.ones(len(k), bool)
    first[1:] = k[1:] != k[:-1]
    alone = first.copy()
    alone[:-1] &= first[1:]
    return order, first, alone


def _by_id(doc: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(id, bytes of its columns' rows) of records in any order."""
    if not len(doc):
        return
    order = np.lexsort((columns[0], doc))
    table, d = np.stack([c[order] for c in columns], 1).astype(np.int64), doc[order]
    cut = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
    for a, b in zip(cut, np.append(cut[1:], len(d)), strict=False):
        yield int(d[a]), table[a:b].tobytes()


def _doc_packs(bits: int, doc: np.ndarray, *columns: np.ndarray) -> list[tuple[int, bytes]]:
    """Packs (id, columns) of records in any order, by -1 - bucket of the id."""
    bucket = (K.mix(doc.view(U)) >> U(64 - bits)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return [(-1 - b, x) for b, x in packs_by_bucket(bucket[order], [c[order] for c in (doc, *columns)])]


_RECORDS = (["bucket", "pack"], [pa.int64(), pa.binary()])


def _text_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[bytes], list[bytes]]]:
    """(ids, texts, marks) of about GATHER bytes each, from plain or packed texts."""
    ids, texts, marks, size = [], [], [], 0
    for batch in batches:
        packed = "packed" in batch.schema.names
        for a in range(0, batch.num_rows, 256):
            part = batch.slice(a, 256)
            for raw in part.column("packed" if packed else "text").cast(pa.binary()).to_pylist():
                texts.append(unpack_text(raw) if packed else raw)
                size += len(texts[-1])
            ids += part.column("id").to_pylist()
            marks += part.column("marks").to_pylist() if packed else [b""] * part.num_rows
            if size >= GATHER:
                yield ids, texts, marks
                ids, texts, marks, size = [], [], [], 0
    if ids:
        yield ids, texts, marks


def _bucket_of(key: np.ndarray, bits: int) -> np.ndarray:
    """The low bits: anchors are least by their high ones, which are near 0 therefore."""
    return (key & U((1 << min(bits, PLACE_BITS)) - 1)).astype(np.int64)


def _first_digit(threshold: int, bits: int):
    """Anchors by bucket of their gram; those met twice in a task are settled (by document, negative buckets)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, _ in _text_groups(batches):
            found = []
            for data, offsets, doc, place in _pieces(np.array(ids, np.int64), texts, threshold):
                a = Anchors(data, offsets, threshold)
                found.append((a.hash, doc[a.doc], a.start - offsets[a.doc] + place[a.doc]))
            if not found:
                continue
            key, doc, start = (np.concatenate(x) for x in zip(*found, strict=True))
            order, first, alone = _repeated(key, doc, start)
            again = order[~alone]
            rows = _doc_packs(bits, doc[again], start[again])
            sent = order[first]
            bucket = _bucket_of(key[sent], bits)
            by = np.argsort(bucket, kind="stable")
            sent = sent[by]
            rows += packs_by_bucket(bucket[by], [key[sent], doc[sent], start[sent].astype(np.int32)])
            for a in range(0, len(rows), 2000):
                yield _rows(_RECORDS[0], rows[a : a + 2000], _RECORDS[1])

    return run


def _buckets(batches: Iterator[pa.RecordBatch]) -> tuple[dict[int, list[bytes]], list[tuple[int, bytes]]]:
    """The packs of each bucket, and those by document, which pass through."""
    held: dict[int, list[bytes]] = {}
    settled: list[tuple[int, bytes]] = []
    for batch in batches:
        for b, x in zip(batch.column("bucket").to_pylist(), batch.column("pack").to_pylist(), strict=True):
            settled.append((b, x)) if b < 0 else held.setdefault(b, []).append(x)
    return held, settled


def _repeated_anchors(bits: int):
    """First windows of the anchors whose gram occurs again, by document, from the packs of whole buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = _buckets(batches)
        found = []
        for packs in held.values():
            key, doc, start = unpack_columns(packs, [U, np.int64, np.int32])
            order, _, alone = _repeated(key, doc, start)
            found.append((doc[order[~alone]], start[order[~alone]].astype(np.int64)))
        if found:
            rows += _doc_packs(bits, *(np.concatenate(x) for x in zip(*found, strict=True)))
        for a in range(0, len(rows), 2000):
            yield _rows(_RECORDS[0], rows[a : a + 2000], _RECORDS[1])

    return run


def _one_row_each(n_columns: int):
    """(id, marks) for each document, from the packs of whole buckets of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_bucket: dict[int, list[bytes]] = {}
        for b, x in _buckets(batches)[1]:
            by_bucket.setdefault(b, []).append(x)
        for packs in by_bucket.values():
            rows = list(_by_id(*unpack_columns(packs, [np.int64] * (1 + n_columns))))
            for a in range(0, len(rows), 5000):
                yield _rows(["id", "marks"], rows[a : a + 5000], [pa.int64(), pa.binary()])

    return run


def _contexts(threshold: int, bits: int):
    """Contexts of the repeated anchors by bucket of their gram; equal contexts in a task are settled (by document)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, marks in _text_groups(batches):
            chosen = {i: np.frombuffer(m, np.int64) for i, m in zip(ids, marks, strict=True) if m}
            some = [j for j, i in enumerate(ids) if i in chosen]
            found: list[tuple] = []
            contexts: list[np.ndarray] = []
            for data, offsets, doc, place in _pieces(np.array([ids[j] for j in some], np.int64), [texts[j] for j in some], threshold):
                a = Anchors(data, offsets, threshold)
                if not len(a.hash):
                    continue
                start = a.start - offsets[a.doc] + place[a.doc]
                keep = np.zeros(len(start), bool)
                cut = np.searchsorted(a.doc, np.arange(len(doc) + 1))
                for j, (lo, hi) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                    keep[lo:hi] = np.isin(start[lo:hi], chosen[int(doc[j])])
                at, size = a.start[keep], a.count[keep] + threshold - 1
                contexts.append(data[ragged(at, size)])
                found.append((a.hash[keep], doc[a.doc[keep]], start[keep], a.count[keep], K.run_hashes(data, at, at + size)))
            if not found:
                continue
            key, doc, start, count, digest = (np.concatenate(x) for x in zip(*found, strict=True))
            text = np.concatenate(contexts)
            size = count + threshold - 1
            at = np.cumsum(size) - size
            order, first, _ = _repeated(key ^ digest * U(3), doc, start)
            again = order[~first]
            rows = _doc_packs(bits, doc[again], start[again], start[again] + size[again])
            sent = order[first]
            sent = sent[np.argsort(_bucket_of(key[sent], bits), kind="stable")]
            bucket = _bucket_of(key[sent], bits)
            cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(sent) else np.zeros(0, np.int64)
            for a, b in zip(cut, np.append(cut[1:], len(bucket)), strict=False):
                part = sent[a:b]
                body = [len(part).to_bytes(8, "little"), key[part].tobytes(), doc[part].tobytes(), start[part].tobytes(), count[part].astype(np.int32).tobytes()]
                rows.append((int(bucket[a]), pack_text(b"".join([*body, text[ragged(at[part], size[part])].tobytes()]))))
            for a in range(0, len(rows), 1000):
                yield _rows(_RECORDS[0], rows[a : a + 1000], _RECORDS[1])

    return run


def equal_windows(data: np.ndarray, at: np.ndarray, threshold: int) -> np.ndarray:
    """For each window (its first byte in ``at``, in the wanted order), the index of the first equal one.

    Most-significant-digit passes over four digits; windows that are alone leave after each pass.
    """
    digit = -(-threshold // 4)
    loads = _loads(data)
    hashes = string_hashes(loads, slice(0, max(len(data) - digit + 1, 0)), digit)
    out = np.arange(len(at))
    left = out
    group = np.zeros(len(at), U)
    for step in (0, digit, 2 * digit, threshold - digit):
        key = (group[left] << U(32)) | (hashes[at[left] + step] >> U(32))
        order = np.argsort(key, kind="stable")
        key, left = key[order], left[order]
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        alone = first.copy()
        alone[:-1] &= first[1:]
        group[left] = np.cumsum(first).astype(U)
        left = left[~alone]
    if len(left):
        order = np.argsort(group[left], kind="stable")
        left = left[order]
        g = group[left]
        heads = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        head = np.repeat(left[heads], np.diff(np.append(heads, len(left))))
        out[left] = head
        words = np.ndarray((len(data),), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
        same = np.ones(len(left), bool)
        for step in [*range(0, threshold - 8, 8), threshold - 8]:
            same &= words[at[left] + step] == words[at[head] + step]
        if not same.all():  # two strings with equal hashes: their groups are told apart by their bytes
            broken = np.isin(g, g[~same])
            seen: dict[tuple[int, bytes], int] = {}
            for i, k in zip(left[broken].tolist(), g[broken].tolist(), strict=True):
                out[i] = seen.setdefault((k, data[at[i] : at[i] + threshold].tobytes()), i)
    return out


def _last_digits(threshold: int, bits: int):
    """Removed byte runs, by document, from the packs of whole buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = _buckets(batches)
        found = []
        for packs in held.values():
            parts = []
            for packed in packs:
                raw = unpack_text(packed)
                n, at = int.from_bytes(raw[:8], "little"), 8
                own = []
                for kind in (U, np.int64, np.int64, np.int32):
                    own.append(np.frombuffer(raw, kind, n, at))
                    at += n * np.dtype(kind).itemsize
                parts.append((*own, np.frombuffer(raw, np.uint8, offset=at)))
            _, doc, start, count, data = (np.concatenate(x) for x in zip(*parts, strict=True))
            count = count.astype(np.int64)
            size = count + threshold - 1
            at = np.cumsum(size) - size
            order = np.lexsort((start, doc))
            windows, w_doc = ragged(at[order], count[order]), np.repeat(doc[order], count[order])
            w_start = ragged(start[order], count[order])
            again = np.flatnonzero(equal_windows(data, windows, threshold) != np.arange(len(windows)))
            d, s = w_doc[again], w_start[again]
            cut = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (s[1:] != s[:-1] + 1)])) if len(again) else np.zeros(0, np.int64)
            last = np.append(cut[1:], len(again)) - 1
            found.append((d[cut], s[cut], s[last[: len(cut)]] + threshold))
        if found:
            rows += _doc_packs(bits, *(np.concatenate(x) for x in zip(*found, strict=True)))
        for a in range(0, len(rows), 2000):
            yield _rows(_RECORDS[0], rows[a : a + 2000], _RECORDS[1])

    return run


def merge_spans(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of (start, end) rows in any order; touching runs become one."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    at = np.flatnonzero(new)
    return np.stack([spans[at, 0], reach[np.append(at[1:], len(spans)) - 1]], 1)


def _cut(as_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _cut_batch(batch, as_text)

    return run


def _cut_batch(batch: pa.RecordBatch, as_text: bool) -> Iterator[pa.RecordBatch]:
    for a in range(0, batch.num_rows, 500):
        part = batch.slice(a, 500)
        rows = []
        for i, packed, found in zip(*(part.column(c).to_pylist() for c in ("id", "packed", "marks")), strict=True):
            text = unpack_text(packed)
            spans = merge_spans(np.frombuffer(found or b"", np.int64).reshape(-1, 2))
            kept, at = [], 0
            for lo, hi in spans.tolist():
                kept.append(text[at:lo])
                at = hi
            left = b"".join([*kept, text[at:]])
            rows.append((i, len(text), left.decode(errors="ignore") if as_text else left, [{"start": lo, "end": hi} for lo, hi in spans.tolist()]))
        yield _rows(["id", "n_bytes", "kept", "spans"], rows, [pa.int64(), pa.int64(), pa.string() if as_text else pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))])


def remove_repeats(docs: DataFrame | Keyed, id_col: str = "doc_id", text_col: str = "text", threshold: int = 100, as_text: bool = False) -> DataFrame:
    """(id, n_bytes, kept binary, spans array<struct<start, end>>) of each document.

    ``spans`` are the maximal runs of bytes covered by a ``threshold``-byte string that also
    starts earlier (smaller id, or earlier in the same text); ``kept`` are the other bytes (with
    ``as_text`` a string, without the characters of which only a part is left). Texts
    are judged as they came in, as whole UTF-8 bytes, however long. Null and empty texts have no
    bytes; an empty table gives an empty one. Each row is a document: of rows that share an id one
    comes first, by a hash of their columns, and a null id comes before all others; ids may be
    strings. Other columns of ``docs`` are left aside. ``threshold``: 32 to 4096.
    """
    if not 32 <= threshold <= 4096:
        raise ValueError("threshold must be between 32 and 4096")
    keyed = with_keys(docs, id_col)
    spark = keyed.rows.sparkSession
    # More buckets than partitions, so that a task goes through small groups one by one.
    bits = max(9, (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))).bit_length())
    plain = keyed.texts(text_col)
    texts = packed(plain)
    records = "bucket long, pack binary"
    deal = lambda df: df.repartition("bucket")
    each = lambda df, n: deal(df).mapInArrow(tidy(_one_row_each(n)), "id long, marks binary")  # noqa: E731  # bounded by the document's length
    anchors = deal(plain.mapInArrow(tidy(_first_digit(threshold, bits)), records)).mapInArrow(tidy(_repeated_anchors(bits)), records)
    contexts = texts.join(each(anchors, 1), "id").mapInArrow(tidy(_contexts(threshold, bits)), records)
    removed = deal(contexts).mapInArrow(tidy(_last_digits(threshold, bits)), records)
    out = texts.join(each(removed, 2), "id", "left").mapInArrow(tidy(_cut(as_text)), f"id long, n_bytes long, kept {'string' if as_text else 'binary'}, spans array<struct<start:long,end:long>>")
    return keyed.named(out, "id")

