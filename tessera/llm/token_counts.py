"""Token counts that follow edits, by a tree of pre-token segments for each document.

A text is cut at places that no pre-token crosses (before a single space or
line break between two other characters) into segments of about
``SEGMENT`` characters; their token counts add up to the text's. The segments
are the leaves of a complete binary tree whose nodes hold the sums of
characters and tokens below them. An edit walks down by characters to the
segments that it touches; those are re-encoded, with neighbours for as long as
the cut between is no longer safe, and the sums on their paths are updated.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.tables import bounded_batches, pack_text, unpack_text
from tessera.llm.text_kernels import tidy
from tessera.llm.token_ids import Encoder, encoder, vocabulary_path

SEGMENT = 256
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")


def segments(text: str) -> list[str]:
    """Pieces of at least SEGMENT characters (but for the last), cut where no pre-token crosses."""
    out, at = [], 0
    while len(text) - at > SEGMENT and (m := _CUT.search(text, at + SEGMENT)):
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


def safe_cut(text: str, at: int) -> bool:
    return at <= 0 or at >= len(text) or _CUT.match(text, at) is not None


class TokenTree:
    """Sums of characters and tokens: node i has children 2i and 2i + 1, leaves begin at ``width``."""

    def __init__(self, nodes: np.ndarray) -> None:
        self.nodes = nodes
        self.width = len(nodes) // 2

    @classmethod
    def build(cls, chars: list[int], tokens: list[int]) -> TokenTree:
        width = 1 << max(len(chars) - 1, 0).bit_length()
        nodes = np.zeros((2 * width, 2), np.int64)
        nodes[width : width + len(chars)] = np.stack([chars, tokens], 1)
        for i in range(width - 1, 0, -1):
            nodes[i] = nodes[2 * i] + nodes[2 * i + 1]
        return cls(nodes)

    @property
    def n_tokens(self) -> int:
        return int(self.nodes[1, 1])

    def leaf(self, at: int) -> tuple[int, int]:
        """The last leaf with characters that begins at or before place ``at``, and its beginning."""
        i, begin = 1, 0
        at = min(at, int(self.nodes[1, 0]) - 1)
        while i < self.width:
            left = int(self.nodes[2 * i, 0])
            i = 2 * i if at < begin + left else 2 * i + 1
            begin += left if i & 1 else 0
        return i - self.width, begin

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        i = leaf + self.width
        change = np.array([chars, tokens]) - self.nodes[i]
        while i:
            self.nodes[i] += change
            i //= 2

    def leaves(self) -> tuple[list[int], list[int]]:
        own = self.nodes[self.width :]
        chars, tokens = own[own[:, 0] > 0].T
        return chars.tolist(), tokens.tolist()

    def edit(self, text: str, edits: list[tuple[int, int, str]], count) -> tuple[str, int]:
        """The text with ``size`` characters at ``at`` replaced by ``new``, for disjoint (at, size, new) in ascending
        order, and the number of characters encoded again."""
        if not edits:
            return text, 0
        parts, done = [], 0
        for at, size, new in edits:
            parts += [text[done:at], new]
            done = at + size
        edited = "".join([*parts, text[done:]])
        found = self._regions(text, edited, edits)
        encoded, put, grown = 0, [], False
        for first, last, begin, end in found:
            own = segments(edited[begin:end])
            encoded += end - begin
            put.append((first, last, [(len(s), count(s)) for s in own]))
            grown |= len(own) > last - first + 1
        if not grown:
            for first, last, own in put:
                for leaf in range(first, last + 1):
                    self.put(leaf, *(own[leaf - first] if leaf - first < len(own) else (0, 0)))
        else:  # more segments than leaves: the tree gets new ones, the old counts stay
            rows = self.nodes[self.width :].tolist()
            for first, last, own in reversed(put):
                rows[first : last + 1] = own
            rows = [r for r in rows if r[0]] or [(0, 0)]
            self.__init__(TokenTree.build([r[0] for r in rows], [r[1] for r in rows]).nodes)
        return edited, encoded

    def _regions(self, text: str, edited: str, edits: list[tuple[int, int, str]]) -> list[tuple[int, int, int, int]]:
        """(first leaf, last leaf, begin, end), the places in the edited text, of what is to be encoded again:
        the leaves that edits touch, and neighbours as long as the cut between is no longer safe."""
        if not text:
            return [(0, 0, 0, len(edited))]

        def reach(at: int) -> tuple[int, int]:
            leaf, begin = self.leaf(at)
            return leaf, begin + int(self.nodes[leaf + self.width, 0])

        out: list[tuple[int, int, int, int, int, int]] = []  # first, last, begin and end in the text, shift before, growth
        i = shift = 0
        while i < len(edits):
            at, size, new = edits[i]
            first, begin = self.leaf(at)
            last, end = reach(at + max(size - 1, 0))
            grown, i = len(new) - size, i + 1
            while True:
                if i < len(edits) and (edits[i][0] < end or end == len(text)):
                    at, size, new = edits[i]
                    if at + size > end:
                        last, end = reach(at + size - 1)
                    grown, i = grown + len(new) - size, i + 1
                elif out and begin <= out[-1][3] and (begin < out[-1][3] or not safe_cut(edited, begin + shift)):
                    first, _, begin, _, shift, more = out.pop()
                    grown += more
                elif begin > 0 and not safe_cut(edited, begin + shift):
                    first, begin = self.leaf(begin - 1)
                elif end < len(text) and not safe_cut(edited, end + shift + grown):
                    last, end = reach(end)
                else:
                    break
            out.append((first, last, begin, end, shift, grown))
            shift += grown
        return [(first, last, begin + before, end + before + more) for first, last, begin, end, before, more in out]


def disjoint(edits: list[tuple[int, int, str]], length: int) -> list[tuple[int, int, str]]:
    """Distinct edits in ascending order, cut to the text; one that begins before the end of another is left out."""
    out, end = [], 0
    for at, size, new in sorted(set(edits)):
        at = min(max(at, 0), length)
        size = min(max(size, 0), length - at)
        if at >= end:
            out.append((at, size, new))
            end = at + size
    return out


def _counter(e: Encoder):
    return lambda s: len(e.encode(s)) // 4


def _trees(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(encoder(path))
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                packed, totals, trees = [], [], []
                for text in part.column("text").to_pylist():
                    own = segments(text)
                    tree = TokenTree.build([len(s) for s in own], [count(s) for s in own])
                    packed.append(pack_text(text.encode()))
                    totals.append(tree.n_tokens)
                    trees.append(pack_text(tree.nodes.astype(np.int32).tobytes()))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("digest"), pa.array(packed, pa.binary()), pa.array(totals, pa.int64()), pa.array(trees, pa.binary())], ["id", "digest", "packed", "n_tokens", "tree"])

    return run


def _texts(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """(id, digest long, text), null texts empty, and the ids' type."""
    bounded_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("digest"), text.alias("text")), docs.schema[id_col].dataType.simpleString()


def token_trees(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id, digest long, packed text, n_tokens long, tree binary), one row for each row of ``docs``.

    ``digest`` is the text's xxhash64. Null and empty texts have no tokens; very long texts are
    counted as a whole; ids may be null, repeated or strings; an empty table gives an empty one.
    Other columns of ``docs`` are left aside.
    """
    texts, kind = _texts(docs, id_col, text_col)
    return texts.mapInArrow(tidy(_trees(vocabulary or vocabulary_path())), f"id {kind}, digest long, packed binary, n_tokens long, tree binary")


def _edited(path: str):
    names = ["id", "digest", "packed", "n_tokens", "tree", "n_tokens_before", "n_edits", "n_chars", "n_chars_encoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(encoder(path))
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                rows = []
                for packed, before, raw, edits in zip(*(part.column(c).to_pylist() for c in ("packed", "n_tokens", "tree", "edits")), strict=True):
                    text, encoded, own = unpack_text(packed).decode(), 0, []
                    after = before
                    if edits:
                        own = disjoint([(e["at"], e["size"], e["new"]) for e in edits], len(text))
                        tree = TokenTree(np.frombuffer(unpack_text(raw), np.int32).reshape(-1, 2).astype(np.int64))
                        text, encoded = tree.edit(text, own, count)
                        packed, raw, after = pack_text(text.encode()), pack_text(tree.nodes.astype(np.int32).tobytes()), tree.n_tokens
                    rows.append((packed, after, raw, before, len(own), len(text), encoded))
                kinds = [pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                columns = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("digest"), *columns], names)

    return run


def apply_edits(trees: DataFrame, edits: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``trees`` after the edits (id, at, size, new), with n_tokens_before, n_edits, n_chars and n_chars_encoded.

    Places and sizes are characters of the text before any edit and are cut to it. Equal edits count
    once; of overlapping ones the first by (at, size, new) holds, and those that begin before its end
    are left out and not counted. An edit with a null place, size or id does nothing, a null
    replacement is empty; documents without edits pass as they are, edits without a document are left
    out. Edits go to every row with their id; with a column ``digest``, to those with that text only.
    """
    listed = F.collect_set(F.struct(F.col("at").cast("long").alias("at"), F.col("size").cast("long").alias("size"), F.coalesce("new", F.lit("")).alias("new"))).alias("edits")
    kind = trees.schema["id"].dataType.simpleString()
    keys = ["id", *(c for c in ("digest",) if c in edits.columns)]
    grouped = edits.withColumn("id", F.col("id").cast(kind)).dropna(subset=["id", "at", "size"]).groupBy(keys).agg(listed)
    schema = f"id {kind}, digest long, packed binary, n_tokens long, tree binary, n_tokens_before long, n_edits long, n_chars long, n_chars_encoded long"
    return trees.join(grouped, keys, "left").select("id", "digest", "packed", "n_tokens", "tree", "edits").mapInArrow(tidy(_edited(vocabulary or vocabulary_path())), schema)


def pattern_edits(docs: DataFrame, pattern: str, new: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Edits (id, digest, at, size, new) that replace each match of a Python pattern; none in rows without an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = re.compile(pattern)
        for batch in batches:
            at = [(i, m.start(), m.end() - m.start()) for i, text in enumerate(batch.column("text").to_pylist()) for m in compiled.finditer(text)]
            row = pa.array([x[0] for x in at], pa.int64())
            columns = [pa.array([x[j] for x in at], pa.int64()) for j in (1, 2)]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(row), batch.column("digest").take(row), *columns, pa.array([new] * len(at), pa.string())], ["id", "digest", "at", "size", "new"])

    texts, kind = _texts(docs, id_col, text_col)
    return texts.filter("id is not null").mapInArrow(tidy(run), f"id {kind}, digest long, at long, size long, new string")
