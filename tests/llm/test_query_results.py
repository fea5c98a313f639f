"""The registered queries over all of sf0.001, against plain versions."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import decontamination, license_scan, queries
from tests.llm.test_language_model import learned, tokens
from tests.llm.test_packing import vocabulary_path
from tests.llm.test_quality import plain as plain_stats
from tests.llm.test_suffix_dedup import brute_force as repeats_brute_force

SF = "/root/testdata/sf0.001"
LOWER = {c: c + 32 for c in range(65, 91)}


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows(spark, name):
    out = queries.queries()[name](spark, SF).collect()
    return {r.doc_id: r for r in out}


def test_op1(spark, texts):
    want = {i: (n, n - len(kept), spans, hashlib.sha256(kept).hexdigest()) for i, (n, kept, spans) in repeats_brute_force(texts, 100).items()}
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in rows(spark, "op1_suffix_array").items()} == want


def test_op4(spark, texts):
    """Every document against every test item, whole texts."""
    words = lambda t: np.array([zlib.crc32(w.encode()) for w in re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (t or "").translate(LOWER))], np.uint64)
    items = {r.item_id: words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    want = set()
    for d, text in texts.items():
        w = words(text)
        if len(w):
            for i, (score, _, _) in zip(items, decontamination.align(list(items.values()), [w] * len(items)), strict=True):
                if score >= 0.5 * decontamination.MATCH * len(items[i]):
                    want.add((d, i))
    got = {(r.doc_id, r.item_id) for r in queries.op4_decontamination(spark, SF).collect()}
    assert got == want and want


def test_op5(spark, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary_path())
    pieces = queries.op5_best_fit_packing(spark, SF).collect()
    total = 0
    for i, text in texts.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], np.uint32)
        own = sorted((r for r in pieces if r.doc_id == i), key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and len(own) == -(-len(ids) // 2048)
        assert np.concatenate([ids[r.start : r.start + r.length] for r in own]).tolist() == ids.tolist()
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) and (r.length == 2048 or not r.piece) for r in own)
        total += len(ids)
    filled = {}
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 2048 and len(filled) <= 1.02 * -(-total // 2048) + 1


def test_op6(spark, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary_path())
    count = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    for i, r in rows(spark, "op6_token_counts").items():
        text = texts[i] or ""
        after, n = re.subn(queries.PERSONAL, "[REDACTED]", text)
        assert (r.n_edits, r.n_chars, r.n_tokens_before, r.n_tokens) == (n, len(after), count(text), count(after)) and r.n_chars_encoded <= len(after)


def test_op7(spark, texts):
    got = rows(spark, "op7_language_model")
    counts = Counter(t for i, x in texts.items() if learned(i) for t in tokens(x))
    total = sum(counts.values())
    z = math.log10(total + 0.1 * (len(counts) + 1))
    for i, text in texts.items():
        own, r = tokens(text), got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (not learned(i), len(own), sum(counts[t] > 0 for t in own), total)
        assert math.isclose(r.base_score, sum(math.log10(counts[t] + 0.1) for t in own) - len(own) * z, rel_tol=1e-9, abs_tol=1e-6) and r.score < 0
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_op8(spark, texts):
    for i, r in rows(spark, "op8_quality_rules").items():
        stats = plain_stats(texts[i])
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == stats
        assert r.base_failed == (stats[0] < 50 or 100 * stats[4] > 50 * stats[0]) and not (r.kept and r.base_failed)


def test_op10(spark, texts):
    phrases = [(t.label, t.text.split()) for t in license_scan.PHRASES]
    for i, r in rows(spark, "op10_license_scans").items():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (texts[i] or "").translate(LOWER))
        places = sorted((k, label) for label, p in phrases for k in range(len(words) - len(p) + 1) if words[k : k + len(p)] == p)
        labels = {x for _, x in places}
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted(labels)))
        assert labels <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1 and (r.score == 1) >= bool(labels)
