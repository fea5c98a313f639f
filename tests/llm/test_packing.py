import zlib

import numpy as np
import pytest

from tessera.llm.packing import Plan, fit_repeats, length_patterns, pack_documents
from tessera.llm.token_ids import encoder, vocabulary_path


def placements(counts):
    plan, rows = Plan(counts), []
    table = plan.table()
    for length in np.flatnonzero(counts):
        own = table[table[:, 0] == length]
        for rank in range(counts[length]):
            _, first, sequence, offset = own[np.searchsorted(own[:, 1], rank, "right") - 1]
            rows.append((sequence + rank - first, offset, int(length)))
    return plan.sequences, sorted(rows)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_plan_is_gapless_and_tight(seed):
    rng = np.random.default_rng(seed)
    counts = np.bincount(np.minimum(rng.lognormal(3.5, 1.2, 3000).astype(int) + 1, 256), minlength=257)
    n, rows = placements(counts)
    place = {}
    for sequence, offset, length in rows:
        assert offset == place.get(sequence, 0)
        place[sequence] = offset + length
    assert max(place.values()) <= 256 and len(place) == n
    assert n <= 1.01 * -(-sum(place.values()) // 256) + 1


def test_patterns_and_fit():
    counts = np.zeros(11, np.int64)
    counts[[3, 4, 6, 7]] = 5, 3, 4, 5
    patterns = length_patterns(counts)
    assert sorted(map(tuple, patterns.tolist())) == [(4, 3, 3), (6, 4, 0), (7, 3, 0)]
    x = fit_repeats(patterns, counts)
    made = np.bincount(patterns.reshape(-1), np.repeat(x, 3), 11)
    assert np.abs(made - counts)[1:].max() < 1.2


def test_pieces_round_trip(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary_path())
    texts = {1: None, 2: "", 3: "Hello  world\n\n\tà é 你好 123's", 4: "word " * 700, 5: " x" * 128, 6: "a b\r\n <|endoftext|> c", None: "no id"}
    docs = spark.createDataFrame([(i, t, 7) for i, t in texts.items()], "doc_id long, text string, piece int")
    got = pack_documents(docs, capacity=64).collect()
    for i, t in texts.items():
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], np.uint32)
        own = sorted((r for r in got if r.doc_id == i), key=lambda r: r.piece)
        assert [r.start for r in own] == list(np.cumsum([0, *(r.length for r in own)])[:-1]) and sum(r.length for r in own) == len(ids)
        assert all(r.length == 64 for r in own[1:])
        assert [r.ids_crc32 for r in own] == [zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own]
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)
    assert pack_documents(docs.limit(0)).count() == 0


def test_encoder_agrees_with_the_tokenizer(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary_path())
    rows = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    rows += ["", " ", "a", "a  b", " a b", "a b ", "a \nb", "a\n\nb", "a\tb c", "x\n b", "l'ami d'été\n1234 56", "a\u00a0b \u3000c", "a \u00a0 b", "\nx y"]
    for made in (encoder(vocabulary_path()).encode_many(rows), encoder(vocabulary_path()).encode_many(rows[::-1])[::-1]):
        for t, ids in zip(rows, made, strict=True):
            assert np.frombuffer(ids, np.uint32).tolist() == tokenizer.encode(t, add_special_tokens=False).ids
