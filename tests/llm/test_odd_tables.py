"""Very long texts, empty tables and columns of maps, for the operators that take documents and for each stage of the pipeline."""

import hashlib
import random

import corpus_pipeline
from pyspark.sql import functions as F
from tests.llm.test_near_dedup import brute_force as near_brute_force
from tests.llm.test_packing import vocabulary_path
from tests.llm.test_quality import plain as plain_stats

from tessera.llm import language_model, near_dedup, packing, passage_quality, quality, suffix_dedup, token_counts, url_filter

SF = "/root/testdata/sf0.001"


def long_texts():
    rng = random.Random(12)
    words = [f"w{i}" for i in range(900)]
    prose = " ".join(rng.choice(words) for _ in range(40_000))
    return {1: prose, 2: prose.replace(" w7 ", " other "), 3: "x" * 150_000, 4: "é" * 70_000, 5: "\n" * 90_000, 6: "a few words"}


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").repartition(2)


def test_very_long_texts(spark):
    texts = long_texts()
    docs = table(spark, texts)
    near = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs, k=4).collect()}
    assert near == near_brute_force(texts, 4)

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary_path())
    lengths = {i: 0 for i in texts}
    for r in packing.pack_documents(docs).collect():
        lengths[r.doc_id] += r.length
    assert lengths == {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts.items()}

    scored = {r.doc_id: r for r in language_model.score_texts(docs, F.col("doc_id") != 2).collect()}
    assert {i: r.n_tokens for i, r in scored.items()} == {i: len(t.split()) + 1 for i, t in texts.items()} and all(r.score < 0 for r in scored.values())

    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 0, 1), (6, 1, 0)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in quality.score_quality(docs, quality.train_quality(docs, labels)).collect()}
    assert all([r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == plain_stats(texts[i]) for i, r in rows.items())
    passages = passage_quality.score_passage_quality(docs, passage_quality.train_passage_quality(docs, labels))
    assert {r.doc_id: r.n_passages for r in passages.collect()} == {i: max(1, -(-len(t.split()) // passage_quality.PASSAGE)) for i, t in texts.items()}

    url = "http://" + "a." * 500 + "example.org/es/" + "x" * 60_000
    got = url_filter.filter_urls(spark.createDataFrame([(1, url), (2, "http://" + "y" * 90_000)], "page_id long, url string"), "url", [("block", "example.org", "/es/")]).collect()
    assert {r.page_id: (r.rule, r.verdict, len(r.host) + len(r.path)) for r in got} == {1: ("example.org/es/", "block", len(url) - 7), 2: (None, "allow", 90_000)}


def test_stages_on_very_long_and_no_texts(spark):
    docs = table(spark, long_texts())
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() <= 6
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert {r.doc_id for r in corpus_pipeline.packed_sequences(spark, docs, SF).collect()} == set(range(1, 7))


def test_maps_beside_repeated_ids(spark):
    """Rows that need keys of their own and have columns that can't be hashed as they are."""
    text = "one of many words " * 30
    rows = [(1, text, {"a": 1}, [{"b": 2}]), (1, text + "more", {"a": 2}, None), (None, text, None, [{}]), (None, None, {}, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, tags map<string,int>, more array<map<string,int>>")
    near = near_dedup.near_duplicates(df).collect()
    assert len(near) == 4 and sum(r.kept for r in near) == 2
    kept = suffix_dedup.remove_repeats(df).collect()
    assert len(kept) == 4 and sum(r.n_bytes for r in kept) == sum(len(r[1] or "") for r in rows)
    assert len(packing.pack_documents(df).collect()) == 4
    assert language_model.score_texts(df, F.lit(True)).count() == 4
    assert token_counts.apply_edits(token_counts.token_trees(df), token_counts.pattern_edits(df, "more", "x")).count() >= 2
    full = df.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.lit(1).cast("long")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, full, SF).columns == full.columns
    digest = lambda r: hashlib.sha256((r.text or "").encode()).hexdigest()
    assert {digest(r) for r in corpus_pipeline.near_duplicates(spark, full, SF).collect()} <= {digest(r) for r in full.collect()}
