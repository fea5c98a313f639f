import corpus_pipeline
from tests.llm.test_near_dedup import brute_force as near_brute_force
from tests.llm.test_packing import vocabulary_path
from tests.llm.test_suffix_dedup import brute_force as repeats_brute_force

SF = "/root/testdata/sf0.001"


def test_stages_match_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    quality, near, repeats, copies, pack = (f for _, f in corpus_pipeline.STAGES)
    kept = quality(spark, docs, SF)
    assert kept.columns == names and 0 < kept.count() < docs.count()
    texts = {r.doc_id: r.text for r in kept.collect()}
    kept = spark.createDataFrame([tuple(r) for r in kept.collect()], docs.schema)

    single = near(spark, kept, SF)
    assert single.columns == names
    expected = {i for i, (_, _, first) in near_brute_force(texts, 5).items() if first}
    assert {r.doc_id for r in single.collect()} == expected
    single = kept.filter(kept.doc_id.isin(sorted(expected)))

    left = repeats(spark, single, SF)
    assert left.columns == names
    plain = {i: raw.decode(errors="ignore") for i, (_, raw, _) in repeats_brute_force({i: texts[i] for i in expected}, 100).items()}
    assert {r.doc_id: r.text for r in left.collect()} == {i: t for i, t in plain.items() if t}
    assert all(r.n_chars == len(r.text) for r in left.collect())

    clean = copies(spark, left, SF)
    assert clean.columns == names
    items = [r.text.lower() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    ids = {r.doc_id for r in clean.collect()}
    assert ids <= set(plain)
    assert not [i for i in ids if any(t in plain[i].lower() for t in items)]

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary_path())
    pieces = pack(spark, clean, SF).collect()
    total = {i: 0 for i in ids}
    for r in pieces:
        total[r.doc_id] += r.length
    assert total == {i: len(tokenizer.encode(plain[i], add_special_tokens=False).ids) + 1 for i in ids}


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and rows.count() > 0


def test_odd_rows_and_other_columns(spark):
    """Nulls, repeated ids and rows, and columns whose names the stages use themselves."""
    good = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.doc_id % 2 == 0}
    some = [t for t in good.values() if len(t.split()) > 200][:6]
    made = [(None, some[0]), (1, some[1]), (1, some[2]), (2, some[3]), (2, some[3]), (3, None), (4, ""), (5, some[4])]
    names = ["_kept", "_id", "_text", "_found", "_q_kept", "q_kept", "row_key", "kept_key", "cut_key", "cut_text", "found", "kept", "id"]
    df = spark.createDataFrame([(i, t, None, "s", -1, *([7] * len(names))) for i, t in made], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names))
    quality, near, repeats, copies, pack = (f for _, f in corpus_pipeline.STAGES)
    for stage in (quality, near, repeats, copies):
        out = stage(spark, df, SF)
        assert out.columns == df.columns and out.count() <= len(made)
        assert stage(spark, df.limit(0), SF).count() == 0
    assert sorted((r.doc_id or 0, r.text or "") for r in near(spark, df, SF).collect()) == sorted((i or 0, t or "") for i, t in dict.fromkeys(made))
    left = repeats(spark, df, SF).collect()
    assert len(left) == len(made) - 1 and {r.text for r in left} <= {t or "" for _, t in made} | {r.text for r in left if r.doc_id in (1, 2, 5)} and all(r.kept == 7 for r in left)
    pieces = pack(spark, df, SF).collect()
    assert len([r for r in pieces if not r.piece]) == len(made)
