import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import license_scan, queries, sharding, url_filter
from tests.compare import SF, compare, connection

LOWER = {c: c + 32 for c in range(65, 91)}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    assert compare(spark, queries.queries()[name], queries.oracle_sql()[name], connection(), SF) == ""


def test_shards_are_even_and_stable(spark):
    names = [f"s{i}" for i in range(10)]
    slots = sharding.fill_table(names, 1009)
    counts = Counter(slots)
    assert max(counts.values()) - min(counts.values()) <= 1
    fewer = sharding.fill_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(slots, fewer, strict=True) if a != 9)
    assert moved < 0.2 * 1009
    df = spark.createDataFrame([(1, 2), (1, 3), (None, 4)], "doc_id long, slot int")
    with pytest.raises(ValueError):
        sharding.assign_shards(df, "doc_id", names)
    rows = sharding.assign_shards(df, "doc_id", names, 1009, "x_").collect()
    assert len(rows) == 3 and len({r.x_shard for r in rows if r.doc_id == 1}) == 1
    assert sharding.assign_shards(df.limit(0), "doc_id", names, 1009, "x_").count() == 0
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.fill_table(bad)
    with pytest.raises(ValueError):
        sharding.fill_table(names, 1000)


def test_urls(spark):
    urls = ["http://A.Example.ORG/es/x?q=/en/1", "https://example.org/en/123", "https://example.org/en/2", "http://org", "http://org/", "ftp://x.com/fr/", "http://notexample.org.com/de/#x", "http://com?x=/de/", None, "no scheme", "://", "x://example.org/es/://", "http://example.org:80/es/"]
    df = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls + urls)], "page_id long, url string, size int")

    def plain(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(LOWER)
        fits = [(len(h + p), h + p, v) for v, h, p in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else "allow")

    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(df, "url", queries.URL_RULES).collect()}
    assert got == {i: plain(u) for i, u in enumerate(urls + urls)}
    assert url_filter.filter_urls(df.limit(0), "url", queries.URL_RULES).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(df, "url", []).collect()} == {"allow"}
    taken = df.withColumnsRenamed({"size": "host"}).withColumn("rule", F.lit("own"))
    with pytest.raises(ValueError, match="exist"):
        url_filter.filter_urls(taken, "url", queries.URL_RULES)
    beside = url_filter.filter_urls(taken, "url", queries.URL_RULES, prefix="f_").collect()
    assert {r.page_id: (r.f_host, r.f_path, r.f_rule, r.f_verdict) for r in beside} == got and all(r.rule == "own" and r.host == 1 for r in beside)


def test_licenses(spark):
    rng = random.Random(6)
    phrases = [(t.label, t.text.split()) for t in license_scan.PHRASES]
    filler = ["under", "the", "mit", "license", "Apache", "version", "2", "cc", "by", "nc", "word", "été"]
    docs = {1: None, 2: "", 3: "mit", 4: "Released under the MIT License. " * 30, 5: "Licensed under CC-BY-NC 4.0", 6: "apache license, version 2.0", 7: "word " * 3000 + "cc by nc"}
    for i in range(10, 150):
        docs[i] = " ".join(rng.choice([rng.choice(filler), " ".join(rng.choice(phrases)[1]) if rng.random() < 0.1 else rng.choice(filler)]) for _ in range(rng.randrange(80)))

    def plain(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        places = sorted((i, label) for label, p in phrases for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p)
        return (len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({x for _, x in places})))

    df = spark.createDataFrame([(i, t, 9) for i, t in docs.items()], "doc_id long, text string, score int").repartition(3)
    rows = license_scan.scan_licenses(df).collect()
    assert {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows} == {i: plain(t) for i, t in docs.items()}
    assert all(0 <= r.score <= 1 and set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} for r in rows)
    mangled = spark.createDataFrame([(1, "Permission is hereby granted, free of any charge, to any person obtaining one copy of this software and associated documentation")], "doc_id long, text string")
    assert license_scan.scan_licenses(mangled).first().labels == "mit"
    assert license_scan.scan_licenses(df.limit(0)).count() == 0


def test_long_templates(spark):
    words = [f"t{i}" for i in range(200)]
    templates = (license_scan.Template("long", " ".join(words)), license_scan.Template("exact", " ".join(words[:150]), True))
    docs = {1: " ".join(words), 2: " ".join(words[:140] + ["other"] * 3 + words[145:]), 3: " ".join(words[:90]), 4: "x " * 20 + " ".join(words[:150])}
    df = spark.createDataFrame([(str(i), t) for i, t in docs.items()], "doc_id string, text string")
    got = {r.doc_id: (r.labels, r.base_labels, r.first_word) for r in license_scan.scan_licenses(df, templates=templates).collect()}
    assert got == {"1": ("exact,long", "exact", 0), "2": ("long", "", None), "3": ("", "", None), "4": ("exact,long", "exact", 20)}


def plain_scan(text, templates=license_scan.PHRASES + license_scan.NOTICES + license_scan.LICENSES):
    """(labels, score) by hits of each template, diagonal by diagonal."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    labels, best = set(), 0.0
    for t in templates:
        split = t.text.split()
        n = len(split) - 2
        hits = {}
        for i in range(len(words) - 2):
            for j in range(n):
                if words[i : i + 3] == split[j : j + 3]:
                    hits.setdefault(i - j, set()).add(j)
        spans, start, last = [], None, None
        for diagonal in sorted(hits):
            if last is None or diagonal - last > license_scan.NEIGHBOUR:
                start = diagonal
            last = diagonal
            spans.append(((start, (diagonal - start) // (max(license_scan.NEIGHBOUR, int(n * license_scan.DRIFT)) + 1)), diagonal))
        covers = {}
        for key, diagonal in spans:
            covers.setdefault(key, set()).update(hits[diagonal])
        for key, covered in covers.items():
            whole = any(len(hits[d]) == n for k, d in spans if k == key)
            if whole if t.exact else len(covered) / n >= license_scan.LEAST_COVER:
                labels.add(t.label)
                best = max(best, len(covered) / n)
    return ",".join(sorted(labels)), best


def test_license_labels_and_scores(spark):
    rng = random.Random(8)
    texts = [t.text.split() for t in license_scan.PHRASES + license_scan.NOTICES + license_scan.LICENSES]
    docs = {1: None, 2: "licensed under the apache foo bar licence; the apache license version one; license version 2 1; version 2 0"}
    for i in range(10, 130):
        words = list(rng.choice(texts))
        for _ in range(rng.choice([0, 1, len(words) // 12, len(words) // 5])):  # words changed, dropped and put in
            at = rng.randrange(len(words))
            words[at : at + rng.choice([0, 1, 1, 3])] = [rng.choice(["other", "the", "software"])] * rng.choice([0, 1, 1, 2])
        docs[i] = " ".join([*["before"] * rng.randrange(3), *words, *rng.choice(texts)[: rng.randrange(20)]])
    df = spark.createDataFrame([(i, t) for i, t in docs.items()], "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.labels, round(r.score, 9)) for r in license_scan.scan_licenses(df).collect()}
    assert got == {i: (labels, round(score, 9)) for i, (labels, score) in ((i, plain_scan(t)) for i, t in docs.items())}
    assert got[2] == ("", 0) and {"isc", "zlib", "bsd-3", "bsd-2", "unlicense", "gpl-3"} <= {x for labels, _ in got.values() for x in labels.split(",")}


def test_shard_table_against_wish_lists():
    """Written-out wish lists of all shards, which strike what others have taken, in place of steps through the table."""
    names, size = [f"shard-{i:03d}" for i in range(64)], 1009
    wishes = []
    for name in names:
        offset, step = (int(hashlib.md5(name.encode()).hexdigest()[k : k + 16], 16) for k in (0, 16))
        wishes.append([(offset % size + k * (step % (size - 1) + 1)) % size for k in range(size)])
        assert sorted(wishes[-1]) == list(range(size))
    owner = {}
    while len(owner) < size:
        for s in range(len(names)):
            wishes[s] = [w for w in wishes[s] if w not in owner]
            if wishes[s]:
                owner[wishes[s][0]] = s
    assert [owner[k] for k in range(size)] == sharding.fill_table(names, size)
