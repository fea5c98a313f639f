"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import clustering, decontamination, language_model, license_scan, near_dedup, packing, passage_quality, prefix_trie, quality, sharding, suffix_dedup, token_counts, url_filter
from tessera.llm.tables import table

PERSONAL = r"[\w.+-]+@[\w-]+\.[\w.]+|\d[\d -]{5,}\d"
SHARDS = [f"shard-{i:03d}" for i in range(64)]
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op1_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    n_spans = F.size("spans").cast("long").alias("n_spans")
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), n_spans, F.sha2("kept", 256).alias("kept_sha256"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=4)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents before and after the redaction of long numbers and e-mail addresses."""
    docs = table(spark, sf_dir, "documents")
    edits = token_counts.pattern_edits(docs, PERSONAL, "[REDACTED]")
    out = token_counts.apply_edits(token_counts.token_trees(docs), edits)
    return out.select(F.col("id").alias("doc_id"), "n_edits", "n_chars", "n_chars_encoded", "n_tokens_before", "n_tokens")


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    learned = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 != 0
    out = language_model.score_texts(table(spark, sf_dir, "documents"), learned)
    return out.withColumn("held_out", ~F.col("training")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train_quality(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model, with_text=False)


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), "url", URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, convs = prefix_trie.branched(prefix_trie.ordered_turns(table(spark, sf_dir, "conversations")))
    return prefix_trie.prefix_trie(turns, convs)


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.yinyang_clusters(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = lambda c: F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")) % 5
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = passage_quality.train_passage_quality(docs, table(spark, sf_dir, "labels"), fold("id") != 0)
    out = passage_quality.score_passage_quality(docs, model, with_text=False)
    return out.withColumn("held_out", fold("doc_id") == 0).select("doc_id", "held_out", "score", "predicted", "n_passages", "top_passage", "top_attention")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_suffix_array": op1_suffix_array,
        "op2_minhash": op2_minhash,
        "op3_sharding": op3_sharding,
        "op4_decontamination": op4_decontamination,
        "op5_best_fit_packing": op5_best_fit_packing,
        "op6_token_counts": op6_token_counts,
        "op7_language_model": op7_language_model,
        "op8_quality_rules": op8_quality_rules,
        "op9_url_filters": op9_url_filters,
        "op10_license_scans": op10_license_scans,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_centroid_clustering": op12_centroid_clustering,
        "op13_quality_classifier": op13_quality_classifier,
    }


#: A document's distinct 4-word shingles, inverted, give all pairs that share any; links are closed by a recursive query.
NEAR_SQL = r"""with recursive words as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sets as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')] else [array_to_string(w[i : i + 3], ' ') for i in range(1, len(w) - 2)] end) as s from words),
sizes as materialized (select doc_id, len(s) as n from sets),
flat as materialized (select doc_id, unnest(s) as g from sets),
common as (select a.doc_id as x, b.doc_id as y, count(*) as c from flat a join flat b on a.g = b.g and a.doc_id < b.doc_id group by all),
links as materialized (select x, y from common join sizes p on p.doc_id = x join sizes q on q.doc_id = y where 100 * c >= 80 * (p.n + q.n - c)),
both_ways as materialized (select x, y from links union all select y, x from links),
reach as (select doc_id as x, doc_id as y from sizes union select r.x, l.y from reach r join both_ways l on r.y = l.x),
least as (select x, min(y) as component_id from reach group by x)
select doc_id, n as n_shingles, component_id, doc_id = component_id as kept from sizes join least on doc_id = x"""


#: Nodes are named by the digests of all their turns' digests; each node is counted at all prefixes of its smallest member.
TRIE_SQL = r"""with turns as (
    select conv_id, role, txt, row_number() over (partition by conv_id order by turn nulls first, d) - 1 as pos, d
    from (select *, sha256(len(role) || ':' || role || ':' || txt) as d from (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as txt from conversations where conv_id is not null))),
convs as (select conv_id, conv_id - conv_id % 5 as head_id, xor(4294967295, list_reduce(list_prepend(4294967295::bigint,
    flatten(list_transform(string_split(conv_id::varchar, ''), lambda b: [ascii(b)::bigint, 0, 0, 0, 0, 0, 0, 0]))), lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1)))) % 9 as h from (select distinct conv_id from turns)),
heads as (select c.conv_id, c.head_id, c.h, least(c.h, count(t.conv_id)) as taken from convs c left join turns t on t.conv_id = c.head_id group by c.conv_id, c.head_id, c.h),
built as materialized (
    select c.conv_id, t.pos, t.txt, t.d from heads c join turns t on t.conv_id = c.head_id and t.pos < c.h
    union all select c.conv_id, t.pos - c.h + c.taken, t.txt, t.d from heads c join turns t on t.conv_id = c.conv_id and t.pos >= c.h),
named as materialized (
    select conv_id, pos + 1 as depth, strlen(txt) as n_bytes, sha256(string_agg(d, '') over (partition by conv_id order by pos)) as node,
        coalesce(sha256(string_agg(d, '') over (partition by conv_id order by pos rows between unbounded preceding and 1 preceding)), 'root') as parent from built
    union all select conv_id, 0, 0, 'root', null from convs),
nodes as materialized (select node, min(conv_id) as conv_id, min(depth) as depth, min(parent) as parent, min(n_bytes) as n_bytes, count(*) as n_convs from named group by node),
childs as (select parent, count(*) as n_children from nodes group by parent),
counted as materialized (select n.*, coalesce(n_children, 0) as n_children from nodes n left join childs c on c.parent = n.node),
sums as (select r.node, sum((n.n_children = 0)::int) as n_leaves, sum((n.n_convs - 1) * n.n_bytes) as saved_tokens from counted n join named r on r.conv_id = n.conv_id and r.depth <= n.depth group by r.node),
ends as (select node, string_agg(conv_id::varchar, ',' order by conv_id) as ids from (select conv_id, max_by(node, depth) as node from named group by conv_id) group by node)
select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n_convs, n.n_children, n_leaves::bigint as n_leaves, saved_tokens::bigint as saved_tokens, sha256(coalesce(ids, '')) as ends_sha256
from counted n join sums s on s.node = n.node left join counted p on p.node = n.parent left join ends e on e.node = n.node"""


def _clusters_sql(rounds: int = 3, k: int = 16, size: int = 64) -> str:
    """Every vector against every centroid, round by round."""
    parts = [
        f"""v as materialized (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v from embeddings
            where len(embedding) = {size} and len(list_filter(embedding, lambda x: isfinite(x))) = {size})""",
        f"c0 as materialized (select row_number() over (order by sha256('1:' || coalesce(vec_id::varchar, '')), v) - 1 as cluster, v as c from v qualify row_number() over (order by sha256('1:' || coalesce(vec_id::varchar, '')), v) <= {k})",
    ]
    for i in range(rounds + 1):
        parts.append(f"""a{i} as materialized (select r, vec_id, v, cluster, distance from (select *, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint as distance from v cross join c{i})
            qualify row_number() over (partition by r order by distance, cluster) = 1)""")
        if i < rounds:
            parts.append(f"""m{i} as (select cluster, j, sum(v[j])::bigint as s, count(*) as n from a{i} cross join range(1, {size + 1}) as t(j) group by all),
            f{i} as (select cluster, list((s - ((s % n) + n) % n) // n order by j) as c from m{i} group by cluster),
            c{i + 1} as materialized (select cluster, coalesce(f.c, o.c) as c from c{i} o left join f{i} f using (cluster))""")
    return f"""with {", ".join(parts)} select vec_id, cluster::int as cluster, distance, (sum(distance) over (partition by cluster))::bigint as cluster_inertia, (sum(distance) over ())::bigint as inertia,
        sha256(array_to_string(c, ',')) as centroid_sha256 from a{rounds} join c{rounds} using (cluster)"""


def _sharding_sql() -> str:
    slots = ", ".join(map(str, sharding.fill_table(SHARDS)))
    slot = f"(('0x' || substring(md5(coalesce(doc_id::varchar, '')), 1, 8))::bigint % {sharding.SIZE})::int"
    return f"""with s as (select doc_id, {slot} as slot from documents), t as (select *, [{slots}][slot + 1]::int as shard from s)
        select doc_id, slot, shard, printf('shard-%03d', shard) as shard_name from t"""


def _url_sql() -> str:
    rules = ", ".join(f"('{v}', '{h}', '{p}', '{h}{p}')" for v, h, p in URL_RULES)
    return f"""with r(verdict, rule_host, rule_path, rule) as (values {rules}),
        u as (select page_id, case when contains(url, '://') then substring(url, instr(url, '://') + 3) else '' end as rest from pages),
        p as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(substring(rest, len(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') as path from u),
        f as (select p.*, r.*, row_number() over (partition by page_id order by len(rule) desc nulls last) as k from p left join r on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path))
        select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from f where k = 1"""


def oracle_sql() -> dict[str, str]:
    out = {"op2_minhash": NEAR_SQL, "op3_sharding": _sharding_sql(), "op9_url_filters": _url_sql(), "op11_prefix_trie": TRIE_SQL, "op12_centroid_clustering": _clusters_sql()}
    return out | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
