"""Queries of single-step operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import scalar as S
from tessera.functions.wording import describe_feature
from tessera.operators import sampling
from tessera.operators.running import percentiles
from tessera.plans import surrogates as T
from tessera.sources.readers import join_protocol, protocol_fields


def score_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clip's score from the table, or nothing with no confidence."""
    d, s = T.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), T.scored(spark, sf_dir).select("id", "p")
    return d.join(s, "id", "left").select("id", T.r6("p", "score"), F.when(F.col("p").isNull(), S.lit(0)).otherwise(S.lit(1)).alias("confidence"))


def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, s = T.table(spark, sf_dir, "documents"), T.table(spark, sf_dir, "labels")
    return d.select("doc_id").exceptAll(s.select("doc_id"))


def band_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = T.table(spark, sf_dir, "lineitem")
    hit = S.band_limited(F.col("l_extendedprice") / 10, F.col("l_quantity"), S.lit(16000))
    return o.groupBy("l_returnflag").agg(F.count_if(hit).alias("limited"), F.count("*").alias("n"))


def strongest_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block of eight numbers with the largest absolute sum, the first of several."""
    e = T.table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    layers = e.groupBy("vec_id", F.floor(F.col("i") / 8).alias("layer")).agg(F.round(F.sum(F.col("x").cast("double")), 5).alias("total"))
    return layers.groupBy("vec_id").agg(F.max_by("layer", F.struct(F.abs("total"), -F.col("layer"))).alias("layer"))


def topk_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.abs("x").desc(), "i"))
    return e.withColumn("rank", rank).filter("rank <= 5").select("vec_id", "rank", "i")


def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings as JSON; missing and non-finite numbers become null."""
    f = T.features(spark, sf_dir)
    value = F.coalesce(F.format_string("%.2f", S.finite(F.col("value"))).alias("v"), F.lit("null"))
    cell = F.concat(F.lit('"'), "feature", F.lit('": '), F.when(S.finite(F.col("value")).isNull(), "null").otherwise(value))
    return f.groupBy("clip", "expert").agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_set(cell)), ", "), F.lit("}")).alias("json"))


def metric_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators.metrics import summary

    return summary(T.scored(spark, sf_dir)).select(F.format_string("minDCF %.3f EER %.1f%% AUC %.3f", "min_dcf_nsa", F.col("eer") * 100, "auc").alias("text"))


def protocol_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips with attack and label from the lines of a protocol: all real ones and a share of the fakes, by the digest of their id."""
    labels = T.table(spark, sf_dir, "labels")
    line = F.concat_ws(" ", F.lit("LA_1"), "doc_id", F.lit("-"), F.concat(F.lit("A"), F.col("doc_id") % 19), F.when(F.col("quality") == 1, "spoof").otherwise("bonafide"))
    protocol = protocol_fields(labels.select(line.alias("line")), "line")
    clips = T.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("uid"), "source").join(labels.select(F.col("doc_id").cast("string").alias("uid")), "uid", "left_semi")
    share = F.substring(sampling.draw_order(F.col("uid"), 3), 1, 1)
    return join_protocol(clips, protocol).filter((F.col("label") == 0) | share.isin("0", "1")).select("uid", "source", "attack", "label")


def column_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, deviation, median and robust spread of each expert's features over finite values."""
    f = T.features(spark, sf_dir).withColumn("value", S.finite(F.col("value")))
    q = percentiles(f, "value", {"q1": 0.25, "q2": 0.5, "q3": 0.75}, ["expert", "feature"])
    out = f.groupBy("expert", "feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("scale")).join(q, ["expert", "feature"], "left")
    return out.select("expert", "feature", F.round("mean", 4).alias("mean"), F.round("scale", 4).alias("scale"), F.round("q2", 4).alias("median"), F.round((F.col("q3") - F.col("q1")) / S.lit(1.349), 4).alias("spread"))


def finite_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = T.features(spark, sf_dir)
    return f.groupBy("expert").agg(F.count("*").alias("n"), F.count_if(S.finite(F.col("value")).isNull()).alias("not_finite"))


def feature_wording(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain words for names of spectral numbers, one for each order line."""
    k = F.col("l_linenumber")
    name = F.element_at(F.array(F.concat(F.lit("lfcc"), k, F.lit("_mean")), F.concat(F.lit("lfcc"), k, F.lit("_std")), F.concat(F.lit("dlfcc"), k, F.lit("_std")), F.concat(F.lit("band_"), k * 1000, F.lit("_"), k * 1000 + 1000, F.lit("_mean")), F.lit("pause_ratio"), F.lit("unknown")), (F.col("l_partkey") % 6 + 1).cast("int"))
    return T.table(spark, sf_dir, "lineitem").select(describe_feature(name).alias("words")).groupBy("words").agg(F.count("*").alias("n"))


def spaced_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where up to three windows of 64,600 samples begin, for clips as long as a text at 60 samples a character."""
    n = F.col("n_chars") * 60
    return T.table(spark, sf_dir, "documents").select("doc_id", F.array_join(S.spaced_windows(n), ",").alias("starts"))


def per_generator_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All real clips and at most five fakes of each generator."""
    m = T.manifest(spark, sf_dir).filter("label >= 0")
    return sampling.capped_sample(m, None, 5, 13).groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("system").alias("systems"))


def capped_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list behind ``per_generator_cap``: every real clip, and each generator's first five fakes in the draw order."""
    return sampling.capped_sample(T.manifest(spark, sf_dir).filter("label >= 0"), None, 5, 13).select("uid", "system", "label", "source")


def seam_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest and mean step between successive pauses' mean values, for each user's low-value runs of two or more events."""
    e = T.table(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = e.select("user_id", "value", "ts", "event_id", F.row_number().over(order).alias("i"))
    level = e.agg(F.avg("value").alias("level"))
    quiet = rows.join(F.broadcast(level), how="cross").filter("value < level").withColumn("island", F.col("i") - F.row_number().over(Window.partitionBy("user_id").orderBy("i")))
    pauses = quiet.groupBy("user_id", "island").agg(F.avg("value").alias("mean"), F.min("i").alias("i"), F.count("*").alias("n")).filter("n >= 2")
    step = F.abs(F.col("mean") - F.lag("mean").over(Window.partitionBy("user_id").orderBy("i")))
    return pauses.withColumn("step", step).groupBy("user_id").agg(F.round(F.max("step"), 3).alias("most"), F.round(F.avg("step"), 3).alias("mean"))


QUERIES = {f.__name__: f for f in (score_lookup, set_difference, band_limited, strongest_layer, topk_contributions, report_json, metric_text, protocol_join, column_stats, finite_check, feature_wording, per_generator_cap, capped_files, seam_steps, spaced_windows)}
_RATES = f"""{T.SCORED}, total as (select sum(y) as n1, count(*) - sum(y) as n0 from scored), counts as (select p, sum(y) as a, count(*) - sum(y) as b from scored group by p),
    rates as (select p, sum(a) over w / n1 as miss, 1 - sum(b) over w / n0 as flag from counts, total window w as (order by p rows unbounded preceding) union all select null, 0, 1),
    ranks as (select sum(a * (coalesce(below, 0) + b / 2e0)) / max(n1 * n0) as auc from (select *, sum(b) over (order by p rows between unbounded preceding and 1 preceding) as below from counts), total)"""
SQL = {
    "score_lookup": f"with {T.SCORED} select d.doc_id as id, round(p, 6) as score, case when p is null then 0e0 else 1e0 end as confidence from documents d left join scored s on d.doc_id = s.id",
    "set_difference": "select doc_id from documents except all select doc_id from labels",
    "band_limited": "select l_returnflag, count(*) filter (l_extendedprice / 10 < 0.97e0 * 16000 / 2 and l_quantity > 25) as limited, count(*) as n from lineitem group by 1",
    "strongest_layer": """with x as (select vec_id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as i from embeddings), l as (select vec_id, (i // 8)::bigint as layer, round(sum(x), 5) as total from x group by all)
        select vec_id, layer from (select *, row_number() over (partition by vec_id order by abs(total) desc, layer) as r from l) where r = 1""",
    "topk_contributions": """with x as (select vec_id, unnest(embedding) as x, (generate_subscripts(embedding, 1) - 1)::int as i from embeddings), k as (select *, row_number() over (partition by vec_id order by abs(x) desc, i) as rank from x)
        select vec_id, rank, i from k where rank <= 5""",
    "report_json": f"""with {T.FEATURES}, c as (select distinct clip, expert, concat('"', feature, '": ', case when isfinite(value) then printf('%.2f', value) else 'null' end) as cell from features)
        select clip, expert, concat('{{', string_agg(cell, ', ' order by cell), '}}') as json from c group by all""",
    "metric_text": f"with {_RATES} select printf('minDCF %.3f EER %.1f%% AUC %.3f', round(least(min((miss * 0.5e0 + 4 * flag * 0.5e0) / 0.5e0), 1), 4), round((select (miss + flag) / 2 from rates order by abs(miss - flag), p nulls first limit 1), 4) * 100, round((select auc from ranks), 4)) as text from rates",
    "protocol_join": """select d.doc_id::varchar as uid, d.source, concat('A', d.doc_id % 19) as attack, l.quality as label from documents d join labels l on d.doc_id = l.doc_id
        where l.quality = 0 or substring(md5(concat(d.doc_id, ':3')), 1, 1) in ('0', '1')""",
    "spaced_windows": """with c as (select doc_id, n_chars * 60 as n from documents), k as (select *, least(3, ceil(n / 64600.0))::int as c from c)
        select doc_id, case when n > 1920000 then null when n < 64600 then '0' else array_to_string([floor(i * ((n - 64600)::double / greatest(c - 1, 1)))::bigint for i in range(0, c)], ',') end as starts from k""",
    "column_stats": f"""with {T.FEATURES}, f as (select expert, feature, case when isfinite(value) then value end as v from features)
        select expert, feature, round(avg(v), 4) as mean, round(stddev_pop(v), 4) as scale, round(median(v), 4) as median, round((quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / 1.349e0, 4) as spread from f group by all""",
    "finite_check": f"with {T.FEATURES} select expert, count(*) as n, count(*) filter (value is null or not isfinite(value)) as not_finite from features group by expert",
    "feature_wording": """with k as (select l_linenumber as k, l_partkey % 6 as kind from lineitem), w as (select case kind
        when 0 then concat('average of cepstral coefficient ', k, ' (spectral envelope detail)') when 1 then concat('variation over time of cepstral coefficient ', k, ' (spectral envelope detail)')
        when 2 then concat('frame-to-frame jitter of cepstral coefficient ', k, ' (spectral envelope detail)') when 3 then concat('share of energy in the ', k * 1000, '-', k * 1000 + 1000, ' Hz band')
        when 4 then 'fraction of frames that are pauses or near-silence' else 'unknown' end as words from k) select words, count(*) as n from w group by words""",
    "capped_files": f"with {T.MANIFEST}, k as (select *, row_number() over (partition by label, system order by md5(concat(uid, ':13')), uid) as r from manifest where label >= 0) select uid, system, label, source from k where label = 0 or r <= 5",
    "per_generator_cap": f"with {T.MANIFEST}, k as (select *, row_number() over (partition by label, system order by md5(concat(uid, ':13')), uid) as r from manifest where label >= 0) select label, count(*) as n, count(distinct system) as systems from k where label = 0 or r <= 5 group by label",
    "seam_steps": """with r as (select user_id, value, row_number() over (partition by user_id order by ts, event_id) as i from events), q as (select *, i - row_number() over (partition by user_id order by i) as island from r where value < (select avg(value) from events)),
        p as (select user_id, island, avg(value) as m, min(i) as i from q group by all having count(*) >= 2), s as (select user_id, abs(m - lag(m) over (partition by user_id order by i)) as step from p)
        select user_id, round(max(step), 3) as most, round(avg(step), 3) as mean from s group by user_id""",
}
