"""Queries over ordered rows of a clip; a user's events in time order stand for a clip's frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import scalar as S
from tessera.operators import sequence as Q
from tessera.plans import surrogates as T

FRAMES = """frames as (select user_id as clip, row_number() over (partition by user_id order by ts, event_id) - 1 as frame, value as db, event_type from events)"""
THRESHOLD = """t as (select clip, greatest(quantile_cont(db, 0.95) - 25, quantile_cont(db, 0.10) + 8) as threshold from frames group by clip),
loud as (select f.*, (db > threshold)::int as loud from frames f join t on f.clip = t.clip),
mask as (select *, sum(loud) over (partition by clip order by frame rows between 2 preceding and 2 following) > 2 as speech from loud)"""


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.table(spark, sf_dir, "events")
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(F.col("user_id").alias("clip"), i.alias("frame"), F.col("value").alias("db"), "event_type")


def frame_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.frame_levels(_frames(spark, sf_dir), "clip", "frame", "db", 10, 4).select("clip", "frame", F.round("db", 5).alias("db"))


LEVELS = f"""with {FRAMES}, g as (select clip, frame // 4 as f, avg(db * db) over w as power, count(*) over w as n, frame from frames window w as (partition by clip order by frame rows between current row and 9 following))
select clip, f::bigint as frame, round(10 * log10(power + 1e-12), 5) as db from g where frame % 4 = 0 and n = 10"""


def speech_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.speech_mask(_frames(spark, sf_dir)).select("clip", "frame", "speech")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.runs(Q.speech_mask(_frames(spark, sf_dir)), "clip", "frame", "speech")


def level_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.level_jumps(Q.speech_mask(_frames(spark, sf_dir)), "clip", "frame", "db", "speech").select("clip", T.r6("level_jump_db", "level_jump_db"))


def speech_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of ten frames every five with enough speech, at most eight a clip, spread evenly."""
    m = Q.speech_mask(_frames(spark, sf_dir))
    start = F.explode(F.filter(F.array(F.floor(F.col("frame") / 5) * 5, F.floor(F.col("frame") / 5) * 5 - 5), lambda s: s >= 0))
    w = m.select("clip", start.alias("start"), F.col("speech").cast("int").alias("s")).groupBy("clip", "start").agg(F.sum("s").alias("s"), F.count("*").alias("n"))
    return Q.spread_pick(w.filter("n = 10 and s >= 4").select("clip", "start"), "clip", "start", 8)


WINDOWS = f"""with {FRAMES}, {THRESHOLD}, w as (
    select clip, start, sum(s) as s, count(*) as n from (select clip, unnest([frame // 5 * 5, frame // 5 * 5 - 5]) as start, speech::int as s from mask) where start >= 0 group by all),
r as (select clip, start::bigint as start, row_number() over (partition by clip order by start) - 1 as r, count(*) over (partition by clip) as n from w where n = 10 and s >= 4),
p as (select unnest(range(8)) as j)
select clip, start from r where n <= 8 or exists (select 1 from p where round_even(j * (n - 1) / 7e0, 0) = r)"""


def speaker_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.table(spark, sf_dir, "embeddings")
    out = Q.speaker_consistency(e, "label", "vec_id", "embedding", 64)
    return out.select("clip", "n", *(F.round(c, 5).alias(c) for c in ("sim_mean", "sim_min", "adjacent_min", "sim_std")), F.round("drift", 7).alias("drift"))


CONSISTENCY = """with v as (select label as clip, vec_id, embedding::double[] as e from embeddings),
flat as (select clip, vec_id, unnest(e) as x, generate_subscripts(e, 1) as j from v),
c as (select clip, list(x order by j) as c from (select clip, j, avg(x) as x from flat group by all) group by clip),
f as (select clip, arg_min(e, vec_id) as f, count(*) as n from v group by clip),
s as (select v.clip, n, vec_id, list_cosine_similarity(e, c) as a, list_cosine_similarity(e, lag(e) over (partition by v.clip order by vec_id)) as b, list_cosine_similarity(e, f) as g from v join c on v.clip = c.clip join f on v.clip = f.clip)
select clip, n, round(avg(a), 5) as sim_mean, round(min(a), 5) as sim_min, round(min(b), 5) as adjacent_min, round(stddev_pop(a), 5) as sim_std, round(-regr_slope(g, vec_id), 7) as drift from s group by clip, n"""


def layer_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 numbers as four layers of two statistics of eight; two layers chosen and flattened."""
    e = T.table(spark, sf_dir, "embeddings")
    flat = F.concat(F.slice("embedding", 17, 16), F.slice("embedding", 49, 16))
    return e.select("vec_id", F.size(flat).alias("n"), F.round(F.aggregate(flat, S.lit(0), lambda a, x: a + x.cast("double")), 5).alias("total"))


def fixed_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frozen two-feature head over a probability and a mean margin."""
    s = T.scored(spark, sf_dir)
    z = S.lit(0.27019) * S.logit(F.col("p"), 1e-6) + S.lit(0.15065) * ((F.col("id") % 9).cast("double") - 4) + S.lit(-0.71863) - S.lit(0.92125)
    return s.select("id", T.r6(S.sigmoid(z), "score"))


def peak_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.table(spark, sf_dir, "embeddings")
    x = S.peak_normalize(F.transform("embedding", lambda v: v.cast("double")))
    return e.select("vec_id", T.r6(F.array_max(F.transform(x, lambda v: F.abs(v))), "peak"), F.round(F.aggregate(x, S.lit(0), lambda a, v: a + v), 4).alias("total"))


def crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.table(spark, sf_dir, "embeddings")
    start = (F.col("vec_id") % 49 + 1).cast("int")
    return e.select("vec_id", T.r6(F.slice("embedding", start, F.lit(16))[0].cast("double"), "first"), F.size(F.slice("embedding", start, F.lit(16))).alias("n"))


def mask_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speech frames of each clip's mask, cut or padded with false to 50 frames."""
    m = Q.speech_mask(_frames(spark, sf_dir)).filter("frame < 50")
    return m.groupBy("clip").agg(F.sum(F.col("speech").cast("long")).alias("speech"), F.greatest(F.lit(50) - F.count("*"), F.lit(0).cast("long")).alias("padded"))


def band_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.size(F.filter("embedding", lambda f: (f >= 0) & (f < 1))).alias("n"))


QUERIES = {f.__name__: f for f in (frame_levels, speech_mask, runs, level_jumps, speech_windows, speaker_consistency, layer_flatten, fixed_head, peak_normalize, crop, mask_align, band_mask)}
SQL = {
    "frame_levels": LEVELS,
    "speech_mask": f"with {FRAMES}, {THRESHOLD} select clip, frame, speech from mask",
    "runs": f"""with {FRAMES}, {THRESHOLD}, k as (select clip, frame, frame - row_number() over (partition by clip order by frame) as island from mask where speech)
        select clip, min(frame) as first, max(frame) + 1 as "end" from k group by clip, island""",
    "level_jumps": f"""with {FRAMES}, {THRESHOLD}, k as (select clip, case when speech and lag(speech) over w then abs(db - lag(db) over w) end as step from mask window w as (partition by clip order by frame))
        select clip, round(max(step), 6) as level_jump_db from k group by clip""",
    "speech_windows": WINDOWS,
    "speaker_consistency": CONSISTENCY,
    "layer_flatten": "select vec_id, 32 as n, round(list_sum(list_concat(embedding[17:32], embedding[49:64])::double[]), 5) as total from embeddings",
    "fixed_head": f"with {T.SCORED}, q as (select id, greatest(1e-6, least(1 - 1e-6, p)) as c from scored) select id, round(1 / (1 + exp(-(0.27019e0 * ln(c / (1 - c)) + 0.15065e0 * (id % 9 - 4) - 0.71863e0 - 0.92125e0))), 6) as score from q",
    "peak_normalize": """with v as (select vec_id, embedding::double[] as e, list_max(list_transform(embedding::double[], lambda x: abs(x))) as top from embeddings)
        select vec_id, round(case when top < 1e-9 then top else 0.95e0 end, 6) as peak, round(list_sum(e) * case when top < 1e-9 then 1 else 0.95e0 / top end, 4) as total from v""",
    "crop": "select vec_id, round(embedding[vec_id % 49 + 1]::double, 6) as first, 16 as n from embeddings",
    "mask_align": f"with {FRAMES}, {THRESHOLD} select clip, sum(speech::int)::bigint as speech, greatest(50 - count(*), 0) as padded from mask where frame < 50 group by clip",
    "band_mask": "select vec_id, len(list_filter(embedding, lambda f: f >= 0 and f < 1))::int as n from embeddings",
}
