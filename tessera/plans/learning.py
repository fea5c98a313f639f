"""Queries that fit models; embeddings stand for a clip's learned features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import learning as L
from tessera.operators import metrics as M
from tessera.plans import surrogates as T
from tessera.sources import spectral


def _clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), (F.col("label") % 2).cast("double").alias("y"), F.lit(1.0).alias("weight"), L.dense("embedding").alias("x"))


def fit_linear_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC of the linear head on every fifth clip, fitted on the others."""
    clips = _clips(spark, sf_dir)
    model = L.linear_head(clips.filter("id % 5 != 0"), "x")
    held = L.log_odds(model, clips.filter("id % 5 = 0"), "p")
    return M.auc(M.score_counts(held))


def fit_nonneg_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = T.scored(spark, sf_dir).select(F.col("y").cast("double").alias("y"), F.lit(1.0).alias("weight"), (F.col("p") * 4 - 2).alias("good"), (2 - F.col("p") * 4 + F.col("id") % 3).alias("bad"))
    model = L.nonneg_fusion(s, ["good", "bad"])
    return spark.createDataFrame([(float(model.coefficients[0]), float(model.coefficients[1]), float(model.intercept))], "good double, bad double, bias double")


def grouped_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.grouped_folds(T.scored(spark, sf_dir).withColumn("grp", F.col("id") - F.col("id") % 3), "grp", "y").select("id", "fold")


def spectral_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spectral numbers of repeated embeddings taken as samples."""
    e = T.table(spark, sf_dir, "embeddings")
    tone = F.flatten(F.array_repeat(F.col("embedding"), 20))
    return spectral.spectral_vectors(e.select("vec_id", tone.alias("x")), "vec_id", "x").select("clip", F.transform("spec", lambda v: F.round(v, 3)).alias("spec"))


def power_spectrogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean power of each frequency of repeated embeddings taken as samples."""
    e = T.table(spark, sf_dir, "embeddings").select("vec_id", F.flatten(F.array_repeat(F.col("embedding"), 5)).alias("x"))
    frames = spectral.power_spectrogram(e, "vec_id", "x", 64, 20)
    bins = frames.select("clip", F.posexplode("power").alias("bin", "power"))
    return bins.groupBy(F.col("clip").alias("vec_id"), "bin").agg(T.r6(F.avg("power") * 1000, "mean_power"), F.count("*").alias("n_frames"))


QUERIES = {f.__name__: f for f in (fit_linear_head, fit_nonneg_fusion, grouped_folds, spectral_vector, power_spectrogram)}
SQL = {
    # the sums of a Fourier transform, written out
    "power_spectrogram": """with x as (select vec_id, unnest(embedding)::double as v, unnest(range(64)) as j from embeddings where len(embedding) = 64),
        f as (select vec_id, frame, k, bin, v * pow(sin(pi() * k / 64), 2) / 32e0 as v from x, range(13) t(frame), range(33) u(bin), lateral (select (j - frame * 20 % 64 + 64) % 64 as k)),
        p as (select vec_id, frame, bin, pow(sum(v * cos(2 * pi() * bin * k / 64)), 2) + pow(sum(v * sin(2 * pi() * bin * k / 64)), 2) + 1e-14 as power from f group by all)
        select vec_id, bin::int as bin, round(avg(power) * 1000, 6) as mean_power, count(*) as n_frames from p group by all""",
    "grouped_folds": f"""with {T.SCORED}, g as (select id - id % 3 as grp, max(y) as y from scored group by 1), n as (select least(5, min(c)) as k from (select count(*) as c from g group by y)),
        r as (select grp, row_number() over (order by y, substring(md5(grp::varchar), 1, 12), grp) as r from g)
        select id, (r.r % k)::bigint as fold from scored s join r on s.id - s.id % 3 = r.grp, n""",
}
