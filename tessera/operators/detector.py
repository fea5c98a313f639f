"""The detector: a linear head on learned features, a tree head on spectral numbers, and their fusion.

Both heads are fitted without each fold in turn; the fusion learns from the log-odds that a clip
gets from heads fitted without its fold, and the operating points from the fused ones.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import learning, metrics, sampling
from tessera.sources.spectral import NAMES, SHORTCUTS
from tessera.sources.store import kept

FOLDS = 4
#: Fixed value: seconds of a clip that learned features cover.
LEARNED_S = 12.0


class Detector(NamedTuple):
    """The heads over the vector columns ``ssl`` and ``spec``, their fusion, and the thresholds of the operating points."""

    linear: PipelineModel
    tree: PipelineModel
    fusion: LogisticRegressionModel
    analyst: float
    as_coded: float
    default_score: float

    def logits(self, clips: DataFrame) -> DataFrame:
        """``clips`` with the log-odds of both heads."""
        return _logits(clips, self.linear, self.tree)

    def predict(self, clips: DataFrame) -> DataFrame:
        """``clips`` with linear_logit, tree_logit and probability."""
        rows = VectorAssembler(inputCols=["linear_logit", "tree_logit"], outputCol="_logits").transform(self.logits(clips))
        out = self.fusion.transform(rows).withColumn("_p", vector_to_array("probability")[1])
        return out.select(*clips.columns, "linear_logit", "tree_logit", F.col("_p").alias("probability"))

    def save(self, path: str) -> None:
        for name in ("linear", "tree", "fusion"):
            getattr(self, name).write().overwrite().save(f"{path}/{name}")
        spark = SparkSession.getActiveSession()
        spark.createDataFrame([tuple(self[3:])], "analyst double, as_coded double, default_score double").coalesce(1).write.mode("overwrite").json(f"{path}/points")

    @classmethod
    def load(cls, path: str) -> Detector:
        points = SparkSession.getActiveSession().read.schema("analyst double, as_coded double, default_score double").json(f"{path}/points").first()
        return cls(PipelineModel.load(f"{path}/linear"), PipelineModel.load(f"{path}/tree"), LogisticRegressionModel.load(f"{path}/fusion"), *points)


def _logits(clips: DataFrame, linear: PipelineModel, tree: PipelineModel) -> DataFrame:
    """Log-odds; those of the trees are twice their margin."""
    first = learning.log_odds(linear, clips, "linear_logit")
    second = tree.transform(first).withColumn("tree_logit", vector_to_array("rawPrediction")[1] * 2)
    return second.select(*clips.columns, "linear_logit", "tree_logit")


def fit_detector(train: DataFrame, clip: str = "clip", y: str = "y", system: str = "system", speaker: str = "speaker", source: str = "source", folds: int = FOLDS, at_once: int = 4, **trees: object) -> Detector:
    """A detector from clips (clip, y, system, speaker, source, ssl vector, spec vector).

    Clips weigh by their corpus' share of the class, and by generator within a corpus. Synthetic clips of one system, and real
    ones of one speaker, stay in one fold. The tree head never sees the numbers that tell how a clip was cut. Heads
    of all folds and the final ones are independent jobs, ``at_once`` of which run together over one written table.
    """
    group = F.when(F.col(y) == 1, F.concat(F.lit("system:"), system)).otherwise(F.concat(F.lit("speaker:"), speaker))
    rows = sampling.corpus_weights(train, y, system, source).withColumns({"group": group, y: F.col(y).cast("double")})
    dealt = kept(learning.grouped_folds(rows, "group", y, folds))
    k = int(dealt.agg(F.max("fold")).first()[0]) + 1
    heads = (lambda some: learning.linear_head(some, "ssl", y), lambda some: learning.tree_head(some, "spec", y, names=NAMES, exclude=SHORTCUTS, **trees))
    parts = [dealt.filter(F.col("fold") != i) for i in range(k)] + [dealt]
    with ThreadPoolExecutor(at_once) as pool:
        fits = [pool.submit(inheritable_thread_target(dealt.sparkSession)(head), part) for part in parts for head in heads]
        fitted = [f.result() for f in fits]
    pairs = list(zip(fitted[::2], fitted[1::2], strict=True))
    held = _logits(dealt.filter(F.col("fold") == 0), *pairs[0])
    for i in range(1, k):
        held = held.unionByName(_logits(dealt.filter(F.col("fold") == i), *pairs[i]))
    held = kept(held.select(clip, y, "weight", "linear_logit", "tree_logit"))
    fusion = learning.nonneg_fusion(held, ["linear_logit", "tree_logit"], y)
    vector = VectorAssembler(inputCols=["linear_logit", "tree_logit"], outputCol="_logits").transform(held)
    scored = fusion.transform(vector).select(F.col(y).cast("int").alias("y"), vector_to_array("probability")[1].alias("p"))
    points = metrics.operating_points(scored).first()
    return Detector(*pairs[-1], fusion, points["analyst"], points["as_coded"], points["default_score"])


def score_audio(files: DataFrame, detector: Detector, embeddings: DataFrame) -> DataFrame:
    """(filename, score, error, duration_s, truncated) of audio files (path, name, content).

    Spectral numbers are measured; learned features come from (filename, ssl vector) and cover the first ``LEARNED_S`` seconds: of
    longer clips ``truncated`` tells. A clip without either has the detector's default score and an error. Audio
    is decoded once and written.
    """
    from tessera.sources.audio import decoded
    from tessera.sources.spectral import RATE, spectral_vectors

    clips = kept(decoded(files))
    duration = F.round(F.size("samples") / RATE, 3)
    spec = spectral_vectors(clips, "path", "samples").withColumnRenamed("clip", "path")
    told = clips.select("path", "error", F.when(F.col("samples").isNotNull(), duration).alias("duration_s"))
    named = files.select("path", F.col("name").alias("filename")).join(told, "path")
    rows = kept(named.join(spec, "path").join(embeddings, "filename", "left").withColumn("truncated", F.coalesce(F.col("duration_s") > LEARNED_S, F.lit(False))))
    whole = F.col("spec").isNotNull() & F.col("ssl").isNotNull()
    there = rows.filter(whole).withColumn("spec", F.coalesce("spec", F.array().cast("array<float>")))
    good = detector.predict(there.withColumn("spec", learning.dense("spec"))).select("filename", F.col("probability").alias("score"), F.lit(None).cast("string").alias("error"), "duration_s", "truncated")
    bad = rows.filter(~whole).select("filename", F.lit(detector.default_score).alias("score"), F.coalesce("error", F.lit("no learned features")).alias("error"), "duration_s", "truncated")
    return good.unionByName(bad)


def score_directory(spark: SparkSession, root: str, detector: Detector, embeddings: DataFrame, out: str) -> int:
    """Scores every audio file below ``root`` (unique names, none hidden) into a table of scores at ``out``; the number of rows."""
    from tessera.sources.readers import audio_files, write_submission

    scores = score_audio(audio_files(spark, root, strict=True, content=True), detector, embeddings)
    return write_submission(scores.select("filename", "score"), out)
