"""Tables of the scoring domain, derived from the general test tables; each as a DataFrame and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scalar import lit


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(x, name: str):
    return F.round(x, 6).alias(name)


SCORED = """scored as (
    select d.doc_id as id, l.quality as y, concat('doc', d.doc_id) as filename,
        floor(((d.n_chars % 41) / 41e0 * 0.6e0 + case when (l.quality = 1) = (d.doc_id % 7 <> 0) then 0.35e0 else 0.05e0 end) * 50e0) / 50e0 as p
    from documents d join labels l on d.doc_id = l.doc_id)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with many ties for labelled documents: quality 1 stands for spoof."""
    d, labels = table(spark, sf_dir, "documents").select("doc_id", "n_chars"), table(spark, sf_dir, "labels")
    lean = F.when((F.col("quality") == 1) == (F.col("doc_id") % 7 != 0), lit(0.35)).otherwise(lit(0.05))
    p = F.floor(((F.col("n_chars") % 41) / lit(41) * lit(0.6) + lean) * lit(50)) / lit(50)
    return d.join(labels, "doc_id").select(F.col("doc_id").alias("id"), F.col("quality").alias("y"), F.concat(F.lit("doc"), "doc_id").alias("filename"), p.alias("p"))


MANIFEST = """manifest as (
    select d.doc_id as uid, d.lang as source, d.source as system, coalesce(l.quality, -1) as label
    from documents d left join labels l on d.doc_id = l.doc_id)"""


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, labels = table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    return d.join(labels, "doc_id", "left").select(F.col("doc_id").alias("uid"), F.col("lang").alias("source"), F.col("source").alias("system"), F.coalesce("quality", F.lit(-1)).alias("label"))


EXPERTS = ["spectral", "compression", "prosody", "environment", "splice", "speaker", "deep"]
FEATURES = """features as (
    select clip, expert, feature, case when bad = 0 then null when bad = 1 then 'nan'::double else value end as value from (
        select l_orderkey as clip, ['spectral', 'compression', 'prosody', 'environment', 'splice', 'speaker', 'deep'][l_linenumber] as expert,
            unnest(['quantity', 'price', 'discount']) as feature, unnest([l_quantity, l_extendedprice, l_discount]) as value, l_partkey % 17 as bad
        from lineitem) t)"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(clip, expert, feature, value), one expert for each order line, some values null or NaN."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("clip"), F.element_at(F.array(*map(F.lit, EXPERTS)), F.col("l_linenumber")).alias("expert"), (F.col("l_partkey") % 17).alias("bad"),
        F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), F.col(c).alias("value")) for n, c in (("quantity", "l_quantity"), ("price", "l_extendedprice"), ("discount", "l_discount"))))).alias("f"),
    )
    value = F.when(F.col("bad") == 0, None).when(F.col("bad") == 1, lit(float("nan"))).otherwise(F.col("f.value"))
    return rows.select("clip", "expert", "f.feature", value.alias("value"))


def wide_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``features`` with a column for each, a row for each order line."""
    bad = F.col("l_partkey") % 17
    value = lambda c: F.when(bad == 0, None).when(bad == 1, lit(float("nan"))).otherwise(F.col(c))
    expert = F.element_at(F.array(*map(F.lit, EXPERTS)), F.col("l_linenumber"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("clip"), expert.alias("expert"), *(value(c).alias(n) for n, c in (("quantity", "l_quantity"), ("price", "l_extendedprice"), ("discount", "l_discount"))))


_MODEL = [(e, f, m + i, s + i, c * (1 if i % 2 else -1), m, s / 2) for i, e in enumerate(EXPERTS[:6]) for f, m, s, c in (("quantity", 25.0, 14.0, 0.5), ("price", 30000.0, 0.0 if i == 5 else 20000.0, 0.8))]
_INTERCEPTS = [(e, 0.1 * i - 0.2) for i, e in enumerate(EXPERTS[:6])]
#: The shipped fusion weights and bias.
WEIGHTS = {"compression": 1.3344, "environment": 0.141, "prosody": 1.4542, "speaker": 0.8446, "spectral": 1.0338, "splice": 1.023, "container": 1.0, "deep": 1.0}
BIAS = -0.11040245617622751
#: The AUC of each expert in cross-validation.
AUCS = {"spectral": 0.6507, "compression": 0.5585, "prosody": 0.7159, "environment": 0.5971, "splice": 0.6130, "speaker": 0.5541}


def _values(name: str, columns: list[str], rows: list[tuple]) -> str:
    show = lambda v: f"'{v}'" if isinstance(v, str) else f"{v!r}::double"
    return f"{name}({', '.join(columns)}) as (values {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)})"


MODEL_SQL = _values("model", ["expert", "feature", "mean", "scale", "coef", "real_median", "real_spread"], _MODEL)
INTERCEPTS_SQL = _values("intercepts", ["expert", "intercept"], _INTERCEPTS)
WEIGHTS_SQL = _values("weights", ["expert", "weight"], list(WEIGHTS.items()))


def _small(spark: SparkSession, columns: list[str], rows: list[tuple]) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*(F.struct(*(F.lit(v).alias(c) for c, v in zip(columns, r, strict=True))) for r in rows))).alias("r")).select("r.*")


def model(spark: SparkSession) -> DataFrame:
    return _small(spark, ["expert", "feature", "mean", "scale", "coef", "real_median", "real_spread"], _MODEL)


def intercepts(spark: SparkSession) -> DataFrame:
    return _small(spark, ["expert", "intercept"], _INTERCEPTS)


def weights(spark: SparkSession) -> DataFrame:
    return _small(spark, ["expert", "weight"], list(WEIGHTS.items()))


FINDINGS = f"""{FEATURES}, {MODEL_SQL}, {INTERCEPTS_SQL}, {WEIGHTS_SQL},
fine as (select clip, expert, feature, case when isfinite(value) then value end as value from features),
sums as (
    select f.clip, f.expert, coalesce(sum(case when f.value is not null then m.coef * greatest(-6e0, least(6e0, (f.value - m.mean) / case when m.scale = 0 then 1e0 else m.scale end)) end), 0) as total, count(f.value) as n
    from fine f left join model m on f.expert = m.expert and f.feature = m.feature group by all),
scores as (
    select s.clip, s.expert, case when n > 0 and i.intercept is not null then 1 / (1 + exp(-greatest(-40e0, least(40e0, i.intercept + total)))) end as score
    from sums s left join intercepts i on s.expert = i.expert),
info as (
    select l_orderkey as clip, ['spectral', 'compression', 'prosody', 'environment', 'splice', 'speaker', 'deep'][l_linenumber] as expert,
        max(l_tax * 15 - 0.1e0) as confidence, max(case when l_suppkey % 2 = 0 then 'wavlm-xvector' else 'mfcc-stats' end) as backend
    from lineitem group by all),
found as (
    select s.clip, s.expert, case when s.expert = 'speaker' and backend <> 'wavlm-xvector' then null else score end as score,
        case when s.expert = 'speaker' and backend <> 'wavlm-xvector' then 0e0 else least(1e0, greatest(0e0, confidence)) end as confidence
    from scores s join info i on s.clip = i.clip and s.expert = i.expert)"""


def info(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    expert = F.element_at(F.array(*map(F.lit, EXPERTS)), F.col("l_linenumber")).alias("expert")
    backend = F.when(F.col("l_suppkey") % 2 == 0, "wavlm-xvector").otherwise("mfcc-stats")
    return rows.groupBy(F.col("l_orderkey").alias("clip"), expert).agg(F.max(F.col("l_tax") * 15 - lit(0.1)).alias("confidence"), F.max(backend).alias("backend"))
