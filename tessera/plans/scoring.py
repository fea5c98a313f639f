"""Queries of the scoring core and its contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalar as S
from tessera.operators import coverage as C
from tessera.operators import metrics as M
from tessera.operators.running import percentiles
from tessera.plans import surrogates as T

CURVE = f"""{T.SCORED}, total as (select sum(y) as n1, count(*) - sum(y) as n0, min(p) as least from scored),
curve as (
    select p as threshold, sum(y) over w / n1 as frr, (n0 - (count(*) over w - sum(y) over w)) / n0 as far, count(*) over w as rank
    from scored, total window w as (order by p, y desc, id rows unbounded preceding)
    union all select least - 0.001e0, 0, 1, 0 from total)"""
RATES = f"""{T.SCORED}, total as (select sum(y) as n1, count(*) - sum(y) as n0 from scored),
counts as (select p, sum(y) as a, count(*) - sum(y) as b from scored group by p),
rates as (
    select p as threshold, sum(a) over w / n1 as miss, 1 - sum(b) over w / n0 as flag from counts, total window w as (order by p rows unbounded preceding)
    union all select null, 0, 1),
ranks as (select sum(a * (coalesce(below, 0) + b / 2e0)) / max(n1 * n0) as auc from (select *, sum(b) over (order by p rows between unbounded preceding and 1 preceding) as below from counts), total)"""


def detection_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = M.detection_metrics(T.scored(spark, sf_dir))
    return m.select(T.r6("min_dcf", "min_dcf"), T.r6("min_dcf_as_coded", "min_dcf_as_coded"), T.r6("eer", "eer"), T.r6("auc", "auc"), "n_spoof", "n_bonafide", "p_spoof", "c_miss", "c_fa")


DETECTION = f"""with {CURVE}, r as (
    select sum(a * (coalesce(below, 0) + b / 2e0)) as wins from (
        select *, sum(b) over (order by p rows between unbounded preceding and 1 preceding) as below from (select p, sum(y) as a, count(*) - sum(y) as b from scored group by p)))
select round(min((frr * 0.5e0 + 4 * far * 0.5e0) / 0.5e0), 6) as min_dcf, round(min((4 * frr * 0.5e0 + far * 0.5e0) / 0.5e0), 6) as min_dcf_as_coded,
    round((select (frr + far) / 2 from curve order by abs(frr - far), rank limit 1), 6) as eer, round((select max(wins / (n1 * n0)) from r, total), 6) as auc,
    (select n1::bigint from total) as n_spoof, (select n0::bigint from total) as n_bonafide, 0.5e0 as p_spoof, 1e0 as c_miss, 4e0 as c_fa from curve"""


def det_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.det_curve(T.scored(spark, sf_dir)).select(T.r6("threshold", "threshold"), T.r6("frr", "frr"), T.r6("far", "far"), "rank")


def rates_tie_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.tie_rates(T.scored(spark, sf_dir)).select(T.r6("threshold", "threshold"), T.r6("miss", "miss"), T.r6("flag", "flag"))


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.summary(T.scored(spark, sf_dir))


def min_dcf_prior_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = M.tie_rates(T.scored(spark, sf_dir))
    priors = [0.1, 0.3, 0.5, 0.8]
    out = rates.agg(*(F.min(M.cost(F.col("miss"), F.col("flag"), p, four)).alias(f"{'a' if four else 'c'}{i}") for i, p in enumerate(priors) for four in (True, False)))
    rows = F.explode(F.array(*(F.struct(S.lit(p).alias("p_spoof"), F.round(F.col(f"a{i}"), 6).alias("analyst"), F.round(F.col(f"c{i}"), 6).alias("as_coded")) for i, p in enumerate(priors))))
    return out.select(rows.alias("r")).select("r.*")


def eer_two_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = T.scored(spark, sf_dir)
    curve, rates = M.det_curve(s), M.tie_rates(s)
    a = curve.agg(M.eer_of(curve, "frr", "far", F.col("rank")).alias("x"))
    return a.join(rates.agg(M.eer_of(rates, "miss", "flag", F.col("threshold")).alias("y")), how="cross").select(T.r6("x", "eer_curve"), T.r6("y", "eer_tied"))


def operating_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.operating_points(T.scored(spark, sf_dir)).select(T.r6("analyst", "analyst"), T.r6("as_coded", "as_coded"), T.r6("default_score", "default_score"))


OPERATING = f"""with {T.SCORED}, cand as (select distinct p from scored union select 0 union select 1.000000001e0),
c as (
    select cand.p, avg(case when s.y = 1 then (s.p < cand.p)::int end) as miss, avg(case when s.y = 0 then (s.p >= cand.p)::int end) as fa
    from cand, scored s group by cand.p),
b as (
    select (select p from c order by round(miss + 4 * fa, 12), p limit 1) as analyst, (select p from c order by round(4 * miss + fa, 12), p limit 1) as as_coded),
k as (select *, greatest(1e-4, least(1 - 1e-4, analyst)) as u, greatest(1e-4, least(1 - 1e-4, as_coded)) as v from b)
select round(analyst, 6) as analyst, round(as_coded, 6) as as_coded, round(1 / (1 + exp(-(ln(u / (1 - u)) + ln(v / (1 - v))) / 2)), 6) as default_score from k"""


def metric_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC of each system's fake clips against all real clips: one grouped pass, real counts joined in by score."""
    systems = T.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("system"))
    s = T.scored(spark, sf_dir)
    real = M.running_sums(M.score_counts(s), "p", [], {"c0": "n0"}).select("p", "n0", "c0")
    fake = s.filter("y = 1").join(systems, "id").groupBy("system", "p").agg(F.count("*").alias("n1"))
    wins = fake.join(real, "p").groupBy("system").agg(F.sum(F.col("n1") * (F.col("c0") - F.col("n0") / 2)).alias("wins"), F.sum("n1").alias("n_spoof"))
    n0 = s.filter("y = 0").agg(F.count("*").alias("n_bonafide"))
    return wins.join(F.broadcast(n0), how="cross").select("system", T.r6(F.col("wins") / (F.col("n_spoof") * F.col("n_bonafide")), "auc"), "n_spoof", "n_bonafide")


SLICES = f"""with {T.SCORED}, s as (select s.*, d.source as system from scored s join documents d on s.id = d.doc_id)
select f.system, round(sum(case when f.p > r.p then 1e0 when f.p = r.p then 0.5e0 else 0 end) / count(*), 6) as auc, count(distinct f.id) as n_spoof, count(distinct r.id) as n_bonafide
from s f, s r where f.y = 1 and r.y = 0 group by f.system"""


def score_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = T.scored(spark, sf_dir)
    key = T.table(spark, sf_dir, "labels").select(F.concat(F.lit("doc"), "doc_id").alias("filename"), F.when(F.col("quality") == 1, "spoof").otherwise("bonafide").alias("cm_label"))
    return s.select("filename", T.r6("p", "cm_score")).join(key, "filename")


def coverage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    actual = T.table(spark, sf_dir, "labels").filter("doc_id % 5 != 0").select("doc_id").union(spark.range(3).select((F.col("id") - 3).alias("doc_id")))
    return C.coverage(actual, T.table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("doc_id") % 50 == 0, F.concat(F.lit(" "), "source")).when(F.col("doc_id") % 50 == 1, "").when(F.col("doc_id") % 50 == 2, "same").otherwise(F.concat("source", F.lit("_"), "doc_id"))
    return T.table(spark, sf_dir, "documents").select(name.alias("name"))


def invalid_filenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.invalid_names(_named(spark, sf_dir), "name")


INVALID_NAMES = """with n as (select case when doc_id % 50 = 0 then concat(' ', source) when doc_id % 50 = 1 then '' when doc_id % 50 = 2 then 'same' else concat(source, '_', doc_id) end as name from documents)
select name, count(*) as n, case when name = '' or trim(name) <> name or regexp_matches(name, '[\\t\\r\\n]') then 'invalid' else 'duplicate' end as problem
from n group by name having problem = 'invalid' or count(*) > 1"""


def invalid_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = T.scored(spark, sf_dir).select("id", F.when(F.col("id") % 11 == 0, F.col("p") + 1).when(F.col("id") % 13 == 0, S.lit(float("nan"))).when(F.col("id") % 17 == 0, None).otherwise(F.col("p")).alias("p"))
    return C.invalid_probabilities(s, "p").select("id")


def score_reproduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = T.scored(spark, sf_dir)
    again = s.withColumn("p", F.col("p") + F.when(F.col("id") % 9 == 0, S.lit(2e-6)).when(F.col("id") % 31 == 0, S.lit(0.1)).otherwise(S.lit(0)))
    out = C.reproduction(s, again, "filename", "p", 1e-5)
    return out.select("n_rows", T.r6("max_difference", "max_difference"), T.r6("mean_difference", "mean_difference"), "different", "beyond_tolerance")


REPRODUCTION = f"""with {T.SCORED}, d as (select abs(p - (p + case when id % 9 = 0 then 2e-6 when id % 31 = 0 then 0.1e0 else 0 end)) as d from scored)
select count(*) as n_rows, round(max(d), 6) as max_difference, round(avg(d), 6) as mean_difference, count(*) filter (d <> 0) as different, count(*) filter (d > 1e-5) as beyond_tolerance from d"""


def submission_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.scored(spark, sf_dir).select("filename", F.format_string("%.2f", "p").alias("cm_score"))


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = T.scored(spark, sf_dir)
    label = F.when((F.col("p") >= S.lit(0.5)) == (F.col("y") == 1), "match").otherwise("disagree")
    return s.select("id", S.forensic_verdict(F.col("p")).alias("forensic"), S.detector_verdict(F.col("p"), S.lit(0.6), S.lit(0.3)).alias("detector"), label.alias("agreement"))


def sigmoid_logit(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = T.scored(spark, sf_dir)
    return s.select("id", T.r6(S.sigmoid((F.col("p") - S.lit(0.5)) * 20), "sigmoid"), T.r6(S.logit(F.col("p")), "logit"), T.r6(S.sigmoid(S.logit(F.col("p")) + S.prior_shift(0.3)), "shifted"))


def score_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = [0.05, 0.25, 0.5, 0.75, 0.95]
    s, points = T.scored(spark, sf_dir), {f"p{int(100 * x):02d}": x for x in q}
    shares = s.agg(*(T.r6(F.avg((F.col("p") >= S.lit(x)).cast("int")), n) for n, x in (("above_8", 0.8), ("above_5", 0.5))))
    return percentiles(s, "p", points).select(*(T.r6(p, p) for p in points)).join(shares, how="cross")


QUERIES = {f.__name__: f for f in (detection_metrics, det_curve, rates_tie_collapsed, summary, min_dcf_prior_sweep, eer_two_definitions, operating_points, metric_slices, score_key_join, coverage_check, invalid_filenames, invalid_scores, score_reproduction, submission_rows, verdicts, sigmoid_logit, score_quantiles)}
SQL = {
    "detection_metrics": DETECTION,
    "det_curve": f"with {CURVE} select round(threshold, 6) as threshold, round(frr, 6) as frr, round(far, 6) as far, rank::bigint as rank from curve",
    "rates_tie_collapsed": f"with {RATES} select round(threshold, 6) as threshold, round(miss, 6) as miss, round(flag, 6) as flag from rates",
    "summary": f"""with {RATES} select round((select auc from ranks), 4) as auc, round((select (miss + flag) / 2 from rates order by abs(miss - flag), threshold nulls first limit 1), 4) as eer,
        round(least(min((miss * 0.5e0 + 4 * flag * 0.5e0) / 0.5e0), 1), 4) as min_dcf_nsa, round(least(min((4 * miss * 0.5e0 + flag * 0.5e0) / 0.5e0), 1), 4) as min_dcf_code, 0.5e0 as metric_p_spoof from rates""",
    "min_dcf_prior_sweep": f"""with {RATES}, priors(q) as (values (0.1e0), (0.3e0), (0.5e0), (0.8e0))
        select q as p_spoof, round(min((q * miss + 4 * (1 - q) * flag) / least(q, 4 * (1 - q))), 6) as analyst, round(min((4 * q * miss + (1 - q) * flag) / least(4 * q, 1 - q)), 6) as as_coded from rates, priors group by q""",
    "eer_two_definitions": f"""with {CURVE}, counts as (select p, sum(y) as a, count(*) - sum(y) as b from scored group by p),
        rates as (select p, sum(a) over w / n1 as miss, 1 - sum(b) over w / n0 as flag from counts, total window w as (order by p rows unbounded preceding) union all select null, 0, 1)
        select round((select (frr + far) / 2 from curve order by abs(frr - far), rank limit 1), 6) as eer_curve, round((select (miss + flag) / 2 from rates order by abs(miss - flag), p nulls first limit 1), 6) as eer_tied""",
    "operating_points": OPERATING,
    "metric_slices": SLICES,
    "score_key_join": f"with {T.SCORED} select s.filename, round(p, 6) as cm_score, case when l.quality = 1 then 'spoof' else 'bonafide' end as cm_label from scored s join labels l on s.filename = concat('doc', l.doc_id)",
    "coverage_check": """with a as (select doc_id from labels where doc_id % 5 <> 0 union select unnest([-3, -2, -1])), e as (select doc_id from documents)
        select doc_id, 'missing' as problem from e where doc_id not in (select doc_id from a) union all select distinct doc_id, 'extra' from a where doc_id not in (select doc_id from e)""",
    "invalid_filenames": INVALID_NAMES,
    "invalid_scores": f"with {T.SCORED} select id from scored where case when id % 11 = 0 then p + 1 > 1 when id % 13 = 0 then true when id % 17 = 0 then true else false end",
    "score_reproduction": REPRODUCTION,
    "submission_rows": f"with {T.SCORED} select filename, printf('%.2f', p) as cm_score from scored",
    "verdicts": f"""with {T.SCORED} select id, case when p >= 0.8e0 then 'likely synthetic' when p >= 0.5e0 then 'suspicious, below the alert threshold' when p >= 0.2e0 then 'inconclusive, leaning real' else 'likely real' end as forensic,
        case when p >= 0.6e0 then 'synthetic' when p >= 0.3e0 then 'uncertain' else 'bona fide' end as detector, case when (p >= 0.5e0) = (y = 1) then 'match' else 'disagree' end as agreement from scored""",
    "sigmoid_logit": f"""with {T.SCORED}, q as (select id, p, greatest(1e-4, least(1 - 1e-4, p)) as c from scored)
        select id, round(1 / (1 + exp(-(p - 0.5e0) * 20)), 6) as sigmoid, round(ln(c / (1 - c)), 6) as logit, round(1 / (1 + exp(-(ln(c / (1 - c)) + ln(0.3e0 / 0.7e0)))), 6) as shifted from q""",
    "score_quantiles": f"""with {T.SCORED} select {', '.join(f'round(quantile_cont(p, {q}), 6) as p{int(100 * q):02d}' for q in (0.05, 0.25, 0.5, 0.75, 0.95))},
        round(avg((p >= 0.8e0)::int), 6) as above_8, round(avg((p >= 0.5e0)::int), 6) as above_5 from scored""",
}
