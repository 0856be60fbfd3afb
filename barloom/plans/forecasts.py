"""Queries on forecasts: metrics, comparisons, inference, concentration and drift."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import compare as C
from barloom.operators import inference as I
from barloom.operators import labels as L
from barloom.operators import metrics as K
from barloom.plans import algebra as A
from barloom.plans.catalog import SQL, query, r, rounded, table
from barloom.plans.market import UNIVERSE, VOL
from barloom.plans.news import ASSIGNED, EDGES, assigned, events
from barloom.plans.targets import QUANTILES, RESID, residuals
from barloom.session import written

# Predictions: the monthly level, and the mean of daily and weekly levels, for the next day's value.
PREDS = f"{RESID}, preds AS (SELECT entity, date, split, target AS y, har_monthly AS m0, (har_weekly + har_daily) / 2 AS m1 FROM resid), long AS (SELECT entity, date, split, y, 'm0' AS model, m0 AS p FROM preds UNION ALL SELECT entity, date, split, y, 'm1', m1 FROM preds)"


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residuals(spark, sf_dir).select("entity", "date", "split", F.col("target").alias("y"), F.col("har_monthly").alias("m0"), ((F.col("har_weekly") + F.col("har_daily")) / 2).alias("m1"))


def long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide(spark, sf_dir).unpivot(["entity", "date", "split", "y"], ["m0", "m1"], "model", "p")


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions as a table: ranking reads them several times."""
    return written(long(spark, sf_dir), "predictions")


RANKED = "rk AS (SELECT *, rank() OVER (PARTITION BY split, model ORDER BY y) + (count(*) OVER (PARTITION BY split, model, y) - 1) / 2.0 AS ry, rank() OVER (PARTITION BY split, model ORDER BY p) + (count(*) OVER (PARTITION BY split, model, p) - 1) / 2.0 AS rp FROM long)"
D = "least(greatest(y - p, -50), 50)"


@query(f"""WITH {PREDS}, {RANKED} SELECT split, model, count(*) AS n, round(avg(abs(y - p)), 7) AS mae, round(avg((y - p) * (y - p)), 7) AS mse, round(sqrt(avg((y - p) * (y - p))), 7) AS rmse,
  round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 7) AS r2, round(corr(y, p), 7) AS pearson, round(corr(ry, rp), 7) AS spearman, round(avg(exp({D}) - {D} - 1), 6) AS qlike,
  round(avg(CASE WHEN abs(y - p) <= 1 THEN 0.5 * (y - p) * (y - p) ELSE abs(y - p) - 0.5 END), 7) AS huber, round(avg(CAST((y > 0) = (p > 0) AS INT)), 7) AS sign_accuracy,
  round((avg(CASE WHEN y > 0 THEN CAST(p > 0 AS INT) END) + avg(CASE WHEN y <= 0 THEN CAST(p <= 0 AS INT) END)) / 2, 7) AS balanced_sign_accuracy, round(avg(CAST(sign(y) = sign(p) AS INT)), 7) AS directional_accuracy FROM rk GROUP BY split, model""")
def regression_metrics(spark, sf_dir):
    out = rounded(K.regression(long(spark, sf_dir), ["split", "model"]), 7)
    return out.withColumn("qlike", F.round("qlike", 6))


@query(f"""WITH {PREDS} SELECT entity, model, count(*) AS n, round(avg(abs(y - p)), 7) AS mae, round(sqrt(avg((y - p) * (y - p))), 7) AS rmse FROM long WHERE split = 'test' GROUP BY ALL""")
def metrics_by_entity(spark, sf_dir):
    out = K.regression(long(spark, sf_dir).filter("split = 'test'"), ["entity", "model"], ranks=False)
    return rounded(out.select("entity", "model", "n", "mae", "rmse"), 7)


RANK_DESC = "rank() OVER (PARTITION BY split, model ORDER BY {v} DESC) + (count(*) OVER (PARTITION BY split, model, {v}) - 1) / 2.0"


@query(f"""WITH {PREDS}, s AS (SELECT *, y - min(y) OVER (PARTITION BY split, model) AS g, count(*) OVER (PARTITION BY split, model) AS m, {RANK_DESC.format(v='y')} AS ry, {RANK_DESC.format(v='p')} AS rp,
    row_number() OVER (PARTITION BY split, model ORDER BY y DESC, entity, date) AS ny, row_number() OVER (PARTITION BY split, model ORDER BY p DESC, entity, date) AS np FROM long),
  tied AS (SELECT *, avg(1 / log2(np + 1)) OVER (PARTITION BY split, model, p) AS dp, avg(1 / log2(ny + 1)) OVER (PARTITION BY split, model, y) AS dy FROM s)
  SELECT split, model, count(*) AS n, round(count(*) FILTER (WHERE ry <= greatest(1, ceil(m * 0.1)) AND rp <= greatest(1, ceil(m * 0.1))) / max(greatest(1, ceil(m * 0.1))), 7) AS top_recall, round(sum(g * dp) / sum(g * dy), 6) AS ndcg FROM tied GROUP BY split, model""")
def ranking_metrics(spark, sf_dir):
    return rounded(K.ranking(long(spark, sf_dir), ["split", "model"], "entity"), 7).withColumn("ndcg", F.round("ndcg", 6))


# Probabilities of a spike: a bounded function of the weekly level, rounded so that ties occur.
PROB = f"{RESID}, prob AS (SELECT entity, date, split, CAST(abs(residual) > q90 AS INT) AS y, round(1 / (1 + exp(-(har_daily - har_monthly) - 1)), 2) AS p FROM resid JOIN thr USING (entity))"


def prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = residuals(spark, sf_dir)
    labelled = L.spike_labels(frame, "residual", L.fit_thresholds(frame, "residual", QUANTILES)).filter("q90 is not null")
    return labelled.select("entity", "date", "split", F.col("spike_q90").alias("y"), F.round(1 / (1 + F.exp(-(F.col("har_daily") - F.col("har_monthly")) - 1)), 2).alias("p"))


@query(f"""WITH {PROB}, c AS (SELECT split, count(*) AS n, count(*) FILTER (WHERE y = 1 AND p >= 0.5) AS tp, count(*) FILTER (WHERE y = 0 AND p >= 0.5) AS fp, count(*) FILTER (WHERE y = 1 AND p < 0.5) AS fn, count(*) FILTER (WHERE y = 0 AND p < 0.5) AS tn, avg((p - y) * (p - y)) AS brier FROM prob GROUP BY split)
  SELECT split, n, tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0), 0), 7) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 7) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 7) AS f1,
  round((coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0)) / 2, 7) AS macro_f1, round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 7) AS balanced_accuracy, round(brier, 7) AS brier FROM c""")
def confusion_metrics(spark, sf_dir):
    return rounded(K.confusion(prob(spark, sf_dir), ["split"]), 7)


@query(f"""WITH {PROB}, a AS (SELECT *, rank() OVER (PARTITION BY split ORDER BY p) + (count(*) OVER (PARTITION BY split, p) - 1) / 2.0 AS k FROM prob)
  SELECT split, round((sum(k) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 7) AS roc_auc FROM a GROUP BY split""")
def roc_auc(spark, sf_dir):
    return rounded(K.roc_auc(prob(spark, sf_dir), ["split"]), 7)


CURVE = f"{PROB}, d AS (SELECT split, p, sum(y) AS k1, count(*) AS k FROM prob GROUP BY ALL), cv AS (SELECT *, sum(k1) OVER w AS hits, sum(k) OVER w AS seen, sum(k1) OVER (PARTITION BY split) AS total FROM d WINDOW w AS (PARTITION BY split ORDER BY p DESC))"


@query(f"WITH {CURVE} SELECT split, round(sum(k1 * hits / seen) / max(total), 7) AS pr_auc FROM cv GROUP BY split")
def pr_auc(spark, sf_dir):
    return rounded(K.average_precision(prob(spark, sf_dir), ["split"]), 7)


@query(f"WITH {CURVE} SELECT split, round(coalesce(max(hits / total) FILTER (WHERE hits / seen >= 0.25), 0), 7) AS best, round(coalesce(arg_max(hits / total, seen) FILTER (WHERE hits / seen >= 0.25), 0), 7) AS last FROM cv GROUP BY split")
def recall_at_precision(spark, sf_dir):
    return rounded(K.recall_at_precision(prob(spark, sf_dir), ["split"], 0.25), 7)


@query(f"WITH {PROB}, b AS (SELECT split, least(floor(p * 10), 9) AS b, count(*) AS k, avg(y) AS a, avg(p) AS c FROM prob GROUP BY ALL) SELECT split, round(sum(k * abs(a - c)) / sum(k), 7) AS ece FROM b GROUP BY split")
def ece(spark, sf_dir):
    return rounded(K.calibration_error(prob(spark, sf_dir), ["split"]), 7)


REG = f"""{RESID}, reg AS (SELECT split, CASE WHEN abs(residual) <= q50 THEN 0 WHEN abs(residual) <= q90 THEN 1 ELSE 2 END AS y, abs(har_daily - har_weekly) AS a FROM resid JOIN thr USING (entity)),
q0 AS (SELECT split, y, [0.4 + 0.3 / (1 + a), 0.35::DOUBLE, 0.25 * a / (1 + a) + 0.1] AS q FROM reg), q1 AS (SELECT split, y, list_transform(q, lambda v: v / list_sum(q)) AS q FROM q0),
q2 AS (SELECT *, list_position(q, list_max(q)) - 1 AS hat, list_max(q) AS conf FROM q1)"""


@query(
    f"""WITH {REG}, e AS (SELECT split, sum(k * abs(a - c)) / sum(k) AS multiclass_ece FROM (SELECT split, least(floor(conf * 10), 9) AS b, count(*) AS k, avg(CAST(hat = y AS INT)) AS a, avg(conf) AS c FROM q2 GROUP BY ALL) GROUP BY split),
  c AS (SELECT split, count(*) AS n, avg(pow(q[1] - CAST(y = 0 AS INT), 2) + pow(q[2] - CAST(y = 1 AS INT), 2) + pow(q[3] - CAST(y = 2 AS INT), 2)) AS multiclass_brier, """
    + ", ".join(f"count(*) FILTER (WHERE y = {k}) AS s{k}, count(*) FILTER (WHERE hat = {k}) AS h{k}, count(*) FILTER (WHERE y = {k} AND hat = {k}) AS t{k}" for k in range(3))
    + " FROM q2 GROUP BY split) SELECT split, n, round(("
    + " + ".join(f"coalesce(2 * t{k} / nullif(s{k} + h{k}, 0), 0)" for k in range(3))
    + ") / 3, 7) AS macro_f1, round(("
    + " + ".join(f"coalesce(t{k} / nullif(s{k}, 0), 0)" for k in range(3))
    + ") / (CAST(s0 > 0 AS INT) + CAST(s1 > 0 AS INT) + CAST(s2 > 0 AS INT)), 7) AS balanced_accuracy, round(multiclass_brier, 7) AS multiclass_brier, "
    + ", ".join(f"round(coalesce(t{k} / nullif(s{k}, 0), 0), 7) AS recall_{k}, round(coalesce(t{k} / nullif(h{k}, 0), 0), 7) AS precision_{k}" for k in range(3))
    + ", round(multiclass_ece, 7) AS multiclass_ece FROM c JOIN e USING (split)"
)
def regime_metrics(spark, sf_dir):
    frame = residuals(spark, sf_dir)
    labelled = L.spike_labels(frame, "residual", L.fit_thresholds(frame, "residual", QUANTILES)).filter("q50 is not null")
    a = F.abs(F.col("har_daily") - F.col("har_weekly"))
    q = F.array(0.4 + 0.3 / (1 + a), F.lit(0.35), 0.25 * a / (1 + a) + 0.1)
    return rounded(K.multiclass(labelled.select("split", F.col("regime").alias("y"), q.alias("probabilities")), ["split"], 3), 7)


UNC = f"{RESID}, unc AS (SELECT entity, date, split, target AS y, har_weekly + center AS mean, scale, (target - har_weekly - center) / scale AS z, har_weekly + center + 1.6448536269514722 * scale AS bound FROM resid JOIN thr USING (entity))"


def unc(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = residuals(spark, sf_dir)
    out = L.spike_labels(frame, "residual", L.fit_thresholds(frame, "residual", QUANTILES)).filter("scale is not null")
    return out.select("entity", "date", "split", F.col("target").alias("y"), (F.col("har_weekly") + F.col("center")).alias("mean"), "scale")


@query(f"""WITH {UNC} SELECT split, count(*) AS n, round(avg(0.5 * ln(2 * pi()) + ln(scale) + 0.5 * z * z), 7) AS nll, round(avg(CAST(abs(z) <= 1.959963984540054 AS INT)), 7) AS coverage_95, round(avg(2 * 1.959963984540054 * scale), 7) AS width_95,
  round(avg(CAST(y > bound AS INT)), 7) AS exceedance, round(avg(greatest(0.95 * (y - bound), -0.05 * (y - bound))), 7) AS pinball_95 FROM unc GROUP BY split""")
def uncertainty_metrics(spark, sf_dir):
    return rounded(K.uncertainty(unc(spark, sf_dir), ["split"]), 7)


@query(f"""WITH {UNC}, k AS (SELECT split, count(*) AS n, sum(CAST(y > bound AS INT))::BIGINT AS failures FROM unc GROUP BY split),
  l AS (SELECT *, failures * ln(0.05) + (n - failures) * ln(0.95) AS l0, CASE WHEN failures = 0 THEN 0 ELSE failures * ln(failures / n) END + CASE WHEN failures = n THEN 0 ELSE (n - failures) * ln(1 - failures / n) END AS l1 FROM k)
  SELECT split, n, failures, round(greatest(0, -2 * (l0 - l1)), 6)::DOUBLE AS kupiec_lr FROM l""")
def kupiec_lr(spark, sf_dir):
    hits = unc(spark, sf_dir).withColumn("hit", F.col("y") > F.col("mean") + K.Z95 * F.col("scale"))
    return rounded(K.kupiec(hits, ["split"], "hit", 0.05), 6)


def _xl(k: str, p: str) -> str:
    return f"CASE WHEN {k} = 0 THEN 0 ELSE ({k}) * ln({p}) END"


@query(f"""WITH {UNC}, h AS (SELECT split, lag(CAST(y > bound AS INT)) OVER (PARTITION BY split, entity ORDER BY date) AS a, CAST(y > bound AS INT) AS b FROM unc),
  c AS (SELECT split, count(*) FILTER (WHERE a = 0 AND b = 0) AS n00, count(*) FILTER (WHERE a = 0 AND b = 1) AS n01, count(*) FILTER (WHERE a = 1 AND b = 0) AS n10, count(*) FILTER (WHERE a = 1 AND b = 1) AS n11 FROM h WHERE a IS NOT NULL GROUP BY split),
  p AS (SELECT *, (n01 + n11) / greatest(n00 + n01 + n10 + n11, 1) AS pp, n01 / greatest(n00 + n01, 1) AS p01, n11 / greatest(n10 + n11, 1) AS p11 FROM c)
  SELECT split, n00, n01, n10, n11, round(greatest(0, -2 * ({_xl('n01 + n11', 'pp')} + {_xl('n00 + n10', '1 - pp')} - {_xl('n01', 'p01')} - {_xl('n00', '1 - p01')} - {_xl('n11', 'p11')} - {_xl('n10', '1 - p11')})), 6)::DOUBLE AS independence_lr FROM p""")
def christoffersen_lr(spark, sf_dir):
    hits = unc(spark, sf_dir).withColumn("hit", F.col("y") > F.col("mean") + K.Z95 * F.col("scale"))
    return rounded(K.christoffersen(hits, ["split"], "entity", "date", "hit"), 6)


KUPIEC = f"""{UNC}, k AS (SELECT split, count(*) AS n, sum(CAST(y > bound AS INT))::BIGINT AS failures FROM unc GROUP BY split),
  l AS (SELECT *, failures * ln(0.05) + (n - failures) * ln(0.95) AS l0, CASE WHEN failures = 0 THEN 0 ELSE failures * ln(failures / n) END + CASE WHEN failures = n THEN 0 ELSE (n - failures) * ln(1 - failures / n) END AS l1 FROM k), lr AS (SELECT split, round(greatest(0, -2 * (l0 - l1)), 6)::DOUBLE AS kupiec_lr FROM l)"""


@query(f"WITH {KUPIEC} SELECT split, kupiec_lr, round(1 - {A.erf('sqrt(kupiec_lr / 2)')}, 6) + 0.0 AS p_value FROM lr")
def likelihood_p_values(spark, sf_dir):
    from barloom.functions.stats import chi2_p

    return kupiec_lr(spark, sf_dir).select("split", "kupiec_lr", (F.round(chi2_p(F.col("kupiec_lr"), 1), 6) + 0.0).alias("p_value"))


@query(f"""WITH {UNC}, u AS (SELECT split, z, scale, 0.5 * (1 + {A.erf('(z / sqrt(2))')}) AS phi FROM unc)
  SELECT split, round(avg(scale * (z * (2 * phi - 1) + 2 * exp(-z * z / 2) / sqrt(2 * pi()) - 1 / sqrt(pi()))), 6) AS crps, round(avg(phi), 6) AS mean_pit FROM u GROUP BY split""")
def crps_and_pit(spark, sf_dir):
    from barloom.functions.stats import gaussian_crps, normal_pit

    y, m, s = F.col("y"), F.col("mean"), F.col("scale")
    scored = unc(spark, sf_dir).select("split", gaussian_crps(y, m, s).alias("c"), normal_pit(y, m, s).alias("u"))
    return scored.groupBy("split").agg(r(F.avg("c"), 6, "crps"), r(F.avg("u"), 6, "mean_pit"))


BYDATE = "PARTITION BY split, model, date"
IC = f"""{PREDS}, k AS (SELECT *, count(*) OVER ({BYDATE}) AS m, rank() OVER ({BYDATE} ORDER BY y DESC) + (count(*) OVER ({BYDATE}, y) - 1) / 2.0 AS ra, rank() OVER ({BYDATE} ORDER BY p DESC) + (count(*) OVER ({BYDATE}, p) - 1) / 2.0 AS rp FROM long),
ic AS (SELECT split, model, date, count(DISTINCT entity) AS n_entities, CASE WHEN count(*) >= 3 AND stddev_pop(ra) > 0 AND stddev_pop(rp) > 0 THEN corr(ra, rp) END AS daily_ic, count(*) FILTER (WHERE ra <= 3 AND rp <= 3) / 3 AS top3, count(*) FILTER (WHERE ra > m - 3 AND rp > m - 3) / 3 AS bottom3,
  avg(CAST((y > 0) = (p > 0) AS INT)) AS sign FROM k GROUP BY split, model, date)"""


def _ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.daily_ic(long(spark, sf_dir), ["split", "model"], "entity")


@query(f"WITH {IC} SELECT split, model, date, n_entities, round(daily_ic, 7) AS daily_ic, round(top3, 7) AS top3, round(bottom3, 7) AS bottom3, round(sign, 7) AS sign FROM ic")
def daily_ic(spark, sf_dir):
    return rounded(_ic(spark, sf_dir), 7)


@query(f"""WITH {IC} SELECT split, model, count(*) AS n_dates, round(avg(daily_ic), 7) AS mean_ic, round(quantile_cont(daily_ic, 0.5), 7) AS median_ic, round(stddev_samp(daily_ic), 7) AS ic_std, round(avg(CAST(daily_ic > 1e-12 AS INT)), 7) AS positive_rate,
  round(avg(daily_ic) / nullif(stddev_samp(daily_ic), 0), 7) AS ic_ir FROM ic WHERE daily_ic IS NOT NULL GROUP BY split, model""")
def daily_ic_summary(spark, sf_dir):
    return rounded(K.summarize_ic(_ic(spark, sf_dir), ["split", "model"]), 7)


@query(f"""WITH {PREDS}, tb AS (SELECT *, row_number() OVER (PARTITION BY model, date ORDER BY p DESC, entity) AS hi, row_number() OVER (PARTITION BY model, date ORDER BY p, entity DESC) AS lo, count(*) OVER (PARTITION BY model, date) AS m FROM long WHERE split = 'test')
  SELECT model, date, round(avg(y) FILTER (WHERE hi <= 3), 7) AS top_mean, round(avg(y) FILTER (WHERE lo <= 3), 7) AS bottom_mean, round(avg(y) FILTER (WHERE hi <= 3) - avg(y) FILTER (WHERE lo <= 3), 7) AS spread FROM tb WHERE m >= 6 GROUP BY model, date""")
def topk_portfolio(spark, sf_dir):
    return rounded(K.top_bottom(long(spark, sf_dir).filter("split = 'test'"), ["model"], "entity"), 7)


HUB = "CASE WHEN abs({e}) <= 1 THEN 0.5 * ({e}) * ({e}) ELSE abs({e}) - 0.5 END"
LOSS = f"""{PREDS}, loss AS (SELECT entity, date, split, abs(y - m0) - abs(y - m1) AS absolute_gain, (y - m0) * (y - m0) - (y - m1) * (y - m1) AS squared_gain, {HUB.format(e='y - m0')} - {HUB.format(e='y - m1')} AS huber_gain FROM preds),
daily AS (SELECT split, date, avg(absolute_gain) AS absolute_gain, avg(squared_gain) AS squared_gain, avg(huber_gain) AS huber_gain, count(*) AS n FROM loss GROUP BY ALL)"""


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = I.join_models(long(spark, sf_dir), ["entity", "date", "split"], "m0", "m1")
    return I.daily_gains(I.paired_losses(both, "y", "base", "text"), ["split"])


@query(f"WITH {LOSS} SELECT split, date, round(absolute_gain, 7) AS absolute_gain, round(squared_gain, 7) AS squared_gain, round(huber_gain, 7) AS huber_gain, n FROM daily")
def paired_losses(spark, sf_dir):
    return rounded(daily(spark, sf_dir), 7)


LAGS = 5


@query(f"""WITH {LOSS}, c AS (SELECT split, date, absolute_gain AS v, absolute_gain - avg(absolute_gain) OVER (PARTITION BY split) AS x FROM daily), s AS (SELECT *, {", ".join(f"lag(x, {k}) OVER (PARTITION BY split ORDER BY date) AS x{k}" for k in range(1, LAGS + 1))} FROM c),
  l AS (SELECT split, count(*) AS n, avg(v) AS mean, greatest(0, sum(x * x) / count(*) + {" + ".join(f"2 * {1 - k / (LAGS + 1)!r} * sum(x * x{k}) / count(*)" for k in range(1, LAGS + 1))}) AS lrv FROM s GROUP BY split)
  SELECT split, n, round(mean, 8) AS mean, round(sqrt(lrv / n), 8) AS hac_se, round(mean / nullif(sqrt(lrv / n), 0), 6) AS t_statistic FROM l WHERE n > {LAGS + 2}""")
def newey_west(spark, sf_dir):
    return rounded(I.newey_west(daily(spark, sf_dir), ["split"], "absolute_gain", LAGS)).withColumn("t_statistic", F.round("t_statistic", 6))


@query(f"SELECT *, round(1 - {A.erf('(abs(t_statistic) / sqrt(2))')}, 6) + 0.0 AS p_value FROM ({SQL['newey_west']})")
def newey_west_p(spark, sf_dir):
    from barloom.functions.stats import two_sided_p

    return newey_west(spark, sf_dir).withColumn("p_value", F.round(two_sided_p(F.col("t_statistic")), 6) + 0.0)


def _boot(circular: bool) -> str:
    room = "n" if circular else "(n - least(10, n) + 1)"
    return f"""WITH {LOSS}, s AS (SELECT row_number() OVER (ORDER BY date) - 1 AS i, absolute_gain AS v, count(*) OVER () AS n FROM daily WHERE split = 'test'), z AS (SELECT max(n) AS n FROM s),
  st AS (SELECT rep, block, n, floor(('0x' || substr(sha256('42|' || rep || '|' || block), 1, 8))::BIGINT / 4294967296.0 * {room})::BIGINT AS start FROM z, range(200) a(rep), LATERAL (SELECT unnest(range(ceil(n / least(10, n))::BIGINT)) AS block)),
  d AS (SELECT rep, (start + k) % n AS i FROM st, range(10) b(k) WHERE k < least(10, n) AND block * least(10, n) + k < n), m AS (SELECT rep, avg(v) AS mean FROM d JOIN s USING (i) GROUP BY rep)
  SELECT count(*) AS repetitions, round(avg(mean), 8) AS bootstrap_mean, round(stddev_samp(mean), 8) AS bootstrap_se, round(quantile_cont(mean, 0.025), 8) AS ci_lower, round(quantile_cont(mean, 0.975), 8) AS ci_upper, round(avg(CAST(mean > 0 AS INT)), 8) AS p_positive FROM m"""


@query(_boot(True))
def bootstrap_given_starts(spark, sf_dir):
    draws = I.block_bootstrap(daily(spark, sf_dir).filter("split = 'test'"), "absolute_gain", 10, 200, 42)
    return rounded(I.bootstrap_summary(draws).withColumn("ci_upper", F.col("ci_upper")))


@query(_boot(False))
def bootstrap_non_circular(spark, sf_dir):
    draws = I.block_bootstrap(daily(spark, sf_dir).filter("split = 'test'"), "absolute_gain", 10, 200, 42, circular=False)
    return rounded(I.bootstrap_summary(draws))


# The reference's grid: block lengths, seeds and repetitions.
BLOCKS, SEEDS, REPETITIONS = (10, 15, 20), (42, 123, 2026), 2_000


def _boots(circular: bool, blocks: tuple[int, ...], seeds: tuple[int, ...], reps: int) -> str:
    parts = []
    for block in blocks:
        for seed in seeds:
            one = _boot(circular).replace("least(10, n)", f"least({block}, n)").replace("range(10)", f"range({block})").replace("range(200)", f"range({reps})").replace("'42|'", f"'{seed}|'")
            parts.append(f"SELECT {block} AS block_length, {seed} AS seed, * FROM ({one})")
    return " UNION ALL ".join(parts)


def _bootstraps(spark: SparkSession, sf_dir: str, blocks: tuple[int, ...], seeds: tuple[int, ...], reps: int, circular: bool) -> DataFrame:
    series = written(daily(spark, sf_dir).filter("split = 'test'"), "daily")
    parts = [
        rounded(I.bootstrap_summary(I.block_bootstrap(series, "absolute_gain", block, reps, seed, circular=circular))).select(F.lit(block).alias("block_length"), F.lit(seed).alias("seed"), "*")
        for block in blocks for seed in seeds
    ]
    return reduce(DataFrame.unionByName, parts)


@query(_boots(True, BLOCKS, SEEDS, REPETITIONS))
def bootstrap_circular_grid(spark, sf_dir):
    """All block lengths and seeds of the reference with its 2,000 repetitions."""
    return _bootstraps(spark, sf_dir, BLOCKS, SEEDS, REPETITIONS, True)


@query(_boots(False, (10,), (42,), 500))
def bootstrap_non_circular_full(spark, sf_dir):
    """The reference's 500 repetitions."""
    return _bootstraps(spark, sf_dir, (10,), (42,), 500, False)


TICK = f"{VOL}, tick AS (SELECT split_part(entity, '/', 2) AS ticker, date, avg(log_variance) AS v FROM vol WHERE split_part(entity, '/', 2) IN ({', '.join(repr(t) for t in UNIVERSE)}) GROUP BY ALL), pc AS (SELECT a.ticker AS entity_a, b.ticker AS entity_b, count(*) AS n, CASE WHEN stddev_pop(a.v) > 0 AND stddev_pop(b.v) > 0 AND count(*) >= 2 THEN corr(a.v, b.v) END AS correlation FROM tick a JOIN tick b ON a.date = b.date AND a.ticker < b.ticker GROUP BY ALL)"


def tick(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.plans.market import vol

    ticker = F.split_part("entity", F.lit("/"), F.lit(2))
    return vol(spark, sf_dir).withColumn("ticker", ticker).filter(F.col("ticker").isin(*UNIVERSE)).groupBy("ticker", "date").agg(F.avg("log_variance").alias("v"))


@query(f"WITH {TICK} SELECT entity_a, entity_b, n, round(correlation, 7) AS correlation FROM pc")
def pairwise_correlation(spark, sf_dir):
    return rounded(I.pairwise_correlations(tick(spark, sf_dir), "ticker", "v"), 7)


@query(f"""WITH {TICK}, s AS (SELECT count(DISTINCT ticker) AS n_entities, count(DISTINCT date) AS n_dates FROM tick), m AS (SELECT avg(correlation) AS rho FROM pc)
  SELECT n_entities, n_dates, round(rho, 7) AS mean_correlation, round(n_entities * n_dates / (1 + (n_entities - 1) * rho), 5) AS effective, round(least(n_entities * n_dates / (1 + (n_entities - 1) * rho), n_entities * n_dates), 5)::DOUBLE AS effective_capped FROM s, m""")
def effective_sample(spark, sf_dir):
    out = I.effective_sample(tick(spark, sf_dir), "ticker", "v")
    return out.select("n_entities", "n_dates", r("mean_correlation", 7), r("effective", 5), r("effective_capped", 5))


@query(f"WITH {LOSS}, lg AS (SELECT entity, sum(absolute_gain) AS s, count(*) AS n FROM loss WHERE split = 'test' GROUP BY entity) SELECT entity, n AS n_left_out, round(((SELECT sum(s) FROM lg) - s) / nullif((SELECT sum(n) FROM lg) - n, 0), 7) AS mean_without FROM lg")
def leave_one_out_recompute(spark, sf_dir):
    both = I.join_models(long(spark, sf_dir).filter("split = 'test'"), ["entity", "date", "split"], "m0", "m1")
    return rounded(I.leave_one_out(I.paired_losses(both, "y", "base", "text"), "entity", "absolute_gain"), 7)


@query(f"""WITH {PREDS}, b AS (SELECT entity, avg(y) AS own FROM preds WHERE split = 'train' GROUP BY entity) SELECT entity, date, split, round(coalesce(own, (SELECT avg(y) FROM preds WHERE split = 'train')), 7) AS baseline FROM preds LEFT JOIN b USING (entity)""")
def baseline_b0(spark, sf_dir):
    return C.baseline_mean(wide(spark, sf_dir), "y").select("entity", "date", "split", r("baseline", 7))


MET = f"{PREDS}, met AS (SELECT split, model, avg(abs(y - p)) AS mae FROM long GROUP BY ALL)"


@query(f"WITH {MET} SELECT a.split, a.model, round(a.mae, 7) AS mae, round((b.mae - a.mae) / greatest(abs(b.mae), 1e-12), 7) AS gain FROM met a JOIN met b ON a.split = b.split AND b.model = 'm0'")
def relative_gain(spark, sf_dir):
    met = long(spark, sf_dir).groupBy("split", "model").agg(F.avg(F.abs(F.col("y") - F.col("p"))).alias("mae"))
    return C.gains(met, ["split"], "model", "m0", "mae", True).select("split", "model", r("mae", 7), r("gain", 7))


@query(f"""WITH {MET}, gg AS (SELECT a.split, (b.mae - a.mae) / greatest(abs(b.mae), 1e-12) AS gain FROM met a JOIN met b ON a.split = b.split AND b.model = 'm0' AND a.model = 'm1')
  SELECT bool_and(CASE WHEN split = 'validation' THEN gain > 0 ELSE true END) AS validation_gain, bool_and(CASE WHEN split = 'test' THEN gain > 0 ELSE true END) AS test_gain, bool_and(gain > -0.05) AS no_split_much_worse,
  CASE WHEN bool_and(CASE WHEN split = 'validation' THEN gain > 0 ELSE true END) AND bool_and(CASE WHEN split = 'test' THEN gain > 0 ELSE true END) AND bool_and(gain > -0.05) THEN 'GO' ELSE 'NO-GO' END AS decision FROM gg""")
def gain_gate(spark, sf_dir):
    met = long(spark, sf_dir).groupBy("split", "model").agg(F.avg(F.abs(F.col("y") - F.col("p"))).alias("mae"))
    g = C.gains(met, ["split"], "model", "m0", "mae", True).filter("model = 'm1'")
    ok = F.col("gain") > 0
    return C.gate(g, [], {"validation_gain": F.when(F.col("split") == "validation", ok).otherwise(F.lit(True)), "test_gain": F.when(F.col("split") == "test", ok).otherwise(F.lit(True)), "no_split_much_worse": F.col("gain") > -0.05})


@query(f"WITH {PREDS}, e AS (SELECT entity, model, avg(abs(y - p)) AS mae FROM long WHERE split = 'validation' GROUP BY ALL) SELECT entity, model, round(mae, 7) AS mae FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY mae, model) AS k FROM e) WHERE k = 1")
def best_model_per_entity(spark, sf_dir):
    e = long(spark, sf_dir).filter("split = 'validation'").groupBy("entity", "model").agg(F.avg(F.abs(F.col("y") - F.col("p"))).alias("mae"))
    return rounded(C.best_rows(e, ["entity"], "mae", False, ["model"]), 7)


@query("""WITH grid AS (SELECT DISTINCT ticker, feature_date FROM (SELECT DISTINCT upper(trim(ticker)) AS ticker FROM inspect_schema WHERE ticker IS NOT NULL) CROSS JOIN (SELECT feature_date FROM split_calendar)),
  obs AS (SELECT upper(trim(ticker)) AS ticker, feature_date, count(*) AS n FROM inspect_schema WHERE ticker IS NOT NULL AND feature_date IS NOT NULL GROUP BY ALL)
  SELECT problem, count(*) AS n FROM (SELECT 'missing' AS problem FROM grid ANTI JOIN obs USING (ticker, feature_date) UNION ALL SELECT 'unexpected' FROM obs ANTI JOIN grid USING (ticker, feature_date) UNION ALL SELECT 'duplicate' FROM obs WHERE n > 1) GROUP BY problem""")
def grid_exactness(spark, sf_dir):
    obs = table(spark, sf_dir, "inspect_schema").select(F.upper(F.trim("ticker")).alias("ticker"), F.col("feature_date").cast("date").alias("feature_date")).filter("ticker is not null and feature_date is not null")
    tickers = table(spark, sf_dir, "inspect_schema").select(F.upper(F.trim("ticker")).alias("ticker")).filter("ticker is not null").distinct()
    expected = tickers.crossJoin(F.broadcast(table(spark, sf_dir, "split_calendar").select("feature_date")))  # the wanted grid itself
    return C.grid_exactness(expected, obs, ["ticker", "feature_date"]).groupBy("problem").agg(F.count("*").alias("n"))


@query(f"""WITH {ASSIGNED}, c AS (SELECT a.prototype, coalesce(p.prototype_id, -1) AS b, count(*)::DOUBLE AS n FROM assigned a JOIN analyze_prototypes p USING (event_id) GROUP BY ALL),
  s AS (SELECT sum(n * (n - 1) / 2) AS ij, sum(n) AS t FROM c), x AS (SELECT sum(n * (n - 1) / 2) AS ia FROM (SELECT sum(n) AS n FROM c GROUP BY prototype)), y AS (SELECT sum(n * (n - 1) / 2) AS ib FROM (SELECT sum(n) AS n FROM c GROUP BY b))
  SELECT t::BIGINT AS n, round((ij - ia * ib / (t * (t - 1) / 2)) / ((ia + ib) / 2 - ia * ib / (t * (t - 1) / 2)), 8) AS adjusted_rand FROM s, x, y""")
def adjusted_rand(spark, sf_dir):
    both = assigned(spark, sf_dir).join(table(spark, sf_dir, "analyze_prototypes").select("event_id", F.coalesce("prototype_id", F.lit(-1)).alias("recorded")), "event_id")
    return rounded(C.rand_index(both, "prototype", "recorded"))


@query(f"""WITH {ASSIGNED}, c AS (SELECT prototype, count(*) FILTER (WHERE lower(trim(split)) = 'train') AS a, count(*) FILTER (WHERE lower(trim(split)) = 'test') AS b FROM assigned JOIN analyze_prototypes USING (event_id) GROUP BY prototype),
  pq AS (SELECT a / (SELECT sum(a) FROM c) AS p, b / (SELECT sum(b) FROM c) AS q FROM c WHERE a + b > 0), j AS (SELECT greatest(0, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2) AS d FROM pq)
  SELECT round(d, 8)::DOUBLE AS js_divergence, round(sqrt(d), 7) AS js_distance FROM j""")
def js_drift(spark, sf_dir):
    both = assigned(spark, sf_dir).join(events(spark, sf_dir).select("event_id", "split"), "event_id")
    return rounded(C.usage_drift(both, "prototype", "split", "train", "test")).withColumn("js_distance", F.round("js_distance", 7))


@query("""WITH c AS (SELECT news_level, source, count(*) AS k FROM analyze_prototypes WHERE source IS NOT NULL GROUP BY ALL), p AS (SELECT *, k / sum(k) OVER (PARTITION BY news_level) AS p, sum(k) OVER (PARTITION BY news_level) AS n FROM c)
  SELECT news_level, max(n)::BIGINT AS n, count(*) AS n_categories, round(sum(p * p), 8) AS hhi, round(exp(-sum(p * ln(p))), 7) AS effective_number, round(max(p), 8) AS largest_share FROM p GROUP BY news_level""")
def hhi(spark, sf_dir):
    return rounded(C.concentration(table(spark, sf_dir, "analyze_prototypes"), ["news_level"], "source")).withColumn("effective_number", F.round("effective_number", 7))


@query("SELECT news_level, prototype_id, event_id, cosine_similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY news_level, prototype_id ORDER BY cosine_similarity DESC, event_id) AS rank FROM analyze_prototypes WHERE cosine_similarity IS NOT NULL) WHERE rank <= 5")
def prototype_examples(spark, sf_dir):
    return C.top_examples(table(spark, sf_dir, "analyze_prototypes"), ["news_level", "prototype_id"], "cosine_similarity", "event_id", 5).select("news_level", "prototype_id", "event_id", "cosine_similarity", F.col("rank").cast("long").alias("rank"))


@query("""SELECT news_level, prototype_id, count(*) AS n_events, count(DISTINCT feature_date) AS n_days, count(DISTINCT source) AS n_sources, min(feature_date) AS first_date, max(feature_date) AS last_date, round(avg(cosine_similarity), 8) AS mean_cosine,
  count(*) FILTER (WHERE lower(trim(split)) = 'train') AS n_train, count(DISTINCT year(feature_date)) AS n_years, count(DISTINCT (year(feature_date), quarter(feature_date))) AS n_quarters FROM analyze_prototypes GROUP BY ALL""")
def prototype_details(spark, sf_dir):
    rows = table(spark, sf_dir, "analyze_prototypes")
    return rows.groupBy("news_level", "prototype_id").agg(
        F.count("*").alias("n_events"), F.countDistinct("feature_date").alias("n_days"), F.countDistinct("source").alias("n_sources"), F.min("feature_date").alias("first_date"), F.max("feature_date").alias("last_date"), r(F.avg("cosine_similarity"), 8, "mean_cosine"),
        F.count_if(F.lower(F.trim("split")) == "train").alias("n_train"), F.countDistinct(F.year("feature_date")).alias("n_years"), F.countDistinct(F.year("feature_date"), F.quarter("feature_date")).alias("n_quarters"),
    )


@query(f"WITH {PREDS} SELECT entity, round(avg(m0) FILTER (WHERE split = 'train'), 7) AS mean_left, round(avg(m0) FILTER (WHERE split = 'test'), 7) AS mean_right, round((avg(m0) FILTER (WHERE split = 'test') - avg(m0) FILTER (WHERE split = 'train')) / nullif(sqrt((var_samp(m0) FILTER (WHERE split = 'train') + var_samp(m0) FILTER (WHERE split = 'test')) / 2), 0), 6) AS smd FROM preds GROUP BY entity")
def distribution_shift(spark, sf_dir):
    return rounded(C.shift(wide(spark, sf_dir), ["entity"], "m0", "split", "train", "test"), 7).withColumn("smd", F.round("smd", 6))


RESPONSE = f"{TICK}, {EDGES}, resp AS (SELECT DISTINCT coalesce(a.prototype_id, -1) AS prototype, tick.ticker, tick.date, v, coalesce(edges.ticker = a.target_ticker, false) AS own FROM edges JOIN analyze_prototypes a USING (event_id) JOIN tick ON tick.ticker = edges.ticker AND tick.date = event_date)"


@query(f"WITH {RESPONSE} SELECT prototype, count(v) FILTER (WHERE own) AS n_own, count(v) FILTER (WHERE NOT own) AS n_rest, round(avg(v) FILTER (WHERE own) - avg(v) FILTER (WHERE NOT own), 6) AS difference, round((avg(v) FILTER (WHERE own) - avg(v) FILTER (WHERE NOT own)) / nullif(stddev_samp(v), 0), 6) AS effect FROM resp GROUP BY prototype")
def target_vs_rest(spark, sf_dir):
    from barloom.operators import pooling as P
    from barloom.plans.news import ALL

    facts = table(spark, sf_dir, "analyze_prototypes").select("event_id", F.coalesce("prototype_id", F.lit(-1)).alias("prototype"), "target_ticker")
    edge = P.edges(events(spark, sf_dir), ALL).join(facts, "event_id")
    rows = edge.join(F.broadcast(tick(spark, sf_dir).withColumnRenamed("date", "event_date")), ["ticker", "event_date"])
    rows = rows.select("prototype", "ticker", F.col("event_date").alias("date"), "v", F.coalesce(F.col("ticker") == F.col("target_ticker"), F.lit(False)).alias("own")).distinct()
    return rounded(C.target_vs_rest(rows, ["prototype"], F.col("own"), "v"), 6)


@query("WITH nulls AS (SELECT split, date, m FROM (SELECT lower(trim(split)) AS split, feature_date AS date, count(*)::DOUBLE AS m FROM analyze_prototypes WHERE split IS NOT NULL GROUP BY ALL)), o AS (SELECT split, avg(m) AS obs FROM nulls GROUP BY split) SELECT split, count(m) AS n_nulls, round(max(obs), 7) AS observed, round((count(*) FILTER (WHERE m >= obs) + 1) / (count(m) + 1), 7) AS p_value, round(count(*) FILTER (WHERE m < obs) / count(m), 7) AS percentile, round(avg(m), 7) AS null_mean FROM nulls JOIN o USING (split) GROUP BY split")
def empirical_p(spark, sf_dir):
    nulls = events(spark, sf_dir).filter("split is not null").groupBy("split", "feature_date").agg(F.count("*").cast("double").alias("m"))
    observed = nulls.groupBy("split").agg(F.avg("m").alias("m"))
    return rounded(I.empirical_p(observed, nulls, ["split"], "m"), 7)


