"""Queries on splits, targets and labels; the flagship is the sector-relative target by split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import labels as L
from barloom.operators import market as M
from barloom.operators import splits as S
from barloom.plans.catalog import query, r, rounded, table
from barloom.plans.market import CALENDAR, READY, VOL, ready, vol
from barloom.session import written

BLOCKS = """days AS (SELECT {d} AS d, row_number() OVER (ORDER BY {d}) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT {d} FROM {t} WHERE {d} IS NOT NULL)),
cuts AS (SELECT d, i, n, least(greatest(floor(n * 0.6::DOUBLE), 1), n - 2) AS a FROM days WHERE n >= 3),
blocks AS (SELECT d, CASE WHEN i < a THEN 'train' WHEN i < least(greatest(floor(n * 0.8::DOUBLE), a + 1), n - 1) THEN 'validation' ELSE 'test' END AS split FROM cuts)"""
SPLIT = f"""{READY}, {BLOCKS.format(d='target_date', t='ready')}, splitted AS (SELECT ready.*, blocks.split FROM ready LEFT JOIN blocks ON target_date = d)"""


def splitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.assign_split(ready(spark, sf_dir))


@query(f"""WITH {SPLIT} SELECT split, min(date) AS input_start, max(date) AS input_end, min(target_date) AS target_start, max(target_date) AS target_end,
  count(DISTINCT target_date) AS n_target_dates, count(*) AS n_samples, count(DISTINCT entity) AS n_entities FROM splitted GROUP BY split""")
def date_split(spark, sf_dir):
    return S.split_summary(splitted(spark, sf_dir))


FOLDS = f"""{SPLIT}, dev AS (SELECT target_date AS d, row_number() OVER (ORDER BY target_date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT target_date FROM splitted WHERE split IN ('train', 'validation'))),
sized AS (SELECT *, CASE WHEN n - 3 * greatest(n // 5, 1) < 60 THEN greatest((n - 60) // 3, 1) ELSE greatest(n // 5, 1) END AS size FROM dev),
grid AS (SELECT d, i, n, size, n - 3 * size AS initial, fold FROM sized, (VALUES (1), (2), (3)) f(fold) WHERE n - 3 * size >= 60),
marked AS (SELECT *, initial + (fold - 1) * size AS s, CASE WHEN fold = 3 THEN n ELSE initial + fold * size END AS e FROM grid),
folds AS (SELECT fold, min(d) FILTER (WHERE i < s) AS train_start, max(d) FILTER (WHERE i < s) AS train_end, min(d) FILTER (WHERE i >= s AND i < e) AS validation_start,
  max(d) FILTER (WHERE i >= s AND i < e) AS validation_end, count(*) FILTER (WHERE i < s) AS n_train_dates, count(*) FILTER (WHERE i >= s AND i < e) AS n_validation_dates FROM marked GROUP BY fold)"""


@query(f"WITH {FOLDS} SELECT * FROM folds")
def expanding_folds(spark, sf_dir):
    return S.expanding_folds(splitted(spark, sf_dir), 3, 60)


@query(f"""WITH {FOLDS} SELECT fold, CASE WHEN target_date BETWEEN train_start AND train_end THEN 'train' ELSE 'validation' END AS fold_split, count(*) AS n_rows, count(DISTINCT entity) AS n_entities
  FROM splitted JOIN folds ON target_date BETWEEN train_start AND train_end OR target_date BETWEEN validation_start AND validation_end GROUP BY ALL""")
def fold_range_join(spark, sf_dir):
    frame = splitted(spark, sf_dir)
    return S.fold_rows(frame, S.expanding_folds(frame, 3, 60)).groupBy("fold", "fold_split").agg(F.count("*").alias("n_rows"), F.countDistinct("entity").alias("n_entities"))


@query(f"""WITH {READY}, d AS (SELECT target_date AS d, row_number() OVER (ORDER BY target_date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT target_date FROM ready)),
  h AS (SELECT *, ntile(5) OVER (ORDER BY d) - 1 AS block FROM d WHERE i >= floor(n * 0.4::DOUBLE))
  SELECT block::INT AS block, (SELECT max(d) FROM d WHERE d.d < min(h.d)) AS history_end, min(h.d) AS predict_start, max(h.d) AS predict_end, count(*) AS n_dates FROM h GROUP BY block""")
def expanding_oof_blocks(spark, sf_dir):
    return S.expanding_blocks(ready(spark, sf_dir), 5, 0.4)


FORWARD = f"""{VOL}, {CALENDAR}, entities AS (SELECT DISTINCT entity FROM vol),
grid AS (SELECT entities.entity, cal.date, vol.log_variance AS base FROM cal CROSS JOIN entities LEFT JOIN vol ON vol.entity = entities.entity AND vol.date = cal.date),
leads AS (SELECT *, {", ".join(f"lead(base, {k}) OVER (PARTITION BY entity ORDER BY date) AS b{k}" for k in range(1, 6))},
  lead(date, 1) OVER (PARTITION BY entity ORDER BY date) AS outcome_start_date, lead(date, 5) OVER (PARTITION BY entity ORDER BY date) AS outcome_end_date FROM grid),
forward AS (SELECT entity, date, base, (b1 + b2 + b3 + b4 + b5) / 5 AS forward_mean, outcome_start_date, outcome_end_date FROM leads WHERE b1 + b2 + b3 + b4 + b5 IS NOT NULL),
stats AS (SELECT date, count(*) AS n_valid, sum(forward_mean) AS s FROM forward GROUP BY date),
rel AS (SELECT forward.*, n_valid, (s - forward_mean) / (n_valid - 1) AS peer_mean, forward_mean - (s - forward_mean) / (n_valid - 1) AS relative_target, forward_mean - s / n_valid AS demeaned_target
  FROM forward JOIN stats USING (date) WHERE n_valid >= 3)"""


def relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.peer_relative(L.forward_windows(vol(spark, sf_dir)))


@query(f"""WITH {FORWARD} SELECT entity, date, round(base, 7) AS base, round(forward_mean, 7) AS forward_mean, outcome_start_date, outcome_end_date, n_valid,
  round(peer_mean, 7) AS peer_mean, round(relative_target, 7) AS relative_target, round(demeaned_target, 7) AS demeaned_target FROM rel""")
def forward_mean_loo(spark, sf_dir):
    return rounded(relative(spark, sf_dir), 7)


NINE = ("unique_entity_date", "sorted_date_entity", "finite_target", "forward_mean_recomputed", "dates_strictly_ahead", "leave_one_out_excludes_self", "leave_one_out_algebra", "demeaned_daily_sum", "cross_section")


@query("SELECT * FROM (VALUES " + ", ".join(f"('{c}')" for c in NINE) + ") v(\"check\") CROSS JOIN (VALUES (true, 0::BIGINT)) w(passed, n_violations)")
def target_invariants(spark, sf_dir):
    panel = written(vol(spark, sf_dir).select("entity", "date", "log_variance"), "vol")
    return L.audit_target(L.peer_relative(L.forward_windows(panel)), panel)


PURGE = f"""{FORWARD}, {BLOCKS.format(d='date', t='rel')}, anchored AS (SELECT rel.*, blocks.split FROM rel JOIN blocks ON rel.date = d),
starts AS (SELECT min(date) FILTER (WHERE split = 'validation') AS v, min(date) FILTER (WHERE split = 'test') AS t FROM anchored),
purged AS (SELECT anchored.* FROM anchored, starts WHERE (split = 'train' AND outcome_end_date < v) OR (split = 'validation' AND outcome_end_date < t) OR split = 'test')"""


def anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.assign_split(relative(spark, sf_dir), "date")


@query(f"""WITH {PURGE} SELECT split, count(*) AS n_rows, count(DISTINCT date) AS n_dates, max(date) AS last_date, max(outcome_end_date) AS last_outcome FROM purged GROUP BY split""")
def purged_split(spark, sf_dir):
    return S.purge(anchored(spark, sf_dir)).groupBy("split").agg(F.count("*").alias("n_rows"), F.countDistinct("date").alias("n_dates"), F.max("date").alias("last_date"), F.max("outcome_end_date").alias("last_outcome"))


@query(f"""WITH {PURGE}, k AS (SELECT *, dense_rank() OVER (PARTITION BY split ORDER BY date) AS k FROM purged) SELECT split, count(*) AS n_rows, count(DISTINCT date) AS n_dates, min(date) AS first_date FROM k WHERE split = 'train' OR k > 2 GROUP BY split""")
def embargo_split(spark, sf_dir):
    return S.embargo(S.purge(anchored(spark, sf_dir)), 2).groupBy("split").agg(F.count("*").alias("n_rows"), F.countDistinct("date").alias("n_dates"), F.min("date").alias("first_date"))


@query(f"""WITH {PURGE} SELECT entity, date, split, CASE WHEN split = 'train' THEN -1 ELSE (dense_rank() OVER (PARTITION BY split ORDER BY date) - 1) % 5 END AS "offset" FROM purged""")
def offset_assignment(spark, sf_dir):
    return S.offsets(S.purge(anchored(spark, sf_dir)), 5).select("entity", "date", "split", F.col("offset").cast("long").alias("offset"))


@query(f"""WITH {PURGE}, k AS (SELECT *, dense_rank() OVER (PARTITION BY split ORDER BY date) AS up, dense_rank() OVER (PARTITION BY split ORDER BY date DESC) AS down FROM purged)
  SELECT split, min(date) AS first_date, max(date) AS last_date, count(*) AS n_rows FROM k WHERE CASE WHEN split = 'train' THEN down ELSE up END <= 10 GROUP BY split""")
def trim_split_dates(spark, sf_dir):
    return S.trim_dates(S.purge(anchored(spark, sf_dir)), 10).groupBy("split").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("n_rows"))


@query(f"""WITH {PURGE}, o AS (SELECT DISTINCT split, d FROM (SELECT split, outcome_start_date AS d FROM purged UNION ALL SELECT split, outcome_end_date FROM purged))
  SELECT count(*) AS n_shared FROM o a JOIN o b ON a.d = b.d AND a.split < b.split""")
def shared_outcomes(spark, sf_dir):
    return S.shared_outcomes(S.purge(anchored(spark, sf_dir))).agg(F.count("*").alias("n_shared"))


@query(f"""WITH {PURGE} SELECT split, count(*) AS n_rows, count(DISTINCT date) AS n_dates, count(DISTINCT entity) AS n_entities, round(avg(relative_target), 7) AS mean_target, round(stddev_samp(relative_target), 7) AS std_target,
  round(max(relative_target) - min(relative_target), 7) AS spread FROM purged GROUP BY split""")
def sector_relative_target(spark, sf_dir):
    """Flagship: bars, range volatility, forward windows, peers, split and purge in one plan."""
    return S.purge(anchored(spark, sf_dir)).groupBy("split").agg(
        F.count("*").alias("n_rows"), F.countDistinct("date").alias("n_dates"), F.countDistinct("entity").alias("n_entities"), r(F.avg("relative_target"), 7, "mean_target"), r(F.stddev_samp("relative_target"), 7, "std_target"),
        r(F.max("relative_target") - F.min("relative_target"), 7, "spread"),
    )


RESID = f"""{SPLIT}, resid AS (SELECT *, target - har_weekly AS residual FROM splitted),
thr AS (SELECT entity, quantile_cont(abs(residual), 0.5) AS q50, quantile_cont(abs(residual), 0.9) AS q90, quantile_cont(abs(residual), 0.95) AS q95, avg(residual) AS center,
  greatest(coalesce(stddev_samp(residual), 0), 1e-12) AS scale, count(*) AS n FROM resid WHERE split = 'train' GROUP BY entity)"""


def residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitted(spark, sf_dir).withColumn("residual", F.col("target") - F.col("har_weekly"))


QUANTILES = {"q50": 0.5, "q90": 0.9, "q95": 0.95}


@query(f"WITH {RESID} SELECT entity, round(q50, 7) AS q50, round(q90, 7) AS q90, round(q95, 7) AS q95, round(center, 7) AS center, round(scale, 7) AS scale, n FROM thr")
def train_thresholds(spark, sf_dir):
    return rounded(L.fit_thresholds(residuals(spark, sf_dir), "residual", QUANTILES), 7)


@query(f"""WITH {RESID} SELECT entity, date, CAST(abs(residual) > q90 AS INT) AS spike_q90, CAST(abs(residual) > q95 AS INT) AS spike_q95,
  CASE WHEN q50 IS NULL THEN NULL WHEN abs(residual) <= q50 THEN 0 WHEN abs(residual) <= q90 THEN 1 ELSE 2 END AS regime FROM resid LEFT JOIN thr USING (entity)""")
def spike_labels(spark, sf_dir):
    frame = residuals(spark, sf_dir)
    return L.spike_labels(frame, "residual", L.fit_thresholds(frame, "residual", QUANTILES)).select("entity", "date", "spike_q90", "spike_q95", "regime")


@query(f"""WITH {RESID}, z AS (SELECT resid.entity, date, split, (residual - center) / scale AS z FROM resid LEFT JOIN thr USING (entity)),
  q AS (SELECT quantile_cont(abs(z), 0.5) AS q50, quantile_cont(abs(z), 0.9) AS q90, quantile_cont(abs(z), 0.95) AS q95 FROM z WHERE split = 'train')
  SELECT entity, date, round(z, 7) AS standardized, CAST(abs(z) > q90 AS INT) AS spike_q90_pooled, CAST(abs(z) > q95 AS INT) AS spike_q95_pooled,
  CASE WHEN abs(z) <= q50 THEN 0 WHEN abs(z) <= q90 THEN 1 WHEN z IS NOT NULL THEN 2 END AS regime_pooled FROM z, q""")
def pooled_spike_labels(spark, sf_dir):
    frame = residuals(spark, sf_dir)
    return rounded(L.pooled_labels(frame, "residual", L.fit_thresholds(frame, "residual", QUANTILES)).select("entity", "date", "standardized", "spike_q90_pooled", "spike_q95_pooled", "regime_pooled"), 7)


LEVELS = f"""{SPLIT}, lthr AS (SELECT entity, quantile_cont(abs(target), 0.1) AS q50, quantile_cont(abs(target), 0.5) AS q90 FROM splitted WHERE split = 'train' GROUP BY entity)"""


@query(f"WITH {LEVELS} SELECT CASE WHEN q50 IS NULL THEN NULL WHEN abs(target) <= q50 THEN 0 WHEN abs(target) <= q90 THEN 1 ELSE 2 END AS regime, split, count(*) AS n FROM splitted LEFT JOIN lthr USING (entity) GROUP BY ALL")
def regime_labels(spark, sf_dir):
    frame = splitted(spark, sf_dir)
    thresholds = L.fit_thresholds(frame, "target", {"q50": 0.1, "q90": 0.5, "q95": 0.95}, sample_deviation=False)
    return L.spike_labels(frame, "target", thresholds).groupBy("regime", "split").agg(F.count("*").alias("n"))


@query(f"""WITH {RESID}, s AS (SELECT date, entity, residual, CAST(abs(residual) > q90 AS INT) AS spike FROM resid LEFT JOIN thr USING (entity))
  SELECT date, count(DISTINCT entity) AS n_entities, round(avg(residual), 7) AS sector_mean, round(stddev_samp(residual), 7) AS sector_std, round(avg(spike), 7) AS spike_breadth, sum(spike)::BIGINT AS spike_count,
  CAST(sum(spike) >= 3 AS INT) AS spike_at_least_3, CAST(sum(spike) >= 5 AS INT) AS spike_at_least_5, CAST(sum(spike) >= 6 AS INT) AS spike_at_least_6 FROM s GROUP BY date""")
def sector_breadth(spark, sf_dir):
    frame = residuals(spark, sf_dir)
    labelled = L.spike_labels(frame, "residual", L.fit_thresholds(frame, "residual", QUANTILES))
    return rounded(L.sector_panel(labelled, "residual"), 7)


@query(f"""WITH {RESID}, s AS (SELECT entity, date, CASE WHEN q50 IS NULL THEN NULL WHEN abs(residual) <= q50 THEN 0 WHEN abs(residual) <= q90 THEN 1 ELSE 2 END AS state FROM resid LEFT JOIN thr USING (entity)),
  p AS (SELECT state, lead(state) OVER (PARTITION BY entity ORDER BY date) AS next_state FROM s), c AS (SELECT state, next_state, count(*) AS n FROM p WHERE state IS NOT NULL AND next_state IS NOT NULL GROUP BY ALL)
  SELECT state, next_state, n, round(n / sum(n) OVER (PARTITION BY state), 8) AS share FROM c""")
def transition_matrix(spark, sf_dir):
    frame = residuals(spark, sf_dir)
    labelled = L.spike_labels(frame, "residual", L.fit_thresholds(frame, "residual", QUANTILES))
    return rounded(M.transition_matrix(labelled, "regime"))


@query("SELECT split, count(*) AS n_dates, min(feature_date) AS first_date, max(feature_date) AS last_date, min(date_index) AS first_index, max(date_index) AS last_index FROM split_calendar GROUP BY split")
def given_calendar(spark, sf_dir):
    return table(spark, sf_dir, "split_calendar").groupBy("split").agg(F.count("*").alias("n_dates"), F.min("feature_date").alias("first_date"), F.max("feature_date").alias("last_date"), F.min("date_index").alias("first_index"), F.max("date_index").alias("last_index"))
