"""Queries on representations, gates, placebos, diagnostics and replicated evaluation."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions import expr as X
from barloom.operators import events as E
from barloom.operators import labels as L
from barloom.operators import metrics as K
from barloom.operators import models as O
from barloom.operators import pooling as P
from barloom.operators import representations as R
from barloom.operators import splits as S
from barloom.plans import algebra as A
from barloom.plans.catalog import query, r, rounded, table
from barloom.plans.forecasts import LOSS, PREDS, TICK, long, tick, wide
from barloom.plans.market import UNIVERSE
from barloom.plans.news import ALL, ASSIGNED, EDGES, ONTOLOGY, PANEL, VEC, assigned, events, panel
from barloom.plans.targets import QUANTILES, RESID, SPLIT, residuals, splitted
from barloom.session import written


@query(f"WITH {TICK} SELECT date, " + ", ".join(f"round(max(v) FILTER (WHERE ticker = '{t}'), 8) AS {t}" for t in ALL) + " FROM tick GROUP BY date")
def pivot_wide(spark, sf_dir):
    return rounded(R.pivoted(tick(spark, sf_dir), "date", "ticker", "v", ALL))


@query("SELECT source, ticker, feature_date, min(source_row_number) AS source_row_number, arg_min(close, source_row_number) AS close FROM (SELECT source_row_number, upper(trim(source)) AS source, upper(trim(ticker)) AS ticker, feature_date, coalesce(close, -1) AS close FROM inspect_schema) GROUP BY ALL")
def dedup_keep_first(spark, sf_dir):
    rows = table(spark, sf_dir, "inspect_schema").select("source_row_number", F.upper(F.trim("source")).alias("source"), F.upper(F.trim("ticker")).alias("ticker"), "feature_date", F.coalesce("close", F.lit(-1.0)).alias("close"))
    return R.keep_one(rows, ["source", "ticker", "feature_date"], "source_row_number")


@query("SELECT source, ticker, feature_date, max(source_row_number) AS source_row_number, arg_max(close, source_row_number) AS close FROM (SELECT source_row_number, upper(trim(source)) AS source, upper(trim(ticker)) AS ticker, feature_date, coalesce(close, -1) AS close FROM inspect_schema) GROUP BY ALL")
def dedup_keep_last(spark, sf_dir):
    rows = table(spark, sf_dir, "inspect_schema").select("source_row_number", F.upper(F.trim("source")).alias("source"), F.upper(F.trim("ticker")).alias("ticker"), "feature_date", F.coalesce("close", F.lit(-1.0)).alias("close"))
    return R.keep_one(rows, ["source", "ticker", "feature_date"], "source_row_number", last=True)


SAME = f"{PANEL}, {EDGES}, {VEC}, inst AS (SELECT edges.event_id, edges.ticker, date, news_level FROM edges JOIN panel ON edges.ticker = panel.ticker AND event_date = date JOIN vec USING (event_id))"


def frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = panel(spark, sf_dir)
    pooled = P.pooled(P.event_sets(events(spark, sf_dir), ALL), table(spark, sf_dir, "event_vectors"), rows, "mean", 64)
    return R.assembled(rows, pooled, E.LEVELS, 64)


@query(f"WITH {SAME}, c AS (SELECT ticker, date, " + ", ".join(f"count(*) FILTER (WHERE news_level = '{v}') AS n__{v}" for v in E.LEVELS) + " FROM inst GROUP BY ALL) SELECT ticker, date, " + ", ".join(f"coalesce(n__{v}, 0) AS n__{v}, 64 AS d__{v}" for v in E.LEVELS) + " FROM panel LEFT JOIN c USING (ticker, date)")
def representation_frame(spark, sf_dir):
    out = frame(spark, sf_dir)
    return out.select("ticker", "date", *(c for v in E.LEVELS for c in (f"n__{v}", F.size(f"x__{v}").alias(f"d__{v}"))))


@query(f"WITH {SAME}, n AS (SELECT ticker, date, (max(norm) > 0) AS has_news FROM (SELECT inst.*, list_sum(list_transform(embedding, lambda v: abs(v))) AS norm FROM inst JOIN vec USING (event_id) WHERE news_level = 'target') GROUP BY ALL) SELECT coalesce(has_news, false) AS has_news, count(*) AS n_rows, count(DISTINCT ticker) AS n_tickers FROM panel LEFT JOIN n USING (ticker, date) GROUP BY 1")
def news_presence_gate(spark, sf_dir):
    return frame(spark, sf_dir).groupBy(R.presence_gate("x__target").alias("has_news")).agg(F.count("*").alias("n_rows"), F.countDistinct("ticker").alias("n_tickers"))


@query("WITH c AS (" + " UNION ALL ".join(f"SELECT 'event_type__{v}' AS \"column\", count(*) FILTER (WHERE lower(trim(event_type)) = '{v}')::DOUBLE AS total FROM (SELECT DISTINCT * FROM structured_events)" for v in ONTOLOGY) + ") SELECT \"column\", total, total >= 200 AS kept FROM c")
def rare_feature_filter(spark, sf_dir):
    counts = P.structured_counts(table(spark, sf_dir, "structured_events").distinct(), ["target_ticker", "feature_date"], "event_type", list(ONTOLOGY))
    return R.feature_totals(counts, [f"event_type__{v}" for v in ONTOLOGY], 200)


@query(f"""WITH {SPLIT}, c AS (SELECT entity, quantile_cont(log_variance, 0.33) AS a, quantile_cont(log_variance, 0.67) AS b FROM splitted WHERE split = 'train' GROUP BY entity)
  SELECT entity, date, CAST(log_variance > a AND log_variance <= b AS INT)::DOUBLE AS regime_middle, CAST(log_variance > b AS INT)::DOUBLE AS regime_high, round(CASE WHEN log_variance > a AND log_variance <= b THEN har_weekly ELSE 0 END, 7) + 0.0 AS har_weekly__middle,
  round(CASE WHEN log_variance > b THEN har_weekly ELSE 0 END, 7) + 0.0 AS har_weekly__high FROM splitted JOIN c USING (entity)""")
def regime_interactions(spark, sf_dir):
    out = R.regime_interactions(splitted(spark, sf_dir), "log_variance", ["har_weekly"], F.col("split") == "train")
    return out.select("entity", "date", "regime_middle", "regime_high", *((F.round(f"har_weekly__{k}", 7) + 0.0).alias(f"har_weekly__{k}") for k in ("middle", "high")))


@query(f"WITH {EDGES}, u AS (SELECT unnest({ALL!r}) AS ticker) SELECT u.ticker, count(event_id) AS n_events, count(DISTINCT event_date) AS n_days FROM u LEFT JOIN edges ON u.ticker = edges.ticker AND news_level = 'target' GROUP BY u.ticker")
def ticker_coverage(spark, sf_dir):
    universe = spark.createDataFrame([(t,) for t in UNIVERSE], "ticker string")
    own = P.edges(events(spark, sf_dir), ALL).filter("news_level = 'target'").groupBy("ticker").agg(F.count("event_id").alias("n_events"), F.countDistinct("event_date").alias("n_days"))
    return universe.join(own, "ticker", "left").na.fill(0, ["n_events", "n_days"])


@query(f"""WITH {ASSIGNED}, tr AS (SELECT prototype, count(*) AS k FROM assigned JOIN analyze_prototypes USING (event_id) WHERE lower(trim(split)) = 'train' GROUP BY prototype),
  e AS (SELECT prototype AS placebo, (sum(k) OVER (ORDER BY prototype) - k) / sum(k) OVER () AS low, sum(k) OVER (ORDER BY prototype) / sum(k) OVER () AS high FROM tr),
  u AS (SELECT event_id, ('0x' || substr(sha256('991|' || event_id), 1, 8))::BIGINT / 4294967296.0 AS u FROM analyze_prototypes) SELECT placebo, count(*) AS n FROM u JOIN e ON u >= low AND u < high GROUP BY placebo""")
def random_prototype_placebo(spark, sf_dir):
    train = assigned(spark, sf_dir).join(events(spark, sf_dir).filter("split = 'train'").select("event_id"), "event_id")
    return R.random_labels(events(spark, sf_dir), train, "event_id", "prototype", 991).groupBy("placebo").agg(F.count("*").alias("n"))


def _perm(seed: int) -> str:
    h = "('0x' || substr(sha256('{s}|' || event_id), 1, 15))::BIGINT"
    return f"row_number() OVER (PARTITION BY split ORDER BY {h.format(s=seed)}) AS i, row_number() OVER (PARTITION BY split ORDER BY {h.format(s=seed + 1)}) AS j"


@query(f"WITH b AS (SELECT event_id, lower(trim(split)) AS split, news_level FROM analyze_prototypes WHERE split IS NOT NULL), p AS (SELECT *, {_perm(5)} FROM b) SELECT a.split, a.event_id, c.news_level AS permuted FROM p a JOIN p c ON a.split = c.split AND a.i = c.j")
def permuted_rows(spark, sf_dir):
    return R.permuted(events(spark, sf_dir).filter("split is not null"), ["split"], "event_id", "news_level", 5)


@query(f"WITH s AS (SELECT event_id, min(lower(trim(event_type))) AS event_type FROM structured_events GROUP BY event_id), b AS (SELECT s.event_id, lower(trim(split)) AS split, event_type FROM s JOIN analyze_prototypes USING (event_id) WHERE split IS NOT NULL), p AS (SELECT *, {_perm(11)} FROM b) SELECT a.split, c.event_type AS permuted, count(*) AS n, count(*) FILTER (WHERE a.event_type = c.event_type) AS n_same FROM p a JOIN p c ON a.split = c.split AND a.i = c.j GROUP BY ALL")
def shuffled_event_types(spark, sf_dir):
    own = table(spark, sf_dir, "structured_events").groupBy("event_id").agg(F.min(F.lower(F.trim("event_type"))).alias("event_type"))
    base = own.join(events(spark, sf_dir).select("event_id", "split").filter("split is not null"), "event_id")
    dealt = R.permuted(base, ["split"], "event_id", "event_type", 11)
    both = dealt.join(base.select("event_id", "event_type"), "event_id")
    return both.groupBy("split", "permuted").agg(F.count("*").alias("n"), F.count_if(F.col("permuted") == F.col("event_type")).alias("n_same"))


@query(f"""WITH {ASSIGNED}, cv AS MATERIALIZED (SELECT event_id, prototype AS label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM assigned JOIN usable USING (event_id)),
  cp AS (SELECT a.event_id, a.label AS own, b.label AS other, sum(1 - list_dot_product(a.u, b.u)) AS d, count(*) FILTER (WHERE a.event_id <> b.event_id) AS k FROM cv a JOIN cv b ON true GROUP BY ALL),
  cs AS (SELECT event_id, own AS label, max(CASE WHEN other = own AND k > 0 THEN d / k END) AS a, min(CASE WHEN other <> own THEN d / k END) AS b FROM cp GROUP BY ALL),
  cm AS (SELECT label, list(c ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS c FROM (SELECT label, generate_subscripts(u, 1) AS i, unnest(u) AS x FROM cv) GROUP BY ALL) GROUP BY label),
  cr AS (SELECT label, count(*) AS n, avg(sqrt(greatest(list_dot_product(u, u) - 2 * list_dot_product(u, c) + list_dot_product(c, c), 0))) AS scatter FROM cv JOIN cm USING (label) GROUP BY label),
  cd AS (SELECT x.label, max((p.scatter + q.scatter) / sqrt(list_dot_product(x.c, x.c) - 2 * list_dot_product(x.c, y.c) + list_dot_product(y.c, y.c))) AS davies_bouldin FROM cm x JOIN cm y ON x.label <> y.label JOIN cr p ON p.label = x.label JOIN cr q ON q.label = y.label GROUP BY x.label)
  SELECT cr.label AS prototype, n, round(silhouette, 6) + 0.0 AS silhouette, round(scatter, 6) AS scatter, round(davies_bouldin, 5) AS davies_bouldin FROM cr LEFT JOIN cd USING (label) JOIN (SELECT label, avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END) AS silhouette FROM cs GROUP BY label) USING (label)""")
def cluster_quality(spark, sf_dir):
    labelled = assigned(spark, sf_dir).select("event_id", "prototype").join(table(spark, sf_dir, "event_vectors").filter("embedding is not null").distinct(), "event_id")
    return rounded(R.cluster_quality(labelled, "prototype", "embedding", 64), 6).withColumns({"silhouette": F.col("silhouette") + 0.0, "davies_bouldin": F.round("davies_bouldin", 5)})


@query(f"""WITH {ASSIGNED}, u AS (SELECT prototype, count(*) AS n FROM assigned GROUP BY prototype), s AS (SELECT n / (SELECT sum(n) FROM u) AS p, n FROM u)
  SELECT 10 AS k, round(exp(-sum(p * ln(p))), 7) AS effective_number, round(1 - count(*) / 10, 7) AS dead_fraction, round((10 - count(*) + count(*) FILTER (WHERE n < 50)) / 10, 7) AS small_fraction FROM s""")
def usage_diagnostics(spark, sf_dir):
    use = assigned(spark, sf_dir).groupBy("prototype").agg(F.count("*").alias("n"))
    total = use.agg(F.sum("n").alias("total"))
    p = F.col("n") / F.col("total")
    return use.crossJoin(F.broadcast(total)).agg(F.lit(10).alias("k"), r(F.exp(-F.sum(p * F.ln(p))), 7, "effective_number"), r(1 - F.count("*") / 10, 7, "dead_fraction"), r((10 - F.count("*") + F.count_if(F.col("n") < 50)) / 10, 7, "small_fraction"))


CROSS = f"{TICK}, resp0 AS (SELECT ticker, date, v - avg(v) OVER (PARTITION BY ticker) AS residual FROM tick), resp AS (SELECT *, CAST(abs(residual) > 1 AS INT) AS spike FROM resp0), d AS (SELECT DISTINCT feature_date AS date, coalesce(prototype_id, -1) AS prototype FROM analyze_prototypes)"


@query(f"""WITH {CROSS}, b AS (SELECT d.date, prototype, residual, spike FROM d JOIN resp ON d.date = resp.date), c AS (SELECT *, avg(residual) OVER (PARTITION BY date, prototype) AS m FROM b)
  SELECT date, prototype, count(*) AS n_stocks, round(avg(spike), 7) AS breadth, round(greatest(avg(CAST(residual >= 0 AS INT)), avg(CAST(residual < 0 AS INT))), 7) AS same_sign, round(avg(residual), 7) + 0.0 AS common, round(avg(abs(residual)), 7) AS mean_absolute, round(avg(abs(residual - m)), 7) AS firm_specific FROM c GROUP BY ALL""")
def daily_cross_stock(spark, sf_dir):
    base = tick(spark, sf_dir)
    means = F.broadcast(base.groupBy("ticker").agg(F.avg("v").alias("m")))
    responses = base.join(means, "ticker").select("ticker", "date", (F.col("v") - F.col("m")).alias("residual")).withColumn("spike", (F.abs("residual") > 1).cast("int"))
    days = table(spark, sf_dir, "analyze_prototypes").select(F.col("feature_date").alias("date"), F.coalesce("prototype_id", F.lit(-1)).alias("prototype"))
    return rounded(R.cross_stock(days, responses, ["prototype"]), 7).withColumn("common", F.col("common") + 0.0)


@query(f"""WITH {SPLIT}, dd AS (SELECT target_date AS d, row_number() OVER (ORDER BY target_date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT target_date FROM splitted WHERE split = 'train'))
  SELECT CASE WHEN i < least(greatest(floor(n * 0.85::DOUBLE), 63), n - 1) THEN 'prefix' ELSE 'tail' END AS "window", count(*) AS n_rows, min(target_date) AS first_date, max(target_date) AS last_date FROM splitted JOIN dd ON target_date = d WHERE split = 'train' AND n > 63 GROUP BY 1""")
def screening_windows(spark, sf_dir):
    return R.screening_windows(splitted(spark, sf_dir), 0.15, 63).groupBy("window").agg(F.count("*").alias("n_rows"), F.min("target_date").alias("first_date"), F.max("target_date").alias("last_date"))


@query(f"""WITH {SPLIT}, dd AS (SELECT target_date AS d, row_number() OVER (ORDER BY target_date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT target_date FROM splitted)),
  sz AS (SELECT *, CASE WHEN n - 3 * greatest(20, (n - 60) // 3) < 60 THEN (n - 60) // 3 ELSE greatest(20, (n - 60) // 3) END AS size FROM dd WHERE n >= 120), gg AS (SELECT d, i, n, size, fold, n - 3 * size + (fold - 1) * size AS s FROM sz, (VALUES (1), (2), (3)) f(fold) WHERE size >= 20)
  SELECT fold, max(d) FILTER (WHERE i < s) AS train_end, min(d) FILTER (WHERE i >= s AND i < s + size) AS validation_start, max(d) FILTER (WHERE i >= s AND i < s + size) AS validation_end, count(*) FILTER (WHERE i < s) AS n_train_dates, count(*) FILTER (WHERE i >= s AND i < s + size) AS n_validation_dates FROM gg GROUP BY fold""")
def refit_folds(spark, sf_dir):
    return R.refit_folds(splitted(spark, sf_dir), 3, 60, 20)


OFF = f"{PREDS}, od AS (SELECT split, date, (row_number() OVER (PARTITION BY split ORDER BY date) - 1) % 5 AS o FROM (SELECT DISTINCT split, date FROM long WHERE split <> 'train')), om AS (SELECT long.split, model, o AS \"offset\", count(*) AS n, avg(abs(y - p)) AS mae, sqrt(avg((y - p) * (y - p))) AS rmse FROM long JOIN od ON long.split = od.split AND long.date = od.date GROUP BY ALL)"


def _offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.offsets(long(spark, sf_dir), 5).filter("offset >= 0")
    e = F.col("y") - F.col("p")
    return rows.groupBy("split", "model", F.col("offset").cast("long").alias("offset")).agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))


@query(f'WITH {OFF} SELECT split, model, "offset", n, round(mae, 7) AS mae, round(rmse, 7) AS rmse FROM om')
def offset_evaluation(spark, sf_dir):
    return rounded(_offsets(spark, sf_dir), 7)


@query(f'WITH {OFF} SELECT split, model, count(DISTINCT "offset") AS n_offsets, round(avg(mae), 7) AS mean_mae, round(stddev_samp(mae), 7) AS std_mae, arg_max("offset", mae) AS worst_offset, arg_min("offset", mae) AS best_offset FROM om GROUP BY split, model')
def offset_aggregate(spark, sf_dir):
    return rounded(_offsets(spark, sf_dir).groupBy("split", "model").agg(F.countDistinct("offset").alias("n_offsets"), F.avg("mae").alias("mean_mae"), F.stddev_samp("mae").alias("std_mae"), F.max_by("offset", "mae").alias("worst_offset"), F.min_by("offset", "mae").alias("best_offset")), 7)


@query(f"WITH {LOSS}, dq AS (SELECT quantile_cont(abs(absolute_gain), 0.95) AS q FROM daily WHERE split = 'test') SELECT count(*) AS n_kept, round(avg(absolute_gain), 8) AS trimmed_mean FROM daily, dq WHERE split = 'test' AND abs(absolute_gain) <= q")
def trim_extreme(spark, sf_dir):
    from barloom.plans.forecasts import daily

    own = daily(spark, sf_dir).filter("split = 'test'")
    cut = own.agg(F.percentile(F.abs("absolute_gain"), F.lit(0.95)).alias("q"))
    return own.crossJoin(F.broadcast(cut)).filter(F.abs("absolute_gain") <= F.col("q")).agg(F.count("*").alias("n_kept"), r(F.avg("absolute_gain"), 8, "trimmed_mean"))


@query(f"""WITH {PREDS}, m AS (SELECT entity, avg(abs(y - m0)) AS a, avg(abs(y - m1)) AS b FROM preds WHERE split = 'test' GROUP BY entity) SELECT count(*) AS n_cells, round(avg((a - b) / greatest(abs(a), 1e-12)), 7) AS mean_gain, round(stddev_samp((a - b) / greatest(abs(a), 1e-12)), 7) AS std_gain, round(avg(CAST(b < a AS INT)), 7) AS win_rate FROM m""")
def robustness_summary(spark, sf_dir):
    cells = wide(spark, sf_dir).filter("split = 'test'").groupBy("entity").agg(F.avg(F.abs(F.col("y") - F.col("m0"))).alias("a"), F.avg(F.abs(F.col("y") - F.col("m1"))).alias("b"))
    g = X.gain(F.col("a"), F.col("b"), True)
    return cells.agg(F.count("*").alias("n_cells"), r(F.avg(g), 7, "mean_gain"), r(F.stddev_samp(g), 7, "std_gain"), r(F.avg((F.col("b") < F.col("a")).cast("double")), 7, "win_rate"))


@query(f"""WITH {RESID}, x AS (SELECT split, CASE WHEN abs(residual) <= q50 THEN 0 WHEN abs(residual) <= q90 THEN 1 ELSE 2 END AS stratum, abs(target - har_monthly) - abs(target - (har_weekly + har_daily) / 2) AS gain FROM resid JOIN thr USING (entity))
  SELECT split, stratum, count(*) AS n, round(avg(gain), 7) AS mean_gain, round(avg(CAST(gain > 0 AS INT)), 7) AS win_rate FROM x GROUP BY ALL""")
def paired_by_stratum(spark, sf_dir):
    frame_ = residuals(spark, sf_dir)
    labelled = L.spike_labels(frame_, "residual", L.fit_thresholds(frame_, "residual", QUANTILES)).filter("q50 is not null")
    g = F.abs(F.col("target") - F.col("har_monthly")) - F.abs(F.col("target") - (F.col("har_weekly") + F.col("har_daily")) / 2)
    return rounded(labelled.withColumn("gain", g).groupBy("split", F.col("regime").alias("stratum")).agg(F.count("*").alias("n"), F.avg("gain").alias("mean_gain"), F.avg((F.col("gain") > 0).cast("double")).alias("win_rate")), 7)


@query("""WITH v AS (SELECT DISTINCT event_id, embedding FROM event_vectors WHERE embedding IS NOT NULL), c AS (SELECT lower(trim(split)) AS split, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS e FROM v JOIN analyze_prototypes USING (event_id)),
  d AS (SELECT i, (avg(e) FILTER (WHERE split = 'test') - avg(e) FILTER (WHERE split = 'train')) / sqrt((var_samp(e) FILTER (WHERE split = 'train') + var_samp(e) FILTER (WHERE split = 'test')) / 2) AS smd FROM c GROUP BY i)
  SELECT count(*) AS n_dims, round(avg(abs(smd)), 6) AS mean_abs_smd, round(max(abs(smd)), 6) AS max_abs_smd FROM d""")
def vector_shift(spark, sf_dir):
    rows = table(spark, sf_dir, "event_vectors").filter("embedding is not null").distinct().join(events(spark, sf_dir).select("event_id", "split"), "event_id")

    def stats(split: str):
        own = [F.when(F.col("split") == split, F.col("embedding")[k].cast("double")) for k in range(64)]
        return F.array(*map(F.avg, own)), F.array(*map(F.var_samp, own))

    (a, va), (b, vb) = stats("train"), stats("test")
    one = rows.agg(a.alias("a"), va.alias("va"), b.alias("b"), vb.alias("vb")).select(F.explode(F.arrays_zip("a", "va", "b", "vb")).alias("d"))
    smd = F.abs((F.col("d.b") - F.col("d.a")) / F.sqrt((F.col("d.va") + F.col("d.vb")) / 2))
    return one.agg(F.count("*").alias("n_dims"), r(F.avg(smd), 6, "mean_abs_smd"), r(F.max(smd), 6, "max_abs_smd"))


@query(f"""WITH RECURSIVE {PREDS}, ce AS (SELECT split, model, entity, avg(abs(y - p)) AS mae FROM long GROUP BY ALL), st AS (SELECT split, model, avg(mae) AS mean, stddev_samp(mae) AS std, count(mae) AS n FROM ce GROUP BY ALL),
  bi(df, k, low, high) AS (SELECT DISTINCT n - 1, 0, 0.0::DOUBLE, 700.0::DOUBLE FROM st WHERE n > 1 UNION ALL SELECT df, k + 1, CASE WHEN {A.within_t('((low + high) / 2)', 'df')} < 0.95 THEN (low + high) / 2 ELSE low END, CASE WHEN {A.within_t('((low + high) / 2)', 'df')} < 0.95 THEN high ELSE (low + high) / 2 END FROM bi WHERE k < 60)
  SELECT split, model, round(mean, 7) AS mean, round(std, 7) AS std, n, round((low + high) / 2 * std / sqrt(n), 6) AS half_width FROM st LEFT JOIN bi ON df = n - 1 AND k = 60""")
def confidence_intervals(spark, sf_dir):
    from barloom.functions.stats import half_width

    cells = long(spark, sf_dir).groupBy("split", "model", "entity").agg(F.avg(F.abs(F.col("y") - F.col("p"))).alias("mae"))
    stats = cells.groupBy("split", "model").agg(F.avg("mae").alias("mean"), F.stddev_samp("mae").alias("std"), F.count("mae").alias("n"))
    return stats.withColumn("half_width", F.round(half_width(F.col("std"), F.col("n")), 6)).withColumns({"mean": F.round("mean", 7), "std": F.round("std", 7)})


HAR = ["har_daily", "har_weekly", "har_monthly"]


@query(f"WITH {SPLIT} SELECT split, count(*) AS n, (SELECT 3 + count(DISTINCT entity) FROM splitted WHERE split = 'train') AS n_features, 0.0::DOUBLE AS gradient FROM splitted GROUP BY split")
def baseline_b2(spark, sf_dir):
    """Pooled ridge on scaled features and one-hot entities; `gradient` is its distance from the optimum."""
    data = written(splitted(spark, sf_dir), "b2")
    train = data.filter("split = 'train'")
    how = O.fit_preparation(train, HAR, [])
    ready = O.prepare(data, how)
    (model,) = O.fit_grouped(ready.filter("split = 'train'"), how.names, "target", "entity", (1.0,))
    gradient = abs(round(O.grouped_gradient(ready.filter("split = 'train'"), model, "target"), 6))
    n_features = len(how.names) + model.moments.filter("entity is not null").count()
    return O.predict_grouped(ready, {"prediction": model}).groupBy("split").agg(F.count("prediction").alias("n"), F.lit(n_features).cast("long").alias("n_features"), F.lit(gradient).alias("gradient"))


@query(f"WITH {SPLIT} SELECT split, count(*) AS n, 0.0::DOUBLE AS violation FROM splitted GROUP BY split")
def elastic_net(spark, sf_dir):
    """`violation`: how far the weights are from the optimality conditions."""
    data = written(splitted(spark, sf_dir), "net")
    train = data.filter("split = 'train'")
    model = O.fit_elastic_net(train, HAR, "target", 0.01, 0.5)
    violation = abs(round(O.elastic_violation(train, model, "target", 0.01, 0.5), 6))
    return O.predict_linear(data, model).groupBy("split").agg(F.count("prediction").alias("n"), F.lit(violation).alias("violation"))


@query(f"WITH {SPLIT} SELECT split, count(*) AS n, 0.0::DOUBLE AS gradient, true AS chosen_is_least FROM splitted GROUP BY split")
def chosen_logistic(spark, sf_dir):
    """Penalty chosen on the later part of train; the refit's distance from the optimum, and whether the
    choice has the least log loss of the grid there."""
    data = written(splitted(spark, sf_dir).withColumn("spike", (F.col("target") > F.col("har_monthly") + 1).cast("int")), "chosen")
    windows = written(R.screening_windows(data, 0.15, 63), "windows")
    prefix, tail = windows.filter("window = 'prefix'"), windows.filter("window = 'tail'")
    grid = (0.01, 1.0, 100.0)
    c = O.choose_strength(prefix, tail, HAR, "spike", grid)
    p, y = F.least(F.greatest(F.col("probability"), F.lit(1e-12)), F.lit(1 - 1e-12)), F.col("spike")
    loss = {g: O.predict_probability(tail, O.fit_logistic(prefix, HAR, "spike", g)).agg(F.avg(-(y * F.ln(p) + (1 - y) * F.ln(1 - p)))).first()[0] for g in grid}
    train = data.filter("split = 'train'")
    model = O.fit_logistic(train, HAR, "spike", c)
    gradient = abs(round(O.logistic_gradient(train, model, "spike", c), 6))
    return O.predict_probability(data, model).groupBy("split").agg(F.count("probability").alias("n"), F.lit(gradient).alias("gradient"), F.lit(bool(loss[c] <= min(loss.values()) + 1e-9)).alias("chosen_is_least"))


@query(f"WITH {RESID} SELECT split, count(*) AS n, 0.0::DOUBLE AS gradient, 1.0::DOUBLE AS total FROM resid JOIN thr USING (entity) GROUP BY split")
def regime_multinomial(spark, sf_dir):
    """`gradient`: the largest entry of the penalised score over train (to three digits); `total`: the
    mean sum of the class probabilities."""
    frame_ = residuals(spark, sf_dir)
    data = written(L.spike_labels(frame_, "residual", L.fit_thresholds(frame_, "residual", QUANTILES)).filter("regime is not null"), "regimes")
    model = O.fit_multinomial(data.filter("split = 'train'"), HAR, "regime")
    from pyspark.ml.functions import array_to_vector, vector_to_array

    scored = written(model.transform(O.column_vector(data, HAR).withColumn("features", array_to_vector("__x"))).select("split", "regime", *HAR, vector_to_array("probability").alias("q")), "scored")
    train = scored.filter("split = 'train'")
    n = train.count()
    e = [F.col("q")[k] - (F.col("regime") == k).cast("double") for k in range(3)]
    one = train.agg(*(F.avg(e[k] * F.col(f)).alias(f"g{k}_{i}") for k in range(3) for i, f in enumerate(HAR))).first()
    score = [one[f"g{k}_{i}"] + model.coefficientMatrix[k, i] / n for k in range(3) for i in range(3)]
    return scored.groupBy("split").agg(F.count("*").alias("n"), F.lit(abs(round(max(map(abs, score)), 3))).alias("gradient"), r(F.avg(F.col("q")[0] + F.col("q")[1] + F.col("q")[2]), 7, "total"))


@query(f"WITH {RESID} SELECT split, count(*) AS n, true AS between_0_and_1, true AS no_worse_than_constant FROM resid GROUP BY split")
def mlp_spikes(spark, sf_dir):
    """A small neural network on scaled features (Spark's own): on train its log loss is no worse than
    that of the constant rate."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = written(splitted(spark, sf_dir).withColumn("spike", (F.col("target") > F.col("har_monthly") + 1).cast("double")), "mlp")
    how = O.fit_preparation(data.filter("split = 'train'"), HAR, [])
    rows = O.column_vector(O.prepare(data, how), how.names).withColumn("features", array_to_vector("__x"))
    model = MultilayerPerceptronClassifier(labelCol="spike", layers=[len(how.names), 8, 2], maxIter=60, seed=7).fit(rows.filter("split = 'train'").select("features", "spike"))
    scored = written(model.transform(rows.select("split", "spike", "features")).select("split", "spike", vector_to_array("probability")[1].alias("p")), "scored")
    p, y = F.least(F.greatest(F.col("p"), F.lit(1e-12)), F.lit(1 - 1e-12)), F.col("spike")
    one = scored.filter("split = 'train'").agg(F.avg(-(y * F.ln(p) + (1 - y) * F.ln(1 - p))).alias("loss"), F.avg(y).alias("rate")).first()
    constant = -(one.rate * math.log(one.rate) + (1 - one.rate) * math.log(1 - one.rate)) if 0 < one.rate < 1 else 0.0
    return scored.groupBy("split").agg(F.count("*").alias("n"), F.bool_and(F.col("p").between(0, 1)).alias("between_0_and_1"), F.lit(bool(one.loss <= constant + 1e-6)).alias("no_worse_than_constant"))


def representation_catalog(spark, sf_dir):
    return R.catalog(spark)


query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}', {str(k in ('R9', 'R10', 'R11')).lower()}, NULL::VARCHAR)" for k, v in R.CATALOG.items()) + ", " + ", ".join(f"('{b}_{k}', '{k} of {b}', true, '{b}')" for b in ("R6", "R7") for k in ("lagged", "permuted")) + ") v(representation, description, is_placebo, base)")(representation_catalog)
