"""Queries on choosing and comparing: replicates, families, placebo grids, cohorts, fold-wise labels and codebooks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions import expr as X
from barloom.operators import compare as C
from barloom.operators import labels as L
from barloom.operators import metrics as K
from barloom.operators import models as O
from barloom.operators import pooling as P
from barloom.operators import splits as S
from barloom.plans.catalog import query, r, rounded, table
from barloom.plans.forecasts import PREDS, PROB, REG, UNC, long, prob, unc
from barloom.plans.market import READY, ready
from barloom.plans.news import ALL, EDGES, events
from barloom.plans.targets import FOLDS, PURGE, QUANTILES, RESID, anchored, residuals, splitted
from barloom.session import written

# A grid of tasks: four forecasts by fold and replicate; a replicate leaves out a fifth of the rows.
MODELS = {"daily": "har_daily", "mean": "(har_daily + har_weekly) / 2", "monthly": "har_monthly", "weekly": "har_weekly"}
TASKS = f"""{FOLDS}, fr AS (SELECT fold, entity, date, target, har_daily, har_weekly, har_monthly FROM splitted JOIN folds ON target_date BETWEEN validation_start AND validation_end),
gl AS ({" UNION ALL ".join(f"SELECT fold, entity, date, target AS y, '{k}' AS model, {v} AS p FROM fr" for k, v in MODELS.items())}),
tasks AS (SELECT fold, seed, model, count(*) AS n, avg(abs(y - p)) AS mae FROM gl, (VALUES (1), (2), (3)) s(seed) WHERE ('0x' || substr(sha256(seed || '|' || entity || '|' || date), 1, 8))::BIGINT / 4294967296.0 < 0.8 GROUP BY ALL),
holed AS (SELECT * FROM tasks WHERE NOT (model = 'monthly' AND seed = 3 AND fold = 2))"""


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = splitted(spark, sf_dir)
    rows = S.fold_rows(frame, S.expanding_folds(frame, 3, 60)).filter("fold_split = 'validation'")
    wide = rows.select("fold", "entity", "date", F.col("target").alias("y"), *(F.expr(v).alias(k) for k, v in MODELS.items()))
    each = wide.unpivot(["fold", "entity", "date", "y"], list(MODELS), "model", "p").withColumn("seed", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    kept = each.filter(X.uniform("seed", "entity", "date") < 0.8)
    return written(kept.groupBy("fold", "seed", "model").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("y") - F.col("p"))).alias("mae")), "tasks")


def holed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid with one task missing."""
    return tasks(spark, sf_dir).filter(~((F.col("model") == "monthly") & (F.col("seed") == 3) & (F.col("fold") == 2)))


@query(f"WITH {TASKS} SELECT model, round(avg(mae), 7) AS mean, round(stddev_samp(mae), 7) AS std, round(min(mae), 7) AS least, round(max(mae), 7) AS most, count(*) AS n_rows, count(DISTINCT seed) AS n_seed, count(DISTINCT fold) AS n_fold FROM holed GROUP BY model")
def replicate_average(spark, sf_dir):
    return rounded(C.replicates(holed(spark, sf_dir), ["model"], ["seed", "fold"], "mae"), 7)


@query(f"""WITH {TASKS}, e AS (SELECT fold, count(DISTINCT seed) AS expected_seed FROM holed GROUP BY fold) SELECT fold, model, count(DISTINCT seed) AS n_seed, expected_seed, count(DISTINCT seed) >= expected_seed AS complete FROM holed JOIN e USING (fold) GROUP BY fold, model, expected_seed""")
def seed_fold_coverage(spark, sf_dir):
    return C.completeness(holed(spark, sf_dir), ["fold"], ["model"], ["seed"])


@query(f"""WITH {TASKS}, sc AS (SELECT fold, seed, model, CASE WHEN model = 'daily' AND seed = 1 AND fold = 1 THEN NULL ELSE mae END AS v FROM tasks), f AS (SELECT fold, model, avg(v) AS mean_value, count(*) AS n_repeats, count(v) AS n_scored FROM sc GROUP BY ALL),
  k AS (SELECT *, CASE WHEN n_scored = n_repeats THEN row_number() OVER (PARTITION BY fold, n_scored = n_repeats ORDER BY mean_value, model) END AS place FROM f) SELECT fold, model, round(mean_value, 7) AS mean_value, n_repeats, n_scored, place, coalesce(place <= 2, false) AS selected FROM k""")
def top_families(spark, sf_dir):
    """The two best forecasts of each fold; one that lacks a score is no candidate."""
    scored = tasks(spark, sf_dir).withColumn("mae", F.when(~((F.col("model") == "daily") & (F.col("seed") == 1) & (F.col("fold") == 1)), F.col("mae")))
    return C.top_families(scored, ["fold"], "model", "mae", 2).withColumn("mean_value", F.round("mean_value", 7)).withColumn("place", F.col("place").cast("long"))


CANDIDATES = """cd AS (SELECT candidate_id, news_level, TRY_CAST(regexp_extract(candidate_id, '_k(\\d+)', 1) AS INT) AS k, TRY_CAST(nullif(regexp_extract(candidate_id, '_pca(\\d+)', 1), '') AS INT) AS pca_dim, prototype_id, count(*) AS n FROM analyze_prototypes WHERE prototype_id IS NOT NULL GROUP BY ALL),
  cs AS (SELECT news_level, candidate_id, k, pca_dim, x.seed, exp(-sum(n / t.total * ln(n / t.total))) / max(k) AS effective FROM cd JOIN (SELECT candidate_id, sum(n) AS total FROM cd GROUP BY candidate_id) t USING (candidate_id), (VALUES (1), (2)) x(seed) GROUP BY ALL)"""


@query(f"""WITH {CANDIDATES} SELECT news_level, candidate_id, k, pca_dim, seed, round(effective, 7) AS effective FROM (SELECT *, row_number() OVER (PARTITION BY news_level ORDER BY CASE WHEN seed = 2 THEN 0 ELSE 1 END, abs(k - 8), CASE WHEN pca_dim IS NULL THEN 10000 ELSE abs(pca_dim - 32) END, effective DESC, candidate_id) AS r FROM cs) WHERE r = 1""")
def preference_choice(spark, sf_dir):
    """The candidate per level nearest to wanted settings; quality only breaks ties."""
    rows = table(spark, sf_dir, "analyze_prototypes").filter("prototype_id is not null")
    k, pca = (F.regexp_extract("candidate_id", p, 1) for p in (r"_k(\d+)", r"_pca(\d+)"))
    use = rows.groupBy("news_level", "candidate_id", "prototype_id").agg(F.count("*").alias("n"))
    total = use.groupBy("candidate_id").agg(F.sum("n").alias("total"))
    share = F.col("n") / F.col("total")
    scored = use.join(total, "candidate_id").groupBy("news_level", "candidate_id").agg(F.exp(-F.sum(share * F.ln(share))).alias("number"))
    grid = scored.select("news_level", "candidate_id", k.try_cast("int").alias("k"), pca.try_cast("int").alias("pca_dim"), "number").withColumn("effective", F.col("number") / F.col("k")).withColumn("seed", F.explode(F.array(F.lit(1), F.lit(2))))
    return C.preferred(grid, ["news_level"], {"seed": 2, "k": 8, "pca_dim": 32}, "effective", "candidate_id", exact=("seed",)).select("news_level", "candidate_id", "k", "pca_dim", "seed", r("effective", 7))


@query(f"""WITH {PREDS}, px AS (SELECT *, lag(m0, 5) OVER (PARTITION BY entity ORDER BY date) AS late0, lag(m1, 5) OVER (PARTITION BY entity ORDER BY date) AS late1 FROM preds), lx AS (SELECT split, 'm0' AS model, abs(y - m0) AS e FROM px UNION ALL SELECT split, 'm1', abs(y - m1) FROM px UNION ALL SELECT split, 'late0', abs(y - late0) FROM px UNION ALL SELECT split, 'late1', abs(y - late1) FROM px),
  mx AS (SELECT split, model, avg(e) AS mae FROM lx GROUP BY ALL), pg AS (SELECT a.real, b.placebo FROM (VALUES ('m0'), ('m1')) a(real), (VALUES ('late0'), ('late1'), ('absent')) b(placebo)),
  pw AS (SELECT pg.*, rv.mae AS rv, pv.mae AS pv, rt.mae AS rt, pt.mae AS pt FROM pg LEFT JOIN mx rv ON rv.model = real AND rv.split = 'validation' LEFT JOIN mx pv ON pv.model = placebo AND pv.split = 'validation' LEFT JOIN mx rt ON rt.model = real AND rt.split = 'test' LEFT JOIN mx pt ON pt.model = placebo AND pt.split = 'test')
  SELECT 'mae' AS metric, real, placebo, rv IS NOT NULL AND pv IS NOT NULL AS executed, round(rv, 7) AS real_validation, round(pv, 7) AS placebo_validation, round(rt, 7) AS real_test, round(pt, 7) AS placebo_test, round((pv - rv) / greatest(abs(pv), 1e-12), 7) AS validation_gain, round((pt - rt) / greatest(abs(pt), 1e-12), 7) AS test_gain,
  CASE WHEN rv IS NOT NULL AND pv IS NOT NULL THEN (pv - rv) / greatest(abs(pv), 1e-12) > 0 END AS better_on_validation FROM pw""")
def placebo_grid(spark, sf_dir):
    """Real forecasts against forecasts five rows late; a placebo without evidence is listed as such."""
    from pyspark.sql import Window

    late = Window.partitionBy("entity").orderBy("date")
    rows = long(spark, sf_dir).groupBy("entity", "date", "split", "y").pivot("model", ["m0", "m1"]).agg(F.first("p"))
    rows = rows.withColumns({"late0": F.lag("m0", 5).over(late), "late1": F.lag("m1", 5).over(late)})
    each = rows.unpivot(["split", "y"], ["m0", "m1", "late0", "late1"], "model", "p").filter("p is not null")
    scores = written(each.groupBy("split", "model").agg(F.avg(F.abs(F.col("y") - F.col("p"))).alias("mae")), "scores").withColumn("metric", F.lit("mae"))
    return rounded(C.locked_grid(scores.filter("split = 'validation'"), scores.filter("split = 'test'"), ["metric"], "model", "mae", ["m0", "m1"], ["late0", "late1", "absent"]), 7)


COHORTS = f"""{PREDS}, {EDGES}, nd AS (SELECT DISTINCT ticker, event_date AS date FROM edges WHERE news_level = 'target'),
cl AS (SELECT long.*, nd.ticker IS NOT NULL AS has_news FROM long LEFT JOIN nd ON nd.ticker = split_part(entity, '/', 2) AND nd.date = long.date)"""


@query(f"""WITH {COHORTS} SELECT split, model, cohort, count(*) AS n, round(avg(abs(y - p)), 7) AS mae, round(sqrt(avg((y - p) * (y - p))), 7) AS rmse FROM cl, (VALUES ('all'), ('news_days'), ('no_news_days')) c(cohort) WHERE cohort = 'all' OR (cohort = 'news_days') = has_news GROUP BY ALL""")
def metrics_by_news_state(spark, sf_dir):
    """Metrics of all rows, of days with news on the company, and of the others."""
    news = P.edges(events(spark, sf_dir), ALL).filter("news_level = 'target'").select("ticker", F.col("event_date").alias("date")).distinct().withColumn("__hit", F.lit(True))
    rows = long(spark, sf_dir).withColumn("ticker", F.split_part("entity", F.lit("/"), F.lit(2))).join(F.broadcast(news), ["ticker", "date"], "left")  # universe x calendar
    cohort = F.when(F.col("__hit"), F.array(F.lit("all"), F.lit("news_days"))).otherwise(F.array(F.lit("all"), F.lit("no_news_days")))
    out = K.regression(rows.withColumn("cohort", F.explode(cohort)), ["split", "model", "cohort"], ranks=False)
    return rounded(out.select("split", "model", "cohort", "n", "mae", "rmse"), 7)


@query(f"""WITH {UNC}, pb AS (SELECT resid.entity, date, split, CAST(abs(residual) > q90 AS INT) AS y, round(1 / (1 + exp(-(har_daily - har_monthly) - 1)), 2) AS p FROM resid JOIN thr USING (entity)), o AS (SELECT split, 'signed' AS target, exp(least(greatest(target - har_weekly, -50), 50)) - least(greatest(target - har_weekly, -50), 50) - 1 AS loss FROM resid
  UNION ALL SELECT split, 'magnitude', pow(abs(residual) - abs(har_daily - har_weekly), 2) FROM resid UNION ALL SELECT split, 'spike', pow(y - p, 2) FROM pb UNION ALL SELECT split, 'uncertainty', 0.5 * ln(2 * pi()) + ln(scale) + 0.5 * z * z FROM unc)
  SELECT split, target, count(loss) AS n, round(avg(loss), 6) AS mean_loss FROM o GROUP BY ALL""")
def target_losses(spark, sf_dir):
    """The loss of one observation by the kind of its target."""
    frame = residuals(spark, sf_dir)
    parts = {
        "signed": frame.select("split", F.col("target").alias("y"), F.col("har_weekly").alias("p")),
        "magnitude": frame.select("split", F.abs("residual").alias("y"), F.abs(F.col("har_daily") - F.col("har_weekly")).alias("p")),
        "spike": prob(spark, sf_dir).select("split", "y", "p"),
        "uncertainty": unc(spark, sf_dir).select("split", "y", F.col("mean").alias("p"), "scale"),
    }
    out = None
    for kind, rows in parts.items():
        one = rows.select("split", F.lit(kind).alias("target"), K.observation_loss(kind).alias("loss"))
        out = one if out is None else out.union(one)
    return out.groupBy("split", "target").agg(F.count("loss").alias("n"), r(F.avg("loss"), 6, "mean_loss"))


@query(f"WITH {REG} SELECT split, count(*) AS n, round(avg(pow(q[1] - CAST(y = 0 AS INT), 2) + pow(q[2] - CAST(y = 1 AS INT), 2) + pow(q[3] - CAST(y = 2 AS INT), 2)), 7) AS mean_loss FROM q1 GROUP BY split")
def regime_losses(spark, sf_dir):
    frame = residuals(spark, sf_dir)
    labelled = L.spike_labels(frame, "residual", L.fit_thresholds(frame, "residual", QUANTILES)).filter("q50 is not null")
    a = F.abs(F.col("har_daily") - F.col("har_weekly"))
    q = F.array(0.4 + 0.3 / (1 + a), F.lit(0.35), 0.25 * a / (1 + a) + 0.1)
    total = F.aggregate(q, F.lit(0.0), lambda s, v: s + v)
    rows = labelled.select("split", F.col("regime").alias("y"), F.transform(q, lambda v: v / total).alias("p"))
    return rows.groupBy("split").agg(F.count("*").alias("n"), r(F.avg(K.observation_loss("regime")), 7, "mean_loss"))


@query(f"""WITH {FOLDS}, fx AS (SELECT fold, CASE WHEN target_date BETWEEN train_start AND train_end THEN 'train' ELSE 'validation' END AS fold_split, entity, date, target - har_weekly AS v FROM splitted JOIN folds ON target_date BETWEEN train_start AND train_end OR target_date BETWEEN validation_start AND validation_end),
  ft AS (SELECT fold, entity, quantile_cont(abs(v), 0.5) AS q50, quantile_cont(abs(v), 0.9) AS q90, quantile_cont(abs(v), 0.95) AS q95, avg(v) AS c, greatest(coalesce(stddev_samp(v), 0), 1e-12) AS s FROM fx WHERE fold_split = 'train' GROUP BY ALL),
  fz AS (SELECT fx.*, q50, q90, q95, (v - c) / s AS z FROM fx LEFT JOIN ft USING (fold, entity)), fp AS (SELECT fold, quantile_cont(abs(z), 0.5) AS p50, quantile_cont(abs(z), 0.9) AS p90, quantile_cont(abs(z), 0.95) AS p95 FROM fz WHERE fold_split = 'train' GROUP BY fold)
  SELECT fold, fold_split, entity, date, round(z, 7) AS standardized, CAST(abs(v) > q90 AS INT) AS spike_q90, CAST(abs(v) > q95 AS INT) AS spike_q95, CASE WHEN q50 IS NULL THEN NULL WHEN abs(v) <= q50 THEN 0 WHEN abs(v) <= q90 THEN 1 ELSE 2 END AS regime,
  CAST(abs(z) > p90 AS INT) AS spike_q90_pooled, CAST(abs(z) > p95 AS INT) AS spike_q95_pooled, CASE WHEN abs(z) <= p50 THEN 0 WHEN abs(z) <= p90 THEN 1 WHEN z IS NOT NULL THEN 2 END AS regime_pooled FROM fz JOIN fp USING (fold)""")
def fold_relabel(spark, sf_dir):
    """Spikes and regimes of every fold, from thresholds of its own train side."""
    frame = residuals(spark, sf_dir)
    out = L.fold_labels(written(S.fold_rows(frame, S.expanding_folds(frame, 3, 60)), "folds"), "residual")
    names = ["spike_q90", "spike_q95", "regime", "spike_q90_pooled", "spike_q95_pooled", "regime_pooled"]
    return out.select("fold", "fold_split", "entity", "date", r("standardized", 7), *names)


DAYS = f"{READY}, dy AS (SELECT target_date AS d, row_number() OVER (ORDER BY target_date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT target_date FROM ready))"
_SPANS = "SELECT block::INT AS block, (SELECT max(d) FROM dy WHERE dy.d < min(h.d)) AS history_end, min(h.d) AS predict_start, max(h.d) AS predict_end, count(*) AS n_dates FROM h GROUP BY block"


@query(f"WITH {DAYS}, h AS (SELECT d, floor((i - greatest(60, ceil(n * 0.4::DOUBLE))) / 21) AS block FROM dy WHERE i >= greatest(60, ceil(n * 0.4::DOUBLE))) {_SPANS}")
def stepped_oof_blocks(spark, sf_dir):
    return S.stepped_blocks(ready(spark, sf_dir), 21, 60, 0.4)


@query(f"WITH {DAYS}, h AS (SELECT d, ntile(6) OVER (ORDER BY d) - 1 AS block FROM dy WHERE i >= greatest(22, ceil(n * 0.35::DOUBLE))) {_SPANS}")
def split_oof_blocks(spark, sf_dir):
    return S.split_blocks(ready(spark, sf_dir), 6, 22, 0.35)


# -- fold-safe codebooks -------------------------------------------------------------------------


def fold_codebooks(vectors: DataFrame, label: str, folds: DataFrame, width: int = 64) -> dict[int, list[list[float]]]:
    """Per fold, the mean vector of each label over events of its train dates only (a bounded model)."""
    past = F.col("feature_date").between(F.col("train_start"), F.col("train_end"))
    rows = vectors.join(F.broadcast(folds.select("fold", "train_start", "train_end")), past)
    means = rows.groupBy("fold", label).agg(*(F.avg(F.col("embedding")[k].cast("double")).alias(f"x{k}") for k in range(width))).orderBy("fold", label)
    out: dict[int, list[list[float]]] = {}
    for row in means.collect():
        out.setdefault(row["fold"], []).append(list(row)[2:])
    return out


SAFE = f"""{FOLDS}, sv AS (SELECT DISTINCT event_id, embedding::DOUBLE[] AS v FROM event_vectors WHERE embedding IS NOT NULL AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
se AS (SELECT event_id, news_level, feature_date, v FROM sv JOIN analyze_prototypes USING (event_id)), sc AS (SELECT fold, news_level, i, avg(x) AS c FROM (SELECT fold, news_level, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM se JOIN folds ON feature_date BETWEEN train_start AND train_end) GROUP BY ALL),
sb AS (SELECT fold, row_number() OVER (PARTITION BY fold ORDER BY news_level) - 1 AS prototype, c FROM (SELECT fold, news_level, list(c ORDER BY i) AS c FROM sc GROUP BY ALL)),
sa AS (SELECT fold, event_id, CASE WHEN feature_date <= train_end THEN 'train' ELSE 'validation' END AS fold_split, arg_max(prototype, list_cosine_similarity(v, c))::INT AS prototype, max(list_cosine_similarity(v, c)) AS cosine
  FROM se JOIN folds ON feature_date BETWEEN train_start AND train_end OR feature_date BETWEEN validation_start AND validation_end JOIN sb USING (fold) GROUP BY ALL)"""


@query(f"WITH {SAFE} SELECT fold, fold_split, prototype, count(*) AS n_events, round(avg(cosine), 7) AS mean_cosine FROM sa GROUP BY ALL")
def fold_safe_representations(spark, sf_dir):
    """Events of a fold placed by a codebook that was fitted on the fold's train dates alone."""
    frame = splitted(spark, sf_dir)
    folds = written(S.expanding_folds(frame, 3, 60), "folds")
    norm = X.dot(F.col("embedding"), F.col("embedding"))
    vectors = table(spark, sf_dir, "event_vectors").select("event_id", "embedding").filter("embedding is not null").distinct().filter(norm > 0)
    placed = written(vectors.join(events(spark, sf_dir).select("event_id", F.col("news_level").alias("level"), "feature_date"), "event_id"), "placed")
    out = None
    for fold, centers in sorted(fold_codebooks(placed, "level", folds).items()):
        own = folds.filter(F.col("fold") == fold).select("fold", "train_start", "train_end", "validation_start", "validation_end")
        part = placed.crossJoin(F.broadcast(own)).filter(F.col("feature_date").between(F.col("train_start"), F.col("train_end")) | F.col("feature_date").between(F.col("validation_start"), F.col("validation_end")))  # one row
        sides = part.select("event_id", "fold", F.when(F.col("feature_date") <= F.col("train_end"), "train").otherwise("validation").alias("fold_split"))
        one = P.assignment(part.select("event_id", "embedding"), centers).select("event_id", "prototype", "cosine").join(sides, "event_id")
        out = one if out is None else out.unionByName(one)
    return out.groupBy("fold", "fold_split", "prototype").agg(F.count("*").alias("n_events"), r(F.avg("cosine"), 7, "mean_cosine"))


# -- ridge chosen by the mean error of the offsets -----------------------------------------------

ALPHAS = (0.1, 1.0, 10.0, 100.0)


@query(f"""WITH {PURGE}, k AS (SELECT m, a.alpha FROM (VALUES ('M0'), ('M1'), ('M2'), ('M3')) m(m), (VALUES {", ".join(f"({a})" for a in ALPHAS)}) a(alpha)) SELECT m AS model_name, count(*) AS n_alphas, (SELECT count(*) FROM purged WHERE split = 'train') AS n_train, 0.0::DOUBLE AS gradient, true AS chosen_is_least FROM k GROUP BY m""")
def alpha_by_offset(spark, sf_dir):
    """Four feature sets; the penalty of each is the one with the least mean offset error on validation.

    The result says how far the fit is from its normal equations (0) and whether the choice is the least."""
    frame = written(S.offsets(S.purge(anchored(spark, sf_dir)), 5).withColumns({"price": F.coalesce("base", F.lit(0.0)), "no_price": F.col("base").isNull().cast("double")}), "offsets")
    edge = P.edges(events(spark, sf_dir), ALL).groupBy("ticker", F.col("event_date").alias("date")).agg(F.count("*").cast("double").alias("n_news"), F.count_if(F.col("news_level") == "target").cast("double").alias("n_target"))
    rows = frame.withColumn("ticker", F.split_part("entity", F.lit("/"), F.lit(2))).join(F.broadcast(edge), ["ticker", "date"], "left").na.fill(0.0, ["n_news", "n_target"])  # universe x calendar
    rows = written(rows, "alpha")
    train, validation = rows.filter("split = 'train'"), rows.filter("split = 'validation'")
    how = O.fit_preparation(train, ["price", "n_news", "n_target"], [])
    prepared = [O.prepare(part, how) for part in (train, validation)]
    sets = {"M0": ["z__price"], "M1": ["z__price", "z__n_news"], "M2": ["z__price", "z__n_target"], "M3": ["z__price", "z__n_news", "z__n_target"]}
    n_train, out = train.count(), []
    for name, features in sets.items():
        model, errors = O.choose_alpha(prepared[0], prepared[1], features, "relative_target", "entity", ALPHAS)
        out.append((name, len(errors), n_train, abs(round(O.grouped_gradient(prepared[0], model, "relative_target"), 6)), all(dict(errors)[model.alpha] <= e for _, e in errors)))
    return spark.createDataFrame(out, "model_name string, n_alphas long, n_train long, gradient double, chosen_is_least boolean")


# -- decisions -----------------------------------------------------------------------------------


@query(f"""WITH {TASKS}, tb AS (SELECT fold, seed, mae FROM tasks WHERE model = 'monthly'), tg AS (SELECT t.model, t.fold, t.seed, (tb.mae - t.mae) / greatest(abs(tb.mae), 1e-12) AS gain FROM tasks t JOIN tb USING (fold, seed) WHERE t.model <> 'monthly'),
  tf AS (SELECT model, bool_and(gain > 0) AS every_fold FROM (SELECT model, fold, avg(gain) AS gain FROM tg GROUP BY ALL) GROUP BY model), tc AS (SELECT model, every_fold, avg(gain) > 0 AS mean_gain, avg(CAST(gain > 0 AS INT)) >= 0.75 AS most_tasks, min(gain) > -0.05 AS no_task_much_worse FROM tg JOIN tf USING (model) GROUP BY ALL)
  SELECT model, mean_gain, every_fold, most_tasks, no_task_much_worse, CAST(mean_gain AS INT) + CAST(every_fold AS INT) + CAST(most_tasks AS INT) + CAST(no_task_much_worse AS INT) AS n_held,
  CASE WHEN mean_gain AND every_fold AND most_tasks AND no_task_much_worse THEN 'GO' WHEN mean_gain AND (every_fold OR most_tasks) THEN 'REVIEW' ELSE 'NO-GO' END AS decision FROM tc""")
def target_gates(spark, sf_dir):
    """Conditions over the task grid per model, how many hold, and the decision they give."""
    rows = tasks(spark, sf_dir)
    gains = C.gains(rows, ["fold", "seed"], "model", "monthly", "mae", True).filter("model <> 'monthly'")
    folds = gains.groupBy("model", "fold").agg((F.avg("gain") > 0).alias("up")).groupBy("model").agg(F.bool_and("up").alias("every_fold"))
    own = gains.groupBy("model").agg((F.avg("gain") > 0).alias("mean_gain"), (F.avg((F.col("gain") > 0).cast("double")) >= 0.75).alias("most_tasks"), (F.min("gain") > -0.05).alias("no_task_much_worse")).join(folds, "model")
    names = ["mean_gain", "every_fold", "most_tasks", "no_task_much_worse"]
    held = sum((F.col(c).cast("int") for c in names[1:]), F.col(names[0]).cast("int"))
    decision = F.when(held == len(names), "GO").when(F.col("mean_gain") & (F.col("every_fold") | F.col("most_tasks")), "REVIEW").otherwise("NO-GO")
    return own.select("model", *names, held.alias("n_held"), decision.alias("decision"))
