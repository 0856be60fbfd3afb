"""Queries on fitted models, sources and streams."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions import expr as X
from barloom.operators import compare as C
from barloom.operators import models as O
from barloom.operators import pooling as P
from barloom.operators import splits as S
from barloom.plans import algebra as A
from barloom.plans.catalog import query, r, rounded, table
from barloom.plans.market import READY, ready
from barloom.plans.news import events
from barloom.plans.targets import SPLIT, splitted
from barloom.session import written
from barloom.sources import tables as T

FEATURES = ["har_daily", "har_weekly", "har_monthly"]


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, embedding, split of usable vectors, once each."""
    usable = table(spark, sf_dir, "event_vectors").select("event_id", "embedding").filter("embedding is not null").distinct()
    usable = usable.filter(X.dot(F.col("embedding"), F.col("embedding")) > 0)
    return written(usable.join(events(spark, sf_dir).select("event_id", "split"), "event_id"), "vectors")


USABLE = "us AS (SELECT v.event_id, v.e, lower(trim(p.split)) AS split FROM (SELECT DISTINCT event_id, embedding::DOUBLE[] AS e FROM event_vectors WHERE embedding IS NOT NULL AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0) v JOIN analyze_prototypes p USING (event_id))"


@query(f"WITH {USABLE} SELECT split, count(*) AS n_events, 0.0::DOUBLE AS mixed, 1.0::DOUBLE AS least_norm, 1.0::DOUBLE AS most_norm, true AS falling FROM us GROUP BY split")
def pca_projection(spark, sf_dir):
    """Axes fitted on train events only, all events projected.  `mixed` is the largest covariance of two
    components over train (0), `falling` whether the variances fall."""
    vectors = _vectors(spark, sf_dir)
    model = O.fit_pca(vectors.filter("split = 'train'"), "embedding", 64, 8)
    raw = O.project(vectors.filter("split = 'train'"), "event_id", "embedding", model, unit=False)
    m = O.moments(raw, "projected", 8)
    cov = m[1:, 1:] / m[0, 0]
    mixed = round(float(abs(cov - np.diag(np.diag(cov))).max()), 6)
    out = O.project(vectors, "event_id", "embedding", model).join(vectors.select("event_id", "split"), "event_id")
    norm = F.sqrt(X.dot(F.col("projected"), F.col("projected")))
    return out.groupBy("split").agg(F.count("*").alias("n_events"), F.lit(abs(mixed)).alias("mixed"), r(F.min(norm), 9, "least_norm"), r(F.max(norm), 9, "most_norm"), F.lit(bool((np.diff(np.diag(cov)) <= 1e-12).all())).alias("falling"))


@query(f"WITH {USABLE} SELECT split, count(*) AS n_events, 8 AS n_prototypes, 0.0::DOUBLE AS last_step, true AS sensible FROM us GROUP BY split")
def spherical_kmeans(spark, sf_dir):
    """Centres fitted on train events only, all events assigned.  `last_step` is what one more round would
    move them (0); entropies and cosines are within their bounds."""
    vectors = _vectors(spark, sf_dir)
    train = written(vectors.filter("split = 'train'").select("embedding"), "train")
    centers = O.spherical_kmeans(train, "embedding", 64, 8, unit=False)
    step = abs(round(O.lloyd_step(train, "embedding", centers), 6))
    found = P.assignment(vectors, centers.tolist()).join(vectors.select("event_id", "split"), "event_id")
    sane = F.bool_and(F.col("cosine").between(-1.0000001, 1.0000001) & F.col("entropy").between(-1e-9, float(np.log(8)) + 1e-9) & F.col("prototype").between(0, 7))
    return found.groupBy("split").agg(F.count("*").alias("n_events"), F.lit(len(centers)).alias("n_prototypes"), F.lit(step).alias("last_step"), sane.alias("sensible"))


@query("SELECT 6::BIGINT AS n_pairs, 6::BIGINT AS n_left, 6::BIGINT AS n_right, true AS best_of_all")
def centroid_stability(spark, sf_dir):
    """Centres of two seeds, matched one to one; the total likeness is the best of all matchings."""
    train = _vectors(spark, sf_dir).filter("split = 'train'")
    a, b = (O.spherical_kmeans(train, "embedding", 64, 6, seed=s) for s in (1, 2))
    pairs = O.match_centers(a, b)
    cosine = a @ b.T
    best = max(sum(cosine[i, j] for i, j in enumerate(order)) for order in itertools.permutations(range(6)))
    one = (len(pairs), len({i for i, _, _ in pairs}), len({j for _, j, _ in pairs}), bool(abs(sum(c for _, _, c in pairs) - best) < 1e-9))
    return spark.createDataFrame([one], "n_pairs long, n_left long, n_right long, best_of_all boolean")


U32 = "(('0x' || substr(sha256('7|' || i || '|' || j || '|{k}'), 1, 8))::BIGINT + 0.5) / 4294967296.0"
AXES = f"ax AS (SELECT i, list(sqrt(-2 * ln({U32.format(k=1)})) * cos(2 * pi() * {U32.format(k=2)}) / sqrt(8) ORDER BY j) AS a FROM range(8) x(i), range(64) y(j) GROUP BY i)"


@query(f"""WITH {USABLE}, {AXES}, pj AS (SELECT event_id, i, list_dot_product(e, a) AS z FROM us, ax), pn AS (SELECT event_id, sqrt(sum(z * z)) AS norm FROM pj GROUP BY event_id)
  SELECT event_id, {", ".join(f"round(max(z / norm) FILTER (WHERE i = {k}), 6) + 0.0 AS z{k}" for k in range(8))} FROM pj JOIN pn USING (event_id) GROUP BY event_id""")
def random_projection(spark, sf_dir):
    out = O.project(_vectors(spark, sf_dir), "event_id", "embedding", O.portable_axes(64, 8, 7))
    return out.select("event_id", *((F.round(F.col("projected")[k], 6) + 0.0).alias(f"z{k}") for k in range(8)))


@query(f"""WITH {SPLIT}, tr AS (SELECT har_weekly AS x, target AS y FROM splitted WHERE split = 'train'), f AS (SELECT regr_slope(y, x) AS w, regr_intercept(y, x) AS b FROM tr)
  SELECT split, count(*) AS n, round(avg(abs(target - (b + w * har_weekly))), 6) AS mae FROM splitted, f GROUP BY split""")
def ridge_closed_form(spark, sf_dir):
    """Pooled least squares on one feature: the ridge at penalty zero."""
    frame = splitted(spark, sf_dir)
    model = O.fit_ridge(frame.filter("split = 'train'"), ["har_weekly"], "target", 0.0)
    return O.predict_linear(frame, model).groupBy("split").agg(F.count("*").alias("n"), r(F.avg(F.abs(F.col("target") - F.col("prediction"))), 6, "mae"))


@query(f"""WITH {SPLIT}, {A.ridge("splitted WHERE split = 'train'", FEATURES, "target", 10.0, "rg")} SELECT split, count(*) AS n, round(avg(abs(target - ({A.predicted(FEATURES)}))), 6) AS mae FROM splitted, rg GROUP BY split""")
def pooled_ridge(spark, sf_dir):
    frame = splitted(spark, sf_dir)
    model = O.fit_ridge(frame.filter("split = 'train'"), FEATURES, "target", 10.0)
    return O.predict_linear(frame, model).groupBy("split").agg(F.count("*").alias("n"), r(F.avg(F.abs(F.col("target") - F.col("prediction"))), 6, "mae"))


@query(f"""WITH {SPLIT}, f AS (SELECT entity, regr_slope(target, har_weekly) AS w, regr_intercept(target, har_weekly) AS b FROM splitted WHERE split = 'train' GROUP BY entity HAVING var_pop(har_weekly) > 0)
  SELECT entity, round(b, 5) AS intercept, round(w, 5) AS w_har_weekly FROM f""")
def per_entity_baseline(spark, sf_dir):
    frame = splitted(spark, sf_dir).filter("split = 'train'")
    varied = frame.groupBy("entity").agg(F.var_pop("har_weekly").alias("v")).filter("v > 0").select("entity")
    return rounded(O.per_entity_ols(frame.join(varied, "entity", "left_semi"), ["har_weekly"], "target"), 5)


@query(f"WITH {SPLIT} SELECT split, count(*) AS n, round(avg(CAST(target > har_monthly + 1 AS INT)), 7) AS rate, 0.0::DOUBLE AS gradient, true AS ranked FROM splitted GROUP BY split")
def logistic_spikes(spark, sf_dir):
    """A weighted logistic fit on train: its score vanishes, and spikes get the higher probabilities there."""
    frame = written(splitted(spark, sf_dir).withColumn("spike", (F.col("target") > F.col("har_monthly") + 1).cast("int")), "spikes")
    train = frame.filter("split = 'train'")
    model = O.fit_logistic(train, FEATURES, "spike", balanced=True)
    gradient = abs(round(O.logistic_gradient(train, model, "spike", 1.0, True), 6))
    one = O.predict_probability(train, model).agg(F.avg(F.when(F.col("spike") == 1, F.col("probability"))).alias("a"), F.avg(F.when(F.col("spike") == 0, F.col("probability"))).alias("b")).first()
    return frame.groupBy("split").agg(F.count("*").alias("n"), r(F.avg("spike"), 7, "rate"), F.lit(gradient).alias("gradient"), F.lit(bool(one.a > one.b)).alias("ranked"))


OOF = f"""{READY}, od AS (SELECT target_date AS d, row_number() OVER (ORDER BY target_date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT target_date FROM ready)), oh AS (SELECT d, ntile(4) OVER (ORDER BY d) - 1 AS block FROM od WHERE i >= floor(n * 0.4::DOUBLE)),
ob AS (SELECT block, min(d) AS predict_start, max(d) AS predict_end FROM oh GROUP BY block), oy AS (SELECT block, ready.* FROM ready JOIN ob ON target_date < predict_start), ox AS (SELECT block, ready.* FROM ready JOIN ob ON target_date BETWEEN predict_start AND predict_end)"""
HELD = f"{OOF}, {A.ridge('oy', FEATURES, 'target', 10.0, 'og', 'block')}, held AS (SELECT ox.*, target - ({A.predicted(FEATURES)}) AS e FROM ox JOIN og USING (block))"


@query(f"WITH {HELD} SELECT block::INT AS block, count(*) AS n, round(avg(e), 6) + 0.0 AS mean_residual, round(stddev_pop(e), 6) AS residual_std FROM held GROUP BY block")
def out_of_fold_residuals(spark, sf_dir):
    frame = written(ready(spark, sf_dir), "ready")
    found = O.out_of_fold(frame, S.expanding_blocks(frame, 4, 0.4), FEATURES, "target", 10.0)
    e = F.col("target") - F.col("prediction")
    return found.groupBy("block").agg(F.count("*").alias("n"), (F.round(F.avg(e), 6) + 0.0).alias("mean_residual"), r(F.stddev_pop(e), 6, "residual_std"))


@query(f"""WITH {HELD}, sized AS (SELECT *, abs(e) / sqrt(2 / pi()) AS size FROM held), {A.ridge('sized', FEATURES, 'size', 10.0, 'sg')}, sc AS (SELECT sized.block, e / greatest({A.predicted(FEATURES)}, 1e-3) AS z FROM sized, sg)
  SELECT block::INT AS block, count(*) AS n, round(avg(CAST(abs(z) <= 1.959963984540054 AS INT)), 6) AS coverage_95 FROM sc GROUP BY block""")
def uncertainty_scale(spark, sf_dir):
    """A second ridge on the absolute out-of-fold residuals gives the scale; E|N| = scale sqrt(2 / pi)."""
    frame = written(ready(spark, sf_dir), "ready")
    found = O.out_of_fold(frame, S.expanding_blocks(frame, 4, 0.4), FEATURES, "target", 10.0).withColumn("size", F.abs(F.col("target") - F.col("prediction")) / F.lit(float(np.sqrt(2 / np.pi))))
    held = written(found, "held")
    scale = O.fit_ridge(held, FEATURES, "size", 10.0)
    out = O.predict_linear(held, scale, "scale").withColumn("scale", F.greatest("scale", F.lit(1e-3)))
    z = (F.col("target") - F.col("prediction")) / F.col("scale")
    return out.groupBy("block").agg(F.count("*").alias("n"), r(F.avg((F.abs(z) <= 1.959963984540054).cast("double")), 6, "coverage_95"))


NUISANCE = ["har_weekly", "har_monthly"]


@query(f"""WITH {OOF}, {A.ridge('oy', NUISANCE, 'har_daily', 10.0, 'og', 'block')}, rest AS (SELECT ox.block, har_weekly, har_daily - ({A.predicted(NUISANCE)}) AS e FROM ox JOIN og USING (block))
  SELECT block::INT AS block, count(*) AS n, round(corr(e, har_weekly), 6) + 0.0 AS left_over, round(stddev_pop(e), 6) AS residual_std FROM rest GROUP BY block""")
def orthogonalized_feature(spark, sf_dir):
    """What a feature adds beyond nuisance features, fitted on earlier blocks only."""
    frame = written(ready(spark, sf_dir), "ready")
    found = O.out_of_fold(frame, S.expanding_blocks(frame, 4, 0.4), NUISANCE, "har_daily", 10.0)
    rest = F.col("har_daily") - F.col("prediction")
    return found.groupBy("block").agg(F.count("*").alias("n"), (F.round(F.corr(rest, F.col("har_weekly")), 6) + 0.0).alias("left_over"), r(F.stddev_pop(rest), 6, "residual_std"))


@query(f"WITH {READY} SELECT 'ready' AS part, count(*) AS n, count(har_weekly) AS n_weekly FROM ready UNION ALL SELECT 'calendar', count(*), 0 FROM split_calendar")
def tagged_union(spark, sf_dir):
    parts = {"ready": ready(spark, sf_dir).select("date", "har_weekly"), "calendar": table(spark, sf_dir, "split_calendar").select(F.col("feature_date").alias("date"))}
    return T.tagged_union(parts, "part").groupBy("part").agg(F.count("*").alias("n"), F.count("har_weekly").alias("n_weekly"))


@query("SELECT event_id FROM analyze_prototypes ANTI JOIN event_vectors USING (event_id)")
def cache_misses(spark, sf_dir):
    return T.cache_misses(table(spark, sf_dir, "analyze_prototypes").select("event_id"), table(spark, sf_dir, "event_vectors"), ["event_id"])


@query("SELECT p.event_id, p.news_level, s.event_type FROM analyze_prototypes p JOIN (SELECT event_id, min(event_type) AS event_type FROM structured_events GROUP BY event_id) s USING (event_id)")
def checked_join(spark, sf_dir):
    right = table(spark, sf_dir, "structured_events").groupBy("event_id").agg(F.min("event_type").alias("event_type"))
    return C.checked_join(table(spark, sf_dir, "analyze_prototypes").select("event_id", "news_level"), right, ["event_id"], "inner")


@query("SELECT DISTINCT event_id FROM structured_events WHERE event_id IN (SELECT event_id FROM analyze_prototypes WHERE lower(trim(split)) = 'test')")
def semi_join(spark, sf_dir):
    locked = table(spark, sf_dir, "analyze_prototypes").filter(F.lower(F.trim("split")) == "test").select("event_id")
    return table(spark, sf_dir, "structured_events").join(locked, "event_id", "left_semi").select("event_id").distinct()


@query("SELECT feature_date FROM split_calendar INTERSECT SELECT feature_date FROM analyze_prototypes")
def key_intersection(spark, sf_dir):
    return table(spark, sf_dir, "split_calendar").select("feature_date").intersect(table(spark, sf_dir, "analyze_prototypes").select("feature_date"))


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents) WHERE i IN (SELECT floor(k * (n - 1) / 29.0)::BIGINT FROM range(30) r(k))")
def even_sample(spark, sf_dir):
    """Thirty evenly spaced rows by key, without a global window: ranks come from range partitions."""
    from barloom.operators.prefix import running

    keys = table(spark, sf_dir, "documents").select("doc_id")
    placed = running(keys, [], "doc_id", {"k": F.lit(1)})
    n = keys.agg(F.count("*").alias("n"))
    wanted = n.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(29)), lambda k: F.floor(k * (F.col("n") - 1) / F.lit(29.0)))).alias("before_k")).distinct()
    return placed.join(F.broadcast(wanted), "before_k").select("doc_id")


@query("SELECT event_id FROM (SELECT event_id, ('0x' || substr(sha256('7|' || event_id), 1, 8))::BIGINT AS u FROM analyze_prototypes) ORDER BY u, event_id LIMIT 100")
def hash_sample(spark, sf_dir):
    """A seeded sample of fixed size that any engine with SHA-256 repeats."""
    from barloom.functions.expr import uniform

    return table(spark, sf_dir, "analyze_prototypes").select("event_id").orderBy(uniform(F.lit(7), "event_id"), "event_id").limit(100)


@query("SELECT event_type, count(*) AS n, count(DISTINCT json_extract_string(props, '$.' || k)) AS n_values, k AS field FROM events, (SELECT unnest(json_keys(props)) AS k, event_id AS e FROM events) WHERE e = event_id GROUP BY event_type, k")
def json_fields(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", F.explode(F.from_json("props", "map<string,string>")).alias("field", "value"))
    return rows.groupBy("event_type", "field").agg(F.count("*").alias("n"), F.countDistinct("value").alias("n_values"))


@query("""SELECT event_type AS entity, CAST(ts AS DATE) AS date, arg_min(value, ts) AS "open", max(value) AS high, min(value) AS low, arg_max(value, ts) AS "close", count(*) AS n_rows
  FROM events WHERE CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY GROUP BY ALL""")
def streamed_bars(spark, sf_dir):
    """Daily bars of the event stream up to what the watermark has closed."""
    from barloom.streaming import bars as B

    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    out = B.run_once(spark, f"{sf_dir}/events.parquet*", schema, entity="event_type", ts="ts", value="value")
    return out.select("entity", F.to_date("start").alias("date"), "open", "high", "low", "close", "n_rows")


@query("""SELECT event_type AS entity, CAST(ts AS DATE) AS date, arg_min(value, ts) AS "open", max(value) AS high, min(value) AS low, arg_max(value, ts) AS "close", count(*) AS n_rows
  FROM events WHERE ts IS NOT NULL GROUP BY ALL""")
def streamed_bars_whole(spark, sf_dir):
    """Daily bars of the whole event stream, the windows that were open at its end included."""
    from barloom.streaming import bars as B

    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    out = B.run_whole(spark, f"{sf_dir}/events.parquet*", schema, entity="event_type", ts="ts", value="value")
    return out.select("entity", F.to_date("start").alias("date"), "open", "high", "low", "close", "n_rows")
