"""Queries on news texts, canonical events and their pooling onto the ticker-date panel."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions import expr as X
from barloom.operators import events as E
from barloom.operators import pooling as P
from barloom.plans.catalog import query, r, rounded, table
from barloom.plans.market import UNIVERSE

ALL = sorted(UNIVERSE)
LIST = "[" + ", ".join(f"'{t}'" for t in ALL) + "]"
BLANK = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
# Stated here once more, so that the SQL doesn't rest on the operator's list.
HOLDERS = "'', '-', '--', 'n/a', 'na', 'nan', 'none', 'null', 'no news', 'no_news', 'not available', '[]', '{}'"
OCC = f"""cleaned AS (SELECT source_row_number, CAST(feature_date AS DATE) AS date, lower(trim(news_level)) AS news_level, upper(trim(ticker)) AS source_ticker,
    trim(regexp_replace(regexp_replace(text, '[\\x{{200B}}\\x{{FEFF}}]', '', 'g'), '{BLANK}', ' ', 'g')) AS text
  FROM inspect_schema WHERE text IS NOT NULL AND news_level IS NOT NULL AND ticker IS NOT NULL AND feature_date IS NOT NULL),
named AS (SELECT *, list_sort(list_distinct(list_filter(regexp_extract_all(text, '\\b[A-Z]{{2,5}}\\b'), lambda x: list_contains({LIST}, x) AND x <> source_ticker))) AS related
  FROM cleaned WHERE lower(trim(text)) NOT IN ({HOLDERS})),
occ AS (SELECT substr(sha256(concat_ws('|', source_row_number::VARCHAR, news_level, text)), 1, 24) AS occurrence_id, date, news_level, source_ticker, CASE WHEN news_level = 'target' THEN source_ticker END AS target_ticker,
  related AS related_tickers, CASE WHEN news_level IN ('macro', 'sector') THEN {LIST} WHEN news_level = 'target' THEN [source_ticker] ELSE list_sort(list_distinct(list_append(related, source_ticker))) END AS available_to_tickers,
  text, sha256(text) AS text_hash FROM named)"""


def occ(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.occurrences(table(spark, sf_dir, "inspect_schema"), ALL)


@query(f"WITH {OCC} SELECT occurrence_id, date, news_level, source_ticker, target_ticker, array_to_string(related_tickers, ',') AS related_tickers, array_to_string(available_to_tickers, ',') AS available_to_tickers, text_hash FROM occ")
def news_occurrences(spark, sf_dir):
    joined = [F.array_join(c, ",").alias(c) for c in ("related_tickers", "available_to_tickers")]
    return occ(spark, sf_dir).select("occurrence_id", "date", "news_level", "source_ticker", "target_ticker", *joined, "text_hash")


def text_compatibility_form(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").select("doc_id", F.sha2(E.normalised("text", compatibility=True), 256).alias("text_hash"))
    return texts


query()(text_compatibility_form)

CANON = f"""{OCC}, exploded AS (SELECT *, CASE WHEN news_level = 'target' THEN coalesce(target_ticker, '') ELSE '__shared__' END AS scope FROM occ),
canon0 AS (SELECT date, news_level, text_hash, scope, list_sort(list_distinct(list(source_ticker))) AS source_tickers, list_sort(list_distinct(flatten(list(related_tickers)))) AS related_tickers,
  list_sort(list_distinct(flatten(list(available_to_tickers)))) AS available, list_sort(list_distinct(list(target_ticker) FILTER (WHERE target_ticker IS NOT NULL))) AS targets, count(*) AS source_occurrence_count FROM exploded GROUP BY date, news_level, text_hash, scope),
canon AS (SELECT substr(sha256(concat_ws('|', date::VARCHAR, news_level, CASE WHEN news_level = 'target' THEN scope ELSE array_to_string(available, ',') END, text_hash)), 1, 24) AS event_id, date, news_level, text_hash,
  CASE WHEN news_level = 'target' THEN scope WHEN news_level = 'related' AND len(targets) = 1 THEN targets[1] END AS target_ticker, source_tickers, available, source_occurrence_count FROM canon0)"""


@query(f"WITH {CANON} SELECT event_id, date, news_level, target_ticker, array_to_string(source_tickers, ',') AS source_tickers, array_to_string(available, ',') AS available_to_tickers, source_occurrence_count FROM canon")
def exact_dedup(spark, sf_dir):
    events = E.canonical_events(occ(spark, sf_dir))
    return events.select("event_id", "date", "news_level", "target_ticker", F.array_join("source_tickers", ",").alias("source_tickers"), F.array_join("available_to_tickers", ",").alias("available_to_tickers"), "source_occurrence_count")


@query(f"""WITH {OCC} SELECT CASE WHEN grouping(news_level) = 1 THEN 'all' ELSE news_level END AS news_level, count(*) AS n_occurrences, count(DISTINCT text_hash) AS n_texts, count(DISTINCT date) AS n_days,
  count(DISTINCT source_ticker) AS n_tickers FROM occ GROUP BY GROUPING SETS ((news_level), ())""")
def news_summary(spark, sf_dir):
    return E.news_summary(occ(spark, sf_dir))


@query(f"""WITH {OCC}, t AS (SELECT news_level, text_hash, count(*) AS n FROM occ GROUP BY ALL), d AS (SELECT news_level, date, text_hash, count(*) AS n, count(DISTINCT source_ticker) AS k FROM occ GROUP BY ALL),
  bt AS (SELECT CASE WHEN grouping(news_level) = 1 THEN 'all' ELSE news_level END AS news_level, sum(n - 1)::BIGINT AS n_repeated_cells, count(*) FILTER (WHERE n > 1) AS n_repeated_texts FROM t GROUP BY GROUPING SETS ((news_level), ())),
  bd AS (SELECT CASE WHEN grouping(news_level) = 1 THEN 'all' ELSE news_level END AS news_level, count(*) FILTER (WHERE n > 1) AS n_same_day_groups, count(*) FILTER (WHERE k > 1) AS n_cross_ticker_groups FROM d GROUP BY GROUPING SETS ((news_level), ()))
  SELECT * FROM bt JOIN bd USING (news_level)""")
def duplicate_metrics(spark, sf_dir):
    return E.duplicate_metrics(occ(spark, sf_dir))


@query(f"""WITH {CANON}, a AS (SELECT CASE WHEN grouping(news_level) = 1 THEN 'all' ELSE news_level END AS news_level, count(*) AS source_occurrences, count(DISTINCT (date, text_hash)) AS unique_date_text FROM occ GROUP BY GROUPING SETS ((news_level), ())),
  b AS (SELECT CASE WHEN grouping(news_level) = 1 THEN 'all' ELSE news_level END AS news_level, count(*) AS events FROM canon GROUP BY GROUPING SETS ((news_level), ()))
  SELECT news_level, source_occurrences, unique_date_text, events, source_occurrences - events AS exact_duplicates_removed FROM a JOIN b USING (news_level)""")
def dedup_summary(spark, sf_dir):
    o = occ(spark, sf_dir)
    return E.dedup_summary(o, E.canonical_events(o))


@query(r"""WITH RECURSIVE ev AS (SELECT event_id, text, feature_date, news_level, CASE WHEN news_level = 'target' THEN target_ticker ELSE '__shared__' END AS scope FROM analyze_prototypes),
  bp AS MATERIALIZED (SELECT a.event_id AS a, b.event_id AS b FROM ev a JOIN ev b ON a.feature_date IS NOT DISTINCT FROM b.feature_date AND a.news_level IS NOT DISTINCT FROM b.news_level AND a.scope IS NOT DISTINCT FROM b.scope AND a.event_id < b.event_id AND a.text IS NOT NULL AND b.text IS NOT NULL),
  bt AS (SELECT event_id, ' ' || unnest(list_filter(regexp_split_to_array(lower(text), '[\t-\r\x{1c}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'), lambda w: w <> '')) || ' ' AS w FROM ev WHERE event_id IN (SELECT a FROM bp UNION SELECT b FROM bp)),
  gr AS MATERIALIZED (SELECT event_id, substr(w, i, n) AS gram, count(*)::DOUBLE AS c FROM (SELECT event_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bt, (VALUES (3), (4), (5)) k(n)) GROUP BY ALL),
  nm AS (SELECT event_id, sqrt(sum(c * c)) AS norm FROM gr GROUP BY event_id), gx AS MATERIALIZED (SELECT bp.a, bp.b, gram, c FROM bp JOIN gr ON event_id = bp.a), cs AS MATERIALIZED (SELECT a, b, sum(gx.c * gr.c) AS dot FROM gx JOIN gr ON gr.event_id = b AND gr.gram = gx.gram GROUP BY ALL),
  lk AS MATERIALIZED (SELECT a, b FROM cs JOIN nm p ON p.event_id = a JOIN nm q ON q.event_id = b WHERE dot / (p.norm * q.norm) >= 0.95 - 1e-12), ed AS (SELECT a AS x, b AS y FROM lk UNION ALL SELECT b, a FROM lk),
  cc(x, y) AS (SELECT event_id, event_id FROM ev UNION SELECT cc.x, ed.y FROM cc JOIN ed ON cc.y = ed.x), ca AS (SELECT x AS event_id, min(y) AS canonical_id FROM cc GROUP BY x)
  SELECT event_id, canonical_id, count(*) OVER (PARTITION BY canonical_id) AS group_size FROM ca""")
def near_dedup(spark, sf_dir):
    events = table(spark, sf_dir, "analyze_prototypes").withColumn("scope", F.when(F.col("news_level") == "target", F.col("target_ticker")).otherwise(F.lit("__shared__")))
    return E.near_deduplicated(events, ["feature_date", "news_level", "scope"], threshold=0.95)


KEYWORDS = r"(?i)(?:guidance|outlook|forecast|acquir|merger|lawsuit|export|tariff|capex|fab|supply|recall)"


@query("SELECT news_level, count(*) AS n_events, count(*) FILTER (WHERE coalesce(regexp_matches(text, '" + KEYWORDS + "'), false)) AS n_candidates FROM analyze_prototypes GROUP BY news_level")
def keyword_gate(spark, sf_dir):
    gate = F.coalesce(F.col("text").rlike(KEYWORDS), F.lit(False))
    return table(spark, sf_dir, "analyze_prototypes").groupBy("news_level").agg(F.count("*").alias("n_events"), F.count_if(gate).alias("n_candidates"))


# -- panel of the universe: one row per ticker and date ------------------------------------------

PANEL = """panel AS (SELECT DISTINCT upper(trim(ticker)) AS ticker, CAST(feature_date AS DATE) AS date FROM inspect_schema
  WHERE upper(trim(ticker)) IN (""" + ", ".join(f"'{t}'" for t in ALL) + """) AND feature_date IS NOT NULL)"""
EDGES = f"""ev AS (SELECT event_id, news_level, lower(trim(split)) AS split, feature_date AS event_date,
    list_sort(list_distinct(list_filter(list_transform(from_json(available_to_tickers, '["VARCHAR"]'), lambda x: upper(trim(x))), lambda x: list_contains({LIST}, x)))) AS tickers FROM analyze_prototypes),
edges AS (SELECT event_id, news_level, split, event_date, unnest(tickers) AS ticker FROM ev)"""


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "inspect_schema").select(F.upper(F.trim("ticker")).alias("ticker"), F.col("feature_date").cast("date").alias("date"))
    return rows.filter(F.col("ticker").isin(*ALL) & F.col("date").isNotNull()).distinct()


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "analyze_prototypes").withColumn("split", F.lower(F.trim("split")))


@query(f"WITH {EDGES} SELECT event_id, news_level, event_date, ticker FROM edges")
def event_edges(spark, sf_dir):
    return P.edges(events(spark, sf_dir), ALL).select("event_id", "news_level", "event_date", "ticker")


def _turned(k: int) -> str:
    return "CASE ticker " + " ".join(f"WHEN '{t}' THEN '{ALL[(i + k) % len(ALL)]}'" for i, t in enumerate(ALL)) + " END"


@query(f"WITH {EDGES} SELECT CASE WHEN news_level IN ('target', 'related') THEN {_turned(3)} ELSE ticker END AS ticker, news_level, count(*) AS n_edges FROM edges GROUP BY ALL")
def rotation_placebo(spark, sf_dir):
    return P.edges(events(spark, sf_dir), ALL, rotate=3).groupBy("ticker", "news_level").agg(F.count("*").alias("n_edges"))


@query(f"""WITH {EDGES}, ranked AS (SELECT split, feature_date AS date, row_number() OVER (PARTITION BY split ORDER BY feature_date) - 1 AS i, count(*) OVER (PARTITION BY split) AS n FROM split_calendar),
  m AS (SELECT a.split, a.date, b.date AS new_date FROM ranked a JOIN ranked b ON a.split = b.split AND b.i = (a.i + CASE WHEN 17 % a.n = 0 THEN 1 ELSE 17 % a.n END) % a.n)
  SELECT edges.split, coalesce(new_date, event_date) AS event_date, count(*) AS n_edges FROM edges LEFT JOIN m ON edges.split = m.split AND event_date = m.date GROUP BY ALL""")
def date_rotation_placebo(spark, sf_dir):
    calendar = table(spark, sf_dir, "split_calendar").select("split", F.col("feature_date").alias("date"))
    return P.rotate_dates(P.edges(events(spark, sf_dir), ALL), calendar, 17).groupBy("split", "event_date").agg(F.count("*").alias("n_edges"))


DECAYED = f"""{PANEL}, {EDGES}, inst AS (SELECT edges.*, panel.date, date_diff('day', event_date, panel.date) AS lag_days, exp(-ln(2) * date_diff('day', event_date, panel.date) / 2.0) AS weight
  FROM edges JOIN panel ON edges.ticker = panel.ticker AND panel.date BETWEEN event_date AND event_date + INTERVAL 5 DAY)"""


@query(f"WITH {DECAYED} SELECT ticker, date, news_level, count(*) AS n, round(sum(weight), 8) AS total_weight, max(lag_days) AS max_lag FROM inst GROUP BY ALL")
def decay_band_join(spark, sf_dir):
    inst = P.decayed(P.edges(events(spark, sf_dir), ALL), panel(spark, sf_dir), 2.0, 5)
    return inst.groupBy("ticker", "date", "news_level").agg(F.count("*").alias("n"), r(F.sum("weight"), 8, "total_weight"), F.max("lag_days").cast("long").alias("max_lag"))


VEC = "vec AS (SELECT DISTINCT event_id, embedding FROM event_vectors WHERE embedding IS NOT NULL)"


def _pool(how: str) -> str:
    source = DECAYED if how == "decay" else f"{PANEL}, {EDGES}, inst AS (SELECT edges.*, date, 1.0 AS weight FROM edges JOIN panel ON edges.ticker = panel.ticker AND event_date = date)"
    cell = "max(e * weight)" if how == "max" else "sum(e * weight)"
    scale = {"mean": "w", "decay": "w", "normalized_sum": "sqrt(n)", "max": "1"}[how]
    return f"""WITH {source}, {VEC}, cells AS (SELECT ticker, date, news_level, i, {cell} AS x, count(*) AS n, sum(weight) AS w FROM
      (SELECT inst.*, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS e FROM inst JOIN vec USING (event_id)) GROUP BY ALL)
    SELECT ticker, date, news_level, max(n) AS n, round(sum(x / {scale}), 6) AS total, round(sqrt(sum(pow(x / {scale}, 2))), 6) AS norm, round(sum(x / {scale} * i), 5) AS weighted FROM cells GROUP BY ALL"""


def _pooled(spark: SparkSession, sf_dir: str, how: str) -> DataFrame:
    vectors = table(spark, sf_dir, "event_vectors")
    out = P.pooled(P.event_sets(events(spark, sf_dir), ALL), vectors, panel(spark, sf_dir), how, 64)
    total = F.aggregate("pooled", F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(F.aggregate("pooled", F.lit(0.0), lambda s, v: s + v * v))
    weighted = F.aggregate(F.transform("pooled", lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v)
    return out.select("ticker", "date", "news_level", "n", r(total, 6, "total"), r(norm, 6, "norm"), r(weighted, 5, "weighted"))


@query(_pool("mean"))
def pooling_mean(spark, sf_dir):
    return _pooled(spark, sf_dir, "mean")


@query(_pool("normalized_sum"))
def pooling_normsum(spark, sf_dir):
    return _pooled(spark, sf_dir, "normalized_sum")


@query(_pool("max"))
def pooling_max(spark, sf_dir):
    return _pooled(spark, sf_dir, "max")


@query(_pool("decay"))
def pooling_decay(spark, sf_dir):
    return _pooled(spark, sf_dir, "decay")


@query(f"""WITH {PANEL}, {EDGES}, s AS (SELECT panel.ticker, panel.date, (SELECT max(event_date) FROM edges WHERE edges.ticker = panel.ticker AND event_date <= panel.date AND news_level = 'target') AS last FROM panel)
  SELECT ticker, date, coalesce(date_diff('day', last, date), 3650) AS days_since, CAST(last IS NOT NULL AS INT) AS has_prior FROM s""")
def days_since_news(spark, sf_dir):
    edge = P.edges(events(spark, sf_dir), ALL).filter("news_level = 'target'")
    return P.days_since(panel(spark, sf_dir), edge).withColumn("days_since", F.col("days_since").cast("long"))


@query(f"""WITH {PANEL}, {EDGES}, h AS (SELECT panel.*, row_number() OVER (PARTITION BY ticker ORDER BY date) AS i, EXISTS (SELECT 1 FROM edges WHERE edges.ticker = panel.ticker AND event_date = panel.date AND news_level = 'target') AS news FROM panel)
  SELECT ticker, date, least(coalesce(i - max(CASE WHEN news THEN i END) OVER (PARTITION BY ticker ORDER BY date), 1000), 1000) AS rows_since FROM h""")
def rows_since_news(spark, sf_dir):
    news = P.edges(events(spark, sf_dir), ALL).filter("news_level = 'target'").select("ticker", F.col("event_date").alias("date"), F.lit(True).alias("news")).distinct()
    rows = panel(spark, sf_dir).join(news, ["ticker", "date"], "left").withColumn("news", F.coalesce("news", F.lit(False)))
    return P.rows_since(rows, "news").select("ticker", "date", F.col("rows_since").cast("long").alias("rows_since"))


@query("""SELECT news_date, trading_date FROM (SELECT DISTINCT CAST(published_at AS DATE) AS news_date FROM documents), LATERAL (SELECT min(feature_date) AS trading_date FROM split_calendar WHERE feature_date >= news_date) WHERE trading_date IS NOT NULL""")
def forward_asof(spark, sf_dir):
    dates = table(spark, sf_dir, "documents").select(F.to_date("published_at").alias("news_date")).distinct()
    return P.forward_asof(dates, table(spark, sf_dir, "split_calendar").select(F.col("feature_date").alias("date")))


# -- assignment to given centres -----------------------------------------------------------------

CENTERS = """cells AS (SELECT label, i, avg(e) AS c FROM (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS e FROM embeddings) GROUP BY ALL),
centers AS (SELECT row_number() OVER (ORDER BY label) - 1 AS prototype, list(c ORDER BY i) AS c FROM cells GROUP BY label)"""
ASSIGNED = f"""{CENTERS}, usable AS (SELECT DISTINCT event_id, embedding::DOUBLE[] AS v FROM event_vectors WHERE embedding IS NOT NULL AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
sims AS (SELECT event_id, prototype, list_cosine_similarity(v, c) AS s FROM usable, centers),
w AS (SELECT *, exp((s - max(s) OVER (PARTITION BY event_id)) / 0.1) AS e FROM sims),
p AS (SELECT *, e / sum(e) OVER (PARTITION BY event_id) AS p FROM w),
assigned AS (SELECT event_id, arg_max(prototype, s)::INT AS prototype, max(s) AS cosine, -sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) AS entropy, 1 - max(s) AS novelty FROM p GROUP BY event_id)"""


def given_centers(spark: SparkSession, sf_dir: str) -> list[list[float]]:
    """Mean vector of each label: as many rows as labels."""
    means = table(spark, sf_dir, "embeddings").groupBy("label").agg(*(F.avg(F.col("embedding")[k].cast("double")).alias(f"x{k}") for k in range(64))).orderBy("label")
    return [list(row)[1:] for row in means.collect()]


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "event_vectors").filter("embedding is not null").distinct()
    return P.assignment(vectors, given_centers(spark, sf_dir))


@query(f"WITH {ASSIGNED} SELECT event_id, prototype, round(cosine, 7) AS cosine, round(entropy, 7) AS entropy, round(novelty, 7) AS novelty FROM assigned")
def soft_assignment(spark, sf_dir):
    return rounded(assigned(spark, sf_dir).select("event_id", "prototype", "cosine", "entropy", "novelty"), 7)


@query(f"""WITH {ASSIGNED}, u AS (SELECT prototype, count(*) AS n, avg(cosine) AS mean_cosine FROM assigned GROUP BY prototype), t AS (SELECT sum(n) AS total FROM u)
  SELECT prototype, n, round(n / total, 8) AS share, round(mean_cosine, 7) AS mean_cosine FROM u, t""")
def hard_usage(spark, sf_dir):
    rows = assigned(spark, sf_dir).groupBy("prototype").agg(F.count("*").alias("n"), F.avg("cosine").alias("mean_cosine"))
    total = rows.agg(F.sum("n").alias("total"))
    return rows.crossJoin(F.broadcast(total)).select("prototype", "n", r(F.col("n") / F.col("total"), 8, "share"), r("mean_cosine", 7))


META = f"""{DECAYED}, {ASSIGNED}, x AS (SELECT inst.*, entropy, novelty, 1 - cosine AS distance FROM inst LEFT JOIN assigned USING (event_id) WHERE news_level = 'related'),
a AS (SELECT ticker, date, count(*) AS news_count, count(DISTINCT event_id) AS event_count, sum(weight * entropy) / greatest(sum(weight) FILTER (WHERE entropy IS NOT NULL), 1e-12) AS mean_entropy,
  sum(weight * novelty) / greatest(sum(weight) FILTER (WHERE entropy IS NOT NULL), 1e-12) AS mean_novelty, sum(weight * distance) / greatest(sum(weight) FILTER (WHERE entropy IS NOT NULL), 1e-12) AS mean_distance,
  max(novelty) AS max_novelty, min(distance) AS min_distance, sum(lag_days * weight) / greatest(sum(weight), 1e-12) AS mean_lag, max(lag_days) AS max_lag FROM x GROUP BY ALL),
since AS (SELECT panel.ticker, panel.date, (SELECT max(event_date) FROM edges WHERE edges.ticker = panel.ticker AND event_date <= panel.date AND news_level = 'related') AS last FROM panel)
SELECT ticker, date, coalesce(news_count, 0) AS news_count, coalesce(event_count, 0) AS event_count, {", ".join(f"round(coalesce({c}, 0), 6)::DOUBLE AS {c}" for c in ("mean_entropy", "mean_novelty", "mean_distance", "max_novelty", "min_distance", "mean_lag", "max_lag"))},
  CAST(coalesce(news_count, 0) = 0 AS INT) AS no_news, coalesce(date_diff('day', last, date), 3650) AS days_since, CAST(last IS NOT NULL AS INT) AS has_prior FROM since LEFT JOIN a USING (ticker, date)"""


@query(f"WITH {META}")
def metadata_block(spark, sf_dir):
    edge = P.edges(events(spark, sf_dir), ALL)
    rows = panel(spark, sf_dir)
    diagnostics = assigned(spark, sf_dir).select("event_id", "entropy", "novelty", (1 - F.col("cosine")).alias("distance"))
    facts = events(spark, sf_dir).select("event_id", F.lit(1).alias("occurrences")).join(diagnostics, "event_id", "left")
    out = P.metadata_block(rows, P.decayed(edge, rows, 2.0, 5), facts, edge, "related")
    return rounded(out, 6).withColumn("days_since", F.col("days_since").cast("long"))


ONTOLOGY = ("earnings_guidance", "customer_supplier", "analyst_rating", "fab_capex", "legal_regulatory", "product_launch")


@query("SELECT target_ticker, feature_date, " + ", ".join(f"count(*) FILTER (WHERE lower(trim(event_type)) = '{v}') AS event_type__{v}" for v in ONTOLOGY) + " FROM (SELECT DISTINCT * FROM structured_events) GROUP BY ALL")
def structured_counts(spark, sf_dir):
    return P.structured_counts(table(spark, sf_dir, "structured_events").distinct(), ["target_ticker", "feature_date"], "event_type", list(ONTOLOGY))


@query(f"WITH {EDGES} SELECT ticker, event_date, " + ", ".join(f"count(DISTINCT event_id) FILTER (WHERE news_level = '{v}') AS {v}" for v in E.LEVELS) + " FROM edges GROUP BY ALL")
def exposure_counts(spark, sf_dir):
    edge = P.edges(events(spark, sf_dir), ALL)
    return edge.groupBy("ticker", "event_date").agg(*(F.countDistinct(F.when(F.col("news_level") == v, F.col("event_id"))).alias(v) for v in E.LEVELS))


