"""Queries on bars and their features."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions import expr as X
from barloom.operators import market as M
from barloom.plans.catalog import query, r, rounded, table

C = repr(2 * math.log(2) - 1)
P4 = repr(4 * math.log(2))

RAW = """raw AS (
  SELECT upper(trim(source)) || '/' || upper(trim(ticker)) AS entity, CAST(feature_date AS DATE) AS date,
         "open", high, low, "close", source_row_number AS rn
  FROM inspect_schema WHERE source IS NOT NULL AND ticker IS NOT NULL AND feature_date IS NOT NULL)"""
BARS = f"""{RAW}, valid AS (
  SELECT * FROM raw WHERE isfinite("open") AND isfinite(high) AND isfinite(low) AND isfinite("close")
    AND least("open", high, low, "close") > 0 AND high >= greatest("open", "close", low) AND low <= least("open", "close", high)),
bars AS (SELECT entity, date, avg("open") AS "open", max(high) AS high, min(low) AS low, avg("close") AS "close" FROM valid GROUP BY ALL)"""
VOL = f"""{BARS}, g AS (
  SELECT *, 0.5 * pow(ln(high / low), 2) - {C}::DOUBLE * pow(ln("close" / "open"), 2) AS gk_raw, pow(ln(high / low), 2) / {P4}::DOUBLE AS parkinson_raw FROM bars),
vol AS (SELECT *, ln(greatest(gk_raw, 1e-12) + 1e-12) AS log_variance, ln(greatest(parkinson_raw, 1e-12) + 1e-12) AS log_parkinson FROM g)"""
W = "PARTITION BY entity ORDER BY date"


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.series_panel(table(spark, sf_dir, "inspect_schema"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.merged_bars(M.valid_bars(raw(spark, sf_dir)))


def vol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.with_volatility(bars(spark, sf_dir))


@query("""SELECT c_mktsegment AS entity, CAST(date_trunc('week', o_orderdate) AS DATE) AS date,
  arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS "open", max(o_totalprice) AS high, min(o_totalprice) AS low,
  arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS "close", count(*) AS n_rows
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL""")
def ohlc_bars(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return M.transaction_bars(rows, "c_mktsegment", F.to_date(F.date_trunc("week", "o_orderdate")), ["o_orderdate", "o_orderkey"], "o_totalprice")


@query("""SELECT event_type AS entity, CAST(ts AS DATE) AS date, arg_min(value, (ts, event_id)) AS "open", max(value) AS high, min(value) AS low,
  arg_max(value, (ts, event_id)) AS "close", count(*) AS n_rows FROM events GROUP BY ALL""")
def ohlc_bars_events(spark, sf_dir):
    return M.transaction_bars(table(spark, sf_dir, "events"), "event_type", F.to_date("ts"), ["ts", "event_id"], "value")


@query(f"""WITH {RAW} SELECT entity, count(*) AS n_rows,
  count(*) FILTER (WHERE "open" IS NULL OR high IS NULL OR low IS NULL OR "close" IS NULL) AS n_incomplete,
  count(*) FILTER (WHERE coalesce(least("open", high, low, "close") > 0 AND "open" IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND "close" IS NOT NULL
    AND high >= greatest("open", "close", low) AND low <= least("open", "close", high), false)) AS n_valid FROM raw GROUP BY entity""")
def ohlc_validity(spark, sf_dir):
    missing = F.col("open").isNull() | F.col("high").isNull() | F.col("low").isNull() | F.col("close").isNull()
    return M.coerced(raw(spark, sf_dir)).groupBy("entity").agg(F.count("*").alias("n_rows"), F.count_if(missing).alias("n_incomplete"), F.count_if(M.is_valid_bar()).alias("n_valid"))


@query("""SELECT upper(trim(ticker)) AS ticker, count(*) AS n_rows, count(DISTINCT source) AS n_sources FROM inspect_schema
  WHERE upper(trim(ticker)) IN ('ADI','AMAT','AMD','AVGO','INTC','KLAC','LRCX','MU','NVDA','QCOM','TXN') GROUP BY 1""")
def universe_filter(spark, sf_dir):
    ticker = F.upper(F.trim("ticker"))
    return table(spark, sf_dir, "inspect_schema").filter(ticker.isin(*UNIVERSE)).groupBy(ticker.alias("ticker")).agg(F.count("*").alias("n_rows"), F.countDistinct("source").alias("n_sources"))


# The ticker universe.
UNIVERSE = ("ADI", "AMAT", "AMD", "AVGO", "INTC", "KLAC", "LRCX", "MU", "NVDA", "QCOM", "TXN")


@query("""SELECT coalesce(regexp_replace(lower(industry), '[^a-z0-9]', '', 'g'), '') LIKE '%semiconductor%' AS is_core, count(*) AS n_rows, count(DISTINCT industry) AS n_spellings FROM inspect_schema GROUP BY 1""")
def industry_match(spark, sf_dir):
    core = F.coalesce(F.regexp_replace(F.lower("industry"), "[^a-z0-9]", ""), F.lit("")).contains("semiconductor")
    return table(spark, sf_dir, "inspect_schema").groupBy(core.alias("is_core")).agg(F.count("*").alias("n_rows"), F.countDistinct("industry").alias("n_spellings"))


@query(f"""WITH {BARS} SELECT entity, date, round("open", 8) AS "open", high, low, round("close", 8) AS "close" FROM bars""")
def duplicate_bar_merge(spark, sf_dir):
    return rounded(bars(spark, sf_dir))


@query(f"""WITH {BARS} SELECT entity, date, count(*) AS n_rows,
  min("open") <> max("open") OR min(high) <> max(high) OR min(low) <> max(low) OR min("close") <> max("close") AS conflicting FROM valid GROUP BY ALL HAVING count(*) > 1""")
def duplicate_bar_audit(spark, sf_dir):
    return M.duplicate_audit(M.valid_bars(raw(spark, sf_dir)))


@query(f"WITH {VOL} SELECT entity, date, round(gk_raw, 10) AS gk_raw, round(log_variance, 8) AS log_variance FROM vol")
def garman_klass(spark, sf_dir):
    return vol(spark, sf_dir).select("entity", "date", r("gk_raw", 10), r("log_variance"))


@query(f"WITH {VOL} SELECT entity, date, round(parkinson_raw, 10) AS parkinson_raw, round(log_parkinson, 8) AS log_parkinson FROM vol")
def parkinson(spark, sf_dir):
    return vol(spark, sf_dir).select("entity", "date", r("parkinson_raw", 10), r("log_parkinson"))


@query(f"WITH {VOL} SELECT entity, date, " + ", ".join(f"round(lag(log_variance, {k}) OVER ({W}), 8) AS lag_{k}" for k in range(1, 23)) + " FROM vol")
def lag_features(spark, sf_dir):
    return rounded(M.lag_features(vol(spark, sf_dir).select("entity", "date", "log_variance")).drop("log_variance"))


def _full(n: int, f: str, v: str = "log_variance") -> str:
    over = f"OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({v}) {over} = {n} THEN {f}({v}) {over} END"


@query(f"WITH {VOL} SELECT entity, date, round(log_variance, 8) AS har_daily, round({_full(5, 'avg')}, 8) AS har_weekly, round({_full(22, 'avg')}, 8) AS har_monthly FROM vol")
def har_features(spark, sf_dir):
    return rounded(M.har_features(vol(spark, sf_dir).select("entity", "date", "log_variance")).drop("log_variance"))


@query(
    f"WITH {VOL} SELECT entity, date, "
    + ", ".join(f"round({_full(n, f)}, 6) AS roll_{n}_{k}" for n in (5, 10, 22) for k, f in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max")))
    + " FROM vol"
)
def rolling_stats(spark, sf_dir):
    return rounded(M.rolling_stats(vol(spark, sf_dir).select("entity", "date", "log_variance")).drop("log_variance"), 6)


@query(f"WITH {VOL} SELECT entity, date, round(avg(log_variance) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 8) AS historical_mean FROM vol")
def expanding_mean(spark, sf_dir):
    return rounded(M.expanding_mean(vol(spark, sf_dir)).select("entity", "date", "historical_mean"))


@query(f"""WITH {VOL}, l AS (SELECT entity, date, ln("close" / lag("close") OVER ({W})) AS log_return FROM vol)
  SELECT entity, date, round(log_return, 8) AS log_return, round(abs(log_return), 8) AS abs_return,
  round({_full(5, 'stddev_pop', 'log_return')}, 6) AS return_std_5, round({_full(22, 'stddev_pop', 'log_return')}, 6) AS return_std_22 FROM l""")
def log_returns(spark, sf_dir):
    out = M.log_returns(bars(spark, sf_dir))
    return out.select("entity", "date", r("log_return"), r("abs_return"), r("return_std_5", 6), r("return_std_22", 6))


CALENDAR = "cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS position, lead(date) OVER (ORDER BY date) AS next_date FROM (SELECT DISTINCT date FROM vol))"
TARGET = f"""{VOL}, {CALENDAR}, t AS (SELECT *, lead(date) OVER ({W}) AS target_date, lead(log_variance) OVER ({W}) AS target FROM vol),
targets AS (SELECT t.*, coalesce(t.target_date = cal.next_date, false) AS aligned FROM t LEFT JOIN cal USING (date))"""


@query(f"WITH {VOL}, {CALENDAR} SELECT date, position, next_date FROM cal")
def common_calendar(spark, sf_dir):
    return M.calendar(bars(spark, sf_dir)).withColumn("position", F.col("position").cast("long"))


@query(f"WITH {TARGET} SELECT entity, date, target_date, round(target, 8) AS target, aligned FROM targets")
def next_target_aligned(spark, sf_dir):
    return M.next_target(vol(spark, sf_dir)).select("entity", "date", "target_date", r("target"), "aligned")


READY = f"""{TARGET}, feat AS (SELECT *, log_variance AS har_daily, {_full(5, 'avg')} AS har_weekly, {_full(22, 'avg')} AS har_monthly FROM targets),
ready AS (SELECT * FROM feat WHERE aligned AND target IS NOT NULL AND har_weekly IS NOT NULL AND har_monthly IS NOT NULL)"""


def ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.model_ready(M.har_features(M.next_target(vol(spark, sf_dir))), ["har_daily", "har_weekly", "har_monthly"])


@query(f"WITH {READY} SELECT entity, count(*) AS n_ready, min(date) AS first_date, max(target_date) AS last_target FROM ready GROUP BY entity")
def model_ready(spark, sf_dir):
    return ready(spark, sf_dir).groupBy("entity").agg(F.count("*").alias("n_ready"), F.min("date").alias("first_date"), F.max("target_date").alias("last_target"))


_DIST = ", ".join(f"round(quantile_cont(value, {q}), 6) AS q{q.replace('.', '_')}" for q in ("0", "0.001", "0.01", "0.05", "0.5", "0.95", "0.99", "0.999", "1"))
_METRICS = {"gk_variance_raw": "gk_raw", "gk_variance": "greatest(gk_raw, 1e-12)", "log_variance": "log_variance", "parkinson_variance": "greatest(parkinson_raw, 1e-12)", "log_parkinson": "log_parkinson"}


@query(f"""WITH {VOL}, long AS ({" UNION ALL ".join(f"SELECT entity, '{k}' AS metric, {v} AS value FROM vol" for k, v in _METRICS.items())}),
  everything AS (SELECT * FROM long UNION ALL SELECT '__ALL__', metric, value FROM long)
  SELECT entity, metric, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, {_DIST} FROM everything GROUP BY entity, metric""")
def distribution_table(spark, sf_dir):
    floor = F.lit(X.EPSILON)
    panel = vol(spark, sf_dir).select("entity", F.col("gk_raw").alias("gk_variance_raw"), F.greatest("gk_raw", floor).alias("gk_variance"), "log_variance", F.greatest("parkinson_raw", floor).alias("parkinson_variance"), "log_parkinson")
    return rounded(M.distribution_table(panel, ["gk_variance_raw", "gk_variance", "log_variance", "parkinson_variance", "log_parkinson"]), 6)


@query("""SELECT DISTINCT feature_date AS date, round(sin((dayofweek(feature_date) + 6) % 7 * 2 * pi() / 7), 8) AS dow_sin, round(cos((dayofweek(feature_date) + 6) % 7 * 2 * pi() / 7), 8) AS dow_cos,
  round(sin((month(feature_date) - 1) * 2 * pi() / 12), 8) AS month_sin, round(cos((month(feature_date) - 1) * 2 * pi() / 12), 8) AS month_cos,
  round(date_diff('day', DATE '2000-01-01', feature_date) / 365.25, 8) AS years FROM split_calendar""")
def calendar_encodings(spark, sf_dir):
    return rounded(M.calendar_encodings(table(spark, sf_dir, "split_calendar").select(F.col("feature_date").alias("date")).distinct()))


@query(f"WITH {VOL} SELECT entity, date, round(" + " + ".join(f"{math.exp(-0.3 * k)!r} * coalesce(lag(log_variance, {k}) OVER ({W}), 0)" for k in range(6)) + ", 8) AS decayed FROM vol")
def decayed_lookback(spark, sf_dir):
    return rounded(M.decayed_lookback(vol(spark, sf_dir).select("entity", "date", "log_variance"), "log_variance", 0.3, 5).drop("log_variance"))


@query(f"WITH {VOL} SELECT entity, date, round(coalesce(lag(log_variance, 30) OVER ({W}), 0), 8) AS placebo FROM vol")
def lagged_placebo(spark, sf_dir):
    return rounded(M.lagged_placebo(vol(spark, sf_dir).select("entity", "date", "log_variance"), "log_variance").drop("log_variance"))


@query(f"""WITH {VOL}, c AS (SELECT entity, date, log_variance - avg(log_variance) OVER (PARTITION BY entity) AS x FROM vol),
  s AS (SELECT *, {", ".join(f"lag(x, {k}) OVER ({W}) AS x{k}" for k in (1, 2, 3, 4, 5))} FROM c),
  e AS (SELECT entity, sum(x * x) AS total, {", ".join(f"sum(x * x{k}) AS c{k}" for k in (1, 2, 3, 4, 5))} FROM s GROUP BY entity HAVING sum(x * x) > 0)
  {" UNION ALL ".join(f"SELECT {k} AS lag, round(avg(c{k} / total), 6) AS mean_acf, count(c{k}) AS n_entities FROM e" for k in (1, 2, 3, 4, 5))}""")
def mean_acf(spark, sf_dir):
    return rounded(M.mean_autocorrelation(vol(spark, sf_dir), "log_variance", 5), 6)


@query(f"""WITH {READY} SELECT round(avg(exp(d) - d - 1), 8) AS qlike, round(avg(l - ln(l) - 1), 8) AS qlike_levels, round(avg(CASE WHEN abs(e) <= 1 THEN 0.5 * e * e ELSE abs(e) - 0.5 END), 8) AS huber, count(*) AS n
  FROM (SELECT least(greatest(target - har_weekly, -50), 50) AS d, target - har_weekly AS e,
    greatest(exp(least(greatest(target, -40), 40)) / greatest(exp(least(greatest(har_weekly, -40), 40)), 1e-12), 1e-12) AS l FROM ready)""")
def loss_functions(spark, sf_dir):
    y, p = F.col("target"), F.col("har_weekly")
    return ready(spark, sf_dir).agg(r(F.avg(X.qlike(y, p)), 8, "qlike"), r(F.avg(X.qlike_levels(y, p)), 8, "qlike_levels"), r(F.avg(X.huber(y - p)), 8, "huber"), F.count("*").alias("n"))
