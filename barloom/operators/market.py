"""Bars: validity, merging of deliveries, range volatility, features of one series, next-day target.

A panel has the columns entity, date, open, high, low, close and is unique by (entity, date).  Windows
run within an entity, whose rows are bounded by the calendar; everything per date is a grouped
aggregate joined back, so that no date is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import expr as X
from barloom.operators import prefix
from barloom.session import written

PRICES = ("open", "high", "low", "close")


def coerced(bars: DataFrame) -> DataFrame:
    """Prices as finite doubles; what is no number becomes null (never an error)."""
    fields = {f.name: f.dataType.simpleString() for f in bars.schema.fields}
    return bars.withColumns({p: X.no_nan(F.col(p).try_cast("double") if fields[p] == "string" else p) for p in PRICES})


def is_valid_bar() -> Column:
    o, h, l, c = (F.col(p) for p in PRICES)
    complete = o.isNotNull() & h.isNotNull() & l.isNotNull() & c.isNotNull()
    return F.coalesce(complete & (F.least(o, h, l, c) > 0) & (h >= F.greatest(o, c, l)) & (l <= F.least(o, c, h)), F.lit(False))


def valid_bars(bars: DataFrame) -> DataFrame:
    """Rows with four finite positive prices and a consistent range."""
    return coerced(bars).filter(is_valid_bar())


def series_panel(bars: DataFrame, *, by: tuple[str, ...] = ("source", "ticker")) -> DataFrame:
    """entity, date and prices of raw rows; the entity joins the cleaned `by` columns.

    Keys are trimmed and upper-cased; rows without a key or date are left out.
    """
    keys = [F.upper(F.trim(k)) for k in by]
    rows = bars.select(F.concat_ws("/", *keys).alias("entity"), F.col("feature_date").cast("date").alias("date"), *PRICES, *[k.alias(f"__{i}") for i, k in enumerate(keys)])
    for i in range(len(keys)):
        rows = rows.filter(F.col(f"__{i}").isNotNull())
    return rows.filter("date is not null").select("entity", "date", *PRICES)


def merged_bars(bars: DataFrame, keys: tuple[str, ...] = ("entity", "date")) -> DataFrame:
    """One bar per key: mean open and close, highest high, lowest low (equal deliveries stay as they are)."""
    return bars.groupBy(*keys).agg(F.avg("open").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.avg("close").alias("close"))


def duplicate_audit(bars: DataFrame, keys: tuple[str, ...] = ("entity", "date")) -> DataFrame:
    """Keys with several rows: their number and whether any price differs."""
    differ = F.lit(False)
    for p in PRICES:
        differ = differ | (F.min(p) != F.max(p))
    return bars.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.coalesce(differ, F.lit(False)).alias("conflicting")).filter("n_rows > 1")


def transaction_bars(rows: DataFrame, entity: str, when: Column, order: list[str], value: str) -> DataFrame:
    """Open, high, low, close of a value per entity and period; first and last by `order`."""
    first = F.struct(*order)
    return rows.groupBy(F.col(entity).alias("entity"), when.alias("date")).agg(
        F.min_by(value, first).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, first).alias("close"), F.count("*").alias("n_rows")
    )


def with_volatility(panel: DataFrame, epsilon: float = X.EPSILON) -> DataFrame:
    """Adds gk_raw, log_variance, parkinson_raw, log_parkinson."""
    out = panel.withColumn("gk_raw", X.garman_klass()).withColumn("parkinson_raw", X.parkinson())
    return out.withColumn("log_variance", X.log_variance(F.col("gk_raw"), epsilon)).withColumn("log_parkinson", X.log_variance(F.col("parkinson_raw"), epsilon))


def _series() -> Window:
    return Window.partitionBy("entity").orderBy("date")


def full_window(value: str, rows: int, aggregate) -> Column:
    """An aggregate over the last `rows` rows, null until there are that many values."""
    w = _series().rowsBetween(-(rows - 1), 0)
    return F.when(F.count(value).over(w) == rows, aggregate(value).over(w))


def lag_features(panel: DataFrame, value: str = "log_variance", lags: int = 22) -> DataFrame:
    w = _series()
    return panel.select("*", *(F.lag(value, k).over(w).alias(f"lag_{k}") for k in range(1, lags + 1)))


def har_features(panel: DataFrame, value: str = "log_variance") -> DataFrame:
    """Daily, weekly (5 rows) and monthly (22 rows) levels."""
    return panel.select("*", F.col(value).alias("har_daily"), full_window(value, 5, F.avg).alias("har_weekly"), full_window(value, 22, F.avg).alias("har_monthly"))


def rolling_stats(panel: DataFrame, value: str = "log_variance", windows: tuple[int, ...] = (5, 10, 22)) -> DataFrame:
    """Mean, population deviation, minimum and maximum over full windows."""
    named = (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))
    return panel.select("*", *(full_window(value, n, f).alias(f"roll_{n}_{k}") for n in windows for k, f in named))


def expanding_mean(panel: DataFrame, value: str = "log_variance") -> DataFrame:
    return panel.withColumn("historical_mean", F.avg(value).over(_series().rowsBetween(Window.unboundedPreceding, 0)))


def log_returns(panel: DataFrame, windows: tuple[int, ...] = (5, 22)) -> DataFrame:
    out = panel.withColumn("log_return", F.ln(F.col("close") / F.lag("close").over(_series()))).withColumn("abs_return", F.abs("log_return"))
    return out.select("*", *(full_window("log_return", n, F.stddev_pop).alias(f"return_std_{n}") for n in windows))


def calendar(panel: DataFrame) -> DataFrame:
    """date, position (from 0), next_date: one row per date of the common calendar.

    The window without a partition runs over distinct dates only, which no amount of data multiplies.
    """
    w = Window.orderBy("date")
    return panel.select("date").filter("date is not null").distinct().select("date", (F.row_number().over(w) - 1).alias("position"), F.lead("date").over(w).alias("next_date"))


def next_target(panel: DataFrame, value: str = "log_variance") -> DataFrame:
    """Next row's date and value, and whether that date is the next one of the common calendar."""
    w = _series()
    out = panel.withColumn("target_date", F.lead("date").over(w)).withColumn("target", F.lead(value).over(w))
    return out.join(F.broadcast(calendar(panel).select("date", "next_date")), "date", "left").withColumn("aligned", F.coalesce(F.col("target_date") == F.col("next_date"), F.lit(False)))


def model_ready(frame: DataFrame, features: list[str], target: str = "target") -> DataFrame:
    """Rows with all features and the target present and the target on the next common date."""
    ok = F.col("aligned") & F.col(target).isNotNull()
    for f in features:
        ok = ok & F.col(f).isNotNull()
    return frame.filter(ok)


# The quantiles of the distribution table.
QUANTILES = (0.0, 0.001, 0.01, 0.05, 0.5, 0.95, 0.99, 0.999, 1.0)


def distribution_table(panel: DataFrame, metrics: list[str], quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """Per entity and for all (__ALL__): count, mean, sample deviation and exact quantiles of each metric.

    An entity is bounded by its calendar; the quantiles over all come from counted values, so no task
    holds them all.  A metric without values gives no row.
    """
    long = written(panel.select("entity", *metrics).unpivot(["entity"], metrics, "metric", "value").filter("value is not null"), "distribution")
    stats = [F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std")]
    own = long.groupBy("entity", "metric").agg(*stats, F.percentile("value", F.array(*map(F.lit, quantiles))).alias("q"))
    pooled = long.groupBy("metric").agg(*stats).join(prefix.quantiles(long, ["metric"], "value", list(quantiles)), "metric").select(F.lit("__ALL__").alias("entity"), "metric", "n", "mean", "std", "q")
    return own.unionByName(pooled).select("entity", "metric", "n", "mean", "std", *(F.col("q")[i].alias(f"q{p:g}".replace(".", "_")) for i, p in enumerate(quantiles)))


def calendar_encodings(panel: DataFrame, date: str = "date") -> DataFrame:
    """Sine and cosine of weekday (Monday 0) and month, and years since 2000."""
    import math

    dow, month = F.weekday(date), F.month(date) - 1
    two_pi = 2 * math.pi
    return panel.select(
        "*", F.sin(dow * F.lit(two_pi / 7)).alias("dow_sin"), F.cos(dow * F.lit(two_pi / 7)).alias("dow_cos"), F.sin(month * F.lit(two_pi / 12)).alias("month_sin"), F.cos(month * F.lit(two_pi / 12)).alias("month_cos"),
        (F.datediff(F.col(date), F.lit("2000-01-01").cast("date")) / F.lit(365.25)).alias("years"),
    )


def decayed_lookback(panel: DataFrame, value: str, rate: float, rows: int) -> DataFrame:
    """Sum of exp(-rate * k) times the value k rows back, k = 0 to rows; a missing row counts as 0."""
    import math

    w = _series()
    total = F.lit(0.0)
    for k in range(rows + 1):
        total = total + F.lit(math.exp(-rate * k)) * F.coalesce(F.lag(value, k).over(w) if k else F.col(value), F.lit(0.0))
    return panel.withColumn("decayed", total)


def lagged_placebo(panel: DataFrame, value: str, rows: int = 30) -> DataFrame:
    return panel.withColumn("placebo", F.coalesce(F.lag(value, rows).over(_series()), F.lit(0.0)))


def transition_matrix(panel: DataFrame, state: str) -> DataFrame:
    """Counts and row shares of consecutive states of each entity."""
    pairs = panel.select(F.col(state).alias("state"), F.lead(state).over(_series()).alias("next_state")).filter("state is not null and next_state is not null")
    counts = pairs.groupBy("state", "next_state").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("state")))


def mean_autocorrelation(panel: DataFrame, value: str, lags: int) -> DataFrame:
    """Autocorrelation per entity at lags 1..n, averaged over entities with a varying series."""
    w, whole = _series(), Window.partitionBy("entity")
    centred = panel.filter(F.col(value).isNotNull()).select("entity", "date", (F.col(value) - F.avg(value).over(whole)).alias("x"))
    shifted = centred.select("entity", "x", *(F.lag("x", k).over(w).alias(f"x{k}") for k in range(1, lags + 1)))
    per = shifted.groupBy("entity").agg(F.sum(F.col("x") * F.col("x")).alias("total"), *(F.sum(F.col("x") * F.col(f"x{k}")).alias(f"c{k}") for k in range(1, lags + 1))).filter("total > 0")
    long = per.select("entity", F.explode(F.array(*(F.struct(F.lit(k).alias("lag"), (F.col(f"c{k}") / F.col("total")).alias("acf")) for k in range(1, lags + 1)))).alias("e")).select("e.*")
    return long.groupBy("lag").agg(F.avg("acf").alias("mean_acf"), F.count("acf").alias("n_entities"))
