"""Paired comparisons of forecasts: losses, long-run variance, block bootstrap, effective sample, placebos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import expr as X


def paired_losses(df: DataFrame, y: str, base: str, text: str, delta: float = 1.0) -> DataFrame:
    """Adds absolute, squared and Huber loss of the base minus that of the candidate (positive: better)."""
    a, b = F.col(y) - F.col(base), F.col(y) - F.col(text)
    return df.withColumns({"absolute_gain": F.abs(a) - F.abs(b), "squared_gain": a * a - b * b, "huber_gain": X.huber(a, delta) - X.huber(b, delta)})


def join_models(predictions: DataFrame, keys: list[str], base: str, text: str) -> DataFrame:
    """keys, y, base, text of rows that both models predict: one scan and conditional aggregates
    instead of a self join.  Several rows of a model per key are an error in the result's `n`."""
    is_base, is_text = F.col("model") == base, F.col("model") == text
    out = predictions.filter(is_base | is_text).groupBy(*keys).agg(F.max("y").alias("y"), F.max(F.when(is_base, F.col("p"))).alias("base"), F.max(F.when(is_text, F.col("p"))).alias("text"), F.count("*").alias("n"))
    return out.filter("base is not null and text is not null")


def daily_gains(losses: DataFrame, keys: list[str], date: str = "date") -> DataFrame:
    return losses.groupBy(*keys, date).agg(F.avg("absolute_gain").alias("absolute_gain"), F.avg("squared_gain").alias("squared_gain"), F.avg("huber_gain").alias("huber_gain"), F.count("*").alias("n"))


def newey_west(daily: DataFrame, keys: list[str], value: str, lags: int, date: str = "date") -> DataFrame:
    """Mean of a daily series with its Bartlett long-run standard error and t statistic.

    Groups of at most lags + 2 dates, and series without variation, have null statistics.  A series has
    one row per date, so its window is bounded by the calendar.
    """
    whole, w = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(date)
    x = daily.filter(X.no_nan(value).isNotNull()).select(*keys, date, F.col(value).alias("v"), (F.col(value) - F.avg(value).over(whole)).alias("x"))
    shifted = x.select("*", *(F.lag("x", k).over(w).alias(f"x{k}") for k in range(1, lags + 1)))
    n = F.count("*")
    total = F.sum(F.col("x") * F.col("x")) / n
    for k in range(1, lags + 1):
        total = total + F.lit(2 * (1 - k / (lags + 1))) * F.coalesce(F.sum(F.col("x") * F.col(f"x{k}")), F.lit(0.0)) / n
    out = shifted.groupBy(*keys).agg(n.alias("n"), F.avg("v").alias("mean"), F.greatest(total, F.lit(0.0)).alias("lrv"))
    se = F.when(F.col("n") > lags + 2, F.sqrt(F.col("lrv") / F.col("n")))
    return out.select(*keys, "n", F.when(F.col("n") > lags + 2, F.col("mean")).alias("mean"), se.alias("hac_se"), F.try_divide(F.col("mean"), se).alias("t_statistic"))


def block_starts(spark, reps: int, blocks: Column, n: Column, seed: int, sizes: DataFrame) -> DataFrame:
    """rep, block, start for every row of `sizes`: portable uniform starts in 0..n-1."""
    grid = sizes.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return grid.withColumn("start", F.floor(X.uniform(F.lit(seed), "rep", "block") * n).cast("int"))


def block_bootstrap(daily: DataFrame, value: str, block: int, reps: int, seed: int, *, date: str = "date", circular: bool = True) -> DataFrame:
    """rep, mean: means of moving-block resamples of a daily series.

    Circular blocks wrap around; otherwise blocks start early enough to fit.  The last block is cut so
    that every draw has as many dates as the series.  Only (replicates x dates) small rows are built,
    from statistics that were collapsed to one row per date before.
    """
    spark = daily.sparkSession
    w = Window.orderBy(date)  # one row per date
    series = daily.select(date, F.col(value).alias("v")).filter("v is not null").select((F.row_number().over(w) - 1).alias("i"), "v")
    size = series.agg(F.count("*").alias("n"))
    length = F.least(F.lit(block), F.col("n"))
    room = F.col("n") if circular else F.col("n") - length + 1
    starts = block_starts(spark, reps, F.ceil(F.col("n") / length).cast("int"), room, seed, size.filter("n > 0"))
    drawn = starts.withColumn("k", F.explode(F.sequence(F.lit(0), length.cast("int") - 1))).filter(F.col("block") * length + F.col("k") < F.col("n")).select("rep", F.pmod(F.col("start") + F.col("k"), F.col("n")).alias("i"))
    return drawn.join(F.broadcast(series), "i").groupBy("rep").agg(F.avg("v").alias("mean"))


def bootstrap_summary(draws: DataFrame, level: float = 0.95) -> DataFrame:
    a = (1 - level) / 2
    return draws.agg(F.count("*").alias("repetitions"), F.avg("mean").alias("bootstrap_mean"), F.stddev_samp("mean").alias("bootstrap_se"), F.percentile("mean", F.lit(a)).alias("ci_lower"), F.percentile("mean", F.lit(1 - a)).alias("ci_upper"), F.avg((F.col("mean") > 0).cast("double")).alias("p_positive"))


def pairwise_correlations(panel: DataFrame, entity: str, value: str, date: str = "date") -> DataFrame:
    """entity_a < entity_b, n, correlation over common dates; meant for universes of bounded size."""
    a = panel.select(F.col(entity).alias("entity_a"), date, F.col(value).alias("x"))
    b = panel.select(F.col(entity).alias("entity_b"), date, F.col(value).alias("y"))
    return a.join(b, date).filter("entity_a < entity_b").groupBy("entity_a", "entity_b").agg(F.count("*").alias("n"), X.correlation(F.col("x"), F.col("y"), 2).alias("correlation"))


def effective_sample(panel: DataFrame, entity: str, value: str, date: str = "date") -> DataFrame:
    """n_entities, n_dates, mean correlation and the sample size n T / (1 + (n - 1) rho), also capped."""
    rho = pairwise_correlations(panel, entity, value, date).agg(F.avg("correlation").alias("mean_correlation"))
    size = panel.filter(F.col(value).isNotNull()).agg(F.countDistinct(entity).alias("n_entities"), F.countDistinct(date).alias("n_dates"))
    both = size.crossJoin(rho)  # one row each
    base = 1 + (F.col("n_entities") - 1) * F.col("mean_correlation")
    nominal = (F.col("n_entities") * F.col("n_dates")).cast("double")
    effective = F.when(base > 0, nominal / base)
    return both.select("n_entities", "n_dates", "mean_correlation", effective.alias("effective"), F.least(effective, nominal).alias("effective_capped"))


def leave_one_out(df: DataFrame, group: str, value: str) -> DataFrame:
    """Mean of a value without each group in turn, from totals minus the group."""
    per = df.filter(F.col(value).isNotNull()).groupBy(group).agg(F.sum(value).alias("s"), F.count("*").alias("n"))
    whole = per.agg(F.sum("s").alias("total_s"), F.sum("n").alias("total_n"))
    return per.crossJoin(F.broadcast(whole)).select(group, F.col("n").alias("n_left_out"), F.try_divide(F.col("total_s") - F.col("s"), F.col("total_n") - F.col("n")).alias("mean_without"))


def empirical_p(observed: DataFrame, nulls: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(1 + #{null >= observed}) / (1 + n), the percentile of the observed value and its win rate."""
    both = observed.select(*keys, F.col(value).alias("obs")).join(nulls.select(*keys, F.col(value).alias("null")), keys)
    n = F.count("null")
    return both.groupBy(*keys).agg(n.alias("n_nulls"), F.max("obs").alias("observed"), ((F.count_if(F.col("null") >= F.col("obs")) + 1) / (n + 1)).alias("p_value"), (F.count_if(F.col("null") < F.col("obs")) / n).alias("percentile"), F.avg("null").alias("null_mean"))
