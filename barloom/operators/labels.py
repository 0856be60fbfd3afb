"""Targets and labels: forward windows, peers, train-only thresholds, spikes, regimes, breadth."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import expr as X
from barloom.operators import prefix
from barloom.operators.market import calendar
from barloom.session import written


def forward_windows(panel: DataFrame, value: str = "log_variance", horizon: int = 5) -> DataFrame:
    """entity, date, forward_mean, outcome_start_date, outcome_end_date, base.

    A row exists for every date of the common calendar whose next `horizon` dates all have a value of
    the entity, whether or not the entity has a bar on the date itself.  Such windows are found from
    their first row, so no grid of dates and entities is built.
    """
    days = calendar(panel).select("date", "position")
    at = panel.filter(F.col(value).isNotNull()).join(F.broadcast(days), "date")
    w = Window.partitionBy("entity").orderBy("position")
    ahead = w.rowsBetween(0, horizon - 1)
    found = at.select(
        "entity", "position", F.col("date").alias("outcome_start_date"), F.lead("date", horizon - 1).over(w).alias("outcome_end_date"), F.lead("position", horizon - 1).over(w).alias("last"),
        F.avg(value).over(ahead).alias("forward_mean"), F.when(F.lag("position").over(w) == F.col("position") - 1, F.lag(value).over(w)).alias("base"),
    ).filter(F.col("last") == F.col("position") + horizon - 1)
    anchor = days.select((F.col("position") + 1).alias("position"), "date")
    return found.join(F.broadcast(anchor), "position").select("entity", "date", "base", "forward_mean", "outcome_start_date", "outcome_end_date")


def peer_relative(targets: DataFrame, value: str = "forward_mean", least: int = 3) -> DataFrame:
    """Adds the mean of the other entities of the date and the difference to it; dates with fewer than
    `least` values are left out.  Per-date sums are joined back by broadcast (one row per date)."""
    stats = targets.groupBy("date").agg(F.count(value).alias("n_valid"), F.sum(value).alias("__s")).filter(F.col("n_valid") >= max(least, 2))
    out = targets.filter(F.col(value).isNotNull()).join(F.broadcast(stats), "date")
    peer = (F.col("__s") - F.col(value)) / (F.col("n_valid") - 1)
    return out.withColumn("peer_mean", peer).withColumn("relative_target", F.col(value) - F.col("peer_mean")).withColumn("demeaned_target", F.col(value) - F.col("__s") / F.col("n_valid")).drop("__s")


def _inversions(batches):
    """Rows of a partition that do not stand above the row before, and its first and last row."""
    before = first = None
    n = 0
    for batch in batches:
        for key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            n += before is not None and key <= before
            first, before = first or key, key
    if first:
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (first[0], first[1], before[0], before[1], n)], ["date_0", "entity_0", "date_1", "entity_1", "n"])


def unsorted_rows(rows: DataFrame, date: str = "date", entity: str = "entity") -> DataFrame:
    """One row: n_violations of the order (date, entity) as the rows stand.  Partitions are checked by
    themselves, and their ends against each other (one row per partition)."""
    edges = rows.select(F.col(date), F.col(entity)).mapInArrow(_inversions, "date_0 date, entity_0 string, date_1 date, entity_1 string, n long")
    w = Window.orderBy("date_0", "entity_0", "date_1", "entity_1")
    steps = edges.select("n", (F.struct("date_0", "entity_0") <= F.lag(F.struct("date_1", "entity_1")).over(w)).alias("overlap"))
    return steps.agg((F.coalesce(F.sum("n"), F.lit(0)) + F.count_if("overlap")).alias("n_violations"))


def audit_target(targets: DataFrame, panel: DataFrame, value: str = "log_variance", horizon: int = 5, least: int = 3) -> DataFrame:
    """The nine invariants of peer-relative targets: check, passed, n_violations.

    `panel` has the values of the dates, from which the forward means are computed once more.
    """
    tight = 1e-9
    peers = F.col("n_valid") - 1
    own = targets.groupBy("date").agg(F.sum("forward_mean").alias("__sum"), F.sum("demeaned_target").alias("__zero"))
    days = calendar(panel).select("date", "position")
    wide = written(targets, "targets")
    steps = wide.select("entity", "date").join(F.broadcast(days), "date").withColumn("__step", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).select("entity", "date", (F.col("position") + F.col("__step")).alias("position"))
    ahead = steps.join(panel.select("entity", "date", value).join(F.broadcast(days), "date").select("entity", "position", F.col(value).alias("__v")), ["entity", "position"], "left")
    again = ahead.groupBy("entity", "date").agg(F.count("__v").alias("__n"), F.avg("__v").alias("__again"))
    rows = wide.join(F.broadcast(own), "date").join(again, ["entity", "date"], "left")
    checks = {
        "unique_entity_date": F.count("*") - F.countDistinct("entity", "date"),
        "finite_target": F.count_if(X.no_nan("relative_target").isNull() | X.no_nan("forward_mean").isNull() | X.no_nan("peer_mean").isNull()),
        "forward_mean_recomputed": F.count_if((F.coalesce(F.col("__n"), F.lit(0)) != horizon) | (F.abs(F.col("__again") - F.col("forward_mean")) > tight)),
        "dates_strictly_ahead": F.count_if((F.col("outcome_start_date") <= F.col("date")) | (F.col("outcome_end_date") < F.col("outcome_start_date"))),
        "leave_one_out_excludes_self": F.count_if(F.abs((F.col("__sum") - F.col("forward_mean")) / peers - F.col("peer_mean")) > tight),
        "leave_one_out_algebra": F.count_if(F.abs(F.col("demeaned_target") * F.col("n_valid") / peers - F.col("relative_target")) > tight),
        "demeaned_daily_sum": F.count_if(F.abs("__zero") > tight * F.col("n_valid")),
        "cross_section": F.count_if(F.col("n_valid") < least),
    }
    found = rows.agg(*(c.alias(k) for k, c in checks.items())).unpivot([], list(checks), "check", "n_violations")
    order = unsorted_rows(targets.orderBy("date", "entity")).select(F.lit("sorted_date_entity").alias("check"), "n_violations")
    return found.unionByName(order).select("check", (F.col("n_violations") == 0).alias("passed"), "n_violations")


def fit_thresholds(frame: DataFrame, value: str, quantiles: dict[str, float], sample_deviation: bool = True) -> DataFrame:
    """Per entity, on train rows only: quantiles of |value|, centre and scale, and n."""
    train = frame.filter((F.col("split") == "train") & F.col(value).isNotNull())
    deviation = F.stddev_samp(value) if sample_deviation else F.stddev_pop(value)
    q = [F.percentile(F.abs(value), F.lit(p)).alias(k) for k, p in quantiles.items()]
    return train.groupBy("entity").agg(*q, F.avg(value).alias("center"), F.greatest(F.coalesce(deviation, F.lit(0.0)), F.lit(X.EPSILON)).alias("scale"), F.count("*").alias("n"))


def _regime(value, low, high):
    return F.when(value <= low, 0).when(value <= high, 1).when(value.isNotNull(), 2)


def spike_labels(frame: DataFrame, value: str, thresholds: DataFrame) -> DataFrame:
    """spike_q90, spike_q95 (strictly above) and regime (at most q50, at most q90, above), by entity.

    An entity without train rows has no thresholds: its labels are null.
    """
    size = F.abs(F.col(value))
    out = frame.join(thresholds.select("entity", "q50", "q90", "q95", "center", "scale"), "entity", "left")
    return out.withColumns({"spike_q90": (size > F.col("q90")).cast("int"), "spike_q95": (size > F.col("q95")).cast("int"), "regime": F.when(F.col("q50").isNotNull(), _regime(size, F.col("q50"), F.col("q90")))})


def pooled_labels(frame: DataFrame, value: str, thresholds: DataFrame) -> DataFrame:
    """The same on values standardised by entity, with one set of quantiles pooled over train."""
    z = (F.col(value) - F.col("center")) / F.col("scale")
    out = frame.join(thresholds.select("entity", "center", "scale"), "entity", "left").withColumn("standardized", z)
    sizes = out.filter((F.col("split") == "train") & F.col("standardized").isNotNull()).select(F.abs("standardized").alias("__size"))
    pooled = prefix.quantiles(sizes, [], "__size", [0.5, 0.9, 0.95], "__q")
    size = F.abs("standardized")
    return out.crossJoin(F.broadcast(pooled)).withColumns({"spike_q90_pooled": (size > F.col("__q")[1]).cast("int"), "spike_q95_pooled": (size > F.col("__q")[2]).cast("int"), "regime_pooled": _regime(size, F.col("__q")[0], F.col("__q")[1])}).drop("__q")


def sector_panel(labelled: DataFrame, value: str, spike: str = "spike_q90", counts: tuple[int, ...] = (3, 5, 6)) -> DataFrame:
    """Per date: entities, mean and deviation, share and number of spikes, and count thresholds."""
    out = labelled.groupBy("date").agg(F.countDistinct("entity").alias("n_entities"), F.avg(value).alias("sector_mean"), F.stddev_samp(value).alias("sector_std"), F.avg(spike).alias("spike_breadth"), F.sum(spike).alias("spike_count"))
    return out.withColumns({f"spike_at_least_{k}": (F.col("spike_count") >= k).cast("int") for k in counts})


def fold_labels(rows: DataFrame, value: str, quantiles: tuple[float, float, float] = (0.5, 0.9, 0.95)) -> DataFrame:
    """Labels of each fold from thresholds of its own train side (`fold`, `fold_split`): spike_q90,
    spike_q95, regime, and the same on values standardised by entity against pooled quantiles.

    An entity that a fold's train side lacks has null labels there.  The pooled quantiles come from
    counted values, so no task holds a fold.
    """
    keys = ["fold", "entity"]
    size = F.abs(F.col(value))
    train = rows.filter((F.col("fold_split") == "train") & F.col(value).isNotNull())
    own = train.groupBy(*keys).agg(*(F.percentile(size, F.lit(q)).alias(f"__q{i}") for i, q in enumerate(quantiles)), F.avg(value).alias("__center"), F.greatest(F.coalesce(F.stddev_samp(value), F.lit(0.0)), F.lit(X.EPSILON)).alias("__scale"))
    out = rows.join(own, keys, "left").withColumn("standardized", (F.col(value) - F.col("__center")) / F.col("__scale"))
    sizes = out.filter((F.col("fold_split") == "train") & F.col("standardized").isNotNull()).select("fold", F.abs("standardized").alias("__size"))
    pooled = prefix.quantiles(sizes, ["fold"], "__size", list(quantiles), "__p")
    z = F.abs("standardized")
    named = out.join(F.broadcast(pooled), "fold", "left").withColumns({
        "spike_q90": (size > F.col("__q1")).cast("int"), "spike_q95": (size > F.col("__q2")).cast("int"), "regime": F.when(F.col("__q0").isNotNull(), _regime(size, F.col("__q0"), F.col("__q1"))),
        "spike_q90_pooled": (z > F.col("__p")[1]).cast("int"), "spike_q95_pooled": (z > F.col("__p")[2]).cast("int"), "regime_pooled": _regime(z, F.col("__p")[0], F.col("__p")[1]),
    })
    return named.drop("__q0", "__q1", "__q2", "__center", "__scale", "__p")
