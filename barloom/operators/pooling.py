"""From events to an entity-date panel: edges, instances with lags, pooled vectors, metadata."""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import expr as X

SENTINEL = 3650


def list_column(c: Column | str) -> Column:
    """A JSON list, or a comma-separated text, as trimmed upper-case elements; null gives an empty list."""
    c = X.col(c)
    parsed = F.coalesce(F.from_json(c, "array<string>"), F.split(c, ","), F.array().cast("array<string>"))
    return F.filter(F.transform(parsed, lambda v: F.upper(F.trim(v))), lambda v: v.isNotNull() & (v != ""))


def event_sets(events: DataFrame, universe: list[str], *, rotate: int = 0) -> DataFrame:
    """event_id, news_level, split, event_date, tickers: the sorted tickers each event concerns.

    `rotate` moves the tickers of target and related news along the universe: a derangement for any
    rotation that is no multiple of its size.
    """
    known = F.array(*map(F.lit, universe))
    base = F.array_sort(F.array_distinct(F.array_intersect(list_column("available_to_tickers"), known)))
    if rotate % len(universe):
        shift = {t: universe[(k + rotate) % len(universe)] for k, t in enumerate(universe)}
        mapping = F.create_map(*[F.lit(x) for pair in shift.items() for x in pair])
        turned = F.array_sort(F.transform(base, lambda v: mapping[v]))
        base = F.when(F.col("news_level").isin("target", "related"), turned).otherwise(base)
    return events.filter("event_id is not null").select("event_id", "news_level", "split", F.col("feature_date").cast("date").alias("event_date"), base.alias("tickers"))


def edges(events: DataFrame, universe: list[str], *, rotate: int = 0) -> DataFrame:
    """event_id, news_level, split, event_date, ticker: one row per event and ticker it concerns."""
    return event_sets(events, universe, rotate=rotate).select("event_id", "news_level", "split", "event_date", F.explode("tickers").alias("ticker"))


def rotate_dates(edge: DataFrame, calendar: DataFrame, offset: int) -> DataFrame:
    """Dates moved by `offset` positions along the dates of their split (calendar: split, date).
    Dates outside the calendar stay."""
    by = Window.partitionBy("split")
    ranked = calendar.select("split", "date").distinct().select("split", "date", (F.row_number().over(by.orderBy("date")) - 1).alias("i"), F.count("*").over(by).alias("n"))
    turn = F.when(F.pmod(F.lit(offset), F.col("n")) == 0, 1).otherwise(F.pmod(F.lit(offset), F.col("n")))
    moved = ranked.withColumn("j", F.pmod(F.col("i") + turn, F.col("n")))
    target = ranked.select("split", F.col("date").alias("new_date"), F.col("i").alias("j"))
    mapping = moved.join(target, ["split", "j"]).select("split", F.col("date").alias("event_date"), "new_date")
    return edge.join(F.broadcast(mapping), ["split", "event_date"], "left").withColumn("event_date", F.coalesce("new_date", "event_date")).drop("new_date")


def same_day(edge: DataFrame, panel: DataFrame) -> DataFrame:
    """Edges on the panel's own dates, lag 0 and weight 1.  The panel is one row per ticker and date,
    bounded by the universe and the calendar, and is broadcast."""
    keys = F.broadcast(panel.select("ticker", F.col("date").alias("event_date")))
    return edge.join(keys, ["ticker", "event_date"]).withColumn("date", F.col("event_date")).withColumn("lag_days", F.lit(0)).withColumn("weight", F.lit(1.0))


def decayed(edge: DataFrame, panel: DataFrame, half_life: float, max_lag: int) -> DataFrame:
    """Edges on every panel date up to `max_lag` calendar days later, weight halving per `half_life`."""
    keys = F.broadcast(panel.select(F.col("ticker").alias("t"), "date"))
    out = edge.join(keys, (F.col("ticker") == F.col("t")) & F.col("date").between(F.col("event_date"), F.date_add("event_date", max_lag))).drop("t")
    lag = F.datediff("date", "event_date")
    return out.withColumn("lag_days", lag).withColumn("weight", F.exp(F.lit(-math.log(2)) * lag / F.lit(half_life)))


def pooled(sets: DataFrame, vectors: DataFrame, panel: DataFrame, how: str, dims: int, vector: str = "embedding", half_life: float = 2.0, max_lag: int = 5) -> DataFrame:
    """ticker, date, news_level, n, pooled: one vector per group.

    mean: sum(v) / n on the same day; decay: sum(w v) / sum(w) over `max_lag` days; normalized_sum:
    sum(v) / sqrt(n); max: elementwise maximum.  Events are first reduced to one vector per date, level
    and ticker set (map-side, on plain columns); only these few rows are spread over tickers and days,
    so an event for the whole universe is not copied once per ticker.  Repeated equal vector rows
    count once; events without a vector do not count.
    """
    both = sets.join(vectors.select("event_id", F.col(vector).alias("v")).filter("v is not null").distinct(), "event_id")
    f = F.max if how == "max" else F.sum
    part = both.groupBy("event_date", "news_level", "tickers").agg(F.count("*").alias("k"), *(f(F.col("v")[i].cast("double")).alias(f"x{i}") for i in range(dims)))
    spread = part.withColumn("ticker", F.explode("tickers")).drop("tickers")
    placed = decayed(spread, panel, half_life, max_lag) if how == "decay" else same_day(spread, panel)
    out = placed.groupBy("ticker", "date", "news_level").agg(F.sum("k").alias("n"), F.sum(F.col("weight") * F.col("k")).alias("w"), *(f(F.col("weight") * F.col(f"x{i}")).alias(f"x{i}") for i in range(dims)))
    scale = {"mean": F.col("w"), "decay": F.col("w"), "normalized_sum": F.sqrt("n"), "max": F.lit(1.0)}[how]
    return out.select("ticker", "date", "news_level", "n", F.array(*(F.col(f"x{i}") / scale for i in range(dims))).alias("pooled"))


def days_since(panel: DataFrame, edge: DataFrame, sentinel: int = SENTINEL) -> DataFrame:
    """Backward as-of: calendar days from the latest news date of the ticker up to the panel date."""
    news = edge.select("ticker", F.col("event_date").alias("date"), F.lit(0).alias("own"), F.col("event_date").alias("seen")).distinct()
    rows = panel.select("ticker", "date", F.lit(1).alias("own"), F.lit(None).cast("date").alias("seen"))
    w = Window.partitionBy("ticker").orderBy("date", "own").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.union(news).withColumn("last", F.last("seen", ignorenulls=True).over(w)).filter("own = 1")
    return out.select("ticker", "date", F.coalesce(F.datediff("date", "last"), F.lit(sentinel)).alias("days_since"), F.col("last").isNotNull().cast("int").alias("has_prior"))


def rows_since(panel: DataFrame, has_news: str, cap: int = 1000) -> DataFrame:
    """The other counter: rows since the last row with news, starting at and capped by `cap`."""
    w = Window.partitionBy("ticker").orderBy("date")
    numbered = panel.withColumn("__i", F.row_number().over(w))
    last = F.last(F.when(F.col(has_news), F.col("__i")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return numbered.withColumn("rows_since", F.least(F.coalesce(F.col("__i") - last, F.lit(cap)), F.lit(cap))).drop("__i")


def forward_asof(dates: DataFrame, calendar: DataFrame) -> DataFrame:
    """news_date, trading_date: the first trading date at or after a news date; none, no row."""
    marks = calendar.select(F.col("date").alias("at"), F.lit(1).alias("k"), F.col("date").alias("t")).distinct()
    news = dates.select(F.col("news_date").alias("at"), F.lit(0).alias("k"), F.lit(None).cast("date").alias("t")).filter("at is not null").distinct()
    w = Window.orderBy("at", "k").rowsBetween(0, Window.unboundedFollowing)  # distinct dates only
    return marks.union(news).withColumn("trading_date", F.first("t", ignorenulls=True).over(w)).filter("k = 0 and trading_date is not null").select(F.col("at").alias("news_date"), "trading_date")


def metadata_block(panel: DataFrame, instances: DataFrame, events: DataFrame, edge: DataFrame, level: str, sentinel: int = SENTINEL) -> DataFrame:
    """The count, lag, novelty and recency features of one news level for every panel row.

    `events` gives event_id, occurrences, entropy, novelty, distance; diagnostics average with the
    weights of rows where all three are present; missing news gives zeros and the sentinel.
    """
    own = instances.filter(F.col("news_level") == level).join(events.select("event_id", "occurrences", "entropy", "novelty", "distance"), "event_id")
    ok = F.col("entropy").isNotNull() & F.col("novelty").isNotNull() & F.col("distance").isNotNull()
    w = F.when(ok, F.col("weight"))
    agg = own.groupBy("ticker", "date").agg(
        F.sum(F.coalesce("occurrences", F.lit(1))).alias("news_count"), F.countDistinct("event_id").alias("event_count"),
        *((F.sum(w * F.col(c)) / F.greatest(F.sum(w), F.lit(1e-12))).alias(f"mean_{c}") for c in ("entropy", "novelty", "distance")),
        F.max(F.when(ok, F.col("novelty"))).alias("max_novelty"), F.min(F.when(ok, F.col("distance"))).alias("min_distance"),
        (F.sum(F.col("lag_days") * F.col("weight")) / F.greatest(F.sum("weight"), F.lit(1e-12))).alias("mean_lag"), F.max("lag_days").alias("max_lag"),
    )
    since = days_since(panel, edge.filter(F.col("news_level") == level), sentinel)
    out = panel.select("ticker", "date").join(F.broadcast(agg), ["ticker", "date"], "left")
    counts = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("news_count", "event_count")]
    means = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("mean_entropy", "mean_novelty", "mean_distance", "max_novelty", "min_distance", "mean_lag", "max_lag")]
    return out.select("ticker", "date", *counts, *means).withColumn("no_news", (F.col("news_count") == 0).cast("int")).join(since, ["ticker", "date"])


def _assigned(batches, centers, temperature: float):
    for batch in batches:
        column = batch.column(1)
        offsets = column.offsets.to_numpy()
        full = np.flatnonzero(np.diff(offsets) == centers.shape[1])
        values = column.values.to_numpy(zero_copy_only=False).astype(float)
        x = values[offsets[full][:, None] + np.arange(centers.shape[1])]
        norm = np.sqrt((x**2).sum(axis=1))
        ok = np.isfinite(norm) & (norm > 0)
        sims = (x[ok] / norm[ok, None]) @ centers.T
        nearest = sims.argmax(axis=1)
        best = sims.max(axis=1)
        e = np.exp((sims - best[:, None]) / temperature)
        p = e / e.sum(axis=1, keepdims=True)
        entropy = -(p * np.log(np.maximum(p, 1e-300))).sum(axis=1)
        ids = batch.column(0).take(pa.array(full[ok]))
        weights = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1]), pa.array(p.ravel()))
        yield pa.RecordBatch.from_arrays([ids, pa.array(nearest.astype(np.int32)), pa.array(best), pa.array(entropy), pa.array(1 - best), weights], ["id", "prototype", "cosine", "entropy", "novelty", "weights"])


def assignment(vectors: DataFrame, centers: list[list[float]], id_col: str = "event_id", vector: str = "embedding", temperature: float = 0.1) -> DataFrame:
    """Nearest of the given centres for every usable vector.

    Columns: the id, prototype (0-based, lowest on ties), cosine, entropy of the softmax weights,
    novelty (1 - cosine) and the weights.  One matrix product per Arrow batch, without a shuffle; the
    centres are a bounded model and travel with the task.  Null, zero, non-finite vectors and vectors
    of another length give no row.
    """
    c = np.asarray(centers, float)
    c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("v is not null")
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(partial(_assigned, centers=c, temperature=temperature), f"id {kind}, prototype int, cosine double, entropy double, novelty double, weights array<double>")
    return out.withColumnRenamed("id", id_col)


def structured_counts(rows: DataFrame, key: list[str], column: str, ontology: list[str]) -> DataFrame:
    """Counts per key and ontology value, every value a column even when absent; unknown values are ignored."""
    value = F.lower(F.trim(column))
    return rows.groupBy(*key).agg(*(F.count_if(value == v).alias(f"{column}__{v}") for v in ontology))
