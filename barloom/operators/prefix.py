"""Ranks and running sums over a value, without one task holding more of a group than it can sort.

Up to `LIMIT` rows a plain window does it.  Beyond that, values are cut into buckets at global
quantiles, as many as keep a bucket at `LIMIT` rows; each bucket runs its own window, and the sums of
the buckets before it are added.  Both ways give the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.session import written

#: Rows that one window may hold; the number of buckets follows the data.
LIMIT = 1_000_000


def _window(keys: list[str], *more: str):
    names = [*keys, *more]
    return Window.partitionBy(*names) if names else Window.partitionBy(F.lit(1))


def running(df: DataFrame, keys: list[str], value: str, sums: dict[str, object], *, descending: bool = False, limit: int = LIMIT) -> DataFrame:
    """One row per (keys, value): every sum (its name), and `before_<name>`, its total over all strictly
    earlier values of the group.  Null values are left out; NaN counts as the largest value."""
    own = written(df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(*(F.sum(c).alias(n) for n, c in sums.items())), "values")
    order = F.col(value).desc() if descending else F.col(value).asc()
    buckets = -(-own.count() // limit)
    if buckets <= 1:
        earlier = _window(keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return own.select(*keys, value, *sums, *(F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"before_{n}") for n in sums))
    cuts = own.agg(F.percentile_approx(value, F.array(*(F.lit((i + 1) / buckets) for i in range(buckets - 1))), F.lit(10 * buckets)).alias("__prefix_cuts"))
    cut = own.crossJoin(F.broadcast(cuts)).withColumn("__prefix_bucket", F.size(F.filter("__prefix_cuts", lambda c: c < F.col(value)))).drop("__prefix_cuts")
    inner = _window(keys, "__prefix_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    step = F.col("__prefix_bucket").desc() if descending else F.col("__prefix_bucket").asc()
    outer = _window(keys).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    blocks = cut.groupBy(*keys, "__prefix_bucket").agg(*(F.sum(n).alias(f"__t_{n}") for n in sums)).select(*keys, "__prefix_bucket", *(F.coalesce(F.sum(f"__t_{n}").over(outer), F.lit(0)).alias(f"__o_{n}") for n in sums))
    same = F.col("l.__prefix_bucket") == F.col("r.__prefix_bucket")
    for k in keys:
        same = same & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    parts = cut.select("*", *(F.coalesce(F.sum(n).over(inner), F.lit(0)).alias(f"__i_{n}") for n in sums))
    out = parts.alias("l").join(blocks.alias("r"), same).select("l.*", *(F.col(f"r.__o_{n}") for n in sums))
    return out.select(*keys, value, *sums, *((F.col(f"__i_{n}") + F.col(f"__o_{n}")).alias(f"before_{n}") for n in sums))


def quantiles(df: DataFrame, keys: list[str], value: str, levels: list[float], name: str = "q", *, limit: int = LIMIT) -> DataFrame:
    """keys and an array of exact quantiles (linear between neighbours) of the non-null values.

    Values are counted before they are placed, so a group of any size is never held by one task; a
    group without values gives no row.
    """
    placed = running(df, keys, value, {"__k": F.lit(1)}, limit=limit)
    size = placed.groupBy(*keys).agg(F.sum("__k").alias("__n"))
    both = placed.join(size, keys) if keys else placed.crossJoin(F.broadcast(size))  # one row
    v = F.col(value).cast("double")

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("before___k") <= place) & (place < F.col("before___k") + F.col("__k")), v))

    cells = []
    for level in levels:
        h = (F.col("__n") - 1) * F.lit(float(level))
        low, high = at(F.floor(h)), at(F.ceil(h))
        cells.append(low + (high - low) * (F.max(h) - F.floor(F.max(h))))
    return both.groupBy(*keys).agg(F.array(*cells).alias(name))


def rank_over(keys: list[str], value: str, *, descending: bool = False) -> Column:
    """The average rank (from 1, ties at their mean) within `keys` as one window, for groups that one
    task can sort; null for null."""
    by = _window(keys).orderBy(F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last())
    ties = F.count("*").over(by.rangeBetween(Window.currentRow, Window.currentRow))
    return F.when(F.col(value).isNotNull(), F.rank().over(by) + (ties - 1) / 2)


def with_ranks(df: DataFrame, keys: list[str], value: str, name: str, *, descending: bool = False, limit: int = LIMIT, rows: int | None = None) -> DataFrame:
    """Adds the average rank (from 1, ties at their mean) of `value` within `keys`; null for null.

    `rows`, if known, is the number of rows; else they are written and counted."""
    if rows is None:
        df = written(df, "ranked")
        rows = df.count()
    if rows <= limit:
        return df.withColumn(name, rank_over(keys, value, descending=descending))
    ranks = running(df, keys, value, {"__n": F.lit(1)}, descending=descending, limit=limit).select(*keys, F.col(value).alias("__v"), (F.col("before___n") + (F.col("__n") + 1) / 2).alias(name))
    same = F.col(f"l.{value}") == F.col("r.__v")
    for k in keys:
        same = same & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    return df.alias("l").join(ranks.alias("r"), same, "left").select("l.*", f"r.{name}")
