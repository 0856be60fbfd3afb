"""Filling containers of fixed capacity with items, by bulk-synchronous best fit.

Items and gaps are kept sorted by size.  A sweep walks the sizes downwards and gives every item of a
size the smallest gap that holds it; items of one size compete for one class of gaps by their rank;
gaps are updated and the sweep goes on.  Sizes are whole tokens up to the capacity, so the sweep works
on size classes (at most `capacity` of them, however many items there are) and yields ranges of ranks
for ranges of containers; the items themselves stay distributed and only learn their rank.
"""

from __future__ import annotations

import bisect
from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one rank window should hold; the number of slices of a size class follows the data.
SLICE = 200_000


def best_fit(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Rules (size, first rank, end rank, first container, items per container) and the number of
    containers, for a histogram of sizes from 1 to capacity."""
    rules: list[tuple[int, int, int, int, int]] = []
    gaps: list[int] = []  # sorted sizes of the open gaps
    ranges: dict[int, list[tuple[int, int]]] = defaultdict(list)
    opened = 0

    def add(gap: int, first: int, end: int) -> None:
        if gap > 0 and end > first:
            if not ranges[gap]:
                bisect.insort(gaps, gap)
            ranges[gap].append((first, end))

    for size in sorted(histogram, reverse=True):
        left, rank = histogram[size], 0
        while left:
            k = bisect.bisect_left(gaps, size)
            if k < len(gaps):
                gap = gaps[k]
                first, end = ranges[gap].pop()
                if not ranges[gap]:
                    gaps.pop(k)
            else:
                gap, per = capacity, capacity // size
                first, end = opened, opened + -(-left // per)
                opened = end
            per = gap // size
            full = min(end - first, left // per)
            if full:
                rules.append((size, rank, rank + full * per, first, per))
                add(gap - per * size, first, first + full)
                rank, left, first = rank + full * per, left - full * per, first + full
            if left and first < end:  # fewer items left than one more container takes
                rules.append((size, rank, rank + left, first, per))
                add(gap - left * size, first, first + 1)
                rank, left, first = rank + left, 0, first + 1
            add(gap, first, end)
    return rules, opened


def ranked(items: DataFrame, keys: list[str], order: list[str], slices: int) -> DataFrame:
    """Adds `rank` (from 0) within `keys`.  A group is cut into slices by hash; each slice is ranked
    by itself and moved by the rows of the slices before it, so no task holds a whole group."""
    cut = items.withColumn("__slice", F.pmod(F.xxhash64(*order), F.lit(slices)))
    by = Window.partitionBy(*keys, "__slice").orderBy(*order)
    sizes = cut.groupBy(*keys, "__slice").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__slice")) - F.col("__n")
    offsets = sizes.select(*keys, "__slice", before.alias("__before"))
    return (
        cut.withColumn("__row", F.row_number().over(by))
        .join(offsets, [*keys, "__slice"])
        .withColumn("rank", F.col("__before") + F.col("__row") - 1)
        .drop("__slice", "__row", "__before")
    )


def pack(sizes: DataFrame, limits: dict[str, int], id_col: str = "doc_id", size_col: str = "n_tokens") -> DataFrame:
    """Container of every piece of every item, for each named capacity.

    Columns: limit_name, container_id, id, piece, token_start, n_tokens.  An item no larger than the
    capacity is one piece; a larger one is cut into pieces of exactly the capacity and a remainder.
    Items of size 0 take no room and stand in container 0.  Null ids or sizes are left out; a
    repeated row is an item of its own; an empty table gives an empty result.
    """
    spark = sizes.sparkSession
    if not limits or min(limits.values()) < 1:
        raise ValueError("capacities must be positive")
    items = sizes.select(F.col(id_col).alias("id"), F.col(size_col).cast("long").alias("total")).filter("id is not null and total is not null")
    names = spark.createDataFrame([(k, int(v)) for k, v in limits.items()], "limit_name string, capacity long")
    pieces = (
        items.join(F.broadcast(names))
        .withColumn("piece", F.explode(F.expr("sequence(0, cast(greatest((total - 1) div capacity, 0) as int))")))
        .select("limit_name", "id", "piece", (F.col("piece") * F.col("capacity")).alias("token_start"), F.least(F.col("capacity"), F.col("total") - F.col("piece") * F.col("capacity")).alias("n_tokens"))
    )
    counts = pieces.groupBy("limit_name", "n_tokens").agg(F.count("*").alias("n")).collect()  # at most one row per size and capacity
    rules, total = [], 0
    for name, capacity in limits.items():
        own = {r.n_tokens: r["n"] for r in counts if r.limit_name == name and r.n_tokens > 0}
        total = max(total, sum(own.values()))
        rules += [(name, *r) for r in best_fit(own, capacity)[0]]
        rules += [(name, 0, 0, r["n"], 0, r["n"]) for r in counts if r.limit_name == name and r.n_tokens == 0]
    plan = spark.createDataFrame(rules, "limit_name string, n_tokens long, first long, end long, container long, per long")
    slices = max(16, -(-total // SLICE))
    placed = ranked(pieces, ["limit_name", "n_tokens"], ["id", "piece"], slices).join(F.broadcast(plan), ["limit_name", "n_tokens"])
    hit = placed.filter("rank >= first and rank < end")
    return hit.select("limit_name", F.expr("container + (rank - first) div per").alias("container_id"), "id", "piece", "token_start", "n_tokens")


def fills(packed: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Tokens and fill of every container."""
    names = packed.sparkSession.createDataFrame([(k, int(v)) for k, v in limits.items()], "limit_name string, capacity long")
    used = packed.groupBy("limit_name", "container_id").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_pieces"))
    return used.join(F.broadcast(names), "limit_name").select("limit_name", "container_id", "n_pieces", "n_tokens", (F.col("n_tokens") / F.col("capacity")).alias("fill"))
