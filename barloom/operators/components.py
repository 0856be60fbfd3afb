"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.session import shared_dir


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Label every linked node with the least node of its component: columns node, component.

    `links` are undirected; direction, repetition, self links and null ends do not matter (null
    ends are dropped, a self link alone makes a component of one).  An empty table gives an empty
    result.  Each round joins the links with one minimum per node, so nothing but the link table
    itself is shuffled and no node's neighbours meet in one place; the joins are split by adaptive
    execution where a node is hot.  Rounds are cut with checkpoint(), and end when a round changes
    nothing.
    """
    shared_dir(links.sparkSession)
    edges = (
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .filter(F.col(a).isNotNull() & F.col(b).isNotNull())
        .distinct()
        .checkpoint()
    )
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter(F.col("v") >= F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select("v", "m").union(low.select(F.col("u").alias("v"), "m"))
        after = small.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).distinct().checkpoint()
        changed = edges.exceptAll(after).limit(1).count() or after.exceptAll(edges).limit(1).count()
        edges = after
        if not changed:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return (
        edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        .union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")))
        .groupBy("node")
        .agg(F.min("component").alias("component"))
    )
