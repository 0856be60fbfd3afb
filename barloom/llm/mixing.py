"""Mixing sources to target weights by a low-discrepancy schedule.

Each source is a shuffled sequence of its documents, epoch after epoch, cut into blocks of equal
tokens.  The schedule is the golden-ratio sequence: point i falls into the interval of one source, and
the k-th point of a source takes that source's k-th block, so every prefix of the result has the
target mix.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_TOKENS = 4_096
GOLDEN = (math.sqrt(5) - 1) / 2
#: Points of the schedule that are ranked together, and rows that one prefix-sum window should hold.
CHUNK = 1 << 16
SLICE = 100_000


def plan(totals: dict[str, int], targets: list[tuple[str, float, int]]) -> list[dict]:
    """Tokens wanted of each source: the largest total that the scarcest source allows.

    A source without tokens, share or allowed repeats supplies nothing, and the other shares are
    scaled up to make the whole.
    """
    able = [(s, w, r) for s, w, r in targets if w and w > 0 and r and r > 0 and totals.get(s, 0) > 0]
    weight = sum(w for _, w, _ in able)
    whole = min((totals[s] * r / (w / weight) for s, w, r in able), default=0.0)
    return [{"source": s, "weight": w / weight, "have": totals[s], "wanted": whole * w / weight, "epochs": min(r, math.ceil(whole * w / weight / totals[s] - 1e-9))} for s, w, r in able]


def schedule(spark, plans: list[dict], block: int) -> DataFrame:
    """source, block, position: the k-th point of a source for its k-th block."""
    need = max((math.ceil(p["wanted"] / block) / p["weight"] for p in plans), default=0)
    points = math.ceil(need + 8 * len(plans) * (1 + math.log2(need + 2)) / min((p["weight"] for p in plans), default=1)) if plans else 0
    edges, low = [], 0.0
    for p in plans:
        edges.append((p["source"], low, low + p["weight"]))
        low += p["weight"]
    if edges:
        edges[-1] = (*edges[-1][:2], 2.0)
    at = spark.range(points).withColumn("point", F.expr(f"(id + 0.5D) * {GOLDEN!r}D - floor((id + 0.5D) * {GOLDEN!r}D)"))
    choice = F.element_at(F.filter(F.array(*(F.struct(F.lit(s).alias("source"), F.lit(a).alias("a"), F.lit(b).alias("b")) for s, a, b in edges)), lambda e: (F.col("point") >= e["a"]) & (F.col("point") < e["b"])), 1)["source"] if edges else F.lit("")
    drawn = at.select("id", choice.alias("source"), F.expr(f"id div {CHUNK}").alias("chunk"))
    counts = drawn.groupBy("source", "chunk").agg(F.count("*").alias("n"))
    before = counts.select("source", "chunk", (F.sum("n").over(Window.partitionBy("source").orderBy("chunk")) - F.col("n")).alias("before"))
    inner = F.row_number().over(Window.partitionBy("source", "chunk").orderBy("id"))
    return drawn.withColumn("k", inner).join(before, ["source", "chunk"]).select("source", (F.col("before") + F.col("k") - 1).alias("block"), F.col("id").alias("position"))


def mix(sizes: DataFrame, targets: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", size_col: str = "n_tokens", block: int = BLOCK_TOKENS, seed: int = 17) -> DataFrame:
    """The drawing: position, source, id, epoch, n_tokens, ordered by position within the mix.

    `targets` has source, target_share and max_repeats; it is read by the driver (one row per
    source).  A document is drawn once per epoch at most, so never more than max_repeats times; it is
    drawn when the middle of its tokens lies within what is wanted of its source.  Documents of other
    or null sources, and null ids or sizes, are left out.  An empty table gives an empty drawing.
    """
    spark = sizes.sparkSession
    items = sizes.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(size_col).cast("long").alias("n_tokens")).filter("id is not null and n_tokens is not null")
    wanted = [(r.source, r.target_share, r.max_repeats) for r in targets.select("source", "target_share", "max_repeats").collect() if r.source is not None]
    listed = F.broadcast(spark.createDataFrame([(s,) for s, _, _ in wanted], "source string"))
    totals = {r.source: (r["tokens"], r["n"]) for r in items.join(listed, "source").groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n")).collect()}
    plans = plan({s: t for s, (t, _) in totals.items()}, wanted)
    terms = spark.createDataFrame([(p["source"], p["epochs"], float(p["wanted"]), int(p["have"])) for p in plans], "source string, epochs int, wanted double, have long")
    slices = max(16, -(-max((n for _, n in totals.values()), default=1) // SLICE))
    copies = (
        items.join(F.broadcast(terms), "source")
        .withColumn("epoch", F.explode(F.expr("sequence(0, greatest(epochs, 1) - 1)")))
        .withColumn("draw", F.xxhash64(F.lit(seed), "epoch", "id"))
        .withColumn("slice", F.expr(f"cast(floor((draw / 18446744073709551616D + 0.5D) * {slices}) as int)"))
    )
    part = copies.groupBy("source", "epoch", "slice").agg(F.sum("n_tokens").alias("__n"))
    ahead = part.select("source", "epoch", "slice", (F.sum("__n").over(Window.partitionBy("source", "epoch").orderBy("slice")) - F.col("__n")).alias("__before"))
    own = F.sum("n_tokens").over(Window.partitionBy("source", "epoch", "slice").orderBy("draw", "id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
    placed = copies.withColumn("__own", own).join(ahead, ["source", "epoch", "slice"]).withColumn("start", F.col("epoch") * F.col("have") + F.col("__before") + F.col("__own"))
    chosen = placed.filter(F.col("start") + F.col("n_tokens") / 2 <= F.col("wanted")).withColumn("block", F.expr(f"start div {block}"))
    return chosen.join(schedule(spark, plans, block), ["source", "block"]).select("position", "source", "id", "epoch", "n_tokens")


def shares(drawing: DataFrame, targets: DataFrame) -> DataFrame:
    """Per listed source: target and reached share of all drawn tokens, documents, most repeats."""
    times = drawing.groupBy("source", "id").agg(F.count("*").alias("times"), F.sum("n_tokens").alias("tokens"))
    own = times.groupBy("source").agg(F.sum("tokens").alias("drawn_tokens"), F.count("*").alias("n_documents"), F.max("times").alias("most_repeats"))
    full = targets.select("source", "target_share", "max_repeats").join(own, "source", "left")
    all_tokens = F.sum("drawn_tokens").over(Window.partitionBy(F.lit(1)))
    return full.select("source", "target_share", "max_repeats", F.coalesce("drawn_tokens", F.lit(0)).alias("drawn_tokens"), F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), F.coalesce(F.col("drawn_tokens") / all_tokens, F.lit(0.0)).alias("reached_share"))
