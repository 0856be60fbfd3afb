"""Representations of the panel: assembled blocks, gates, placebos, diagnostics of prototypes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions import expr as X
from barloom.operators.prefix import running


def long_hash(*keys: Column | str) -> Column:
    """60-bit portable hash of a key."""
    text = F.concat_ws("|", *(X.col(k).cast("string") for k in keys))
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def pivoted(panel: DataFrame, row: str, column: str, value: str, names: list[str]) -> DataFrame:
    """One column per name (all of them, whether present or not), one row per `row`."""
    return panel.groupBy(row).pivot(column, names).agg(F.first(value))


def keep_one(df: DataFrame, keys: list[str], order: str, last: bool = False) -> DataFrame:
    """The first (or last) row per key by an order column, as a grouped struct minimum: it combines
    before the shuffle, so a hot key is not gathered."""
    rest = F.struct(F.col(order).alias("__o"), *[c for c in df.columns if c not in keys and c != order])
    pick = F.max_by(rest, F.col(order)) if last else F.min_by(rest, F.col(order))
    return df.filter(F.col(order).isNotNull()).groupBy(*keys).agg(pick.alias("__s")).select(*keys, F.col("__s.__o").alias(order), *(F.col(f"__s.{c}").alias(c) for c in df.columns if c not in keys and c != order))


def assembled(panel: DataFrame, pooled: DataFrame, levels: tuple[str, ...], dims: int) -> DataFrame:
    """One row per panel row with one array per level; missing news is an array of zeros."""
    zero = F.array_repeat(F.lit(0.0), dims)
    wide = pooled.groupBy("ticker", "date").agg(*(F.max(F.when(F.col("news_level") == v, F.struct(F.col("n"), F.col("pooled")))).alias(v) for v in levels))
    out = panel.select("ticker", "date").join(wide, ["ticker", "date"], "left")
    cells = [c for v in levels for c in (F.coalesce(F.col(f"{v}.n"), F.lit(0)).alias(f"n__{v}"), F.coalesce(F.col(f"{v}.pooled"), zero).alias(f"x__{v}"))]
    return out.select("ticker", "date", *cells)


def presence_gate(vector: str, least: float = 1e-10) -> Column:
    """Whether the absolute values of a feature block add up to more than nothing."""
    return F.coalesce(F.aggregate(F.transform(vector, lambda v: F.abs(v)), F.lit(0.0), lambda s, v: s + v) > least, F.lit(False))


def feature_totals(frame: DataFrame, columns: list[str], least: float) -> DataFrame:
    """column, total, kept: whether a feature's sum over the rows reaches the minimum."""
    wide = frame.agg(*(F.coalesce(F.sum(c).cast("double"), F.lit(0.0)).alias(c) for c in columns))
    return wide.unpivot([], columns, "column", "total").withColumn("kept", F.col("total") >= least)


def regime_interactions(frame: DataFrame, level: str, features: list[str], train: Column) -> DataFrame:
    """Middle and high regime of a level (train terciles of its entity) and their products with features."""
    cuts = frame.filter(train).groupBy("entity").agg(F.percentile(level, F.lit(0.33)).alias("__hash_a"), F.percentile(level, F.lit(0.67)).alias("__hash_b"))
    out = frame.join(cuts, "entity")
    middle, high = ((F.col(level) > F.col("__hash_a")) & (F.col(level) <= F.col("__hash_b"))).cast("double"), (F.col(level) > F.col("__hash_b")).cast("double")
    return out.withColumns({"regime_middle": middle, "regime_high": high} | {f"{f}__{k}": F.col(f) * v for f in features for k, v in (("middle", middle), ("high", high))}).drop("__hash_a", "__hash_b")


def permuted(df: DataFrame, keys: list[str], unit: str, value: str, seed: int) -> DataFrame:
    """unit, permuted: the values of a group dealt to its rows in another hash order.

    Both orders are ranks of portable hashes, so any engine deals alike; no task holds a whole group.
    `unit` must be unique; rows with a null unit are left out.
    """
    base = df.filter(F.col(unit).isNotNull()).select(*keys, unit, value).withColumn("__hash_a", long_hash(F.lit(seed), unit)).withColumn("__hash_b", long_hash(F.lit(seed + 1), unit))
    a = running(base, keys, "__hash_a", {"__n": F.lit(1)}).select(*keys, "__hash_a", F.col("before___n").alias("__i"))
    b = running(base, keys, "__hash_b", {"__n": F.lit(1)}).select(*keys, "__hash_b", F.col("before___n").alias("__i"))
    left = base.select(*keys, unit, "__hash_a").join(a, [*keys, "__hash_a"]).select(*keys, unit, "__i")
    right = base.select(*keys, F.col(value).alias("permuted"), "__hash_b").join(b, [*keys, "__hash_b"]).select(*keys, "permuted", "__i")
    return left.join(right, [*keys, "__i"]).select(*keys, unit, "permuted")


def random_labels(df: DataFrame, train: DataFrame, unit: str, label: str, seed: int) -> DataFrame:
    """unit, placebo: labels drawn from the label shares of `train` by a portable uniform per unit."""
    from pyspark.sql import Window

    counts = train.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("k"))
    w = Window.orderBy(label)  # one row per label
    total = F.sum("k").over(Window.partitionBy(F.lit(1)))
    upto = F.sum("k").over(w.rowsBetween(Window.unboundedPreceding, 0))
    edges = counts.select(F.col(label).alias("placebo"), ((upto - F.col("k")) / total).alias("low"), (upto / total).alias("high"))
    u = X.uniform(F.lit(seed), unit)
    return df.select(unit, u.alias("__u")).join(F.broadcast(edges), (F.col("__u") >= F.col("low")) & (F.col("__u") < F.col("high"))).select(unit, "placebo")


def cluster_quality(vectors: DataFrame, label: str, vector: str, dims: int) -> DataFrame:
    """Per label: size, share, Davies-Bouldin ratio and mean cosine silhouette, from the label sums.

    On unit vectors the mean cosine distance to a cluster only needs the cluster's vector sum, so the
    silhouette is exact without any pair of rows.  Labels are few; their sums are broadcast.
    """
    unit = vectors.select(label, X.unit(F.col(vector)).alias("u")).filter(F.col("u").isNotNull() & F.col(label).isNotNull())
    sums = unit.groupBy(label).agg(F.count("*").alias("n"), F.array(*(F.sum(F.col("u")[k]) for k in range(dims))).alias("s"))
    models = F.broadcast(sums.agg(F.collect_list(F.struct(F.col(label).alias("label"), "n", "s")).alias("__m")))
    both = unit.crossJoin(models)
    near = F.transform("__m", lambda m: F.struct(m["label"].alias("label"), m["n"].alias("n"), X.dot(F.col("u"), m["s"]).alias("d")))
    own = F.element_at(F.filter("__d", lambda m: m["label"] == F.col(label)), 1)
    inner = F.when(own["n"] > 1, (own["n"] - own["d"]) / (own["n"] - 1))
    outer = F.array_min(F.transform(F.filter("__d", lambda m: m["label"] != F.col(label)), lambda m: 1 - m["d"] / m["n"]))
    mine = F.element_at(F.filter("__m", lambda m: m["label"] == F.col(label)), 1)["s"]
    away = F.sqrt(F.greatest(1 - 2 * own["d"] / own["n"] + X.dot(mine, mine) / (own["n"] * own["n"]), F.lit(0.0)))
    scored = both.withColumn("__d", near).select(label, inner.alias("a"), outer.alias("b"), away.alias("r"))
    s = F.when(F.col("a").isNull(), F.lit(0.0)).otherwise(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")))
    per = scored.groupBy(label).agg(F.count("*").alias("n"), F.avg(s).alias("silhouette"), F.avg("r").alias("scatter"))
    c = sums.select(F.col(label).alias("x"), F.transform("s", lambda v: v / F.col("n")).alias("cx"))
    d = sums.select(F.col(label).alias("y"), F.transform("s", lambda v: v / F.col("n")).alias("cy"))
    gap = c.crossJoin(F.broadcast(d)).filter("x <> y").select("x", "y", F.sqrt(F.aggregate(F.zip_with("cx", "cy", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda t, v: t + v)).alias("gap"))  # labels x labels
    ratio = gap.join(F.broadcast(per.select(F.col(label).alias("x"), F.col("scatter").alias("sx"))), "x").join(F.broadcast(per.select(F.col(label).alias("y"), F.col("scatter").alias("sy"))), "y")
    worst = ratio.groupBy(F.col("x").alias(label)).agg(F.max(F.try_divide(F.col("sx") + F.col("sy"), F.col("gap"))).alias("davies_bouldin"))
    return per.join(worst, label, "left").select(label, "n", "silhouette", "scatter", "davies_bouldin")


def cross_stock(days: DataFrame, responses: DataFrame, keys: list[str]) -> DataFrame:
    """Per (date, keys): the cross-section's response on days when a prototype is active.

    `days` has date and keys, `responses` date, ticker, residual and spike; responses are one row per
    ticker and date and are broadcast.
    """
    both = days.select("date", *keys).distinct().join(F.broadcast(responses), "date").filter("residual is not null")
    v = F.col("residual")
    base = both.groupBy("date", *keys).agg(F.count("*").alias("n_stocks"), F.avg(F.col("spike").cast("double")).alias("breadth"), F.greatest(F.avg((v >= 0).cast("double")), F.avg((v < 0).cast("double"))).alias("same_sign"), F.avg(v).alias("common"), F.avg(F.abs(v)).alias("mean_absolute"), F.collect_list(v).alias("__v"))
    firm = F.aggregate("__v", F.lit(0.0), lambda s, x: s + F.abs(x - F.col("common"))) / F.col("n_stocks")
    return base.withColumn("firm_specific", firm).drop("__v")


def screening_windows(frame: DataFrame, fraction: float, least: int, date: str = "target_date") -> DataFrame:
    """train rows with window 'prefix' or 'tail': the last fraction of the train dates is the tail."""
    from barloom.operators.splits import _positions

    train = frame.filter(F.col("split") == "train")
    days = _positions(train, date)
    cut = F.least(F.greatest(F.floor(F.col("n") * F.lit(1 - fraction)), F.lit(least)), F.col("n") - 1)
    part = days.filter(F.col("n") > least).select(date, F.when(F.col("i") < cut, "prefix").otherwise("tail").alias("window"))
    return train.join(F.broadcast(part), date)


def refit_folds(frame: DataFrame, folds: int, least_train: int, least_validation: int, date: str = "target_date") -> DataFrame:
    """The other fold rule: blocks as large as the dates after the least history allow, short ones dropped."""
    from barloom.operators.splits import _positions

    days = _positions(frame, date)
    n, k = F.col("n"), F.lit(folds)
    size = F.greatest(F.lit(least_validation), F.floor((n - least_train) / k))
    size = F.when(n - k * size < least_train, F.floor((n - least_train) / k)).otherwise(size)
    sized = days.filter(n >= least_train + folds * least_validation).withColumn("size", size).filter(F.col("size") >= least_validation)
    grid = sized.withColumn("fold", F.explode(F.sequence(F.lit(1), k)))
    start = n - k * F.col("size") + (F.col("fold") - 1) * F.col("size")
    past, held = F.col("i") < start, (F.col("i") >= start) & (F.col("i") < start + F.col("size"))
    return grid.groupBy("fold").agg(F.max(F.when(past, F.col(date))).alias("train_end"), F.min(F.when(held, F.col(date))).alias("validation_start"), F.max(F.when(held, F.col(date))).alias("validation_end"), F.count_if(past).alias("n_train_dates"), F.count_if(held).alias("n_validation_dates"))


# The representations and the placebos derived from them.
CATALOG = {"R0": "market only", "R1": "basic metadata", "R2": "raw embedding", "R3": "random projection", "R4": "principal axes", "R5": "hard prototype", "R6": "soft prototype", "R7": "metadata and soft prototype", "R8": "nearest cosine", "R9": "random prototype", "R10": "shuffled date", "R11": "shuffled ticker"}


def catalog(spark, base: tuple[str, ...] = ("R6", "R7")) -> DataFrame:
    """representation, description, is_placebo, base: the catalogue with virtual placebo rows."""
    rows = [(k, v, k in ("R9", "R10", "R11"), None) for k, v in CATALOG.items()]
    rows += [(f"{b}_{kind}", f"{kind} of {b}", True, b) for b in base for kind in ("lagged", "permuted")]
    return spark.createDataFrame(rows, "representation string, description string, is_placebo boolean, base string")
