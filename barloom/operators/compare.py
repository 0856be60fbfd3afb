"""Choosing, comparing and gating results: baselines, gains, best rows, grids, drift and concentration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import expr as X


def baseline_mean(frame: DataFrame, value: str) -> DataFrame:
    """Adds the train mean of the entity, or the pooled train mean where the entity has no train row."""
    train = frame.filter((F.col("split") == "train") & F.col(value).isNotNull())
    own = train.groupBy("entity").agg(F.avg(value).alias("__own"))
    pooled = train.agg(F.avg(value).alias("__all"))
    return frame.join(own, "entity", "left").crossJoin(F.broadcast(pooled)).withColumn("baseline", F.coalesce("__own", "__all")).drop("__own", "__all")


def checked_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join that fails at run time if a key of `right` is not unique; no separate job."""
    size = right.groupBy(*keys).agg(F.count("*").alias("__n"), F.first(F.struct(*[c for c in right.columns if c not in keys])).alias("__r"))
    sound = size.withColumn("__ok", F.assert_true(F.col("__n") == 1, F.lit("join key is not unique"))).filter(F.col("__ok").isNull())
    return left.join(sound.select(*keys, "__r"), keys, how).select(*left.columns, "__r.*")


def coverage(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of `left` that `right` lacks."""
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), keys, "left_anti")


def best_rows(df: DataFrame, keys: list[str], metric: str, larger_is_better: bool, ties: list[str]) -> DataFrame:
    """The best row per group, ties by the given columns; rows without the metric lose."""
    m = F.col(metric)
    order = [m.desc_nulls_last() if larger_is_better else m.asc_nulls_last(), *ties]
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__r = 1").drop("__r")


def gains(df: DataFrame, keys: list[str], model: str, reference: str, metric: str, lower_is_better: bool) -> DataFrame:
    """Relative gain of every model over a reference model of its group."""
    ref = df.filter(F.col(model) == reference).select(*keys, F.col(metric).alias("reference_value"))
    return df.join(ref, keys).withColumn("gain", X.gain(F.col("reference_value"), F.col(metric), lower_is_better))


def replicates(df: DataFrame, keys: list[str], repeats: list[str], metric: str) -> DataFrame:
    """Seeds and folds are replicates, never a choice: mean, deviation and range of a metric per
    configuration, its rows, and how many values of each repeat it has (`n_<repeat>`)."""
    counts = [F.countDistinct(c).alias(f"n_{c}") for c in repeats]
    return df.groupBy(*keys).agg(F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"), F.min(metric).alias("least"), F.max(metric).alias("most"), F.count("*").alias("n_rows"), *counts)


def completeness(df: DataFrame, family: list[str], configuration: list[str], repeats: list[str]) -> DataFrame:
    """Whether a configuration has every repeat that its family has: the keys, `n_` and `expected_` per
    repeat, complete.  A null repeat counts for nothing."""
    own = df.groupBy(*family, *configuration).agg(*(F.countDistinct(c).alias(f"n_{c}") for c in repeats))
    wanted = df.groupBy(*family).agg(*(F.countDistinct(c).alias(f"expected_{c}") for c in repeats))
    ok = F.lit(True)
    for c in repeats:
        ok = ok & (F.col(f"n_{c}") >= F.col(f"expected_{c}"))
    return own.join(wanted, family).withColumn("complete", ok)


def top_families(df: DataFrame, group: list[str], family: str, metric: str, top: int, larger_is_better: bool = False) -> DataFrame:
    """Families of a group by their mean over all repeats: group, family, mean_value, n_repeats, n_scored,
    place, selected.  A family with a missing score is not placed and not selected; a group without any
    fully scored family keeps all of them.  Ties go by the family's name."""
    v = X.no_nan(metric)
    own = df.groupBy(*group, family).agg(F.avg(v).alias("mean_value"), F.count("*").alias("n_repeats"), F.count(v).alias("n_scored"))
    whole = F.col("n_scored") == F.col("n_repeats")
    w = Window.partitionBy(*group)
    order = w.partitionBy(*group, whole).orderBy(F.col("mean_value").desc() if larger_is_better else F.col("mean_value").asc(), family)
    placed = own.withColumn("place", F.when(whole, F.row_number().over(order))).withColumn("__some", F.max(whole.cast("int")).over(w))
    return placed.withColumn("selected", F.when(F.col("__some") == 0, F.lit(True)).otherwise(F.coalesce(F.col("place") <= top, F.lit(False)))).drop("__some")


def preferred(df: DataFrame, keys: list[str], wanted: dict[str, float | None], quality: str, name: str, exact: tuple[str, ...] = ()) -> DataFrame:
    """The row per group nearest to the wanted settings, in their order; `exact` settings either agree or
    don't, a setting that is null on one side only is 10,000 away.  Quality (larger first), then the
    name decides the rest."""
    order = []
    for c, v in wanted.items():
        if c in exact:
            order.append(F.when(F.col(c).eqNullSafe(F.lit(v)), 0).otherwise(1))
        elif v is None:
            order.append(F.when(F.col(c).isNull(), 0).otherwise(10_000))
        else:
            order.append(F.coalesce(F.abs(F.col(c) - F.lit(v)).cast("double"), F.lit(10_000.0)))
    w = Window.partitionBy(*keys).orderBy(*order, F.col(quality).desc_nulls_last(), F.col(name).asc())
    return df.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def locked_grid(validation: DataFrame, test: DataFrame, keys: list[str], model: str, metric: str, real: list[str], placebo: list[str], lower_is_better: bool = True) -> DataFrame:
    """Every real model against every placebo of a group, both locked on validation: their values and
    relative gains on validation and test.  A pair without validation evidence is listed, not executed."""
    pairs = validation.select(*keys).distinct().withColumn("real", F.explode(F.array(*map(F.lit, real)))).withColumn("placebo", F.explode(F.array(*map(F.lit, placebo))))
    out = pairs
    for part, name in ((validation, "validation"), (test, "test")):
        for side in ("real", "placebo"):
            out = out.join(part.select(*keys, F.col(model).alias(side), F.col(metric).alias(f"{side}_{name}")), [*keys, side], "left")
    gain = {n: X.gain(F.col(f"placebo_{n}"), F.col(f"real_{n}"), lower_is_better) for n in ("validation", "test")}
    done = F.col("real_validation").isNotNull() & F.col("placebo_validation").isNotNull()
    return out.select(*keys, "real", "placebo", done.alias("executed"), *(F.col(f"{s}_{n}") for n in gain for s in ("real", "placebo")), *(g.alias(f"{n}_gain") for n, g in gain.items()), F.when(done, gain["validation"] > 0).alias("better_on_validation"))


def grid_exactness(expected: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """Cells that are missing, unexpected or duplicated."""
    seen = observed.groupBy(*keys).agg(F.count("*").alias("n"))
    missing = expected.select(*keys).distinct().join(seen, keys, "left_anti").select(*keys, F.lit("missing").alias("problem"))
    strange = seen.join(expected.select(*keys).distinct(), keys, "left_anti").select(*keys, F.lit("unexpected").alias("problem"))
    doubled = seen.filter("n > 1").select(*keys, F.lit("duplicate").alias("problem"))
    return missing.union(strange).union(doubled)


def gate(df: DataFrame, keys: list[str], conditions: dict[str, object]) -> DataFrame:
    """Whether all, and which, conditions hold in every row of a group; a null condition fails."""
    ok = {k: F.coalesce(F.bool_and(F.coalesce(c, F.lit(False))), F.lit(False)).alias(k) for k, c in conditions.items()}
    out = df.groupBy(*keys).agg(*ok.values()) if keys else df.agg(*ok.values())
    every = F.lit(True)
    for k in ok:
        every = every & F.col(k)
    return out.withColumn("decision", F.when(every, "GO").otherwise("NO-GO"))


def rand_index(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labelings from their contingency table."""
    cells = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").cast("double").alias("n"))

    def pairs(c):
        return F.sum(c * (c - 1) / 2)

    ij = cells.agg(pairs(F.col("n")).alias("ij"), F.sum("n").alias("total"))
    ia = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(pairs(F.col("n")).alias("ia"))
    ib = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(pairs(F.col("n")).alias("ib"))
    one = ij.crossJoin(ia).crossJoin(ib)  # one row each
    chance = F.try_divide(F.col("ia") * F.col("ib"), F.col("total") * (F.col("total") - 1) / 2)
    index = F.coalesce(F.try_divide(F.col("ij") - chance, (F.col("ia") + F.col("ib")) / 2 - chance), F.lit(1.0))
    return one.select(F.col("total").cast("long").alias("n"), index.alias("adjusted_rand"))


def usage_drift(df: DataFrame, label: str, side: str, left: str, right: str) -> DataFrame:
    """Jensen-Shannon divergence (base 2) and distance of label shares between two sides."""
    counts = df.filter(F.col(side).isin(left, right) & F.col(label).isNotNull()).groupBy(label).agg(F.count_if(F.col(side) == left).alias("a"), F.count_if(F.col(side) == right).alias("b"))
    whole = counts.agg(F.sum("a").alias("all_a"), F.sum("b").alias("all_b"))
    p, q = F.try_divide(F.col("a"), F.col("all_a")), F.try_divide(F.col("b"), F.col("all_b"))
    m = (p + q) / 2

    def part(x):
        return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    total = counts.crossJoin(F.broadcast(whole)).agg(F.greatest(F.sum(part(p) + part(q)) / 2, F.lit(0.0)).alias("js_divergence"))
    return total.select("js_divergence", F.sqrt("js_divergence").alias("js_distance"))


def concentration(df: DataFrame, keys: list[str], category: str) -> DataFrame:
    """Herfindahl index, effective number (exponential entropy), largest share and size per group."""
    counts = df.filter(F.col(category).isNotNull()).groupBy(*keys, category).agg(F.count("*").alias("k"))
    whole = counts.groupBy(*keys).agg(F.sum("k").alias("n"))
    p = F.col("k") / F.col("n")
    return counts.join(whole, keys).groupBy(*keys).agg(F.max("n").alias("n"), F.count("*").alias("n_categories"), F.sum(p * p).alias("hhi"), F.exp(-F.sum(p * F.ln(p))).alias("effective_number"), F.max(p).alias("largest_share"))


def top_examples(df: DataFrame, keys: list[str], score: str, tie: str, k: int) -> DataFrame:
    """The k best rows per group by falling score, ties by `tie`; Spark limits each group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(tie).asc())
    return df.filter(F.col(score).isNotNull()).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def shift(df: DataFrame, keys: list[str], value: str, side: str, left: str, right: str) -> DataFrame:
    """Standardised mean difference of a value between two sides, with both means."""
    v = F.col(value)
    a, b = F.when(F.col(side) == left, v), F.when(F.col(side) == right, v)
    pooled = F.sqrt((F.var_samp(a) + F.var_samp(b)) / 2)
    return df.groupBy(*keys).agg(F.avg(a).alias("mean_left"), F.avg(b).alias("mean_right"), F.try_divide(F.avg(b) - F.avg(a), pooled).alias("smd"))


def target_vs_rest(df: DataFrame, keys: list[str], own, value: str) -> DataFrame:
    """Mean of a value for own rows and for the rest, and their difference over the whole deviation."""
    v = F.col(value)
    a, b = F.when(own, v), F.when(~own, v)
    return df.groupBy(*keys).agg(F.count(a).alias("n_own"), F.count(b).alias("n_rest"), (F.avg(a) - F.avg(b)).alias("difference"), F.try_divide(F.avg(a) - F.avg(b), F.stddev_samp(v)).alias("effect"))
