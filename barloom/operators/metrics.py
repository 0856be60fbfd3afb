"""Forecast metrics per group.

A prediction frame has the group columns, y and a prediction or probability.  Rows where either is
null do not count.  A metric that is undefined (too few rows, one class, a constant side) is null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions import expr as X
from barloom.operators.prefix import rank_over, running, with_ranks
from barloom.session import written


def paired(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.withColumns({y: X.no_nan(y), p: X.no_nan(p)}).filter(F.col(y).isNotNull() & F.col(p).isNotNull())


def regression(df: DataFrame, keys: list[str], y: str = "y", p: str = "p", *, ranks: bool = True) -> DataFrame:
    """n, mae, mse, rmse, r2, pearson, spearman, qlike, huber and sign accuracies, in one pass but for
    the ranks (`ranks` = False leaves spearman out and needs no sort)."""
    a, b = F.col(y), F.col(p)
    e = a - b
    up, pup = a > 0, b > 0
    rows = paired(df.select(*keys, y, p), y, p)
    more = []
    if ranks:
        rows = written(rows, "paired")
        n = rows.count()
        rows = with_ranks(with_ranks(rows, keys, y, "__ry", rows=n), keys, p, "__rp", rows=n)
        more = [X.correlation(F.col("__ry"), F.col("__rp")).alias("spearman")]
    hit, miss = F.avg(F.when(up, pup.cast("double"))), F.avg(F.when(~up, (~pup).cast("double")))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.try_divide(F.sum(e * e), F.var_pop(a) * F.count("*"))).alias("r2"),
        X.correlation(a, b).alias("pearson"), *more, F.avg(X.qlike(a, b)).alias("qlike"), F.avg(X.huber(e)).alias("huber"),
        F.avg((up == pup).cast("double")).alias("sign_accuracy"), ((hit + miss) / 2).alias("balanced_sign_accuracy"), F.avg((F.signum(a) == F.signum(b)).cast("double")).alias("directional_accuracy"),
    )


#: Places of one tie group whose discounts are added up at once.
PLACES = 4_096


def ranking(df: DataFrame, keys: list[str], unit: str, fraction: float = 0.1, y: str = "y", p: str = "p") -> DataFrame:
    """top_recall: share of the largest y among the largest p (ties by `unit`); ndcg with linear gain
    on y shifted to a minimum of 0, tied predictions sharing their discount (a tie group of any size
    is added up in slices of its places)."""
    rows = written(paired(df.select(*keys, unit, y, p), y, p), "paired")
    n = rows.count()
    size = rows.groupBy(*keys).agg(F.count("*").alias("__m"), F.min(y).alias("__low"))
    ranked = with_ranks(with_ranks(rows, keys, y, "__ry", descending=True, rows=n), keys, p, "__rp", descending=True, rows=n).join(size, keys)
    top = F.greatest(F.lit(1.0), F.ceil(F.col("__m") * F.lit(fraction)))
    recall = ranked.groupBy(*keys).agg((F.count_if((F.col("__ry") <= top) & (F.col("__rp") <= top)) / F.first(top)).alias("top_recall"), F.first("__m").alias("n"))
    shifted = rows.join(size, keys).withColumn("__g", F.col(y) - F.col("__low"))

    def gains(value: str, name: str) -> DataFrame:
        tied = running(shifted, keys, value, {"k": F.lit(1), "g": F.col("__g")}, descending=True)
        slices = tied.select(*keys, "before_k", "k", "g", F.explode(F.expr(f"sequence(0L, (k - 1) div {PLACES})")).alias("__slice"))
        first = F.col("before_k") + F.col("__slice") * PLACES + 1
        places = F.sequence(first, F.least(first + PLACES - 1, F.col("before_k") + F.col("k")))
        discount = F.aggregate(places, F.lit(0.0), lambda s, i: s + 1 / F.log2(i.cast("double") + 1))
        return slices.groupBy(*keys).agg(F.sum(F.col("g") / F.col("k") * discount).alias(name))

    both = gains(p, "__dcg").join(gains(y, "__ideal"), keys)
    return recall.join(both, keys).select(*keys, "n", "top_recall", F.try_divide(F.col("__dcg"), F.col("__ideal")).alias("ndcg"))


def confusion(df: DataFrame, keys: list[str], y: str = "y", p: str = "p", threshold: float = 0.5) -> DataFrame:
    """Counts and the measures of one threshold; a ratio with an empty base is 0, as is usual."""
    hit = F.col(p) >= threshold
    one = F.col(y) == 1
    c = paired(df, y, p).groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(one & hit).alias("tp"), F.count_if(~one & hit).alias("fp"), F.count_if(one & ~hit).alias("fn"), F.count_if(~one & ~hit).alias("tn"), F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier")
    )

    def share(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    f1, f0 = share(2 * tp, 2 * tp + fp + fn), share(2 * tn, 2 * tn + fp + fn)
    balanced = F.when((tp + fn > 0) & (tn + fp > 0), (share(tp, tp + fn) + share(tn, tn + fp)) / 2)
    return c.select(*keys, "n", "tp", "fp", "fn", "tn", share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), f1.alias("f1"), ((f1 + f0) / 2).alias("macro_f1"), balanced.alias("balanced_accuracy"), "brier")


def _curve(df: DataFrame, keys: list[str], y: str, p: str) -> DataFrame:
    """Per distinct score from the top: positives and negatives at it (k1, k0) and above it."""
    one = F.col(y).cast("long")
    return running(paired(df, y, p), keys, p, {"k1": one, "k0": 1 - one}, descending=True)


def roc_auc(df: DataFrame, keys: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """Area under the ROC curve, ties counting half; null with one class."""
    c = _curve(df, keys, y, p)
    return c.groupBy(*keys).agg(F.try_divide(F.sum(F.col("k0") * (F.col("before_k1") + F.col("k1") / 2)), (F.sum("k1") * F.sum("k0")).cast("double")).alias("roc_auc"))


def average_precision(df: DataFrame, keys: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """Average precision over distinct thresholds; null with one class."""
    c = _curve(df, keys, y, p)
    hits = F.col("before_k1") + F.col("k1")
    seen = hits + F.col("before_k0") + F.col("k0")
    area = F.try_divide(F.sum(F.col("k1") * hits / seen), F.sum("k1").cast("double"))
    return c.groupBy(*keys).agg(F.when(F.sum("k0") > 0, area).alias("pr_auc"))


def recall_at_precision(df: DataFrame, keys: list[str], level: float, y: str = "y", p: str = "p") -> DataFrame:
    """best: the largest recall of any threshold with that precision; last: the recall at the last such
    row when rows are walked by falling score, equal scores as one step.  0 when there is none."""
    c = _curve(df, keys, y, p)
    hits = F.col("before_k1") + F.col("k1")
    ok = hits / (hits + F.col("before_k0") + F.col("k0")) >= level
    total = F.sum("k1")
    best = F.max(F.when(ok, hits))
    last = F.max_by(F.when(ok, hits), F.when(ok, hits + F.col("before_k0") + F.col("k0")))
    return c.groupBy(*keys).agg(F.coalesce(F.try_divide(best.cast("double"), total.cast("double")), F.lit(0.0)).alias("best"), F.coalesce(F.try_divide(last.cast("double"), total.cast("double")), F.lit(0.0)).alias("last"))


def calibration_error(df: DataFrame, keys: list[str], bins: int = 10, y: str = "y", p: str = "p") -> DataFrame:
    """Expected calibration error over equal-width bins; the last bin holds 1."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1))
    per = paired(df, y, p).groupBy(*keys, b.alias("__b")).agg(F.count("*").alias("k"), F.avg(y).alias("a"), F.avg(p).alias("c"))
    return per.groupBy(*keys).agg((F.sum(F.col("k") * F.abs(F.col("a") - F.col("c"))) / F.sum("k")).alias("ece"))


def multiclass(df: DataFrame, keys: list[str], classes: int, y: str = "y", probabilities: str = "probabilities") -> DataFrame:
    """Macro F1, balanced accuracy, Brier score, confidence calibration, per-class precision and recall."""
    total = F.aggregate(probabilities, F.lit(0.0), lambda s, v: s + v)
    q = F.transform(probabilities, lambda v: v / F.greatest(total, F.lit(1e-12)))
    rows = df.filter(F.col(y).isNotNull() & F.col(probabilities).isNotNull()).withColumn("__q", q)
    top = F.array_max("__q")
    rows = rows.withColumn("__hat", F.array_position("__q", top) - 1).withColumn("__conf", top)
    brier = F.aggregate(F.transform("__q", lambda v, i: F.pow(v - (i == F.col(y)).cast("double"), 2)), F.lit(0.0), lambda s, v: s + v)
    counts = [F.count_if((F.col(y) == a) & (F.col("__hat") == b)).alias(f"c_{a}_{b}") for a in range(classes) for b in range(classes)]
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(brier).alias("multiclass_brier"), *counts)

    def share(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    def plus(cs: list[Column]) -> Column:
        return sum(cs[1:], cs[0])

    cell = [[F.col(f"c_{a}_{b}") for b in range(classes)] for a in range(classes)]
    support = [plus(cell[a]) for a in range(classes)]
    named = [plus([cell[a][b] for a in range(classes)]) for b in range(classes)]
    recall = [share(cell[k][k], support[k]) for k in range(classes)]
    precision = [share(cell[k][k], named[k]) for k in range(classes)]
    f1 = [share(2 * cell[k][k], support[k] + named[k]) for k in range(classes)]
    present = [(s > 0).cast("double") for s in support]
    balanced = F.try_divide(plus([r * w for r, w in zip(recall, present)]), plus(present))
    ece = calibration_error(rows.withColumn("__hit", (F.col("__hat") == F.col(y)).cast("double")), keys, 10, "__hit", "__conf").withColumnRenamed("ece", "multiclass_ece")
    wide = out.select(*keys, "n", (plus(f1) / classes).alias("macro_f1"), balanced.alias("balanced_accuracy"), "multiclass_brier", *(r.alias(f"recall_{k}") for k, r in enumerate(recall)), *(c.alias(f"precision_{k}") for k, c in enumerate(precision)))
    return wide.join(ece, keys)


# Quantiles of the normal distribution at 95 % and 97.5 %.
Z95, Z975 = 1.6448536269514722, 1.959963984540054


def uncertainty(df: DataFrame, keys: list[str], y: str = "y", mean: str = "mean", scale: str = "scale") -> DataFrame:
    """Gaussian negative log likelihood, 95 % coverage and width, upper exceedance rate and pinball loss."""
    a, m, s = F.col(y), F.col(mean), F.greatest(F.col(scale), F.lit(1e-6))
    z = (a - m) / s
    bound = m + Z95 * s
    e = a - bound
    return df.filter(a.isNotNull() & m.isNotNull() & F.col(scale).isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(F.lit(0.5 * math.log(2 * math.pi)) + F.ln(s) + 0.5 * z * z).alias("nll"), F.avg((F.abs(z) <= Z975).cast("double")).alias("coverage_95"), F.avg(2 * Z975 * s).alias("width_95"),
        F.avg((a > bound).cast("double")).alias("exceedance"), F.avg(F.greatest(0.95 * e, -0.05 * e)).alias("pinball_95"),
    )


def observation_loss(kind: str, y: str = "y", p: str = "p", *, scale: str = "scale", classes: int = 3) -> Column:
    """Loss of one forecast by the kind of target: signed (QLIKE of logs), magnitude and squared
    (squared error), spike (Brier), regime (Brier over `classes`, `p` an array), uncertainty (Gaussian
    negative log likelihood with `scale`).  Null where an input is null."""
    a, b = F.col(y), F.col(p)
    if kind == "signed":
        return X.qlike(a, b)
    if kind in ("magnitude", "squared", "spike"):
        return (a - b) * (a - b)
    if kind == "regime":
        return sum(((b[k] - F.when(a.isNotNull(), (a == k).cast("double"))) * (b[k] - (a == k).cast("double")) for k in range(1, classes)), (b[0] - (a == 0).cast("double")) * (b[0] - (a == 0).cast("double")))
    if kind == "uncertainty":
        z = (a - b) / F.col(scale)
        return F.lit(0.5 * math.log(2 * math.pi)) + F.ln(scale) + 0.5 * z * z
    raise ValueError(kind)


def _xlog(k: Column, p: Column) -> Column:
    return F.when(k == 0, F.lit(0.0)).otherwise(k * F.ln(p))


def kupiec(df: DataFrame, keys: list[str], hit: str, rate: float) -> DataFrame:
    """Likelihood ratio of the exceedance rate against the expected one."""
    out = df.filter(F.col(hit).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col(hit).cast("long")).alias("failures"))
    k, n = F.col("failures"), F.col("n")
    share = k / n
    null, fitted = _xlog(k, F.lit(rate)) + _xlog(n - k, F.lit(1 - rate)), _xlog(k, share) + _xlog(n - k, 1 - share)
    return out.withColumn("kupiec_lr", F.greatest(F.lit(0.0), -2 * (null - fitted)))


def christoffersen(df: DataFrame, keys: list[str], series: str, order: str, hit: str) -> DataFrame:
    """Likelihood ratio of independence from the counts of consecutive (previous, current) hits."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys, series).orderBy(order)
    pairs = df.select(*keys, F.lag(hit).over(w).cast("int").alias("a"), F.col(hit).cast("int").alias("b")).filter("a is not null and b is not null")
    c = pairs.groupBy(*keys).agg(*(F.count_if((F.col("a") == i) & (F.col("b") == j)).alias(f"n{i}{j}") for i in (0, 1) for j in (0, 1)))
    n00, n01, n10, n11 = (F.col(f"n{i}{j}") for i in (0, 1) for j in (0, 1))
    whole = n00 + n01 + n10 + n11
    pooled = (n01 + n11) / F.greatest(whole, F.lit(1))
    p01, p11 = n01 / F.greatest(n00 + n01, F.lit(1)), n11 / F.greatest(n10 + n11, F.lit(1))
    flat = _xlog(n01 + n11, pooled) + _xlog(n00 + n10, 1 - pooled)
    chain = _xlog(n01, p01) + _xlog(n00, 1 - p01) + _xlog(n11, p11) + _xlog(n10, 1 - p11)
    return c.withColumn("independence_lr", F.greatest(F.lit(0.0), -2 * (flat - chain)))


def daily_ic(df: DataFrame, keys: list[str], entity: str, date: str = "date", y: str = "y", p: str = "p") -> DataFrame:
    """Per date: Spearman correlation, overlap of the three highest and lowest by average rank (over 3),
    and sign agreement.  A date's cross-section is ranked by windows: one shuffle and two sorts."""
    from pyspark.sql import Window

    by = [*keys, date]
    rows = paired(df.select(*by, entity, y, p), y, p)
    rows = rows.select(*by, entity, y, p, rank_over(by, y, descending=True).alias("ra"), rank_over(by, p, descending=True).alias("rp"), F.count("*").over(Window.partitionBy(*by)).alias("m"))
    ra, rp, low = F.col("ra"), F.col("rp"), F.col("m") - 3
    return rows.groupBy(*by).agg(
        F.countDistinct(entity).alias("n_entities"), X.correlation(ra, rp).alias("daily_ic"), (F.count_if((ra <= 3) & (rp <= 3)) / 3).alias("top3"), (F.count_if((ra > low) & (rp > low)) / 3).alias("bottom3"),
        F.avg(((F.col(y) > 0) == (F.col(p) > 0)).cast("double")).alias("sign"),
    )


def summarize_ic(daily: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, median, deviation, ratio and share of positive (above rounding noise) daily correlations."""
    v = F.col("daily_ic")
    out = daily.filter(v.isNotNull()).groupBy(*keys).agg(F.count("*").alias("n_dates"), F.avg(v).alias("mean_ic"), F.percentile(v, F.lit(0.5)).alias("median_ic"), F.stddev_samp(v).alias("ic_std"), F.avg((v > 1e-12).cast("double")).alias("positive_rate"))
    return out.withColumn("ic_ir", F.try_divide(F.col("mean_ic"), F.col("ic_std")))


def top_bottom(df: DataFrame, keys: list[str], entity: str, date: str = "date", y: str = "y", p: str = "p", k: int = 3) -> DataFrame:
    """Per date with at least 2k rows: mean y of the k highest and k lowest predictions, and the spread
    (equal predictions in order of the entity).  Only the k best and worst of each date are kept by the
    window group limit."""
    from pyspark.sql import Window

    by = [*keys, date]
    rows = paired(df, y, p)
    size = rows.groupBy(*by).agg(F.count("*").alias("m")).filter(F.col("m") >= 2 * k)
    high = Window.partitionBy(*by).orderBy(F.col(p).desc(), F.col(entity).asc())
    low = Window.partitionBy(*by).orderBy(F.col(p).asc(), F.col(entity).desc())
    top = rows.withColumn("__r", F.row_number().over(high)).filter(F.col("__r") <= k).groupBy(*by).agg(F.avg(y).alias("top_mean"))
    bottom = rows.withColumn("__r", F.row_number().over(low)).filter(F.col("__r") <= k).groupBy(*by).agg(F.avg(y).alias("bottom_mean"))
    return size.join(top, by).join(bottom, by).select(*by, "top_mean", "bottom_mean", (F.col("top_mean") - F.col("bottom_mean")).alias("spread"))
