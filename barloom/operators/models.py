"""Small models fitted from distributed sums.

Every fit is one or a few passes that add up bounded moment matrices per Arrow batch (d x d for ridge and
PCA, k x d for k-means) and solve on the driver; predictions are matrix products in Arrow batches.  The
data never leave the executors, and a fit costs a scan without a shuffle of rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.prefix import quantiles
from barloom.session import discard, written


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column of that length with finite values, and their positions."""
    offsets = column.offsets.to_numpy()
    at = np.flatnonzero((np.diff(offsets) == width) & column.is_valid().to_numpy(zero_copy_only=False))
    x = column.values.to_numpy(zero_copy_only=False).astype(float)[offsets[at][:, None] + np.arange(width)] if len(at) else np.empty((0, width))
    ok = np.isfinite(x).all(axis=1)
    return x[ok], at[ok]


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))


def _moments(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros((width + 1, width + 1))
    for batch in batches:
        x, _ = _matrix(batch.column(0), width)
        x = np.hstack([np.ones((len(x), 1)), x])
        total += x.T @ x
    yield pa.RecordBatch.from_arrays([_lists(total.reshape(1, -1))], ["m"])


def moments(df: DataFrame, vector: str, width: int) -> np.ndarray:
    """[[n, sum x], [sum x, sum x x']] over usable rows; the driver gets one small matrix per partition."""
    parts = df.select(F.col(vector).cast("array<double>").alias("v")).mapInArrow(partial(_moments, width=width), "m array<double>")
    cells = parts.select(F.posexplode("m").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).collect()
    out = np.zeros((width + 1) ** 2)
    for c in cells:
        out[c.k] = c.x
    return out.reshape(width + 1, width + 1)


def column_vector(df: DataFrame, columns: list[str], name: str = "__x") -> DataFrame:
    return df.withColumn(name, F.array(*(F.col(c).cast("double") for c in columns)))


@dataclass(frozen=True)
class Projection:
    mean: np.ndarray
    axes: np.ndarray
    variance: np.ndarray


def fit_pca(df: DataFrame, vector: str, width: int, components: int) -> Projection:
    """Centred principal axes by falling variance; signs fixed by the largest entry being positive."""
    m = moments(df, vector, width)
    n = max(m[0, 0], 1.0)
    mean = m[0, 1:] / n
    cov = m[1:, 1:] / n - np.outer(mean, mean)
    values, axes = np.linalg.eigh((cov + cov.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    axes = axes[:, order].T
    axes *= np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])[:, None]
    return Projection(mean, axes, values[order])


def _projected(batches: Iterator[pa.RecordBatch], model: Projection, unit: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, at = _matrix(batch.column(1), len(model.mean))
        z = (x - model.mean) @ model.axes.T
        if unit:
            z = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), _lists(z)], ["id", "projected"])


def project(df: DataFrame, id_col: str, vector: str, model: Projection, unit: bool = True) -> DataFrame:
    """id, projected: centred, projected and (by default) L2-normalised; unusable vectors give no row."""
    rows = df.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return rows.mapInArrow(partial(_projected, model=model, unit=unit), f"id {rows.schema['id'].dataType.simpleString()}, projected array<double>").withColumnRenamed("id", id_col)


def random_axes(width: int, components: int, seed: int) -> Projection:
    """Gaussian random projection with variance 1 / components."""
    axes = np.random.default_rng(seed).normal(0, 1 / np.sqrt(components), (components, width))
    return Projection(np.zeros(width), axes, np.ones(components))


def _unit_blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, _ = _matrix(batch.column(0), width)
        single = pa.types.is_float32(batch.column(0).type.value_type)
        x = x[np.linalg.norm(x, axis=1) > 0].astype("f4" if single else "f8")
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()), pa.array([single])], ["x", "single"])


def _assign_sums(batches: Iterator[pa.RecordBatch], centers: np.ndarray) -> Iterator[pa.RecordBatch]:
    runs, k, width = centers.shape
    total = np.zeros((runs, k, width + 2))
    for batch in batches:
        for block, single in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x = np.frombuffer(block, "f4" if single else "f8").reshape(-1, width).astype(float)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            at = np.arange(len(x))
            for r in range(runs):
                d = np.maximum((centers[r] ** 2).sum(axis=1)[None, :] + 1 - 2 * x @ centers[r].T, 0)
                near = d.argmin(axis=1)
                member = np.zeros((len(x), k))
                member[at, near] = 1
                total[r, :, 0] += member.sum(axis=0)
                total[r, :, 1] += np.bincount(near, d[at, near], k)
                total[r, :, 2:] += member.T @ x
    yield pa.RecordBatch.from_arrays([_lists(total.reshape(1, -1))], ["m"])


def spherical_kmeans(df: DataFrame, vector: str, width: int, k: int, *, restarts: int = 20, rounds: int = 500, seed: int = 1, sample: int = 4_096, unit: bool = True) -> np.ndarray:
    """k centres (of unit length, or with `unit` = False the plain means): Euclidean Lloyd on unit
    vectors, the best of several starts by cost.

    Starts are drawn from a bounded sample, the `sample` rows of least hash; every round is one pass for
    all starts whose centres still move, over vectors packed and written once.  A start that has not
    settled after `rounds` is an error.  Empty clusters keep their centre.  With fewer distinct rows
    than k, rows repeat.
    """
    given = df.select(F.col(vector).alias("v")).filter("v is not null")
    salted = given.select(F.col("v").cast("array<double>").alias("v"))
    drawn = salted.orderBy(F.xxhash64(F.lit(seed), "v")).limit(sample).collect()
    rows = np.array([r.v for r in drawn if len(r.v) == width], float).reshape(-1, width)
    norm = np.linalg.norm(rows, axis=1)
    rows = rows[norm > 0] / norm[norm > 0, None]
    if not len(rows):
        return np.zeros((0, width))
    rng = np.random.default_rng(seed)
    centers = np.stack([_spread(rows, k, rng) for _ in range(restarts)])
    cost = np.full(restarts, np.inf)
    exact = given if given.schema["v"].dataType.simpleString() == "array<float>" else salted
    blocks = written(exact.mapInArrow(partial(_unit_blocks, width=width), "x binary, single boolean"), "vectors")
    live = np.arange(restarts)
    for _ in range(rounds):
        parts = blocks.mapInArrow(partial(_assign_sums, centers=centers[live]), "m array<double>")
        cells = parts.select(F.posexplode("m").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).collect()
        total = np.zeros(len(live) * k * (width + 2))
        for c in cells:
            total[c.k] = c.x
        total = total.reshape(len(live), k, width + 2)
        cost[live] = total[:, :, 1].sum(axis=1)
        full = total[:, :, 0] > 0
        after = np.where(full[:, :, None], total[:, :, 2:] / np.maximum(total[:, :, :1], 1), centers[live])
        moved = np.abs(after - centers[live]).max(axis=(1, 2))
        centers[live] = after
        live = live[moved >= 1e-9]
        if not len(live):
            break
    else:
        raise RuntimeError(f"{len(live)} of {restarts} starts did not settle in {rounds} rounds")
    discard(blocks)
    best = centers[int(cost.argmin())]
    return best if not unit else best / np.maximum(np.linalg.norm(best, axis=1, keepdims=True), 1e-12)


def _spread(rows: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Starts far from each other: each next row with probability proportional to its squared distance."""
    chosen = [rows[rng.integers(len(rows))]]
    far = ((rows - chosen[0]) ** 2).sum(axis=1)
    while len(chosen) < k:
        p = far / far.sum() if far.sum() > 0 else None
        chosen.append(rows[rng.choice(len(rows), p=p)])
        far = np.minimum(far, ((rows - chosen[-1]) ** 2).sum(axis=1))
    return np.array(chosen)


@dataclass(frozen=True)
class Linear:
    features: list[str]
    intercept: float
    weights: np.ndarray


def fit_ridge(df: DataFrame, features: list[str], target: str, alpha: float, standardize: bool = True) -> Linear:
    """(X'X + alpha I) w = X'y on centred (and population-scaled) features; the intercept is not
    penalised.  Rows with a null or non-finite value do not count; constant features get weight 0."""
    d = len(features)
    return solve_ridge(moments(column_vector(df.select(*features, target), [*features, target]), "__x", d + 1), features, alpha, standardize)


def solve_ridge(m: np.ndarray, features: list[str], alpha: float, standardize: bool) -> Linear:
    """The ridge of a moment matrix of features and target."""
    d = len(features)
    n = max(m[0, 0], 1.0)
    mean = m[0, 1:] / n
    cov = m[1:, 1:] - n * np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cov)[:d] / n, 0)) if standardize else np.ones(d)
    live = scale > 1e-12
    scale = np.where(live, scale, 1.0)
    a = cov[:d, :d] / np.outer(scale, scale) + alpha * np.eye(d)
    a[~live] = a[:, ~live] = 0
    a[~live, ~live] = 1
    b = np.where(live, cov[:d, d] / scale, 0)
    w = np.linalg.lstsq(a, b, rcond=None)[0] / scale
    return Linear(features, float(mean[d] - mean[:d] @ w), w)


def fit_elastic_net(df: DataFrame, features: list[str], target: str, alpha: float, l1_ratio: float, rounds: int = 2_000) -> Linear:
    """(1 / 2n) |y - Xw|^2 + alpha (l1_ratio |w| + (1 - l1_ratio) / 2 |w|^2) on centred, population-scaled
    features, by coordinate descent on the moment matrix (the rows are read once)."""
    d = len(features)
    m = moments(column_vector(df.select(*features, target), [*features, target]), "__x", d + 1)
    n = max(m[0, 0], 1.0)
    mean = m[0, 1:] / n
    cov = m[1:, 1:] / n - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cov)[:d], 0))
    live = scale > 1e-12
    scale = np.where(live, scale, 1.0)
    q, b, w = cov[:d, :d] / np.outer(scale, scale), cov[:d, d] / scale, np.zeros(d)
    for _ in range(rounds):
        before = w.copy()
        for j in np.flatnonzero(live):
            rest = b[j] - q[j] @ w + q[j, j] * w[j]
            w[j] = np.sign(rest) * max(abs(rest) - alpha * l1_ratio, 0) / (q[j, j] + alpha * (1 - l1_ratio))
        if np.abs(w - before).max() < 1e-12:
            break
    w = w / scale
    return Linear(features, float(mean[d] - mean[:d] @ w), w)


@dataclass(frozen=True)
class Prepared:
    """How columns become features: medians, means and deviations of train, and the categories."""

    numeric: dict[str, tuple[float, float, float]]
    indicators: list[str]
    categories: dict[str, list[str]]

    @property
    def names(self) -> list[str]:
        return [*(f"z__{c}" for c in self.numeric), *(f"missing__{c}" for c in self.indicators), *(f"is__{c}__{k}" for c, v in self.categories.items() for k in range(len(v)))]


def fit_preparation(train: DataFrame, numeric: list[str], categorical: list[str], most: int = 1_000) -> Prepared:
    """Medians for missing numbers, an indicator where train has missing ones, population scaling after
    filling, one column per train category.  More than `most` categories are an error: they would not
    be a bounded model."""
    mid, missing = {}, {}
    if numeric:
        long = train.select(*(F.col(c).cast("double").alias(c) for c in numeric)).unpivot([], numeric, "__column", "__value")
        mid = {r[0]: r[1][0] for r in quantiles(long, ["__column"], "__value", [0.5]).collect()}  # one row per column
        missing = train.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in numeric)).first().asDict()
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(float(mid.get(c, 0.0)))) for c in numeric}
    stat = train.agg(*(F.avg(v).alias(f"a_{c}") for c, v in filled.items()), *(F.stddev_pop(v).alias(f"s_{c}") for c, v in filled.items())).first() if numeric else None
    categories = {}
    for c in categorical:
        found = [r[0] for r in train.select(c).filter(F.col(c).isNotNull()).distinct().limit(most + 1).collect()]
        if len(found) > most:
            raise ValueError(f"{c} has more than {most} categories")
        categories[c] = sorted(found)
    return Prepared({c: (float(mid.get(c, 0.0)), float(stat[f"a_{c}"] or 0.0), float(stat[f"s_{c}"] or 0.0) or 1.0) for c in numeric}, [c for c in numeric if missing[c]], categories)


def prepare(df: DataFrame, how: Prepared) -> DataFrame:
    """Adds the prepared columns; categories that train lacked have zeros everywhere."""
    out = {f"z__{c}": (F.coalesce(F.col(c).cast("double"), F.lit(m)) - F.lit(a)) / F.lit(s) for c, (m, a, s) in how.numeric.items()}
    out |= {f"missing__{c}": F.col(c).isNull().cast("double") for c in how.indicators}
    out |= {f"is__{c}__{k}": F.coalesce((F.col(c) == F.lit(v)).cast("double"), F.lit(0.0)) for c, vs in how.categories.items() for k, v in enumerate(vs)}
    return df.withColumns(out)


def fit_multinomial(df: DataFrame, features: list[str], label: str, c: float = 1.0):
    """Multinomial logistic regression of Spark's own library with penalty 1 / (c n)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = column_vector(df, features).select(array_to_vector("__x").alias("features"), F.col(label).cast("double").alias("label")).filter("label is not null")
    n = max(rows.count(), 1)
    return LogisticRegression(family="multinomial", regParam=1 / (c * n), standardization=False, maxIter=200, tol=1e-9).fit(rows)


def choose_strength(prefix: DataFrame, tail: DataFrame, features: list[str], label: str, grid: tuple[float, ...]) -> float:
    """The penalty whose fit on the earlier window has the least log loss on the later one, ties to the
    stronger penalty."""
    best = (float("inf"), grid[0])
    for c in sorted(grid):
        p = F.greatest(F.least(F.col("probability"), F.lit(1 - 1e-12)), F.lit(1e-12))
        y = F.col(label).cast("double")
        loss = predict_probability(tail, fit_logistic(prefix, features, label, c)).agg(F.avg(-(y * F.ln(p) + (1 - y) * F.ln(1 - p)))).first()[0]
        if loss is not None and loss < best[0] - 1e-12:
            best = (loss, c)
    return best[1]


def predict_linear(df: DataFrame, model: Linear, name: str = "prediction"):
    """A plain sum of products: null where a feature is null."""
    total = F.lit(model.intercept)
    for f, w in zip(model.features, model.weights):
        total = total + F.col(f).cast("double") * F.lit(float(w))
    return df.withColumn(name, total)


def _logistic_sums(batches: Iterator[pa.RecordBatch], w: np.ndarray, width: int) -> Iterator[pa.RecordBatch]:
    h, g = np.zeros((width + 1, width + 1)), np.zeros(width + 1)
    for batch in batches:
        x, _ = _matrix(batch.column(0), width + 2)  # features, label, row weight
        y, s, x = x[:, width], x[:, width + 1], np.hstack([np.ones((len(x), 1)), x[:, :width]])
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        h += (x * (s * p * (1 - p))[:, None]).T @ x
        g += x.T @ (s * (y - p))
    yield pa.RecordBatch.from_arrays([_lists(np.vstack([h, g]).reshape(1, -1))], ["m"])


def fit_logistic(df: DataFrame, features: list[str], label: str, c: float = 1.0, balanced: bool = False, rounds: int = 25) -> Linear:
    """L2-penalised logistic regression (strength 1 / c, free intercept) by Newton steps, one pass each.
    `balanced` weighs the classes inversely to their frequency.  One class only gives a constant."""
    d = len(features)
    rows = df.select(*features, F.col(label).cast("double").alias("__y")).filter("__y is not null")
    sizes = {r["__y"]: r["n"] for r in rows.groupBy("__y").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    weight = F.lit(1.0)
    if balanced and len(sizes) == 2:
        weight = F.when(F.col("__y") == 1, total / (2 * sizes[1.0])).otherwise(total / (2 * sizes[0.0]))
    x = column_vector(rows.withColumn("__s", weight), [*features, "__y", "__s"]).select("__x")
    w = np.zeros(d + 1)
    penalty = np.eye(d + 1) / c
    penalty[0, 0] = 0 if len(sizes) == 2 else 1e-3
    for _ in range(rounds):
        parts = x.mapInArrow(partial(_logistic_sums, w=w, width=d), "m array<double>")
        cells = parts.select(F.posexplode("m").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).collect()
        m = np.zeros((d + 2) * (d + 1))
        for cell in cells:
            m[cell.k] = cell.x
        m = m.reshape(d + 2, d + 1)
        step = np.linalg.solve(m[:-1] + penalty + 1e-12 * np.eye(d + 1), m[-1] - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-10:
            break
    return Linear(features, float(w[0]), w[1:])


def predict_probability(df: DataFrame, model: Linear, name: str = "probability") -> DataFrame:
    out = predict_linear(df, model, "__z")
    return out.withColumn(name, 1 / (1 + F.exp(-F.col("__z")))).drop("__z")


def per_entity_ols(frame: DataFrame, features: list[str], target: str, alpha: float = 0.0) -> DataFrame:
    """entity, intercept and one weight per feature, from per-entity moments (a few numbers each).

    The moments are plain aggregates with map-side combination; the tiny systems are solved in Arrow
    batches.  An entity with a singular system gets the minimum-norm solution.
    """
    columns = [*features, target]
    ok = frame.select("entity", *(F.col(c).cast("double").alias(c) for c in columns)).dropna()
    sums = [F.sum(c).alias(f"s_{c}") for c in columns]
    cross = [F.sum(F.col(a) * F.col(b)).alias(f"c_{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if i <= j]
    agg = ok.groupBy("entity").agg(F.count("*").alias("n"), *sums, *cross)

    def solve(batches):
        d = len(features)
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                n = row["n"]
                mean = np.array([row[f"s_{c}"] / n for c in columns])
                m = np.zeros((d + 1, d + 1))
                for i in range(d + 1):
                    for j in range(i, d + 1):
                        m[i, j] = m[j, i] = row[f"c_{i}_{j}"] - n * mean[i] * mean[j]
                w = np.linalg.lstsq(m[:d, :d] + alpha * np.eye(d), m[:d, d], rcond=None)[0]
                out.append([row["entity"], float(mean[d] - mean[:d] @ w), *map(float, w)])
            import pandas as pd

            yield pd.DataFrame(out, columns=["entity", "intercept", *[f"w_{f}" for f in features]])

    return agg.mapInPandas(solve, "entity string, intercept double, " + ", ".join(f"w_{f} double" for f in features))


def out_of_fold(frame: DataFrame, blocks: DataFrame, features: list[str], target: str, alpha: float, date: str = "target_date") -> DataFrame:
    """Predictions of each block from a ridge fitted on strictly earlier dates only: adds block and
    prediction.  The block table (a few rows) drives one fit per block."""
    out = None
    for b in blocks.orderBy("block").collect():
        model = fit_ridge(frame.filter(F.col(date) <= F.lit(b.history_end)), features, target, alpha)
        part = predict_linear(frame.filter(F.col(date).between(F.lit(b.predict_start), F.lit(b.predict_end))), model).withColumn("block", F.lit(int(b.block)))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else frame.limit(0).withColumn("block", F.lit(0)).withColumn("prediction", F.lit(0.0))


def match_centers(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, float]]:
    """One-to-one matching of centres with the largest total cosine (Hungarian method; few centres)."""
    cost = -(a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-12)) @ (b / np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-12)).T
    flip = cost.shape[0] > cost.shape[1]
    c = cost.T if flip else cost
    n, m = c.shape
    u, v, p, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        p[0], j0 = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            row = p[j0]
            free = np.flatnonzero(~used[1:]) + 1
            reduced = c[row - 1, free - 1] - u[row] - v[free]
            better = reduced < least[free]
            least[free[better]], way[free[better]] = reduced[better], j0
            j1 = int(free[least[free].argmin()])
            delta = least[j1]
            u[p[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if p[j0] == 0:
                break
        while j0:
            p[j0] = p[way[j0]]
            j0 = way[j0]
    pairs = [(int(p[j]) - 1, j - 1) for j in range(1, m + 1) if p[j]]
    return sorted(((j, i, float(-c[i, j])) if flip else (i, j, float(-c[i, j]))) for i, j in pairs)


@dataclass(frozen=True)
class Grouped:
    """A ridge on a few features and one-hot values of a column, whose weights are a table: `moments` has
    one row per value, from which `effect` gives the weight of the value."""

    linear: Linear
    group: str
    alpha: float
    moments: DataFrame

    @property
    def effect(self) -> Column:
        d = len(self.linear.features)
        rest = F.col(f"__m0_{d + 1}") - F.col("__m0_0") * F.lit(self.linear.intercept)
        for j, w in enumerate(self.linear.weights):
            rest = rest - F.col(f"__m0_{j + 1}") * F.lit(float(w))
        return F.when(F.col("__m0_0") > 0, rest / (F.col("__m0_0") + F.lit(self.alpha))).otherwise(F.lit(0.0))


def group_moments(df: DataFrame, features: list[str], target: str, group: str) -> DataFrame:
    """Per value of a column the sums of products of (1, features, target) over the rows without a null or
    non-finite value; a value without such a row has zeros.  Any number of values."""
    v = [F.lit(1.0), *(F.col(c).cast("double") for c in [*features, target])]
    ok = F.lit(True)
    for c in v[1:]:
        ok = ok & F.coalesce(F.abs(c) < F.lit(float("inf")), F.lit(False))
    cells = {f"__m{i}_{j}": v[i] * v[j] for i in range(len(v)) for j in range(i, len(v))}
    return written(df.groupBy(group).agg(*(F.sum(F.when(ok, x).otherwise(0.0)).alias(n) for n, x in cells.items())), "moments")


def fit_grouped(df: DataFrame, features: list[str], target: str, group: str, alphas: tuple[float, ...]) -> list[Grouped]:
    """Ridges, one per penalty, on features and the one-hot values of `group` (a null has zeros everywhere),
    none of them scaled; the intercept is not penalised.

    The one-hot block of the normal equations is diagonal, so it is eliminated: what is left of each
    value's moments is summed, a system of the features alone is solved, and the weights of the values
    follow from it.  This is the same solution, and neither a task nor the driver holds a matrix or a
    list as wide as the number of values.  The rows are read once for all penalties.
    """
    d = len(features)
    sums = group_moments(df, features, target, group)
    n, at = F.col("__m0_0"), [(i, j) for i in range(d + 2) for j in range(i, d + 2)]
    known = F.col(group).isNotNull() & (n > 0)

    def left(i: int, j: int, alpha: float) -> Column:
        cell = F.col(f"__m{i}_{j}")
        return F.when(known, cell - F.col(f"__m0_{i}") * F.col(f"__m0_{j}") / (n + F.lit(alpha))).otherwise(cell)

    total = sums.agg(*(F.coalesce(F.sum(left(i, j, a)), F.lit(0.0)).alias(f"t{k}_{i}_{j}") for k, a in enumerate(alphas) for i, j in at)).first()
    out = []
    for k, alpha in enumerate(alphas):
        m = np.zeros((d + 2, d + 2))
        for i, j in at:
            m[i, j] = m[j, i] = total[f"t{k}_{i}_{j}"]
        penalty = alpha * np.eye(d + 1)
        penalty[0, 0] = 0
        w = np.linalg.lstsq(m[: d + 1, : d + 1] + penalty, m[: d + 1, d + 1], rcond=None)[0]
        out.append(Grouped(Linear(features, float(w[0]), w[1:]), group, float(alpha), sums))
    return out


def predict_grouped(df: DataFrame, models: dict[str, Grouped]) -> DataFrame:
    """Adds the prediction of each model (its name); the models are those of one `fit_grouped`.  A value
    that train lacked has no weight."""
    one = next(iter(models.values()))
    effects = one.moments.filter(F.col(one.group).isNotNull()).select(one.group, *(m.effect.alias(f"__effect_{name}") for name, m in models.items()))
    out = df.join(effects, one.group, "left")
    for name, m in models.items():
        out = predict_linear(out, m.linear, name).withColumn(name, F.col(name) + F.coalesce(F.col(f"__effect_{name}"), F.lit(0.0)))
    return out.drop(*(f"__effect_{name}" for name in models))


def choose_alpha(train: DataFrame, validation: DataFrame, features: list[str], target: str, group: str, alphas: tuple[float, ...]) -> tuple[Grouped, list[tuple[float, float]]]:
    """The ridge on features and the values of `group` whose validation error, as the mean over offsets of
    their mean absolute errors, is least (ties to the smaller penalty): the model and (alpha, error) of
    each.  Train is read once; `validation` has a column `offset`."""
    fits = fit_grouped(train, features, target, group, tuple(sorted(alphas)))
    rows = predict_grouped(validation, {f"__p{k}": model for k, model in enumerate(fits)})
    per = rows.groupBy("offset").agg(*(F.avg(F.abs(F.col(target) - F.col(f"__p{k}"))).alias(f"e{k}") for k in range(len(fits))))
    means = per.agg(*(F.avg(f"e{k}").alias(f"e{k}") for k in range(len(fits)))).first()
    errors = [(m.alpha, float("inf") if means[f"e{k}"] is None else float(means[f"e{k}"])) for k, m in enumerate(fits)]
    best = min(range(len(fits)), key=lambda k: (errors[k][1], errors[k][0]))
    return fits[best], errors


def grouped_gradient(df: DataFrame, model: Grouped, target: str) -> float:
    """The largest entry of the penalised normal equations' residual, over the number of rows: 0 at the fit.
    It is taken from the predictions of the rows, not from the sums that the fit used."""
    features = model.linear.features
    e = F.col(target).cast("double") - F.col("__p")
    rows = predict_grouped(df, {"__p": model}).filter(F.abs(e) < F.lit(float("inf")))
    per = rows.groupBy(model.group).agg(F.count("*").alias("n"), F.sum(e).alias("s"), *(F.sum(e * F.col(f)).alias(f"s{i}") for i, f in enumerate(features)))
    effects = model.moments.select(model.group, model.effect.alias("__effect"))
    pull = F.abs(F.col("s") - F.lit(model.alpha) * F.col("__effect"))  # null for the rows without a value, which have no weight
    one = per.join(effects, model.group, "left").agg(F.sum("n").alias("n"), F.max(pull).alias("most"), F.sum("s").alias("s"), *(F.sum(f"s{i}").alias(f"s{i}") for i in range(len(features)))).first()
    if not one.n:
        return 0.0
    score = [one.most or 0.0, one.s, *(one[f"s{i}"] - model.alpha * w for i, w in enumerate(model.linear.weights))]
    return float(np.abs(score).max() / one.n)


def lloyd_step(df: DataFrame, vector: str, centers: np.ndarray) -> float:
    """How far one more round of Lloyd would move plain centres: 0 where they have settled."""
    k, width = centers.shape
    blocks = df.select(F.col(vector).alias("v")).filter("v is not null").mapInArrow(partial(_unit_blocks, width=width), "x binary, single boolean")
    parts = blocks.mapInArrow(partial(_assign_sums, centers=centers[None]), "m array<double>")
    total = np.zeros(k * (width + 2))
    for c in parts.select(F.posexplode("m").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).collect():
        total[c.k] = c.x
    total = total.reshape(k, width + 2)
    full = total[:, :1] > 0
    return float(np.abs(np.where(full, total[:, 2:] / np.maximum(total[:, :1], 1), centers) - centers).max())


def elastic_violation(df: DataFrame, model: Linear, target: str, alpha: float, l1_ratio: float) -> float:
    """The largest violation of the optimality conditions of `fit_elastic_net`: 0 at the optimum."""
    d = len(model.features)
    m = moments(column_vector(df.select(*model.features, target), [*model.features, target]), "__x", d + 1)
    n = max(m[0, 0], 1.0)
    mean = m[0, 1:] / n
    cov = m[1:, 1:] / n - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cov)[:d], 1e-300))
    w = model.weights * scale
    pull = cov[:d, d] / scale - (cov[:d, :d] / np.outer(scale, scale)) @ w - alpha * (1 - l1_ratio) * w
    edge = alpha * l1_ratio
    return float(np.where(w != 0, np.abs(pull - edge * np.sign(w)), np.maximum(np.abs(pull) - edge, 0)).max())


def logistic_gradient(df: DataFrame, model: Linear, label: str, c: float, balanced: bool = False) -> float:
    """The largest entry of the penalised score of `fit_logistic`, over the number of rows: 0 at the fit."""
    d = len(model.features)
    y = F.col(label).cast("double")
    rows = predict_probability(df, model, "__p").filter(y.isNotNull() & F.col("__p").isNotNull())
    size = rows.agg(F.count("*").alias("n"), F.sum(y).alias("k")).first()
    weight = F.when(y == 1, size.n / (2 * size.k)).otherwise(size.n / (2 * (size.n - size.k))) if balanced and 0 < (size.k or 0) < size.n else F.lit(1.0)
    e = weight * (y - F.col("__p"))
    sums = rows.agg(F.sum(e).alias("s"), *(F.sum(e * F.col(f)).alias(f"s{i}") for i, f in enumerate(model.features))).first()
    score = np.array([sums["s"], *(sums[f"s{i}"] - model.weights[i] / c for i in range(d))], float)
    return float(np.abs(score).max() / max(size.n, 1))


def portable_axes(width: int, components: int, seed: int) -> Projection:
    """Gaussian projection with variance 1 / components whose entries any engine with SHA-256 repeats:
    entry (i, j) comes from two uniforms of the keys seed|i|j|1 and seed|i|j|2 by Box and Muller."""

    def uniform(*key: int) -> float:
        return (int(hashlib.sha256("|".join(map(str, key)).encode()).hexdigest()[:8], 16) + 0.5) / 2**32

    axes = np.array([[np.sqrt(-2 * np.log(uniform(seed, i, j, 1))) * np.cos(2 * np.pi * uniform(seed, i, j, 2)) for j in range(width)] for i in range(components)])
    return Projection(np.zeros(width), axes / np.sqrt(components), np.ones(components))
