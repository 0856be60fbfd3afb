"""Similarity clusters of vectors: density balls, spatial partitions with margins, merged locals.

Two vectors belong together when their cosine reaches a threshold, directly or through others.
Pivots are fitted on a bounded sample.  A row whose angle to a pivot is at most half the linking
angle is a core row: all core rows of one pivot are linked to each other by the triangle inequality,
so a dense region of any size is one node and none of its pairs is ever formed.  What is left is
exact too: core rows near the border of two partitions and loose rows (outside every ball) visit the
partitions they can reach, and loose rows meet each other on a grid of reduced vectors whose cells
are as wide as the linking distance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.components import connected_components
from barloom.session import release, spread, written

#: Rows of the sample that pivots are fitted on, and the most pivots kept (bounds of the model).
SAMPLE = 12_000
PIVOTS = 2_048
#: Rows of one partition that are compared at once; larger partitions are split.
BLOCK = 4_096
#: Node numbers below this are partitions, the others are rows.
CELLS = 1 << 20
CHUNK = 2_048
#: Clusters whose sums one task adds up before it passes them on.
SUMS = 16_384

ASSIGNED = "kind int, node long, other long, id string, vec binary"


def unit_rows(column: pa.Array, width: int | None = None, kind: type = np.float32) -> tuple[np.ndarray, np.ndarray]:
    """Usable vectors of a list column as unit rows of that kind, and their positions.

    Null or all-zero vectors, vectors with null or non-finite entries, and vectors of another length
    than the first usable one (or `width`) are not usable.
    """
    offsets = column.offsets.to_numpy()
    size = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float32)
    width = width or int(size[size > 0][0]) if (size > 0).any() else 0
    at = np.flatnonzero((size == width) & (size > 0))
    if not len(at):
        return np.empty((0, width or 1), np.float32), at
    x = values[offsets[at][:, None] + np.arange(width)]
    norm = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
    ok = np.isfinite(norm) & (norm > 0)
    return (x[ok] / norm[ok, None]).astype(kind), at[ok]


@dataclass(frozen=True)
class Model:
    """Pivots (unit centres), one real row inside each ball, and the reduced axes."""

    pivots: np.ndarray
    inside: np.ndarray
    axes: np.ndarray
    share: np.ndarray
    threshold: float

    @property
    def half(self) -> float:
        return math.cos(math.acos(self.threshold) / 2)

    @property
    def reach(self) -> float:
        return math.cos(min(math.pi, 1.5 * math.acos(self.threshold)))

    @property
    def span(self) -> float:
        return math.sqrt(2 - 2 * self.threshold)


def fit(x: np.ndarray, threshold: float, pivots: int = PIVOTS) -> Model:
    """Pivots by leader clustering of the sample and two refinements of the centres."""
    left, centres = np.arange(len(x)), []
    while len(left):
        near = x[left] @ x[left[0]] >= threshold
        near[0] = True
        if near.sum() >= 3:
            centres.append(x[left[near]].mean(axis=0))
        left = left[~near]
    p = np.array(centres, np.float32).reshape(-1, x.shape[1])
    half = math.cos(math.acos(threshold) / 2)
    home = np.empty(0, np.int64)
    for _ in range(3):
        if not len(p):
            break
        p /= np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-12)
        best, home = np.empty(len(x), np.float32), np.empty(len(x), np.int64)
        for s in range(0, len(x), CHUNK):
            sims = x[s : s + CHUNK] @ p.T
            home[s : s + CHUNK], best[s : s + CHUNK] = sims.argmax(axis=1), sims.max(axis=1)
        core = best >= half
        size = np.bincount(home[core], minlength=len(p))
        total = np.zeros_like(p)
        np.add.at(total, home[core], x[core])
        inside = np.zeros(len(p), np.int64)
        order = np.argsort(best)
        inside[home[order]] = order
        keep = np.flatnonzero(size)
        keep = keep[np.argsort(-size[keep], kind="stable")][:pivots]
        used, rows, share = p[keep], x[inside[keep]], size[keep] / max(len(x), 1)
        p = total[keep]
    else:
        return Model(used, rows, _axes(x), share, threshold)
    return Model(p, p, _axes(x), np.empty(0), threshold)


def _axes(x: np.ndarray) -> np.ndarray:
    """The three directions of largest variance: projecting on them never lengthens a distance."""
    if not len(x):
        return np.zeros((1, x.shape[1]), np.float32)
    _, vectors = np.linalg.eigh(np.cov(x.T.astype(np.float64)) if len(x) > 1 else np.eye(x.shape[1]))
    return vectors[:, ::-1][:, : min(3, x.shape[1])].T.astype(np.float32)


def _bytes(x: np.ndarray) -> pa.Array:
    n, width = len(x), x.shape[1] * 4
    return pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * width), pa.py_buffer(np.ascontiguousarray(x, np.float32))])


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, width)


def _assign(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """kind 0: every usable row with its node; 1: links of nodes; 2: visits; 3: loose rows."""
    names = ["kind", "node", "other", "id", "vec"]
    p, width = model.pivots, model.axes.shape[1]
    apart = np.sqrt(np.maximum(2 - 2 * (p @ p.T), 0)) * np.float32(model.span / 2)
    told: set[tuple[int, int]] = set()

    def out(kind, node, other=None, ids=None, vec=None):
        n = len(node)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, kind, np.int32)), pa.array(node.astype(np.int64)), pa.nulls(n, pa.int64()) if other is None else pa.array(other.astype(np.int64)),
             pa.nulls(n, pa.string()) if ids is None else ids, pa.nulls(n, pa.binary()) if vec is None else _bytes(vec)], names)

    for batch in batches:
        whole, at_all = unit_rows(batch.column(2), width)
        own_all = batch.column(1).to_numpy()[at_all]
        for s in range(0, len(whole), CHUNK):
            x, at, own = whole[s : s + CHUNK], at_all[s : s + CHUNK], own_all[s : s + CHUNK]
            ids = batch.column(0).take(pa.array(at))
            if not len(p):
                yield out(0, own, ids=ids)
                yield out(3, own, ids=ids, vec=x)
                continue
            sims = x @ p.T
            home = sims.argmax(axis=1)
            best = sims[np.arange(len(x)), home]
            core = best >= model.half
            node = np.where(core, home, own)
            yield out(0, node, ids=ids)
            balls = sims >= model.half
            balls[np.arange(len(x)), home] = False
            links = {(int(home[i]), int(j)) for i, j in zip(*np.nonzero(balls))} - told
            told |= links
            if links:
                yield out(1, *np.array(sorted(links)).T)
            reach = sims >= model.reach
            border = (best[:, None] - sims <= apart[home]) & reach & core[:, None] & ~balls
            border[np.arange(len(x)), home] = False
            i, j = np.nonzero(border)
            if len(i):
                yield out(2, j, other=home[i], vec=x[i])
            loose = np.flatnonzero(~core)
            if len(loose):
                y = x[loose]
                touch = (y @ model.inside.T) >= model.threshold
                i, j = np.nonzero(touch)
                if len(i):
                    yield out(1, node[loose][i], other=j)
                i, j = np.nonzero(reach[loose] & ~touch)
                if len(i):
                    yield out(2, j, other=node[loose][i], vec=y[i])
                yield out(3, node[loose], ids=ids.take(pa.array(loose)), vec=y)


def _core_rows(batches: Iterator[pa.RecordBatch], model: Model, visited: np.ndarray, blocks: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Core rows of the visited partitions, each in one block of its partition."""
    for batch in batches:
        whole, at_all = unit_rows(batch.column(2), model.axes.shape[1])
        salt_all = batch.column(1).to_numpy()[at_all]
        for s in range(0, len(whole), CHUNK):
            x = whole[s : s + CHUNK]
            sims = x @ model.pivots.T
            home = sims.argmax(axis=1)
            keep = (sims[np.arange(len(x)), home] >= model.half) & visited[home]
            home, salt = home[keep], salt_all[s : s + CHUNK][keep]
            n = len(home)
            yield pa.RecordBatch.from_arrays(
                [pa.array(home.astype(np.int64)), pa.array((salt >> 8) % blocks[home]), pa.array(np.zeros(n, np.int32)), pa.array(np.zeros(n, np.int64)), _bytes(x[keep])], ["cell", "block", "role", "node", "vec"]
            )


def _spread(batches: Iterator[pa.RecordBatch], blocks: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A visit goes to every block of its partition."""
    for batch in batches:
        cell = batch.column(0).to_numpy()
        times = blocks[cell]
        i = np.repeat(np.arange(len(cell)), times)
        block = np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times)
        at = pa.array(i)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(block.astype(np.int64)), pa.array(np.ones(len(i), np.int32)), batch.column(1).take(at), batch.column(2).take(at)], ["cell", "block", "role", "node", "vec"])


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of rows of one (cell, block) from a sorted stream."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cell, block = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = np.flatnonzero((cell[1:] != cell[:-1]) | (block[1:] != block[:-1])) + 1
        for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(cell)]):
            key = (cell[s], block[s])
            if held and key != now:
                yield pa.Table.from_batches(held)
                held = []
            now = key
            held.append(batch.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)


def _meet(batches: Iterator[pa.RecordBatch], threshold: float, width: int) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of visitors to the partition whose core they touch."""
    for rows in _by_block(batches):
        role = rows.column(2).to_numpy()
        home, guest = (rows.filter(pa.array(role == k)) for k in (0, 1))
        if not home.num_rows or not guest.num_rows:
            continue
        x, node, cell = _vectors(home.column(4), width), guest.column(3).to_numpy(), int(rows.column(0)[0].as_py())
        found = []
        y = _vectors(guest.column(4), width)
        for s in range(0, len(y), CHUNK):
            part = y[s : s + CHUNK]
            best = np.full(len(part), -2, np.float32)
            for t in range(0, len(x), CHUNK):
                np.maximum(best, (part @ x[t : t + CHUNK].T).max(axis=1), out=best)
            found.append(best >= threshold)
        hit = np.unique(node[np.concatenate(found)])
        hit = hit[hit != cell]
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(np.full(len(hit), cell, np.int64))], ["a", "b"])


def _gridded(batches: Iterator[pa.RecordBatch], axes: np.ndarray, span: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        g = np.floor(_vectors(batch.column(1), axes.shape[1]) @ axes.T / span).astype(np.int64) + 64
        cell = g @ (128 ** np.arange(g.shape[1]))
        yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column(0), batch.column(1)], ["cell", "node", "vec"])


def _neighbours(batches: Iterator[pa.RecordBatch], blocks: dict[int, int], axes: int) -> Iterator[pa.RecordBatch]:
    """A loose row belongs to one block of its cell; it visits the other blocks and half of the
    neighbouring cells, so that any two rows of adjacent cells meet once."""
    steps = [()]
    for _ in range(axes):
        steps = [(*s, d) for s in steps for d in (-1, 0, 1)]
    half = [sum(d * 128**k for k, d in enumerate(s)) for s in steps if s[::-1] > (0,) * axes]
    for batch in batches:
        cell, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        i, c, b, r = [], [], [], []
        for k, (at, salt) in enumerate(zip(cell.tolist(), (node >> 8).tolist())):
            mine = salt % blocks[at]
            for where, block in [(at, x) for x in range(mine, blocks[at])] + [(at + d, x) for d in half if at + d in blocks for x in range(blocks[at + d])]:
                i.append(k)
                c.append(where)
                b.append(block)
                r.append(int((where, block) != (at, mine)))
        at = pa.array(i, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(b, pa.int64()), pa.array(r, pa.int32()), batch.column(1).take(at), batch.column(2).take(at)], ["cell", "block", "role", "node", "vec"])


def _join_loose(batches: Iterator[pa.RecordBatch], threshold: float, width: int) -> Iterator[pa.RecordBatch]:
    """Local clusters of a block: at most one link per row, to the least row of its local cluster."""
    for rows in _by_block(batches):
        role = rows.column(2).to_numpy()
        order = np.argsort(role, kind="stable")
        node = rows.column(3).to_numpy()[order]
        x = _vectors(rows.column(4), width)[order]
        home = int((role == 0).sum())
        label = np.arange(len(x))
        near = [(s, np.nonzero(x[s : min(s + CHUNK, home)] @ x.T >= threshold)) for s in range(0, home, CHUNK)]
        i = np.concatenate([s + e[0] for s, e in near]) if near else np.empty(0, np.int64)
        j = np.concatenate([e[1] for _, e in near]) if near else np.empty(0, np.int64)
        while True:
            low = np.minimum(label[i], label[j])
            after = label.copy()
            np.minimum.at(after, i, low)
            np.minimum.at(after, j, low)
            after = after[after]
            if (after == label).all():
                break
            label = after
        moved = np.flatnonzero(node != node[label])
        yield pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[label[moved]])], ["a", "b"])


@dataclass(frozen=True)
class Clusters:
    """members: id, node (also of rows alone); nodes: node, first_id of its cluster, cluster size."""

    members: DataFrame
    nodes: DataFrame
    model: Model
    vectors: DataFrame


def vector_clusters(df: DataFrame, id_col: str, vec_col: str, *, threshold: float = 0.7, sample: int = SAMPLE, pivots: int = PIVOTS, block: int = BLOCK) -> Clusters:
    """Clusters of the relation 'cosine of at least `threshold`', closed under chains.

    Rows with a null id or an unusable vector (null, zero, non-finite, or of another length than
    the first) are no members; repeated rows are one member.  The sample only shapes the partitions:
    every row is placed and every link is found whatever the sample held.  Other columns are not
    read.  An empty table gives an empty result.
    """
    spark = df.sparkSession
    salt = F.xxhash64("id").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    vectors = df.select(F.col(id_col).cast("string").alias("id"), F.col(vec_col).cast("array<float>").alias("v")).filter("id is not null and v is not null").select("id", salt.alias("node"), "v")
    total = max(vectors.count(), 1)
    part = min(1.0, 1.1 * sample / total)
    drawn = vectors.filter(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 20)) < int(part * (1 << 20))).limit(2 * sample).select("v").toArrow()
    x, _ = unit_rows(drawn.column("v").combine_chunks() if drawn.num_rows else pa.array([], pa.list_(pa.float32())))
    model = fit(x, threshold, pivots)
    width = model.axes.shape[1]
    assigned = written(spread(vectors).mapInArrow(partial(_assign, model=model), ASSIGNED), "assigned")
    links = [assigned.filter("kind = 1").select(F.col("node").alias("a"), F.col("other").alias("b"))]

    visits = assigned.filter("kind = 2").select(F.col("node").alias("cell"), F.col("other").alias("node"), "vec")
    cells = [r.cell for r in visits.select("cell").distinct().collect()]  # at most one per pivot
    if cells:
        visited = np.zeros(len(model.pivots), bool)
        visited[cells] = True
        blocks = np.maximum(1, np.ceil(model.share * total / block)).astype(np.int64)
        rows = "cell long, block long, role int, node long, vec binary"
        core = vectors.mapInArrow(partial(_core_rows, model=model, visited=visited, blocks=blocks), rows)
        meeting = core.union(visits.mapInArrow(partial(_spread, blocks=blocks), rows)).repartition("cell", "block").sortWithinPartitions("cell", "block")
        links.append(written(meeting.mapInArrow(partial(_meet, threshold=threshold, width=width), "a long, b long"), "met"))
        release(spark)

    loose = assigned.filter("kind = 3").select("node", "vec").mapInArrow(partial(_gridded, axes=model.axes, span=model.span), "cell long, node long, vec binary")
    sizes = {r.cell: -(-r["n"] // block) for r in loose.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a few cells per reduced axis
    if sizes:
        rows = "cell long, block long, role int, node long, vec binary"
        meeting = loose.mapInArrow(partial(_neighbours, blocks=sizes, axes=len(model.axes)), rows).repartition("cell", "block").sortWithinPartitions("cell", "block")
        links.append(written(meeting.mapInArrow(partial(_join_loose, threshold=threshold, width=width), "a long, b long"), "loose"))
        release(spark)

    edges = links[0]
    for more in links[1:]:
        edges = edges.union(more)
    labels = connected_components(edges)
    members = assigned.filter("kind = 0").select("id", "node")
    local = members.groupBy("node").agg(F.min("id").alias("least"))
    named = local.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = named.groupBy("component").agg(F.min("least").alias("first_id"))
    nodes = written(named.join(first, "component").select("node", "first_id"), "nodes")
    return Clusters(members, nodes, model, vectors)


def _with_cluster(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Attach a node's cluster.  Partitions are at most PIVOTS rows and are broadcast, so a hot one
    is not gathered anywhere; loose rows are joined by shuffle."""
    dense = rows.filter(F.col("node") < CELLS).join(F.broadcast(nodes.filter(F.col("node") < CELLS)), "node")
    return dense.union(rows.filter(F.col("node") >= CELLS).join(nodes.filter(F.col("node") >= CELLS), "node"))


def memberships(clusters: Clusters) -> DataFrame:
    """One row per usable id: id, first_id (the least id of its cluster)."""
    return _with_cluster(clusters.members, clusters.nodes).select("id", "first_id").distinct()


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], ["first_id", "total"])

    for batch in batches:
        if len(total) > SUMS:
            yield out()
            total.clear()
        x, at = unit_rows(batch.column(1), kind=np.float64)
        names = batch.column(0).take(pa.array(at)).to_pylist()
        keys, inverse = np.unique(names, return_inverse=True)
        part = np.zeros((len(keys), x.shape[1]))
        np.add.at(part, inverse, x)
        for k, v in zip(keys.tolist(), part):
            total[k] = total[k] + v if k in total else v
    yield out()


def describe(clusters: Clusters, top: int = 3) -> DataFrame:
    """One row per cluster of two or more: first_id, n_members, and its `top` most typical members,
    those nearest to the mean direction (the first of them is the representative), ties by id."""
    placed = _with_cluster(clusters.members.distinct(), clusters.nodes).select("id", "first_id")
    sizes = placed.groupBy("first_id").agg(F.count("*").alias("n_members")).filter("n_members > 1")
    rows = clusters.vectors.select("id", "v").distinct().join(placed, "id").select("first_id", "id", "v")
    sums = rows.select("first_id", "v").mapInArrow(_sums, "first_id string, total array<double>")
    means = sums.select("first_id", F.posexplode("total").alias("k", "x")).groupBy("first_id", "k").agg(F.sum("x").alias("x"))
    means = means.groupBy("first_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("mean"))

    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, t: s + t)

    near = rows.join(means.join(sizes, "first_id"), "first_id")
    score = F.round(dot(F.col("v"), F.col("mean")) / F.sqrt(dot(F.col("v"), F.col("v")) * dot(F.col("mean"), F.col("mean"))), 9)
    scored = near.select("first_id", "n_members", "id", score.alias("cosine"))
    nearest = [F.col("cosine").desc(), F.col("id").asc()]
    salted = scored.distinct().withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    few = salted.withColumn("k", F.row_number().over(Window.partitionBy("first_id", "salt").orderBy(*nearest))).filter(F.col("k") <= top)
    few = few.withColumn("k", F.row_number().over(Window.partitionBy("first_id").orderBy(*nearest))).filter(F.col("k") <= top)  # at most 64 x top rows a cluster
    best = few.groupBy("first_id", "n_members").agg(F.array_sort(F.collect_list(F.struct("k", "id", "cosine"))).alias("t"))
    return best.select("first_id", "n_members", F.transform("t", lambda s: s["id"]).alias("typical_ids"), F.transform("t", lambda s: s["cosine"]).alias("typical_cosines"))
