"""Near-duplicate texts: banded MinHash candidates, odd sketches, exact verification.

One pass over the texts gives every text a print of its shingle set, an odd sketch and its bucket
keys.  Texts with equal sets form a class and count once from then on.  Buckets are sorted streams;
a bucket with too many different classes is not paired but goes through an exact prefix-filter join
instead, so nothing is capped.  Candidate pairs are thinned by the odd sketches and then verified
on the whole texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import kernel as K
from barloom.operators.prefilter import maybe_in
from barloom.session import discard, gathered, input_bytes, release, spread, written

#: Characters that one call of the kernels works on.
CHARS = 1_500_000
BANDS = 40
SKETCH_BITS = 512
#: Different classes in one bucket from which it takes the exact prefix route.
BUCKET = 128
#: Standard errors of the sketch's estimate that a candidate may lie below the threshold.
SLACK = 5.0

#: Bits of a class's print that band rows carry: enough to find its few namesakes by a join, all of
#: which are then compared as candidates.
SHORT = 40
#: Prints of one task that are remembered to keep a class from being told twice.
REMEMBERED = 1 << 18

#: Where the id begins in the card of a class: behind print, side and sketch.
ID = 17 + SKETCH_BITS // 8

ROWS = "hi long, lo long, card binary"
FOUND = "kind int, a long, b long, card binary"


def banding(threshold: float) -> tuple[int, int]:
    """Rows per band and bands: a pair at the threshold shares a band with probability 0.996."""
    return max(1, round(math.log(0.13) / math.log(threshold))), BANDS


def pieces(texts: list[str], limit: int = CHARS) -> Iterator[slice]:
    """Slices of a batch of about `limit` characters; a longer text is a slice of its own."""
    begin = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield slice(begin, k)
            begin, size = k, 0
        size += len(t) + 1
    if begin < len(texts):
        yield slice(begin, len(texts))


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _binary(rows: np.ndarray) -> pa.Array:
    """Fixed-size rows of bytes as a binary column."""
    n, width = rows.shape
    offsets = np.arange(n + 1, dtype=np.int32) * width
    return pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _prints(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 16 bytes of each print, and its leading bits as a number."""
    return prints.astype(">u8").view(np.uint8).reshape(-1, 16), (prints[:, 0] >> np.uint64(64 - SHORT)).astype(np.int64)


def _rows_of(batches: Iterator[pa.RecordBatch], width: int, rows: int, bands: int) -> Iterator[pa.RecordBatch]:
    """Three kinds of rows in one stream (hi, lo, card).

    Band rows have no card: hi is the bucket's key and the upper bits of the class's short print, lo
    its lower bits and the side, all of it as tight as it can be, for there are `bands` of them to
    each class.  A text whose class is new to the task tells it (lo 1, card: print, side, sketch, id)
    and goes by its print.  Others (lo 0, card: print, side, id) go anywhere, so a class of any size
    is spread.
    """
    seen: dict[bytes, int] = {}
    count = 0
    names = ["hi", "lo", "card"]

    def cards(hi, lo, *parts):
        return pa.RecordBatch.from_arrays([pa.array(_signed(hi)), pa.array(np.full(len(hi), lo, np.int64)), pc.binary_join_element_wise(*parts, b"")], names)

    for batch in batches:
        ids, texts = batch.column(0).cast(pa.binary()), batch.column(1).to_pylist()
        sides = batch.column(2).to_numpy(zero_copy_only=False).astype(np.uint8)
        for part in pieces(texts):
            value, bounds = K.shingles(texts[part], width)
            full = np.flatnonzero(np.diff(bounds))
            if not len(full):
                continue
            bounds, side = np.append(bounds[full], bounds[-1]), sides[part][full]
            prints = K.set_prints(value, bounds)
            wide, short = _prints(prints)
            own = ids.slice(part.start, part.stop - part.start).take(pa.array(full))
            new = np.zeros(len(full), bool)
            for k, (p, s) in enumerate(zip(_binary(wide).to_pylist(), side.tolist())):
                if (old := seen.get(p, -1)) < 0 or old | s != old:
                    seen[p] = max(old, 0) | s
                    new[k] = True
            if len(seen) > REMEMBERED:
                seen.clear()
            fresh, known = np.flatnonzero(new), np.flatnonzero(~new)
            if len(known):
                yield cards(K.mix(np.arange(count, count + len(known), dtype=np.uint64)), 0, _binary(wide[known]), _binary(side[known, None]), own.take(pa.array(known)))
                count += len(known)
            if not len(fresh):
                continue
            signature = K.minhash(value, bounds, rows * bands)[fresh]
            yield cards(K.mix(prints[fresh, 0]), 1, _binary(wide[fresh]), _binary(side[fresh, None]), _binary(K.odd_sketch(signature, SKETCH_BITS)), own.take(pa.array(fresh)))
            keys, low = K.band_keys(signature, rows), SHORT - 16
            name = short[fresh].astype(np.uint64)[:, None]
            hi = (keys << np.uint64(16)) | (name >> np.uint64(low))
            lo = ((short[fresh] & ((1 << low) - 1)) << 2) | side[fresh]
            yield pa.RecordBatch.from_arrays([pa.array(_signed(hi.ravel())), pa.array(np.repeat(lo, bands)), pa.nulls(hi.size, pa.binary())], names)


def _pairs_of_groups(key: np.ndarray, value: np.ndarray, side: np.ndarray, sided: bool, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (a, b) of the groups of up to `limit` values, and the values of larger groups."""
    if not len(key):
        return key, key, key
    order = np.lexsort((value, key))
    key, value, side = key[order], value[order], side[order]
    first = np.ones(len(key), bool)
    first[1:] = (key[1:] != key[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(first)
    side = np.bitwise_or.reduceat(side, at)
    key, value = key[at], value[at]
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(begin, len(key)))
    left, right = [], []
    for s in np.unique(size[(size > 1) & (size <= limit)]):
        i, j = np.triu_indices(s, 1)
        base = begin[size == s][:, None]
        x, y = (base + i).ravel(), (base + j).ravel()
        if sided:
            ok = ((side[x] & 1) & (side[y] >> 1)) | ((side[x] >> 1) & (side[y] & 1))
            x, y = x[ok > 0], y[ok > 0]
        left.append(value[x])
        right.append(value[y])
    over = np.repeat(size > limit, size)
    a, b = (np.concatenate(v) if v else np.empty(0, np.int64) for v in (left, right))
    if len(a):
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        keep = np.ones(len(a), bool)
        keep[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        a, b = a[keep], b[keep]
    return a, b, value[over]


def _buckets(batches: Iterator[pa.RecordBatch], sided: bool, limit: int) -> Iterator[pa.RecordBatch]:
    """From rows sorted by hi: kind 0 = a first member for each class, 1 = pairs of classes, 2 = classes
    of hot buckets (all by short prints), 3 = other members, their card without the sketch."""
    names = ["kind", "a", "b", "card"]

    def out(kind: int, a: np.ndarray, b: np.ndarray, card: pa.Array | None = None) -> pa.RecordBatch:
        n = len(a)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(a), pa.array(b), pa.nulls(n, pa.binary()) if card is None else card], names)

    def done(key, value, side):
        a, b, over = _pairs_of_groups(key, value, side, sided, limit)
        if len(a):
            yield out(1, a, b)
        if len(over):
            yield out(2, np.unique(over), np.unique(over))

    empty = np.empty(0, np.int64)
    carry, hot, low = (empty, empty, empty), None, SHORT - 16
    at, told = None, set()
    for batch in batches:
        carded = batch.filter(batch.column(2).is_valid())
        if carded.num_rows:
            kind = carded.column(1).to_numpy()
            rest = carded.column(2).filter(pa.array(kind == 0)).to_pylist()
            cards, short = [], []
            for hi, card in zip(carded.column(0).to_numpy()[kind == 1].tolist(), carded.column(2).filter(pa.array(kind == 1)).to_pylist()):
                if hi != at:
                    at, told = hi, set()
                if (name := card[:16]) in told:
                    rest.append(card[:17] + card[ID:])
                else:
                    told.add(name)
                    cards.append(card)
                    short.append(int.from_bytes(name[: SHORT // 8], "big"))
            if cards:
                yield out(0, np.array(short, np.int64), np.array(short, np.int64), pa.array(cards, pa.binary()))
            if rest:
                yield out(3, np.zeros(len(rest), np.int64), np.zeros(len(rest), np.int64), pa.array(rest, pa.binary()))
        band = batch.filter(batch.column(2).is_null())
        hi, lo = band.column(0).to_numpy(), band.column(1).to_numpy()
        key, value, side = (np.concatenate(x) for x in zip(carry, (hi >> 16, ((hi & 0xFFFF) << low) | (lo >> 2), lo & 3)))
        if hot is not None and len(key):
            n = int(np.searchsorted(key, hot, side="right"))
            if n:
                yield out(2, np.unique(value[:n]), np.unique(value[:n]))
            key, value, side = key[n:], value[n:], side[n:]
            hot = hot if not len(key) else None
        if not len(key):
            carry = (empty, empty, empty)
            continue
        cut = int(np.searchsorted(key, key[-1], side="left"))
        yield from done(key[:cut], value[:cut], side[:cut])
        carry = (key[cut:], value[cut:], side[cut:])
        if len(members := np.unique(carry[1])) > limit:
            yield out(2, members, members)
            hot, carry = int(key[-1]), (empty, empty, empty)
    yield from done(*carry)


def _sketched(batches: Iterator[pa.RecordBatch], threshold: float, samples: int) -> Iterator[pa.RecordBatch]:
    least = threshold - SLACK * math.sqrt(threshold * (1 - threshold) / samples)
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, SKETCH_BITS // 8) for k in (4, 5))
        keep = K.odd_likeness(x, y, samples) >= least
        yield batch.select([0, 1, 2, 3]).filter(pa.array(keep))


def _verified(batches: Iterator[pa.RecordBatch], width: int, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        for part in pieces([x + y for x, y in zip(a, b)], CHARS // 2):
            n = part.stop - part.start
            value, bounds = K.shingles(a[part] + b[part], width)
            size = np.diff(bounds)
            of = np.repeat(np.arange(2 * n) % n, size)
            order = np.lexsort((value, of))
            v, o = value[order], of[order]
            twice = (v[1:] == v[:-1]) & (o[1:] == o[:-1])
            both = np.bincount(o[1:][twice], minlength=n)
            likeness = both / np.maximum(size[:n] + size[n:] - both, 1)
            keep = likeness >= threshold
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(part.start, n).filter(pa.array(keep)), batch.column(1).slice(part.start, n).filter(pa.array(keep)), pa.array(likeness[keep])], ["a", "b", "likeness"]
            )


def _grams_of(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints, texts = batch.column(0), batch.column(1).to_pylist()
        for part in pieces(texts):
            value, bounds = K.shingles(texts[part], width)
            size = np.diff(bounds)
            of = pa.array(np.repeat(np.arange(part.start, part.stop), size))
            yield pa.RecordBatch.from_arrays([prints.take(of), pa.array(np.repeat(size, size).astype(np.int64)), pa.array(_signed(value))], ["print", "size", "gram"])


def prefix_pairs(grams: DataFrame, threshold: float) -> DataFrame:
    """Candidate pairs (a, b) by prefix filtering: exact, for the classes of hot buckets.

    Sets ordered by the rarity of their elements can only reach the threshold if they share an
    element of their prefixes; rare elements come first, so the groups that meet stay small.
    """
    from pyspark.sql import Window

    seen = grams.groupBy("gram").agg(F.count("*").alias("df"))
    by_rarity = Window.partitionBy("print").orderBy("df", "gram")
    prefix = (
        grams.join(seen, "gram")
        .withColumn("place", F.row_number().over(by_rarity))
        .filter(F.col("place") <= F.col("size") - F.ceil(F.col("size") * F.lit(threshold) - F.lit(1e-9)) + 1)
        .select("gram", "print", "size")
    )
    left = prefix.select("gram", F.col("print").alias("a"), F.col("size").alias("size_a"))
    right = prefix.select("gram", F.col("print").alias("b"), F.col("size").alias("size_b"))
    near = (F.least("size_a", "size_b") >= F.greatest("size_a", "size_b") * F.lit(threshold) - F.lit(1e-9)) & (F.col("a") < F.col("b"))
    return left.join(right, "gram").filter(near).select("a", "b").distinct()


@dataclass(frozen=True)
class Nearness:
    """Members (id, print, side) and verified links (a, b, likeness) between different classes."""

    members: DataFrame
    links: DataFrame


def near_duplicates(df: DataFrame, id_col: str, text_col: str, *, width: int = 5, threshold: float = 0.8, side_col: str | None = None, bucket: int = BUCKET) -> Nearness:
    """Texts whose shingle sets of `width` words have a Jaccard similarity of `threshold` or more.

    With `side_col` (1 = one side, 2 = the other, null or 0 = neither) only links across sides are
    sought.  Rows with a null id or text, and texts without any word, belong to no class; ids are
    taken to be unique, a repeated (id, text) row gives a repeated member.  Texts with equal shingle
    sets share one class, whatever their number; links join different classes, a < b.  Other
    columns are not read.  An empty table gives empty tables.
    """
    spark = df.sparkSession
    rows, bands = banding(threshold)
    side = F.coalesce(F.col(side_col).cast("int"), F.lit(0)) if side_col else F.lit(0)
    texts = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), side.alias("side")).filter("id is not null and text is not null")
    if side_col:
        texts = texts.filter("side > 0")
    size = input_bytes(texts)
    keyed = spread(texts.select("id", "text", "side")).mapInArrow(partial(_rows_of, width=width, rows=rows, bands=bands), ROWS)
    # a class has `bands` rows of about 15 bytes, however long its text
    found = written(gathered(keyed, F.shiftright("hi", 16), size=3 * size).sortWithinPartitions("hi").mapInArrow(partial(_buckets, sided=bool(side_col), limit=bucket), FOUND), "buckets")
    release(spark)
    name, of_id = F.expr("substring(card, 1, 16)"), F.expr(f"cast(substring(card, if(kind = 0, {ID + 1}, 18)) as string)")
    members = found.filter("kind in (0, 3)").select(of_id.alias("id"), name.alias("print"), F.ascii(F.expr("cast(substring(card, 17, 1) as string)")).alias("side"))
    classes = found.filter("kind = 0").select(F.col("a").alias("short"), name.alias("print"), F.expr(f"substring(card, 18, {SKETCH_BITS // 8})").alias("sketch"), of_id.alias("id"))
    candidates = written(found.filter("kind = 1").select("a", "b").distinct(), "candidates")
    hot = found.filter("kind = 2").select(F.col("a").alias("short")).distinct()

    def matched(pairs: DataFrame, by: str) -> DataFrame:
        """Both classes of candidate pairs; candidates are far fewer than texts, most of which have none."""
        ends = pairs.select(F.col("a").alias("end")).union(pairs.select("b"))
        those = maybe_in(classes, by, ends, "end")
        one, other = (those.select(F.col(by).alias(f"key_{x}"), F.col("print").alias(x), F.col("id").alias(f"id_{x}"), F.col("sketch").alias(f"sketch_{x}")) for x in "ab")
        both = pairs.select(F.col("a").alias("key_a"), F.col("b").alias("key_b")).join(one, "key_a").join(other, "key_b")
        return both.select("a", "b", "id_a", "id_b", "sketch_a", "sketch_b")

    both = matched(candidates, "short")
    if not hot.isEmpty():
        wide = written(classes.join(hot, "short", "left_semi").select("print", "id"), "hot")
        grams = wide.join(maybe_in(texts.select("id", "text"), "id", wide, "id"), "id").dropDuplicates(["id", "print"]).select("print", "text")
        grams = grams.mapInArrow(partial(_grams_of, width=width), "print binary, size long, gram long")
        close = written(prefix_pairs(written(grams, "grams"), threshold), "close")
        both = both.union(matched(close, "print")).dropDuplicates(["a", "b"])
    likely = written(both.mapInArrow(partial(_sketched, threshold=threshold, samples=rows * bands), "a binary, b binary, id_a string, id_b string"), "likely")
    release(spark)
    bare = maybe_in(texts.select("id", "text"), "id", likely.select("id_a").union(likely.select("id_b")).distinct(), "id_a").dropDuplicates(["id"])
    wanted = (
        likely.join(bare.select(F.col("id").alias("id_a"), F.col("text").alias("text_a")), "id_a")
        .join(bare.select(F.col("id").alias("id_b"), F.col("text").alias("text_b")), "id_b")
        .select("a", "b", "text_a", "text_b")
    )
    links = written(wanted.mapInArrow(partial(_verified, width=width, threshold=threshold), "a binary, b binary, likeness double"), "links")
    discard(likely)
    release(spark)
    return Nearness(members, links)


def all_pairs(near: Nearness) -> DataFrame:
    """Every pair of different ids of linked or equal classes, smaller id first: id_a, id_b."""
    members = near.members.select("id", "print").distinct()
    many = members.groupBy("print").agg(F.count("*").alias("n")).filter("n > 1")
    same = many.select(F.col("print").alias("a"), F.col("print").alias("b"))
    left = members.select(F.col("print").alias("a"), F.col("id").alias("x"))
    right = members.select(F.col("print").alias("b"), F.col("id").alias("y"))
    within = same.join(left, "a").join(right, "b").filter("x < y")
    across = near.links.select("a", "b").join(left, "a").join(right, "b").filter("x <> y")
    return within.union(across).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def overlapping(near: Nearness) -> DataFrame:
    """Members of side 2 whose class equals or is linked to a class with members of side 1: id."""
    sides = near.members.groupBy("print").agg(F.bit_or("side").alias("side"))
    flags = near.links.select("a", "b").join(sides.select(F.col("print").alias("a"), F.col("side").alias("sa")), "a").join(sides.select(F.col("print").alias("b"), F.col("side").alias("sb")), "b")
    touched = (
        sides.filter("side = 3").select("print")
        .union(flags.filter("sa & 1 > 0 and sb & 2 > 0").select("b"))
        .union(flags.filter("sb & 1 > 0 and sa & 2 > 0").select("a"))
        .distinct()
    )
    return near.members.filter("side = 2").join(touched, "print", "left_semi").select("id").distinct()


def groups(near: Nearness) -> DataFrame:
    """One row per id: its group's least id, the links of its class to other classes, its copies."""
    from barloom.operators.components import connected_components

    ends = near.links.select("a", "b").union(near.links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = ends.groupBy(F.col("a").alias("print")).agg(F.count("*").alias("n_links"))
    labels = connected_components(near.links, "a", "b").withColumnRenamed("node", "print")
    classes = near.members.groupBy("print").agg(F.min("id").alias("least"), F.countDistinct("id").alias("n_copies"))
    full = classes.join(labels, "print", "left").join(degree, "print", "left").withColumn("component", F.coalesce("component", "print"))
    names = full.groupBy("component").agg(F.min("least").alias("group_id"), F.sum("n_copies").alias("group_size"))
    full = full.join(names, "component").select("print", "group_id", "group_size", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")
    return near.members.select("id", "print").distinct().join(full, "print").select("id", "group_id", "group_size", "n_links", "n_copies")
