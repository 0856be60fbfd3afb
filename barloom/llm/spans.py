"""Long exact spans shared between texts.

Lines or paragraphs as units miss a span that begins in the middle of a line, so the units here are
content-defined: winnowed grams, of which any shared run of `length` characters holds at least one,
wherever it stands.  Their digests are grouped globally.  Groups of few texts give candidate pairs,
verified on the whole texts; anchors that recur in many texts (house notices) are replaced by all
windows of `length` characters around them, whose equality is the answer itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import kernel as K
from barloom.llm.neardup import _pairs_of_groups, _signed, pieces
from barloom.operators.prefilter import maybe_in
from barloom.session import discard, gathered, input_bytes, release, spread, written

#: Different texts in one digest group from which its anchors are widened to exact windows.
GROUP = 64


def _anchor_rows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    gram = length // 2
    seen: set[int] = set()
    for batch in batches:
        prints, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        fresh = [k for k, p in enumerate(prints.tolist()) if p not in seen and not seen.add(p)]
        prints, texts = prints[fresh], [texts[k] for k in fresh]
        for part in pieces(texts):
            owner, place, digest = K.anchors(texts[part], gram, length - gram + 1)
            yield pa.RecordBatch.from_arrays([pa.array(_signed(digest)), pa.array(prints[part][owner]), pa.array(place)], ["digest", "print", "place"])


def _groups(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """From rows sorted by digest: kind 1 = candidate pairs, 2 = anchors of hot groups."""
    names = ["kind", "a", "b"]

    def out(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b)], names)

    def done(key, value, place):
        if not len(key):
            return
        a, b, over = _pairs_of_groups(key, value, np.zeros(len(key), np.int64), False, limit)
        if len(a):
            yield out(1, a, b)
        if len(over):
            order = np.lexsort((value, key))
            key, value, place = key[order], value[order], place[order]
            first = np.ones(len(key), bool)
            first[1:] = (key[1:] != key[:-1]) | (value[1:] != value[:-1])
            begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            texts = np.add.reduceat(first.astype(np.int64), begin)
            hot = np.repeat(texts > limit, np.diff(np.append(begin, len(key))))
            yield out(2, value[hot], place[hot])

    empty = np.empty(0, np.int64)
    carry, hot = (empty, empty, empty), None
    for batch in batches:
        key, value, place = (np.concatenate([old, batch.column(k).to_numpy()]) for k, old in enumerate(carry))
        if hot is not None and len(key):
            n = int(np.searchsorted(key, hot, side="right"))
            if n:
                yield out(2, value[:n], place[:n])
            key, value, place = key[n:], value[n:], place[n:]
            hot = hot if not len(key) else None
        if not len(key):
            carry = (empty, empty, empty)
            continue
        cut = int(np.searchsorted(key, key[-1], side="left"))
        yield from done(key[:cut], value[:cut], place[:cut])
        carry = (key[cut:], value[cut:], place[cut:])
        if len(np.unique(carry[1])) > limit:
            yield out(2, carry[1], carry[2])
            hot, carry = int(key[-1]), (empty, empty, empty)
    yield from done(*carry)


def _around(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """All windows of `length` characters that hold one of the given anchors: digest, print, place."""
    gram = length // 2
    for batch in batches:
        for print_, text, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            codes, _ = K.flatten([text])
            h = K.window_hashes(codes[:-1], length)
            begin = np.unique((np.array(places, np.int64)[:, None] - np.arange(length - gram + 1)).ravel())
            begin = begin[(begin >= 0) & (begin < len(h))]
            yield pa.RecordBatch.from_arrays([pa.array(_signed(h[begin])), pa.array(np.full(len(begin), print_, np.int64)), pa.array(begin)], ["digest", "print", "place"])


def _merged(begin: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Union of the intervals [x, x + length) for sorted starts."""
    gap = np.flatnonzero(np.diff(begin) > length)
    return begin[np.concatenate([[0], gap + 1])], begin[np.concatenate([gap, [len(begin) - 1]])] + length


#: Characters of texts whose window hashes a task keeps for the next pairs.
KEPT = 8_000_000


def _checked(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Verified pairs with the spans of each text that stand in the other.

    Window hashes find the spans, their characters are then compared; hashes of texts that recur in
    neighbouring pairs are kept.
    """
    kept: dict[int, np.ndarray] = {}
    held = 0

    def hashes(print_: int, text: str) -> np.ndarray:
        nonlocal held
        if (h := kept.get(print_)) is None:
            if held > KEPT:
                kept.clear()
                held = 0
            h = kept[print_] = K.window_hashes(K.flatten([text])[0][:-1], length)
            held += len(text)
        return h

    for batch in batches:
        out = {"print": [], "other": [], "start": [], "stop": []}
        for p, q, x, y in zip(*(batch.column(k).to_pylist() for k in range(4))):
            hx, hy = hashes(p, x), hashes(q, y)
            shared = np.intersect1d(hx, hy)
            found = []
            while len(shared):
                found, wrong = [], []
                for mine, other, h, g, t, u in ((p, q, hx, hy, x, y), (q, p, hy, hx, y, x)):
                    start, stop = _merged(np.flatnonzero(np.isin(h, shared)), length)
                    order = np.argsort(g, kind="stable")
                    for s, e in zip(start.tolist(), stop.tolist()):
                        for k in (s, e - length):
                            at = order[np.searchsorted(g, h[k], sorter=order)]
                            if t[k : k + length] != u[at : at + length]:
                                wrong.append(h[k])
                        found.append((mine, other, s, e))
                if not wrong:
                    break
                shared, found = np.setdiff1d(shared, np.array(wrong, np.uint64)), []
            for row in found:
                for name, v in zip(out, row):
                    out[name].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out.values()], list(out))


@dataclass(frozen=True)
class Shared:
    """members: id, print, n_chars; spans: print, other, start, stop of verified pairs of classes (other
    is null for a span that stands in many texts, where pairs were not asked for)."""

    members: DataFrame
    spans: DataFrame


def _text_print(texts: DataFrame) -> DataFrame:
    """A class number per text, and a second one (`check`) that tells namesakes apart."""
    return texts.withColumn("print", F.xxhash64("text")).withColumn("check", F.xxhash64(F.lit(7), "text"))


def _told_apart(texts: DataFrame) -> DataFrame:
    """Different texts of one class number get their second number instead.  Such numbers are about
    n * n / 2**65 of n texts, so their table is broadcast; nearly always it is empty."""
    twice = texts.select("print", "check").groupBy("print").agg(F.min("check").alias("low"), F.max("check").alias("high")).filter("low <> high").select("print", F.lit(True).alias("twice"))
    twice = written(twice, "namesakes")
    if twice.isEmpty():
        return texts
    return texts.join(F.broadcast(twice), "print", "left").withColumn("print", F.when(F.col("twice"), F.col("check")).otherwise(F.col("print"))).drop("twice")


def _text_of(texts: DataFrame, members: DataFrame, classes: DataFrame) -> DataFrame:
    """One text for each class of `classes`, beside its columns."""
    first = classes.join(members, "print").groupBy(*classes.columns).agg(F.min("id").alias("id"))
    return first.join(maybe_in(texts.select("id", "text"), "id", first.select("id"), "id"), "id")


def shared_spans(df: DataFrame, id_col: str, text_col: str, *, length: int = 200, group: int = GROUP, pairs: bool = True) -> Shared:
    """Runs of `length` or more consecutive identical characters that stand in two texts.

    Identical texts form a class and are compared once.  Null ids or texts, and texts shorter than
    `length`, are no members.  A run repeated inside one text is no case by itself.  Ties and
    repeated rows change nothing; other columns are not read; an empty table gives empty tables.

    With `pairs` = False only the shared places of each text are sought: what stands in more than
    `group` texts is then told by the owners of its windows, and no pair of such texts is formed.
    """
    spark = df.sparkSession
    texts = _text_print(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("id").isNotNull() & (F.length("text") >= length)))
    size = input_bytes(texts)
    texts = _told_apart(texts)
    members = written(texts.select("id", "print", F.length("text").alias("n_chars")), "members")
    anchors = spread(texts.select("print", "text")).mapInArrow(partial(_anchor_rows, length=length), "digest long, print long, place long")
    found = written(gathered(anchors, "digest", size=size).sortWithinPartitions("digest").mapInArrow(partial(_groups, limit=group), "kind int, a long, b long"), "anchors")
    release(spark)
    linked = found.filter("kind = 1").select("a", "b").distinct()
    hot, common = found.filter("kind = 2"), None
    if not hot.isEmpty():
        places = hot.groupBy(F.col("a").alias("print")).agg(F.collect_set("b").alias("places"))
        windows = _text_of(texts, members, places).select("print", "text", "places").mapInArrow(partial(_around, length=length), "digest long, print long, place long")
        if pairs:
            linked = linked.union(window_pairs(windows)).distinct()
        else:
            common = window_spans(written(windows, "windows"), length)
    linked = written(linked, "pairs")
    named = _text_of(texts, members, linked.select(F.col("a").alias("print")).union(linked.select("b")).distinct())
    wanted = (
        linked.join(named.select(F.col("print").alias("a"), F.col("text").alias("text_a")), "a")
        .join(named.select(F.col("print").alias("b"), F.col("text").alias("text_b")), "b")
        .select("a", "b", "text_a", "text_b")
    )
    spans = wanted.mapInArrow(partial(_checked, length=length), "print long, other long, start long, stop long")
    spans = written(spans.unionByName(common) if common is not None else spans, "spans")
    discard(found, linked)
    release(spark)
    return Shared(members, spans)


def window_spans(windows: DataFrame, length: int) -> DataFrame:
    """Places of windows that stand in two or more classes.  A window's owners are only compared as
    least and greatest, so one that stands everywhere costs one row per owner."""
    shared = windows.groupBy("digest").agg(F.min("print").alias("low"), F.max("print").alias("high")).filter("low <> high").select("digest")
    hit = windows.join(shared, "digest", "left_semi")
    return hit.select("print", F.lit(None).cast("long").alias("other"), F.col("place").alias("start"), (F.col("place") + length).alias("stop"))


def window_pairs(windows: DataFrame) -> DataFrame:
    """Pairs of classes with an equal window: each is a true pair, so the join is bounded by the result."""
    own = windows.select("digest", "print").distinct()
    left = own.select("digest", F.col("print").alias("a"))
    right = own.select("digest", F.col("print").alias("b"))
    return left.join(right, "digest").filter("a < b").select("a", "b").distinct()


def sharing_pairs(shared: Shared) -> DataFrame:
    """Every pair of different ids that share a run: id_a < id_b."""
    members = shared.members.select("id", "print").distinct()
    many = members.groupBy("print").agg(F.count("*").alias("n")).filter("n > 1")
    same = many.select(F.col("print").alias("a"), F.col("print").alias("b"))
    links = shared.spans.filter("print < other").select(F.col("print").alias("a"), F.col("other").alias("b")).distinct()
    left = members.select(F.col("print").alias("a"), F.col("id").alias("x"))
    right = members.select(F.col("print").alias("b"), F.col("id").alias("y"))
    within = same.join(left, "a").join(right, "b").filter("x < y")
    across = links.join(left, "a").join(right, "b").filter("x <> y")
    return within.union(across).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def shared_shares(shared: Shared) -> DataFrame:
    """One row per member: characters that also stand in another text, and their share."""
    from pyspark.sql import Window

    by_start = Window.partitionBy("print").orderBy("start", "stop")
    before = F.max("stop").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    own = (
        shared.spans.groupBy("print", "start").agg(F.max("stop").alias("stop"))
        .withColumn("from", F.greatest("start", F.coalesce(before, F.lit(0))))
        .groupBy("print").agg(F.sum(F.greatest(F.col("stop") - F.col("from"), F.lit(0))).alias("covered"))
    )
    copies = shared.members.groupBy("print").agg(F.countDistinct("id").alias("n_copies"))
    full = copies.join(own, "print", "left")
    covered = F.when(F.col("n_copies") > 1, F.col("n_chars")).otherwise(F.coalesce("covered", F.lit(0)))
    return (
        shared.members.distinct().join(full, "print")
        .select("id", F.col("n_chars").cast("long").alias("n_chars"), covered.cast("long").alias("shared_chars"), "n_copies")
        .withColumn("shared_share", F.col("shared_chars") / F.col("n_chars"))
    )


def all_shares(shared: Shared, df: DataFrame, id_col: str, text_col: str, *, length: int = 200) -> DataFrame:
    """As `shared_shares`, with the texts shorter than `length` too: they share no run, so 0 characters."""
    bare = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("id").isNotNull() & (F.length("text") < length))
    short = bare.distinct().withColumn("print", F.sha2("text", 256))
    copies = short.groupBy("print").agg(F.count("*").alias("n_copies"))
    rows = short.join(copies, "print").select("id", F.length("text").cast("long").alias("n_chars"), F.lit(0).cast("long").alias("shared_chars"), "n_copies", F.lit(0.0).alias("shared_share"))
    return shared_shares(shared).unionByName(rows)


def _lines_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib
    import re

    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        of, line, start, stop, digest = [], [], [], [], []
        for k, text in enumerate(texts):
            for n, m in enumerate(re.finditer(r"[^\r\n]+", text)):
                if unit := " ".join(m.group().lower().split()):
                    of.append(k)
                    line.append(n)
                    start.append(m.start())
                    stop.append(m.end())
                    digest.append(hashlib.blake2b(unit.encode("utf-8", "surrogatepass"), digest_size=16).digest())
        yield pa.RecordBatch.from_arrays(
            [ids.take(pa.array(of, pa.int64())), *(pa.array(x, pa.int64()) for x in (line, start, stop)), pa.array(digest, pa.binary())], ["id", "line", "start", "stop", "digest"]
        )


def repeated_lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Lines that recur, with the decision to keep or remove each: id, line, start, stop, kept.

    A line is normalised (case, outer and repeated blanks) and known by its digest; of all equal
    lines of the collection the earliest by (id, line) is kept, the rest are removed.  Offsets are
    those of the original text.  Blank lines and lines that stand only once give no row; null ids
    or texts give none.
    """
    bare = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id is not null and text is not null")
    units = bare.mapInArrow(_lines_of, f"id {bare.schema['id'].dataType.simpleString()}, line long, start long, stop long, digest binary")
    first = units.groupBy("digest").agg(F.min(F.struct("id", "line")).alias("first"), F.count("*").alias("n_copies")).filter("n_copies > 1")
    kept = (F.col("id") == F.col("first.id")) & (F.col("line") == F.col("first.line"))
    return units.join(first, "digest").select("id", "line", "start", "stop", "n_copies", kept.alias("kept"))
