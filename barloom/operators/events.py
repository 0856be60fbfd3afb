"""News: occurrences, exact and near deduplication, canonical events, summaries."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions import expr as X
from barloom.operators.components import connected_components
from barloom.session import gathered, input_bytes, written

# The news levels, and the pattern of a ticker mentioned in a text.
LEVELS = ("macro", "sector", "related", "target")
MENTION = r"\b[A-Z]{2,5}\b"


def _nfkc(texts):
    import unicodedata

    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(c: Column) -> Column:
    """Unicode compatibility form of each text (no JVM function does it), in Arrow batches."""
    return F.pandas_udf(_nfkc, "string")(c)


def normalised(c: Column | str, compatibility: bool = False) -> Column:
    """Compatibility form (optional), no zero-width marks, single blanks, no outer blanks."""
    return X.blank_normalised(nfkc(X.col(c)) if compatibility else X.col(c))


def mentions(text: Column, universe: list[str], but: Column) -> Column:
    """Sorted tickers of the universe named in a text, without `but`; empty array for null."""
    found = F.array_intersect(F.regexp_extract_all(text, F.lit(MENTION), F.lit(0)), F.array(*map(F.lit, universe)))
    return F.array_sort(F.coalesce(F.array_except(found, F.array(F.coalesce(but, F.lit("")))), F.array().cast("array<string>")))


def occurrences(rows: DataFrame, universe: list[str], *, compatibility: bool = False) -> DataFrame:
    """One row per usable news text of raw rows.

    Columns: occurrence_id, date, news_level, source_ticker, target_ticker, related_tickers,
    available_to_tickers, text, text_hash.  Macro and sector news is available to the universe,
    target news to its ticker, related news to its ticker and those it names.  Rows whose text is
    null or stands for a missing text, or without date, level or ticker, give none.
    """
    ticker = F.upper(F.trim("ticker"))
    text = normalised("text", compatibility)
    out = rows.filter("text is not null and news_level is not null and ticker is not null and feature_date is not null").select(
        "source_row_number", F.col("feature_date").cast("date").alias("date"), F.lower(F.trim("news_level")).alias("news_level"), ticker.alias("source_ticker"), text.alias("text")
    )
    out = out.filter(~X.is_placeholder("text"))
    related = mentions(F.col("text"), universe, F.col("source_ticker"))
    everyone = F.array(*map(F.lit, sorted(universe)))
    level = F.col("news_level")
    available = F.when(level.isin("macro", "sector"), everyone).when(level == "target", F.array("source_ticker")).otherwise(F.array_sort(F.array_distinct(F.concat(F.array("source_ticker"), "related"))))
    out = out.withColumn("related", related)
    return out.select(
        F.substring(F.sha2(F.concat_ws("|", F.col("source_row_number").cast("string"), "news_level", "text"), 256), 1, 24).alias("occurrence_id"),
        "date", "news_level", "source_ticker", F.when(level == "target", F.col("source_ticker")).alias("target_ticker"), F.col("related").alias("related_tickers"), available.alias("available_to_tickers"), "text", F.sha2("text", 256).alias("text_hash"),
    )


def canonical_events(occ: DataFrame) -> DataFrame:
    """Exact deduplication by date, level, text hash and target scope.

    Target news never merges across tickers; other levels do.  List columns are sorted unions, the
    representative text is that of the least occurrence id.  The event id is a hash of date, level,
    scope and text hash, so equal input gives equal ids.
    """
    scope = F.when(F.col("news_level") == "target", F.coalesce("target_ticker", F.lit(""))).otherwise(F.lit("__shared__"))
    merged = occ.groupBy("date", "news_level", "text_hash", scope.alias("scope")).agg(
        F.min_by("text", "occurrence_id").alias("text"), F.array_sort(F.collect_set("source_ticker")).alias("source_tickers"), X.sorted_union(F.col("related_tickers")).alias("related_tickers"), X.sorted_union(F.col("available_to_tickers")).alias("available_to_tickers"),
        F.array_sort(F.collect_set("target_ticker")).alias("target_tickers"), F.count("*").alias("source_occurrence_count"),
    )
    level = F.col("news_level")
    target = F.when(level == "target", F.col("scope")).when((level == "related") & (F.size("target_tickers") == 1), F.col("target_tickers")[0])
    reach = F.when(level == "target", F.col("scope")).otherwise(F.concat_ws(",", "available_to_tickers"))
    event_id = F.substring(F.sha2(F.concat_ws("|", F.col("date").cast("string"), level, reach, "text_hash"), 256), 1, 24)
    return merged.withColumn("target_ticker", target).withColumn("event_id", event_id).drop("scope", "target_tickers")


def news_summary(occ: DataFrame) -> DataFrame:
    """Per level and for all: occurrences, texts, days, tickers."""
    return occ.groupingSets([["news_level"], []], "news_level").agg(
        F.grouping("news_level").alias("g"), F.count("*").alias("n_occurrences"), F.countDistinct("text_hash").alias("n_texts"), F.countDistinct("date").alias("n_days"), F.countDistinct("source_ticker").alias("n_tickers")
    ).select(F.when(F.col("g") == 1, "all").otherwise(F.col("news_level")).alias("news_level"), "n_occurrences", "n_texts", "n_days", "n_tickers")


def duplicate_metrics(occ: DataFrame) -> DataFrame:
    """Per level and for all: repeated cells, repeated texts, same-day groups, cross-ticker groups."""
    days = occ.groupBy("news_level", "date", "text_hash").agg(F.count("*").alias("n"), F.countDistinct("source_ticker").alias("t"))
    texts = occ.groupBy("news_level", "text_hash").agg(F.count("*").alias("n"))

    def per(df: DataFrame, *aggregates: Column) -> DataFrame:
        named = df.groupingSets([["news_level"], []], "news_level").agg(F.grouping("news_level").alias("g"), *aggregates)
        return named.withColumn("news_level", F.when(F.col("g") == 1, "all").otherwise(F.col("news_level"))).drop("g")

    by_text = per(texts, F.sum(F.col("n") - 1).alias("n_repeated_cells"), F.count_if(F.col("n") > 1).alias("n_repeated_texts"))
    by_day = per(days, F.count_if(F.col("n") > 1).alias("n_same_day_groups"), F.count_if(F.col("t") > 1).alias("n_cross_ticker_groups"))
    return by_text.join(by_day, "news_level")


def dedup_summary(occ: DataFrame, events: DataFrame) -> DataFrame:
    """Per level and for all: occurrences, events and what deduplication removed."""

    def per(df: DataFrame, *aggregates: Column) -> DataFrame:
        return df.groupingSets([["news_level"], []], "news_level").agg(F.grouping("news_level").alias("g"), *aggregates).withColumn("news_level", F.when(F.col("g") == 1, "all").otherwise(F.col("news_level"))).drop("g")

    left = per(occ, F.count("*").alias("source_occurrences"), F.countDistinct("date", "text_hash").alias("unique_date_text"))
    right = per(events, F.count("*").alias("events"))
    return left.join(right, "news_level").withColumn("exact_duplicates_removed", F.col("source_occurrences") - F.col("events"))


# -- near deduplication inside blocks ------------------------------------------------------------


_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def gram_vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grams of 3 to 5 characters inside blank-padded words, as L2-normalised sparse vectors.

    Returns (gram hashes sorted per text, weights, offsets of the texts).  A padded word no longer than
    n is one gram and is not cut further.  All texts of a batch are cut at once.
    """
    words = [t.lower().split() for t in texts]
    flat = [f" {w} " for ws in words for w in ws]
    of_word = np.repeat(np.arange(len(texts)), [len(ws) for ws in words])
    codes = np.frombuffer("".join(flat).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, flat), np.int64, len(flat))
    start = np.cumsum(size) - size
    place = np.arange(len(codes)) - np.repeat(start, size)
    left = np.repeat(size, size) - place  # characters from here to the end of the padded word
    owner = np.repeat(of_word, size)
    value, text = [], []
    for n in (3, 4, 5):
        at = np.flatnonzero((left >= n) & (np.repeat(size, size) > n) | (place == 0) & (np.repeat(size, size) == n))
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h = _mixed(h + codes[at + k])
        value.append(h)
        text.append(owner[at])
    # one plain sort of (text number, hash) packed into a word; hashes keep 44 bits
    packed = np.sort((np.concatenate(text).astype(np.uint64) << np.uint64(44)) | (np.concatenate(value) >> np.uint64(20)))
    first = np.flatnonzero(np.concatenate([[True], packed[1:] != packed[:-1]])) if len(packed) else np.empty(0, np.int64)
    count = np.diff(np.append(first, len(packed))).astype(float)
    gram, of = (packed[first] & np.uint64((1 << 44) - 1)).astype(np.int64), (packed[first] >> np.uint64(44)).astype(np.int64)
    norm = np.sqrt(np.bincount(of, count**2, minlength=len(texts)))
    return gram, count / np.maximum(norm[of], 1e-12), np.searchsorted(of, np.arange(len(texts) + 1))


def _parts(sizes: list[int], limit: int = 400_000) -> Iterator[slice]:
    begin = held = 0
    for k, n in enumerate(sizes):
        if held and held + n > limit:
            yield slice(begin, k)
            begin, held = k, 0
        held += n + 1
    if begin < len(sizes):
        yield slice(begin, len(sizes))


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`gram_vectors` of any number of texts, cut in parts of bounded size."""
    vectors = [gram_vectors(texts[part]) for part in _parts([len(t) for t in texts])]
    sizes = np.concatenate([np.diff(bounds) for _, _, bounds in vectors])
    return np.concatenate([v[0] for v in vectors]), np.concatenate([v[1] for v in vectors]), np.concatenate([[0], np.cumsum(sizes)])


def _folded(texts: list[str], width: int) -> np.ndarray:
    """Per text the lengths of its vector within `width` classes of grams.  The product of two such rows is
    at least the cosine of the texts (Cauchy and Schwarz in each class)."""
    out = np.zeros((len(texts), width), "f4")
    for part in _parts([max(len(t), 400) for t in texts]):
        gram, weight, bounds = gram_vectors(texts[part])
        of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        out[part] = np.sqrt(np.bincount(of * width + (gram & (width - 1)), weight**2, (len(bounds) - 1) * width)).reshape(-1, width)
    return out


def _candidates(left: np.ndarray, right: np.ndarray, same: bool, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of `left` and `right` whose product reaches `least`; within one table, each pair once."""
    found = []
    for i in range(0, len(left), 512):
        x, y = np.nonzero(left[i : i + 512] @ right[i if same else 0 :].T >= least)
        x, y = x + i, y + (i if same else 0)
        found.append(np.stack([x, y])[:, x < y] if same else np.stack([x, y]))
    return tuple(np.concatenate(found, axis=1))


def _exact(texts: list[str], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of pairs of texts, given by position and ordered by `a`; each text is cut once."""
    used, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    gram, weight, bounds = _joined([texts[k] for k in used])
    known, gram = np.unique(gram, return_inverse=True)
    a, b, size = at[: len(a)], at[len(a) :], np.diff(bounds)
    row, out = np.zeros(len(known)), np.zeros(len(a))
    starts = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
    for begin, end in zip(starts, np.append(starts[1:], len(a))):
        own = slice(bounds[a[begin]], bounds[a[begin] + 1])
        row[gram[own]] = weight[own]
        for part in _parts(size[b[begin:end]].tolist(), 1_000_000):
            other = b[begin:end][part]
            n = size[other]
            entry = np.arange(n.sum()) + np.repeat(bounds[other] - (np.cumsum(n) - n), n)
            out[begin:end][part] = np.bincount(np.repeat(np.arange(len(other)), n), row[gram[entry]] * weight[entry], len(other))
        row[gram[own]] = 0
    return out


def _close_pairs(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Pairs of rows (block, i, j, tile, first, text) of one (block, i, j) that reach the threshold: tile i
    with tile j, or all pairs of a tile where i = j.  Rows come in the order of (block, i, j)."""

    def pairs(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts, first = rows.column(5).to_pylist(), rows.column(4)
        i, j, tile = (rows.column(k).to_numpy() for k in (1, 2, 3))
        edges = np.append(_starts(rows), len(texts))
        size = np.fromiter((max(len(t), 400) for t in texts), np.int64, len(texts))
        for part in _parts(np.add.reduceat(size, edges[:-1]).tolist()):  # small groups share the cutting of their texts
            begin, end = edges[part.start], edges[part.stop]
            own = texts[begin:end]
            width = 1 << int(np.ceil(np.log2(min(max(2 * sum(map(len, own)) / len(own), 256), 1 << 16))))
            folded = _folded(own, width)
            found = []
            for k in range(part.start, part.stop):
                rest = np.arange(edges[k], edges[k + 1]) - begin
                if i[edges[k]] == j[edges[k]]:
                    x, y = _candidates(folded[rest[0] : rest[-1] + 1], folded[rest[0] : rest[-1] + 1], True, threshold - 1e-4)
                    found.append(np.stack([rest[x], rest[y]]))
                else:
                    left = tile[edges[k] : edges[k + 1]] == i[edges[k]]
                    x, y = _candidates(folded[rest[left]], folded[rest[~left]], False, threshold - 1e-4)
                    found.append(np.stack([rest[left][x], rest[~left][y]]))
            a, b = np.concatenate(found, axis=1)
            if not len(a):
                continue
            order = np.argsort(a, kind="stable")
            a, b = a[order], b[order]
            close = _exact(own, a, b) >= threshold - 1e-12
            x, y = first.take(pa.array(a[close] + begin)), first.take(pa.array(b[close] + begin))
            up = pc.less(x, y)
            yield pa.RecordBatch.from_arrays([pc.if_else(up, x, y), pc.if_else(up, y, x)], ["a", "b"])

    held = None
    for batch in batches:
        if not len(batch):
            continue
        rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        last = int(_starts(rows)[-1])
        if last:
            yield from pairs(rows.slice(0, last))
        held = rows.slice(last)
    if held is not None:
        yield from pairs(held)


def _starts(rows: pa.RecordBatch) -> np.ndarray:
    """Where a new (block, i, j) begins."""
    new = np.zeros(len(rows), bool)
    new[0] = True
    for k in range(3):
        v = rows.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def near_links(events: DataFrame, block: list[str], *, id_col: str = "event_id", text_col: str = "text", threshold: float = 0.95, tile_rows: int = 2_048, tile_chars: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """(members: id, first; links: a, b): texts of one block whose character-gram cosine reaches the
    threshold; exact.

    Equal texts of a block are one class, named by its least id, and count once from then on; links
    join different classes.  Texts without company in their block are compared with nothing.  A block
    is one tile, or as many as keep a tile at about `tile_rows` texts and `tile_chars` characters; each
    pair of tiles meets in one place, so no task holds a block.  There the texts are cut into grams once,
    an upper bound of every cosine comes from one matrix product, and only pairs that it cannot rule
    out are computed.  Null ids and null or blank texts are left out.
    """
    texts = events.select(F.col(id_col).alias("id"), F.xxhash64(*block).alias("block"), F.col(text_col).alias("text")).filter("id is not null").filter(F.col("text").rlike(r"(?U)\S"))
    keyed = texts.select("id", "block", F.unhex(F.md5("text")).alias("print"), "text")
    classes = written(keyed.groupBy("block", "print").agg(F.min("id").alias("first"), F.max("text").alias("text")), "classes")
    members = keyed.select("id", "block", "print").distinct().join(classes.select("block", "print", "first"), ["block", "print"]).select("id", "first")
    tiles = F.ceil(F.greatest(F.count("*") / F.lit(tile_rows), F.sum(F.length("text")) / F.lit(tile_chars))).cast("int")
    company = classes.groupBy("block").agg(F.count("*").alias("n"), tiles.alias("tiles")).filter("n > 1").select("block", "tiles")
    wanted = classes.join(company, "block").withColumn("tile", F.pmod(F.xxhash64("first", F.lit(3)), F.col("tiles")).cast("int"))
    met = wanted.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select("block", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "first", "text")
    groups = gathered(met, "block", "i", "j", size=input_bytes(classes), share=32 << 20).sortWithinPartitions("block", "i", "j")
    return members, groups.mapInArrow(partial(_close_pairs, threshold=threshold), "a string, b string")


def near_deduplicated(events: DataFrame, block: list[str], *, threshold: float = 0.95) -> DataFrame:
    """event_id, canonical_id (least event id of its near-duplicate group), group_size.  An event without
    text stands alone."""
    members, links = near_links(events, block, threshold=threshold)
    labels = connected_components(written(links, "near"))
    placed = members.join(labels, F.col("first") == F.col("node"), "left").select(F.col("id").alias("event_id"), F.coalesce("component", "first").alias("canonical_id"))
    out = events.select("event_id").filter("event_id is not null").join(placed, "event_id", "left").select("event_id", F.coalesce("canonical_id", "event_id").alias("canonical_id"))
    sizes = out.groupBy("canonical_id").agg(F.count("*").alias("group_size"))
    return out.join(sizes, "canonical_id").select("event_id", "canonical_id", "group_size")
