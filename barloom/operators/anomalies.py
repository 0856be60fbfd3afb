"""Implausible bars, judged against what is normal for their own series.

Two views: `bad_bars` finds impossible, frozen and spiking prices of dated series exactly;
`sketch_fences` is the mergeable one, with quantile sketches per source and hour of arrival and
expanded interquartile fences.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.prefilter import maybe_in
from barloom.session import release, written

FIELDS = ("open", "high", "low", "close")
FROZEN, SPIKE, IMPOSSIBLE = 1, 2, 4


def clean_series(bars: DataFrame, id_col: str) -> DataFrame:
    """id, source, ticker (trimmed, upper case), feature_date and the four prices without NaN."""
    prices = [F.when(~F.isnan(F.col(f)), F.col(f).cast("double") + 0.0).alias(f) for f in FIELDS]
    return bars.select(F.col(id_col).alias("id"), F.upper(F.trim("source")).alias("source"), F.upper(F.trim("ticker")).alias("ticker"), F.col("feature_date").cast("date").alias("feature_date"), *prices)


def impossible(bars: DataFrame) -> DataFrame:
    """Rows with a price of zero or less, or with high or low on the wrong side of another price."""
    high = [F.col("high") < F.col(f) for f in ("open", "low", "close")]
    low = [F.col("low") > F.col(f) for f in ("open", "high", "close")]
    case = F.lit(False)
    for c in [*(F.col(f) <= 0 for f in FIELDS), *high, *low]:
        case = case | F.coalesce(c, F.lit(False))
    return bars.filter(case)


def frozen_rows(day: np.ndarray, value: np.ndarray, run: int) -> np.ndarray:
    """Rows whose value stands on at least `run` successive days of the days that have a value."""
    out = np.zeros(len(day), bool)
    at = np.flatnonzero(np.isfinite(value))
    if len(at) < run:
        return out
    _, rank = np.unique(day[at], return_inverse=True)
    order = np.lexsort((rank, value[at]))
    r, v = rank[order], value[at][order]
    fresh = np.ones(len(r), bool)
    fresh[1:] = (v[1:] != v[:-1]) | (r[1:] > r[:-1] + 1)
    group = np.cumsum(fresh) - 1
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(r)) - 1
    out[at[order]] = (r[last] - r[first] + 1 >= run)[group]
    return out


def ordinary_closes(level: np.ndarray, reach: float, longest: int = 3) -> np.ndarray:
    """Which log closes of a series are no part of an excursion of at most `longest` dates.

    The walk keeps the last ordinary level.  A far level is an excursion if the series comes back
    within `longest` dates, or settles elsewhere with every date of the excursion far from there too;
    otherwise it is a lasting change and becomes the ordinary level.  First and last are ordinary.
    """
    n = len(level)
    ok = np.ones(n, bool)
    if n < 3 or not (np.abs(np.diff(level)) > reach).any():
        return ok
    x = level.tolist()
    base, i = x[0], 1
    while i < n - 1:
        if abs(x[i] - base) <= reach:
            base, i = x[i], i + 1
            continue
        ends = [j for j in range(i + 1, min(i + longest, n - 1) + 1)]
        back = next((j for j in ends if abs(x[j] - base) <= reach), None)
        if back is None:
            back = next((j for j in ends if (j == n - 1 or abs(x[j + 1] - x[j]) <= reach) and all(abs(x[q] - x[j]) > reach for q in range(i, j))), None)
        if back is None:
            base, i = x[i], i + 1
            continue
        for q in range(i, back):
            ok[q] = abs(x[q] - base) <= reach or abs(x[q] - x[back]) <= reach
        base, i = x[back], back + 1
    return ok


def judge_series(day: np.ndarray, prices: np.ndarray, run: int, times: float) -> np.ndarray:
    """Bit flags of the rows (sorted by day, then arrival) of one series; prices is rows x 4."""
    flags = np.zeros(len(day), np.int32)
    for k in range(prices.shape[1]):
        flags[frozen_rows(day, prices[:, k], run)] |= FROZEN
    close = prices[:, 3]
    usable = np.flatnonzero(np.isfinite(close) & (close > 0))
    days, first = np.unique(day[usable], return_index=True)
    if len(days) < 3:
        return flags
    level = np.log(close[usable[first]])
    reach = times * float(np.median(np.abs(np.diff(level))))
    ok = ordinary_closes(level, reach)
    days, level = days[ok], level[ok]
    before = np.searchsorted(days, day, side="left") - 1
    after = np.searchsorted(days, day, side="right")
    inner = np.flatnonzero((before >= 0) & (after < len(days)) & (day > day.min()) & (day < day.max()))
    with np.errstate(divide="ignore", invalid="ignore"):
        logs = np.where(prices[inner] > 0, np.log(prices[inner]), np.nan)
    far = (np.abs(logs - level[before[inner]][:, None]) > reach) & (np.abs(logs - level[after[inner]][:, None]) > reach)
    flags[inner[far.any(axis=1)]] |= SPIKE
    return flags


def _judged(batches: Iterator[pa.RecordBatch], run: int, times: float) -> Iterator[pa.RecordBatch]:
    """Flagged rows, from rows sorted by source, ticker, date and arrival."""
    held: list[pa.RecordBatch] = []
    now = None

    def done():
        rows = pa.Table.from_batches(held).combine_chunks()
        day = rows.column(2).cast(pa.int32()).to_numpy()
        prices = np.column_stack([rows.column(3 + k).to_numpy() for k in range(4)]).astype(float)
        flags = judge_series(day, prices, run, times)
        keep = pa.array(flags > 0)
        return pa.Table.from_arrays([*(rows.column(k).filter(keep) for k in range(7)), pa.chunked_array([pa.array(flags).filter(keep)])], ["source", "ticker", "feature_date", *FIELDS, "flags"]).to_batches()

    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        cuts = [0, *(k for k in range(1, len(a)) if a[k] != a[k - 1] or b[k] != b[k - 1]), len(a)]
        for s, e in zip(cuts, cuts[1:]):
            if held and (a[s], b[s]) != now:
                yield from done()
                held = []
            now = (a[s], b[s])
            held.append(batch.slice(s, e - s))
    if held:
        yield from done()


def suspects(known: DataFrame, *, run: int, times: float, accuracy: int = 400) -> DataFrame:
    """source, ticker of series that can hold a frozen or spiking price; no series with a case is missed.

    Rows are reduced to one per date.  A quantile sketch of each series' daily changes, merged across
    partitions, gives its usual movement; a series is suspect when some price moves away from the last
    close by more than `times` a lower bound of the median (its 45 % quantile), or when a field shows
    no variance: the value ranges of `run` successive dates each touch the one before.
    """
    positive = [F.when(F.col(f) > 0, F.col(f)) for f in FIELDS]
    close = F.when(F.col("close") > 0, F.col("close"))
    daily = known.groupBy("source", "ticker", "feature_date").agg(
        F.min_by(close, F.when(close.isNotNull(), F.col("id"))).alias("c"), F.min(F.least(*positive)).alias("low_price"), F.max(F.greatest(*positive)).alias("high_price"),
        *(f(x).alias(f"{name}_{x}") for x in FIELDS for name, f in (("from", F.min), ("to", F.max))),
    )
    w = Window.partitionBy("source", "ticker").orderBy("feature_date")
    past = w.rowsBetween(Window.unboundedPreceding, -1)

    def before(c: str):
        return F.last(c, ignorenulls=True).over(past)

    def touches(x: str):
        meets = F.greatest(f"from_{x}", before(f"from_{x}")) <= F.least(f"to_{x}", before(f"to_{x}"))
        return F.when(F.col(f"from_{x}").isNull(), 1).otherwise(F.coalesce((meets & before(f"from_{x}").isNotNull()).cast("int"), F.lit(0)))

    def away(c: str):
        return F.abs(F.ln(F.col(c)) - F.ln(before("c")))

    moved = daily.select("source", "ticker", "feature_date", away("c").alias("change"), F.greatest(away("low_price"), away("high_price")).alias("rate"), *(touches(x).alias(f"t_{x}") for x in FIELDS))
    still = F.lit(False)
    for x in FIELDS:
        still = still | (F.sum(f"t_{x}").over(w.rowsBetween(-(run - 2), 0)) >= run - 1)
    series = moved.withColumn("still", still).groupBy("source", "ticker").agg(
        F.expr(f"kll_sketch_agg_double(change, {accuracy}) FILTER (WHERE change IS NOT NULL)").alias("sketch"), F.count("change").alias("n"), F.max("rate").alias("rate"), F.max("still").alias("still")
    )
    usual = F.expr("CASE WHEN n > 0 THEN kll_sketch_get_quantile_double(sketch, 0.45D) END")
    return series.filter(F.col("still") | F.coalesce(F.col("rate") > F.lit(times) * usual, F.lit(False))).select("source", "ticker")


def bad_bars(bars: DataFrame, id_col: str, *, run: int = 6, times: float = 15.0) -> DataFrame:
    """Rows with at least one bad price: id, flags (1 frozen, 2 spike, 4 impossible).

    A series is one (source, ticker), blanks and case apart.  Impossible prices are judged row by
    row.  Frozen: one field keeps its value on `run` or more successive dates.  Spike: a positive
    price more than `times` the median absolute change of ln(close) away from the ordinary closes
    before and after it.  Repeated deliveries count, null and NaN prices do not; rows with a null
    source, ticker or date are judged for impossible prices only.  An empty table gives an empty
    result; other columns are not read.

    Quantile sketches screen the series (`suspects`); only suspect ones are then checked exactly, each
    sorted once.  Equal deliveries are merged before that shuffle, so what one task holds of a series
    is bounded by its calendar, not by its rows.
    """
    rows = clean_series(bars, id_col)
    tuple_ = ["source", "ticker", "feature_date", *FIELDS]
    known = rows.filter("source is not null and ticker is not null and feature_date is not null")
    chosen = written(suspects(known, run=run, times=times), "suspects")
    release(rows.sparkSession)
    merged = known.groupBy(*tuple_).agg(F.min("id").alias("first")).join(chosen, ["source", "ticker"], "left_semi")
    flagged = (
        merged.repartition("source", "ticker").sortWithinPartitions("source", "ticker", "feature_date", "first").select(*tuple_)
        .mapInArrow(partial(_judged, run=run, times=times), "source string, ticker string, feature_date date, open double, high double, low double, close double, flags int")
    )

    def print_(prefix: str = ""):
        return F.xxhash64(*(f"{prefix}{c}" for c in tuple_[:3]), *(F.coalesce(F.col(f"{prefix}{f}"), F.lit(-1e308)) for f in FIELDS))

    marked = written(flagged.select(*(F.col(c).alias(f"m_{c}") for c in tuple_), "flags"), "flagged").withColumn("m_print", print_("m_"))
    likely = maybe_in(known.withColumn("print", print_()), "print", marked, "m_print")
    same = F.col("print") == F.col("m_print")
    for c in tuple_:
        same = same & F.col(c).eqNullSafe(F.col(f"m_{c}"))
    by_series = likely.join(marked, same).select("id", "flags")
    by_row = impossible(rows).select("id", F.lit(IMPOSSIBLE).alias("flags"))
    return by_series.union(by_row).groupBy("id").agg(F.bit_or("flags").alias("flags"))


def sketch_fences(rows: DataFrame, group: list[str], value: str, *, width: float = 3.0, accuracy: int = 400, salts: int = 16) -> DataFrame:
    """Interquartile fences per group from quantile sketches: the group, n, q1, median, q3, low, high.

    Sketches are built per group and salt, so a hot group is summarised in many tasks, and then
    merged.  Null and NaN values do not count; a group without values gives no row; a group whose
    values are all equal gets fences at that value.
    """
    usable = rows.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*group, F.col(value).cast("double").alias("__v"))
    part = usable.groupBy(*group, F.pmod(F.xxhash64("__v"), F.lit(salts)).alias("__salt")).agg(F.expr(f"kll_sketch_agg_double(__v, {accuracy})").alias("__s"), F.count("*").alias("__n"))
    whole = part.groupBy(*group).agg(F.expr(f"kll_merge_agg_double(__s, {accuracy})").alias("__s"), F.sum("__n").alias("n"))
    q = whole.select(*group, "n", F.expr("kll_sketch_get_quantile_double(__s, array(0.25D, 0.5D, 0.75D))").alias("__q"))
    q1, q3 = F.col("__q")[0], F.col("__q")[2]
    return q.select(*group, "n", q1.alias("q1"), F.col("__q")[1].alias("median"), q3.alias("q3"), (q1 - width * (q3 - q1)).alias("low"), (q3 + width * (q3 - q1)).alias("high"))


def fenced_bars(bars: DataFrame, id_col: str, *, width: float = 6.0) -> DataFrame:
    """Rows outside the fences of their source and hour of arrival: id, source, hour, and three marks.

    `outside`: the bar's log range; `jump`: its log close over log open; `still`: high equals low
    although its source is never still in three quarters of its bars.  Positive, consistent prices
    only; a null hour is a group of its own.
    """
    ranged = bars.filter("open > 0 and high > 0 and low > 0 and close > 0").select(
        F.col(id_col).alias("id"), F.upper(F.trim("source")).alias("source"), F.hour("ingested_at").alias("hour"), F.log(F.col("high") / F.col("low")).alias("spread"), F.log(F.col("close") / F.col("open")).alias("move")
    )
    spread = sketch_fences(ranged, ["source", "hour"], "spread", width=width).select("source", "hour", F.col("q1").alias("s1"), F.col("high").alias("s_high"))
    move = sketch_fences(ranged, ["source", "hour"], "move", width=width).select("source", "hour", F.col("low").alias("m_low"), F.col("high").alias("m_high"))
    left, right = ranged.alias("r"), spread.join(move, (spread["source"].eqNullSafe(move["source"])) & (spread["hour"].eqNullSafe(move["hour"]))).select(spread["source"], spread["hour"], "s1", "s_high", "m_low", "m_high").alias("f")
    both = left.join(right, F.expr("r.source <=> f.source and r.hour <=> f.hour"))
    marks = both.select("id", F.col("r.source").alias("source"), F.col("r.hour").alias("hour"), (F.col("spread") > F.col("s_high")).alias("outside"), ((F.col("move") < F.col("m_low")) | (F.col("move") > F.col("m_high"))).alias("jump"), ((F.col("spread") == 0) & (F.col("s1") > 0)).alias("still"))
    return marks.filter("outside or jump or still")


def flags_by_series(bars: DataFrame, id_col: str) -> DataFrame:
    """Per series: rows, and rows frozen, spiking, impossible."""
    rows = clean_series(bars, id_col).select("id", "source", "ticker")
    found = bad_bars(bars, id_col)

    def has(bit: int):
        return F.count_if(F.col("flags").bitwiseAND(F.lit(bit)) > 0)

    return rows.join(found, "id", "left").groupBy("source", "ticker").agg(F.count("*").alias("n_rows"), has(FROZEN).alias("n_frozen"), has(SPIKE).alias("n_spikes"), has(IMPOSSIBLE).alias("n_impossible"))


