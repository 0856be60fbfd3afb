"""Splits, targets and labels on ragged panels, held against plain Python over the same rows."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import labels as L
from barloom.operators import splits as S

NAMES = ["ash", "birch", "cedar", "elm", "fir"]


def sessions(seed, n):
    """n dates with gaps of one to six days."""
    rng, day, out = random.Random(seed), dt.date(2031, 3, 5), []
    for _ in range(n):
        out.append(day)
        day += dt.timedelta(rng.randint(1, 6))
    return out


def ragged(seed, n=40):
    """(entity, date, value): every entity has its own subset of the dates, one joins late, one is short."""
    rng, days = random.Random(seed), sessions(seed, n)
    rows = []
    for k, name in enumerate(NAMES):
        own = days[n // 3 :] if k == 1 else days[: n // 4] if k == 4 else days
        rows += [(name, d, rng.gauss(k, 1 + k)) for d in own if rng.random() < (0.97, 0.9, 1.0, 0.85, 1.0)[k]]
    return rows


def windows(rows, horizon=5):
    """entity, date -> mean of the next `horizon` dates of the common calendar, where all are there."""
    value = {(e, d): v for e, d, v in rows}
    days = sorted({d for _, d, _ in rows})
    out = {}
    for name in NAMES:
        for i, d in enumerate(days):
            ahead = days[i + 1 : i + 1 + horizon]
            if len(ahead) == horizon and all((name, x) in value for x in ahead):
                out[name, d] = (sum(value[name, x] for x in ahead) / horizon, ahead[0], ahead[-1], value.get((name, d)))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "entity string, date date, log_variance double").withColumn("position", F.lit(-1)).withColumn("base", F.lit("x"))


@pytest.mark.parametrize("seed", [3, 8])
def test_forward_windows_and_peers(spark, seed):
    rows = ragged(seed)
    want = windows(rows)
    targets = L.forward_windows(frame(spark, rows).select("entity", "date", "log_variance"))
    got = {(r.entity, r.date): r for r in targets.collect()}
    assert set(got) == set(want) and want
    for key, (mean, start, end, base) in want.items():
        r = got[key]
        assert abs(r.forward_mean - mean) < 1e-12 and (r.outcome_start_date, r.outcome_end_date) == (start, end)
        assert r.base == base
    peers = {(r.entity, r.date): r for r in L.peer_relative(targets).collect()}
    for (name, d), r in peers.items():
        others = [v[0] for (e, x), v in want.items() if x == d and e != name]
        assert len(others) >= 2 and abs(r.peer_mean - np.mean(others)) < 1e-12 and abs(r.relative_target - (want[name, d][0] - np.mean(others))) < 1e-12
    assert set(peers) == {k for k in want if sum(d == k[1] for _, d in want) >= 3}


def test_audit_sees_every_kind_of_damage(spark):
    rows = ragged(5)
    panel = frame(spark, rows).select("entity", "date", "log_variance")
    good = L.peer_relative(L.forward_windows(panel))

    def failed(targets):
        return {r["check"] for r in L.audit_target(targets, panel).collect() if not r.passed}

    assert failed(good) == set()
    first = F.col("entity") == "ash"
    assert "forward_mean_recomputed" in failed(good.withColumn("forward_mean", F.when(first, F.col("forward_mean") + 1).otherwise(F.col("forward_mean"))))
    assert failed(good.withColumn("peer_mean", F.when(first, F.lit(float("nan"))).otherwise(F.col("peer_mean")))) >= {"finite_target"}
    assert "dates_strictly_ahead" in failed(good.withColumn("outcome_start_date", F.when(first, F.col("date")).otherwise(F.col("outcome_start_date"))))
    assert "unique_entity_date" in failed(good.union(good.filter(first).limit(1)))
    assert "leave_one_out_algebra" in failed(good.withColumn("demeaned_target", F.col("demeaned_target") * 2))
    assert "cross_section" in failed(good.withColumn("n_valid", F.lit(2)))


def test_order_of_rows(spark):
    days = sessions(1, 6)
    rows = [(d, e) for d in days for e in sorted(NAMES)]
    for parts in (1, 4):
        df = spark.createDataFrame(spark.sparkContext.parallelize(rows, parts), "date date, entity string")
        assert L.unsorted_rows(df).first()[0] == 0
        swapped = rows[:7] + [rows[8], rows[7]] + rows[9:]
        assert L.unsorted_rows(spark.createDataFrame(spark.sparkContext.parallelize(swapped, parts), "date date, entity string")).first()[0] > 0
    assert L.unsorted_rows(df.limit(0)).first()[0] == 0


def split_rows(seed, n=45):
    """Rows whose outcomes reach one to seven dates ahead, with splits of uneven length."""
    rng, days = random.Random(seed), sessions(seed, n)
    cuts = sorted(rng.sample(range(n // 4, n - 10), 2))
    rows = []
    for i, d in enumerate(days[:-8]):
        split = "train" if i < cuts[0] else "validation" if i < cuts[1] else "test"
        for name in NAMES[: rng.randint(1, 5)]:
            k = rng.randint(1, 7)
            rows.append((name, d, split, days[i + 1], days[i + k]))
    return rows


COLUMNS = "entity string, date date, split string, outcome_start_date date, outcome_end_date date"


@pytest.mark.parametrize("seed", [11, 12, 13])
def test_purge_embargo_and_offsets(spark, seed):
    rows = split_rows(seed)
    df = spark.createDataFrame(rows, COLUMNS)
    first = {s: min(r[1] for r in rows if r[2] == s) for s in ("validation", "test")}
    kept = {r[:3] for r in rows if r[2] == "test" or r[4] < first["validation" if r[2] == "train" else "test"]}
    purged = S.purge(df)
    assert {(r.entity, r.date, r.split) for r in purged.collect()} == kept
    assert S.purge(purged).count() == len(kept)
    of = {s: sorted({d for _, d, x in kept if x == s}) for s in ("train", "validation", "test")}
    late = {(e, d, s) for e, d, s in kept if s == "train" or d in of[s][3:]}
    assert {(r.entity, r.date, r.split) for r in S.embargo(purged, 3).collect()} == late
    for r in S.offsets(purged, 4).collect():
        assert r.offset == (-1 if r.split == "train" else of[r.split].index(r.date) % 4)
    near = {(s, d) for s, v in of.items() for d in (v[-6:] if s == "train" else v[:6])}
    assert {(r.split, r.date) for r in S.trim_dates(purged, 6).select("split", "date").distinct().collect()} == near


def test_shared_outcomes_are_those_of_two_splits(spark):
    rows = split_rows(21)
    days = {s: {d for r in rows if r[2] == s for d in r[3:]} for s in ("train", "validation", "test")}
    want = {(a, b, d) for a in days for b in days if a < b for d in days[a] & days[b]}
    got = {(r.split_a, r.split_b, r.date) for r in S.shared_outcomes(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert got == want and want


def blocks_of(df):
    return sorted(df.collect(), key=lambda r: r.block)


@pytest.mark.parametrize("n", [30, 97])
def test_out_of_fold_blocks(spark, n):
    days = sessions(n, n)
    df = spark.createDataFrame([(d,) for d in days for _ in range(3)] + [(None,)], "target_date date")
    for made, start in ((S.expanding_blocks(df, 4, 0.3), int(n * 0.3)), (S.split_blocks(df, 4, 12, 0.3), max(12, -(-n * 3 // 10))), (S.stepped_blocks(df, 7, 12, 0.3), max(12, -(-n * 3 // 10)))):
        out = blocks_of(made)
        held = [d for r in out for d in days if r.predict_start <= d <= r.predict_end]
        assert held == days[start:] and sum(r.n_dates for r in out) == len(held)
        assert all(r.history_end == days[days.index(r.predict_start) - 1] for r in out)
    sizes = [r.n_dates for r in blocks_of(S.split_blocks(df, 4, 12, 0.3))]
    assert max(sizes) - min(sizes) <= 1 and all(r.n_dates == 7 for r in blocks_of(S.stepped_blocks(df, 7, 12, 0.3))[:-1])
    assert S.stepped_blocks(df, 7, n + 1, 0.3).count() == 0


@pytest.mark.parametrize("n,sizes", [(0, []), (2, []), (3, [1, 1, 1]), (4, [2, 1, 1]), (10, [6, 2, 2]), (23, [13, 5, 5])])
def test_date_blocks(spark, n, sizes):
    days = sessions(2, n)
    out = sorted((r.target_date, r.split) for r in S.date_blocks(spark.createDataFrame([(d,) for d in days] + [(None,)], "target_date date")).collect())
    assert [d for d, _ in out] == (days if sizes else [])
    assert [sum(s == name for _, s in out) for name in S.ORDER] == (sizes or [0, 0, 0])
    assert [s for _, s in out] == [name for name, k in zip(S.ORDER, sizes) for _ in range(k)]


def test_thresholds_do_not_see_later_rows(spark):
    rng = random.Random(4)
    rows = [(e, s, rng.gauss(0, 3)) for e in NAMES[:3] for s in ("train", "validation", "test") for _ in range(9)] + [("elm", "test", 1.0), ("fir", "train", None), ("fir", "train", 2.5)]
    levels = {"q50": 0.5, "q90": 0.9, "q95": 0.95}

    def fitted(rs):
        return {r.entity: (r.q50, r.q90, r.q95, r.center, r.scale, r.n) for r in L.fit_thresholds(spark.createDataFrame(rs, "entity string, split string, v double"), "v", levels).collect()}

    one = fitted(rows)
    assert one == fitted([(e, s, v if s == "train" else 1e6) for e, s, v in rows]) and "elm" not in one
    own = [v for e, s, v in rows if e == "ash" and s == "train"]
    assert np.allclose(one["ash"], [*np.quantile(np.abs(own), [0.5, 0.9, 0.95]), np.mean(own), np.std(own, ddof=1), 9])
    assert one["fir"][3:] == (2.5, 1e-12, 1)
    df = spark.createDataFrame(rows, "entity string, split string, v double")
    assert L.spike_labels(df, "v", L.fit_thresholds(df, "v", levels)).filter("entity = 'elm' and spike_q90 is null and regime is null").count() == 1


def test_fold_labels(spark):
    rng = random.Random(6)
    rows = [(f, side, e, rng.gauss(0, 1 + f)) for f in (1, 2) for side in ("train", "validation") for e in NAMES[:3] for _ in range(12)] + [(1, "validation", "fir", 2.0), (2, "train", "ash", None)]
    out = L.fold_labels(spark.createDataFrame(rows, "fold int, fold_split string, entity string, v double"), "v").collect()
    assert len(out) == len(rows)
    for fold in (1, 2):
        own = {e: np.array([v for f, s, x, v in rows if f == fold and s == "train" and x == e and v is not None]) for e in NAMES[:3]}
        z = np.concatenate([np.abs((v - v.mean()) / v.std(ddof=1)) for v in own.values()])
        pooled = np.quantile(z, [0.5, 0.9, 0.95])
        for r in out:
            if r.fold != fold:
                continue
            if r.entity == "fir" or r.v is None:
                assert r.spike_q90 is None and r.regime is None and r.regime_pooled is None
                continue
            v = own[r.entity]
            low, high, top = np.quantile(np.abs(v), [0.5, 0.9, 0.95])
            size, s = abs(r.v), abs((r.v - v.mean()) / v.std(ddof=1))
            assert (r.spike_q90, r.spike_q95, r.regime) == (int(size > high), int(size > top), 0 if size <= low else 1 if size <= high else 2)
            assert (r.spike_q90_pooled, r.regime_pooled) == (int(s > pooled[1] + 1e-12), 0 if s <= pooled[0] + 1e-12 else 1 if s <= pooled[1] + 1e-12 else 2)
