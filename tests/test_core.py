import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.functions import expr as X
from barloom.functions import stats
from barloom.operators import anomalies, compare, events, inference, market, metrics, models, pooling, representations
from barloom.operators.components import connected_components
from barloom.operators.prefilter import maybe_in
from barloom.operators.prefix import running, with_ranks
from barloom.sources import responses, tables


def test_components_chain_and_duplicates(spark):
    n = 300
    links = [(i, i + 1) for i in range(n)] + [(5, 5), (None, 3), (1000, 1001), (1001, 1000), (1000, 1001)]
    out = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {out[i] for i in range(n + 1)} == {0} and out[1001] == 1000
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_match_union_find(spark):
    rng = np.random.default_rng(3)
    links = [tuple(map(int, rng.integers(0, 400, 2))) for _ in range(260)]
    parent = list(range(400))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    out = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(out[i] == find(i) for i in out)


def test_prefilter_keeps_every_match(spark):
    big = spark.range(20_000).withColumn("text", F.lit("x"))
    keys = spark.range(0, 20_000, 97).withColumnRenamed("id", "k").union(spark.createDataFrame([(None,)], "k long"))
    out = maybe_in(big, "id", keys, "k")
    assert out.columns == ["id", "text"]
    assert keys.join(out, F.col("k") == F.col("id"), "left_anti").filter("k is not null").count() == 0
    assert out.count() < 1_000
    assert maybe_in(big, "id", keys.limit(0), "k").count() == 0


def test_running_and_ranks_with_ties(spark):
    rng = np.random.default_rng(1)
    rows = [(int(g), float(v)) for g, v in zip(rng.integers(0, 3, 500), rng.integers(0, 40, 500))]
    df = spark.createDataFrame(rows + [(0, None)], "g int, v double").withColumn("i", F.monotonically_increasing_id())
    for descending in (False, True):
        for r in running(df, ["g"], "v", {"n": F.lit(1)}, descending=descending, limit=20).collect():
            own = [v for g, v in rows if g == r.g]
            assert r.before_n == sum(v > r.v if descending else v < r.v for v in own)
            assert r.n == own.count(r.v)
    for limit in (20, 1_000):
        ranked = with_ranks(df, ["g"], "v", "rank", limit=limit).collect()
        assert len(ranked) == 501
        for r in ranked:
            own = [v for g, v in rows if g == r.g]
            expected = None if r.v is None else sum(v < r.v for v in own) + (own.count(r.v) + 1) / 2
            assert r["rank"] == expected


def test_ranking_of_a_constant_prediction(spark):
    """One tie group larger than a slice of places: every row gets the mean discount, so ndcg is known."""
    n = 20_000
    df = spark.range(n).select(F.lit("m").alias("model"), "id", (F.col("id") % 10).cast("double").alias("y"), F.lit(0.5).alias("p"))
    row = metrics.ranking(df, ["model"], "id").first()
    discount = 1 / np.log2(np.arange(1, n + 1) + 1)
    gain = np.sort(np.arange(n) % 10)[::-1]
    assert abs(row.ndcg - gain.sum() / n * discount.sum() / (gain * discount).sum()) < 1e-9


def test_metrics_by_hand(spark):
    y, p = [1, 0, 1, 1, 0, 0], [0.9, 0.8, 0.8, 0.4, 0.4, 0.1]
    df = spark.createDataFrame([("a", a, b) for a, b in zip(y, p)] + [("one", 1, 0.5), ("null", None, 0.5)], "g string, y int, p double")
    pairs = [(1.0 if a > b else 0.5 if a == b else 0.0) for a, s in zip(p, y) if s for b, t in zip(p, y) if not t]
    auc = {r.g: r.roc_auc for r in metrics.roc_auc(df, ["g"]).collect()}
    assert abs(auc["a"] - sum(pairs) / 9) < 1e-12 and auc["one"] is None
    ap = {r.g: r.pr_auc for r in metrics.average_precision(df, ["g"]).collect()}
    assert abs(ap["a"] - (1 / 3 * 1 + 1 / 3 * 2 / 3 + 1 / 3 * 3 / 5)) < 1e-12
    c = {r.g: r for r in metrics.confusion(df, ["g"]).collect()}["a"]
    assert (c.tp, c.fp, c.fn, c.tn) == (2, 1, 1, 2)


def test_regression_metrics_handle_constants_and_nulls(spark):
    df = spark.createDataFrame([("c", 1.0, 2.0)] * 4 + [("n", None, 1.0), ("n", float("nan"), 1.0), ("n", 2.0, 1.0)], "g string, y double, p double")
    out = {r.g: r for r in metrics.regression(df, ["g"]).collect()}
    assert out["c"].pearson is None and out["c"].mae == 1.0 and out["n"].n == 1


def test_distribution_functions():
    assert abs(stats.normal_cdf(1.959963984540054) - 0.975) < 1e-12
    assert abs(stats.normal_ppf(0.95) - 1.6448536269514722) < 1e-9
    assert abs(stats.chi2_sf(3.841458820694124, 1) - 0.05) < 1e-10
    assert abs(stats.chi2_sf(5.991464547107979, 2) - 0.05) < 1e-10
    assert abs(stats.t_ppf(0.975, 10) - 2.2281388519649385) < 1e-7
    assert abs(stats.t_cdf(0.0, 5) - 0.5) < 1e-12


def test_p_values_pass_nulls(spark):
    df = spark.createDataFrame([(1.959963984540054,), (None,)], "z double")
    out = [r.p for r in df.select(stats.two_sided_p(F.col("z")).alias("p")).collect()]
    assert abs(out[0] - 0.05) < 1e-12 and out[1] is None


def bars(spark, rows):
    return spark.createDataFrame(rows, "source_row_number long, source string, ticker string, feature_date date, open double, high double, low double, close double")


def series(closes, source="s", ticker="t", first=0):
    day = dt.date(2022, 1, 1)
    return [(first + i, source, ticker, day + dt.timedelta(i), c, c * 1.001, c * 0.999, c) for i, c in enumerate(closes)]


def test_bad_bars_spikes_and_levels(spark):
    rng = np.random.default_rng(0)
    base = (100 * np.exp(np.cumsum(rng.normal(0, 0.01, 60)))).tolist()
    spiked = list(base)
    spiked[20] *= 3
    spiked[30], spiked[31], spiked[32] = (x * 0.2 for x in spiked[30:33])
    level = base[:40] + [x * 4 for x in base[40:]]
    ends = [base[0] * 5, *base[1:-1], base[-1] * 5]
    rows = series(spiked, "a") + series(level, "b", first=1000) + series(ends, "c", first=2000)
    out = {r.id: r.flags for r in anomalies.bad_bars(bars(spark, rows), "source_row_number").collect()}
    assert out == {20: 2, 30: 2, 31: 2, 32: 2}


def test_bad_bars_frozen_impossible_and_dirty_keys(spark):
    closes = [float(c) for c in (100, 101, 102, 103, 103, 103, 103, 103, 103, 104.5, 99, 101)]
    rows = series(closes, " a ", "x")
    rows += [(100, "A", "X ", rows[4][3], *rows[4][4:]), (101, "a", "x", None, 1.0, 0.5, 1.0, 1.0), (102, None, "x", rows[0][3], -1.0, 2.0, -1.0, 1.0), (103, "a", "x", rows[5][3], None, None, None, None), (104, "a", "x", rows[5][3], float("nan"), 5.0, 4.0, 4.5)]
    clash = bars(spark, rows).withColumn("id", F.lit(1)).withColumn("flags", F.lit(2)).withColumn("print", F.lit(3)).withColumn("first", F.lit("x"))
    out = {r.id: r.flags for r in anomalies.bad_bars(clash, "source_row_number").collect()}
    assert {k for k, v in out.items() if v & 1} == {3, 4, 5, 6, 7, 8, 100}
    assert {k for k, v in out.items() if v & 4} == {101, 102}
    assert anomalies.bad_bars(bars(spark, []), "source_row_number").count() == 0


def test_screening_misses_no_series(spark):
    rng = np.random.default_rng(13)
    rows, n = [], 0
    for k in range(120):
        days = int(rng.integers(2, 40))
        closes = 50 * np.exp(np.cumsum(rng.normal(0, 0.01, days)))
        if k % 3 == 0 and days > 8:
            closes[int(rng.integers(1, days - 2))] *= float(rng.choice([1.16, 1.3, 3.0, 0.4]))
        if k % 4 == 0 and days > 10:
            at = int(rng.integers(0, days - 7))
            closes[at : at + int(rng.integers(4, 8))] = closes[at]
        for d, c in enumerate(closes.tolist()):
            prices = [c, c * 1.001, c * 0.999, c]
            if rng.random() < 0.02:
                prices[int(rng.integers(0, 4))] *= float(rng.choice([2.0, 0.3]))
            if rng.random() < 0.05:
                prices[int(rng.integers(0, 4))] = None
            copies = [prices] if rng.random() < 0.9 else [prices, [*prices[:3], None if prices[3] is None else prices[3] * 1.0001]]
            for p in copies:
                rows.append((n, "s", f"t{k}", dt.date(2022, 1, 1) + dt.timedelta(d), *p))
                n += 1
    got = {r.id: r.flags for r in anomalies.bad_bars(bars(spark, rows), "source_row_number").collect()}
    want = {}
    for k in range(120):
        own = [r for r in rows if r[2] == f"t{k}"]
        day = np.array([r[3].toordinal() for r in own])
        prices = np.array([[np.nan if v is None else v for v in r[4:]] for r in own], float)
        for r, f in zip(own, anomalies.judge_series(day, prices, 6, 15.0)):
            if f:
                want[r[0]] = int(f)
    assert {i: f & 3 for i, f in got.items() if f & 3} == want and len(want) > 60


def test_frozen_rows_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(200):
        n = int(rng.integers(1, 30))
        day, value = np.sort(rng.integers(0, 20, n)), rng.choice([1.0, 2.0, np.nan], n, p=[0.6, 0.2, 0.2])
        got = anomalies.frozen_rows(day, value, 4)
        days = sorted({d for d, v in zip(day, value) if v == v})
        for i in range(n):
            want = False
            if value[i] == value[i]:
                at = days.index(day[i])
                have = [any(d == x and v == value[i] for d, v in zip(day, value)) for x in days]
                a = b = at
                while a > 0 and have[a - 1]:
                    a -= 1
                while b + 1 < len(days) and have[b + 1]:
                    b += 1
                want = b - a + 1 >= 4
            assert got[i] == want


def test_sketch_fences_match_exact_quantiles(spark):
    rng = np.random.default_rng(2)
    rows = [("a", float(v)) for v in rng.normal(0, 1, 3000)] + [("b", 1.0)] * 5 + [("c", None), ("c", float("nan"))]
    out = {r.g: r for r in anomalies.sketch_fences(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()}
    q1, q3 = np.quantile([v for g, v in rows if g == "a"], [0.25, 0.75])
    assert abs(out["a"].q1 - q1) < 0.05 and abs(out["a"].q3 - q3) < 0.05
    assert out["b"].low == out["b"].high == 1.0 and "c" not in out


def char_grams(text):
    out = {}
    for word in text.lower().split():
        padded = f" {word} "
        for n in (3, 4, 5):
            grams = [padded] if len(padded) <= n else [padded[k : k + n] for k in range(len(padded) - n + 1)]
            for g in grams:
                out[g] = out.get(g, 0) + 1
            if len(padded) <= n:
                break
    return out


def test_gram_vectors_match_the_definition():
    texts = ["a bb ccc dddd eeeee", "", "x", "the the thee", "É l'été 2020"]
    gram, weight, bounds = events.gram_vectors(texts)
    for k, t in enumerate(texts):
        want = char_grams(t)
        norm = math.sqrt(sum(n * n for n in want.values())) or 1
        assert sorted(weight[bounds[k] : bounds[k + 1]].round(9)) == sorted(round(n / norm, 9) for n in want.values())


def test_near_texts_are_cut_once_each_however_many_stand_in_a_block(monkeypatch):
    """Texts of one form share grams with all others of their block, so pairs must not be cut again."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    texts = [" ".join(f"{w}{rng.integers(10**6)}" for w in ("guidance", "outlook", "revenue", "margin", "supply")) for _ in range(400)]
    cut, plain = [], events.gram_vectors
    monkeypatch.setattr(events, "gram_vectors", lambda t: cut.append(len(t)) or plain(t))
    zeros = pa.array(np.zeros(400, np.int32))
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(400, np.int64)), zeros, zeros, zeros, pa.array([f"e{k:03}" for k in range(400)]), pa.array([*texts[:-1], texts[0] + "0"])], ["block", "i", "j", "tile", "first", "text"])
    found = [(r["a"], r["b"]) for part in events._close_pairs(iter([batch.slice(0, 150), batch.slice(150)]), 0.95) for r in part.to_pylist()]
    assert found == [("e000", "e399")] and sum(cut) <= 2 * 400


def test_near_links_do_not_depend_on_tiles_or_batches(spark):
    rng = np.random.default_rng(5)
    words = [f"{a}{b}" for a in ("guid", "reven", "marg", "suppl", "fab") for b in ("ance", "ues", "ins", "iers", "rics")]
    rows = []
    for k in range(240):
        own = list(rng.choice(words, 30)) if k % 3 == 0 or k < 3 else rows[k - 1][2].split()
        if k % 3:
            own[int(rng.integers(30))] = str(rng.choice(words))
        rows.append((f"e{k:03}", f"d{k % 2 if k % 5 else 0}", " ".join(own)))
    df = spark.createDataFrame(rows, "event_id string, day string, text string")
    want = set()
    vectors = [char_grams(t) for _, _, t in rows]
    norm = [math.sqrt(sum(n * n for n in v.values())) for v in vectors]
    for i in range(len(rows)):
        for j in range(i + 1, len(rows)):
            if rows[i][1] == rows[j][1] and rows[i][2] != rows[j][2] and sum(n * vectors[j].get(g, 0) for g, n in vectors[i].items()) / (norm[i] * norm[j]) >= 0.9:
                want.add((rows[i][0], rows[j][0]))
    for tile in (2_048, 7):
        members, links = events.near_links(df, ["day"], threshold=0.9, tile_rows=tile)
        first = {r.id: r.first for r in members.collect()}
        got = [(r.a, r.b) for r in links.collect()]
        assert len(got) == len(set(got)) and set(got) == {tuple(sorted((first[a], first[b]))) for a, b in want} and len(got) > 20


def test_near_links_match_brute_force(spark):
    texts = ["the firm raised its outlook for the year on strong demand", "the firm raised its outlook for the year on strong demands", "completely other words stand here", "", None, "the firm raised its outlook for the year on strong demand"]
    df = spark.createDataFrame([(f"e{i}", "d", t) for i, t in enumerate(texts)] + [("e9", "other", texts[0])], "event_id string, day string, text string")
    members, links = events.near_links(df, ["day"], threshold=0.9)
    copies = {r.id: r.first for r in members.collect()}
    assert copies == {"e0": "e0", "e1": "e1", "e2": "e2", "e5": "e0", "e9": "e9"}
    got = {(r.a, r.b) for r in links.collect()}
    want = set()
    for i in range(6):
        for j in range(i + 1, 6):
            if texts[i] and texts[j]:
                (a, b) = (char_grams(texts[k]) for k in (i, j))
                dot = sum(n * b.get(g, 0) for g, n in a.items())
                if dot / math.sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values())) >= 0.9:
                    want.add(tuple(sorted((copies[f"e{i}"], copies[f"e{j}"]))))
    want -= {("e0", "e0")}
    assert got == want and ("e0", "e1") in got
    whole = {r.event_id: (r.canonical_id, r.group_size) for r in events.near_deduplicated(df, ["day"], threshold=0.9).collect()}
    assert whole["e0"] == whole["e1"] == whole["e5"] == ("e0", 3) and whole["e3"] == ("e3", 1) and whole["e4"] == ("e4", 1)
    assert events.near_deduplicated(df.limit(0), ["day"]).count() == 0


def test_occurrences_edge_cases(spark):
    rows = [(1, " nvda", dt.date(2022, 1, 3), "target", "Chips sell ​well"), (2, "NVDA", dt.date(2022, 1, 3), "target", "Chips sell well"), (3, "AMD", dt.date(2022, 1, 3), "related", "NVDA and AMD"), (4, "AMD", dt.date(2022, 1, 3), "macro", "N/A"), (5, None, None, None, None)]
    df = spark.createDataFrame(rows, "source_row_number long, ticker string, feature_date date, news_level string, text string")
    occ = events.occurrences(df, ["AMD", "NVDA"])
    assert occ.count() == 3
    canon = events.canonical_events(occ)
    assert canon.filter("news_level = 'target'").first().source_occurrence_count == 2
    related = canon.filter("news_level = 'related'").first()
    assert related.available_to_tickers == ["AMD", "NVDA"] and related.related_tickers == ["NVDA"]
    assert events.canonical_events(occ.limit(0)).count() == 0


def test_nfkc(spark):
    df = spark.createDataFrame([("ﬁrm   Ａ",), (None,)], "t string")
    assert [r.x for r in df.select(events.normalised("t", True).alias("x")).collect()] == ["firm A", None]


def test_pooling_properties(spark):
    ev = spark.createDataFrame([("a", "macro", "train", dt.date(2022, 1, 3), '["AMD","NVDA"]'), ("b", "target", "train", dt.date(2022, 1, 3), '["AMD"]'), ("c", "target", "train", dt.date(2022, 1, 3), "amd, nvda"), ("d", "target", "train", dt.date(2022, 1, 9), None)], "event_id string, news_level string, split string, feature_date date, available_to_tickers string")
    vec = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 1.0]), ("d", None)], "event_id string, embedding array<float>")
    panel = spark.createDataFrame([("AMD", dt.date(2022, 1, 3)), ("AMD", dt.date(2022, 1, 4)), ("NVDA", dt.date(2022, 1, 3))], "ticker string, date date")
    sets = pooling.event_sets(ev, ["AMD", "NVDA"])
    mean = {(r.ticker, str(r.date), r.news_level): (r.n, r.pooled) for r in pooling.pooled(sets, vec, panel, "mean", 2).collect()}
    assert mean[("AMD", "2022-01-03", "target")] == (2, [0.5, 1.0]) and mean[("NVDA", "2022-01-03", "macro")] == (1, [1.0, 0.0])
    top = {(r.ticker, str(r.date), r.news_level): r.pooled for r in pooling.pooled(sets, vec, panel, "max", 2).collect()}
    assert top[("AMD", "2022-01-03", "target")] == [1.0, 1.0]
    decay = {(r.ticker, str(r.date), r.news_level): r.pooled for r in pooling.pooled(sets, vec, panel, "decay", 2).collect()}
    assert decay[("AMD", "2022-01-04", "target")] == pytest.approx([0.5, 1.0])
    turned = pooling.edges(ev, ["AMD", "NVDA"], rotate=1).filter("event_id = 'b'").first()
    assert turned.ticker == "NVDA"


def test_days_since_and_asof(spark):
    panel = spark.createDataFrame([("A", dt.date(2022, 1, d)) for d in (3, 4, 10)] + [("B", dt.date(2022, 1, 3))], "ticker string, date date")
    edge = spark.createDataFrame([("A", dt.date(2022, 1, 4)), ("A", dt.date(2022, 1, 4)), ("A", dt.date(2022, 1, 20))], "ticker string, event_date date")
    out = {(r.ticker, r.date.day): (r.days_since, r.has_prior) for r in pooling.days_since(panel, edge).collect()}
    assert out == {("A", 3): (3650, 0), ("A", 4): (0, 1), ("A", 10): (6, 1), ("B", 3): (3650, 0)}
    news = spark.createDataFrame([(dt.date(2022, 1, 2),), (dt.date(2022, 1, 4),), (dt.date(2022, 1, 11),), (None,)], "news_date date")
    asof = {r.news_date.day: r.trading_date.day for r in pooling.forward_asof(news, panel.filter("ticker = 'A'").select("date")).collect()}
    assert asof == {2: 3, 4: 4}


def test_assignment_skips_unusable_vectors(spark):
    rows = [("a", [1.0, 0.1]), ("b", None), ("c", [0.0, 0.0]), ("d", [1.0]), ("e", [0.0, 2.0])]
    out = {r.event_id: r for r in pooling.assignment(spark.createDataFrame(rows, "event_id string, embedding array<float>"), [[1, 0], [0, 1]]).collect()}
    assert set(out) == {"a", "e"} and out["a"].prototype == 0 and out["e"].prototype == 1
    assert abs(sum(out["a"].weights) - 1) < 1e-12 and out["e"].novelty == pytest.approx(0)


def test_structured_counts_keep_their_columns(spark):
    empty = spark.createDataFrame([], "t string, d string, event_type string")
    assert pooling.structured_counts(empty, ["t", "d"], "event_type", ["x", "y"]).columns == ["t", "d", "event_type__x", "event_type__y"]


def test_valid_bars_and_nan(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1.0, 2.0, 0.5, 1.5), (1.0, 0.9, 0.5, 0.8), (nan, 2.0, 0.5, 1.0), (None, 2.0, 0.5, 1.0), (0.0, 1.0, 0.0, 1.0)], "open double, high double, low double, close double")
    assert market.valid_bars(df).count() == 1
    text = df.limit(1).selectExpr("'x' as open", "high", "low", "close")
    assert market.coerced(text).first().open is None


def test_missing_variance_stays_missing(spark):
    df = spark.createDataFrame([(None,), (0.0,)], "v double")
    assert [r.x is None for r in df.select(X.log_variance(F.col("v")).alias("x")).collect()] == [True, False]


def test_newey_west_matches_numpy(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(0.1, 1, 50)
    df = spark.createDataFrame([("g", i, float(x)) for i, x in enumerate(v)] + [("short", i, 1.0) for i in range(3)], "g string, date int, v double")
    out = {r.g: r for r in inference.newey_west(df, ["g"], "v", 3).collect()}
    c = v - v.mean()
    lrv = c @ c / 50 + sum(2 * (1 - k / 4) * (c[k:] @ c[:-k]) / 50 for k in (1, 2, 3))
    assert abs(out["g"].hac_se - math.sqrt(lrv / 50)) < 1e-12 and out["short"].mean is None


def test_bootstrap_draws_whole_series(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(20)], "date int, v double")
    draws = inference.block_bootstrap(df, "v", 5, 25, 1)
    assert draws.count() == 25 and draws.agg(F.stddev("mean")).first()[0] > 0
    assert inference.block_bootstrap(df.limit(0), "v", 5, 3, 1).count() == 0


def test_checked_join_fails_on_repeated_keys(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    right = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert {r.v for r in compare.checked_join(left, right, ["k"]).collect()} == {"a", "b"}
    with pytest.raises(Exception, match="not unique"):
        compare.checked_join(left, right.union(right), ["k"]).collect()


def test_rand_index(spark):
    same = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y"), (2, "y")], "a int, b string")
    assert compare.rand_index(same, "a", "b").first().adjusted_rand == 1.0
    mixed = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x"), (2, "y")], "a int, b string")
    assert compare.rand_index(mixed, "a", "b").first().adjusted_rand == pytest.approx(-0.5)


def test_ridge_matches_normal_equations(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(2, 3, (200, 2))
    y = x @ [1.5, -2] + 4 + rng.normal(0, 0.1, 200)
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)] + [(None, 1.0, 1.0)], "a double, b double, y double")
    for alpha in (0.0, 10.0):
        model = models.fit_ridge(df, ["a", "b"], "y", alpha)
        z = (x - x.mean(0)) / x.std(0)
        w = np.linalg.solve(z.T @ z + alpha * np.eye(2), z.T @ (y - y.mean())) / x.std(0)
        assert np.allclose(model.weights, w) and model.intercept == pytest.approx(y.mean() - x.mean(0) @ w)


@pytest.mark.parametrize("alpha", [0.1, 10.0])
def test_ridge_on_many_values_of_a_column_is_that_of_one_hot_columns(spark, alpha):
    rng = np.random.default_rng(8)
    n, k = 3_000, 1_200
    of, x = rng.integers(0, k, n), rng.normal(1, 2, (n, 2))
    y = x @ [1.5, -2] + rng.normal(0, 1, k)[of] + 4
    rows = [(None if e == 0 else f"e{e}", float(a), float(b), float(c)) for e, (a, b), c in zip(of, x, y)]
    df = spark.createDataFrame([*rows, ("e1", None, 1.0, 1.0), ("e2", 1.0, 1.0, float("nan")), ("bare", 1.0, None, 1.0)], "g string, a double, b double, y double")
    (model,) = models.fit_grouped(df, ["a", "b"], "y", "g", (alpha,))
    hot = (of[:, None] == np.arange(1, k)).astype(float)
    full = np.hstack([np.ones((n, 1)), x, hot])
    w = np.linalg.solve(full.T @ full + alpha * np.diag([0.0] + [1.0] * (k + 1)), full.T @ y)
    effects = {r.g: r.e for r in model.moments.select("g", model.effect.alias("e")).collect()}
    assert np.allclose([model.linear.intercept, *model.linear.weights], w[:3]) and np.allclose([effects.get(f"e{e}", 0.0) for e in range(1, k)], w[3:]) and effects["bare"] == 0
    assert models.grouped_gradient(df, model, "y") < 1e-9
    new = spark.createDataFrame([("e1", 1.0, 2.0), ("new", 1.0, 2.0), (None, 1.0, 2.0)], "g string, a double, b double")
    got = {r.g: r.p for r in models.predict_grouped(new, {"p": model}).collect()}
    assert got["new"] == got[None] == pytest.approx(w[0] + w[1] + 2 * w[2]) and got["e1"] == pytest.approx(got["new"] + w[3])


def test_logistic_gradient_vanishes(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(0, 1, (300, 2))
    y = (rng.random(300) < 1 / (1 + np.exp(-(x @ [1, -1])))).astype(int)
    df = spark.createDataFrame([(*map(float, a), int(b)) for a, b in zip(x, y)], "a double, b double, y int")
    m = models.fit_logistic(df, ["a", "b"], "y", c=1.0)
    p = 1 / (1 + np.exp(-(x @ m.weights + m.intercept)))
    assert np.abs(x.T @ (y - p) - m.weights).max() < 1e-6 and abs((y - p).sum()) < 1e-6


def test_pca_matches_numpy(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (100, 5)) * [5, 3, 1, 0.5, 0.1]
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)] + [(100, None), (101, [1.0])], "id int, v array<double>")
    m = models.fit_pca(df, "v", 5, 2)
    assert np.allclose(m.variance, np.sort(np.linalg.eigvalsh(np.cov(x.T, bias=True)))[::-1][:2])
    assert models.project(df, "id", "v", m).count() == 100


def test_kmeans_and_matching(spark):
    rng = np.random.default_rng(9)
    centers = np.eye(4)
    rows = [(list(map(float, centers[i % 4] + rng.normal(0, 0.05, 4))),) for i in range(200)]
    df = spark.createDataFrame(rows, "v array<double>")
    a = models.spherical_kmeans(df, "v", 4, 4)
    pairs = models.match_centers(a, centers)
    assert sorted(j for _, j, _ in pairs) == [0, 1, 2, 3] and all(c > 0.99 for _, _, c in pairs)
    assert models.spherical_kmeans(df.limit(0), "v", 4, 4).shape == (0, 4)


def test_kmeans_runs_until_all_starts_settle(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(3_000, 3)).astype("f4").astype(float)
    for kind in ("float", "double"):
        df = spark.createDataFrame([(v.tolist(),) for v in x], f"v array<{kind}>")
        got = models.spherical_kmeans(df, "v", 3, 8, seed=3)
        drawn = df.select(F.col("v").cast("array<double>").alias("v")).orderBy(F.xxhash64(F.lit(3), "v"))
        rows = np.array([r.v for r in drawn.collect()])
        rows /= np.linalg.norm(rows, axis=1, keepdims=True)
        starts, best = np.random.default_rng(3), (np.inf, None)
        longest = 0
        for c in [models._spread(rows, 8, starts) for _ in range(20)]:
            for n in range(500):
                d = ((rows[:, None] - c) ** 2).sum(axis=2)
                near = d.argmin(axis=1)
                before, c = c, np.array([rows[near == j].mean(axis=0) for j in range(8)])
                if np.abs(c - before).max() < 1e-9:
                    break
            longest = max(longest, n)
            best = min(best, (d.min(axis=1).sum(), c.tolist()))
        want = np.array(best[1])
        assert longest > 12
        assert np.allclose(got, want / np.linalg.norm(want, axis=1, keepdims=True), atol=1e-7)
    with pytest.raises(RuntimeError, match="did not settle"):
        models.spherical_kmeans(df, "v", 3, 8, rounds=3)


def test_matching_is_optimal():
    import itertools

    rng = np.random.default_rng(10)
    for n, m in ((3, 3), (2, 4), (4, 3)):
        a, b = rng.normal(size=(n, 6)), rng.normal(size=(m, 6))
        cos = (a / np.linalg.norm(a, axis=1, keepdims=True)) @ (b / np.linalg.norm(b, axis=1, keepdims=True)).T
        k = min(n, m)
        best = max(sum(cos[i, j] for i, j in zip(r, c)) for r in itertools.permutations(range(n), k) for c in itertools.combinations(range(m), k))
        assert sum(c for *_, c in models.match_centers(a, b)) == pytest.approx(best)


ONTOLOGY = {"event_type": ["guidance"], "direction": ["positive"], "magnitude": ["small"], "certainty": ["confirmed"], "time_horizon": ["immediate"], "entity_role": ["target_company"]}


def test_responses(spark):
    import json

    event = {s: v[0] for s, v in ONTOLOGY.items()} | {"evidence_text": "raised its  guidance", "explicit_tickers": ["nvda", "ZZZ"]}
    good = "Sure: " + json.dumps({"events": [event, event | {"evidence_text": "not there"}, event | {"direction": "up"}, 7]})
    rows = [("a", "Nvidia raised its guidance.", good), ("b", "x", "no json {"), ("c", None, None), ("d", "x", '{"events": []}')]
    out = {r.id: r for r in responses.validated(spark.createDataFrame(rows, "id string, s string, r string"), "id", "s", "r", ONTOLOGY, ["NVDA"]).collect()}
    assert out["a"].valid and out["a"].n_dropped == 3 and out["a"].events[0].explicit_tickers == ["NVDA"]
    assert not out["b"].valid and not out["c"].valid and out["d"].valid and out["d"].events == []


def test_nested_news_cells(spark):
    cells = [("a", '[{"headline": "H", "body": "B"}, "x"]'), ("b", "['p', 'q']"), ("c", "plain"), ("d", None), ("e", "")]
    out = [(r.id, r.text) for r in responses.flattened(spark.createDataFrame(cells, "id string, cell string"), "id", "cell").collect()]
    assert sorted(out) == [("a", "H B"), ("a", "x"), ("b", "p"), ("b", "q"), ("c", "plain")]


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    for name in ("t.parquet", "t.csv"):
        tables.write_table(df, f"{tmp_path}/{name}")
        assert tables.read_table(spark, f"{tmp_path}/{name}", columns=["k"]).count() == 2
    (tmp_path / "x.jsonl").write_text('{"k": 1}\n{"k": 2}\n')
    assert tables.read_table(spark, f"{tmp_path}/x.jsonl", schema="k int").count() == 2
    with pytest.raises(ValueError):
        tables.read_table(spark, "x.xml")
    assert tables.discover(["/d/a.csv", "/d/b.csv"], ["b.csv"]) == "/d/b.csv"
    with pytest.raises(ValueError):
        tables.discover(["/d/a.csv", "/d/b.csv"], [])
    assert tables.first_existing(spark, [f"{tmp_path}/no", f"{tmp_path}/t.csv"]).endswith("t.csv")
    assert tables.resolve_columns(["Trade_Date", "px_close"], {"trade date": {}, "close": {"pattern": r"px_.*"}}) == {"trade date": "Trade_Date", "close": "px_close"}
    with pytest.raises(ValueError):
        tables.resolve_columns(["a-b", "a_b"], {"ab": {}})
    assert tables.news_columns(["macro_10", "macro_2", "sector_1"], {"macro": "macro", "sector": "sector"})["macro"] == ["macro_2", "macro_10"]
    union = tables.tagged_union({"x": df, "y": df.select("k")})
    assert union.filter("split = 'y' and v is null").count() == 2
    assert [r.k for r in tables.cache_misses(df, df.limit(1), ["k"]).collect()] == [2]


def test_stream_equals_batch(spark, tmp_path):
    from barloom.streaming import bars as B

    day = dt.datetime(2022, 1, 1)
    rows = [("e", day + dt.timedelta(hours=7 * i), float(i % 5)) for i in range(40)]
    df = spark.createDataFrame(rows, "kind string, ts timestamp, value double")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    live = B.run_once(spark, f"{tmp_path}/in", df.schema, entity="kind", ts="ts", value="value")
    whole = {r.start: r for r in B.windowed_bars(df, "kind", "ts", "value").collect()}
    seen = live.collect()
    assert seen and all(whole[r.start] == r for r in seen) and len(seen) < len(whole)


def test_stream_with_its_open_windows_is_the_batch(spark, tmp_path):
    from barloom.streaming import bars as B

    day = dt.datetime(2022, 1, 1)
    for n in (40, 3):  # with three rows the watermark closes no window
        df = spark.createDataFrame([("ef"[i % 2], day + dt.timedelta(hours=7 * i), float(i % 5)) for i in range(n)], "kind string, ts timestamp, value double")
        df.coalesce(1).write.parquet(f"{tmp_path}/in{n}")
        got = B.run_whole(spark, f"{tmp_path}/in{n}", df.schema, entity="kind", ts="ts", value="value").collect()
        assert sorted(got) == sorted(B.windowed_bars(df, "kind", "ts", "value").collect())


def test_permutation_keeps_the_values_of_a_group(spark):
    rows = [("g" if i % 3 else "h", f"e{i}", i) for i in range(200)] + [("g", None, 1)]
    df = spark.createDataFrame(rows, "g string, e string, v int")
    out = representations.permuted(df, ["g"], "e", "v", 1).collect()
    for g in "gh":
        assert sorted(r.permuted for r in out if r.g == g) == sorted(v for k, e, v in rows if k == g and e)
    assert any(f"e{r.permuted}" != r.e for r in out)


def test_random_labels_follow_the_shares(spark):
    df = spark.range(5000).withColumnRenamed("id", "e")
    train = spark.createDataFrame([(1,)] * 3 + [(2,), (None,)], "label int")
    counts = {r.placebo: r["count"] for r in representations.random_labels(df, train, "e", "label", 3).groupBy("placebo").count().collect()}
    assert sum(counts.values()) == 5000 and abs(counts[1] / 5000 - 0.75) < 0.03


def test_cluster_quality_matches_pairs(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(60, 4)) + np.repeat(np.eye(4)[:3] * 4, 20, axis=0)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    label = np.repeat([0, 1, 2], 20)
    df = spark.createDataFrame([(int(k), list(map(float, v))) for k, v in zip(label, x)] + [(0, None), (None, [1.0] * 4)], "label int, v array<double>")
    out = {r.label: r for r in representations.cluster_quality(df, "label", "v", 4).collect()}
    d = 1 - u @ u.T
    for k in range(3):
        own = np.flatnonzero(label == k)
        s = []
        for i in own:
            a = d[i, own].sum() / (len(own) - 1)
            b = min(d[i, label == j].mean() for j in range(3) if j != k)
            s.append((b - a) / max(a, b))
        assert out[k].silhouette == pytest.approx(np.mean(s)) and out[k].n == 20
        c = u[own].mean(0)
        assert out[k].scatter == pytest.approx(np.linalg.norm(u[own] - c, axis=1).mean())


def test_keep_one_first_and_last(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, None), ("a", 3, "z"), (None, 5, "n"), ("b", None, "q")], "k string, o int, v string")
    first = {r.k: (r.o, r.v) for r in representations.keep_one(df, ["k"], "o").collect()}
    last = {r.k: (r.o, r.v) for r in representations.keep_one(df, ["k"], "o", last=True).collect()}
    assert first == {"a": (1, None), None: (5, "n")} and last["a"] == (3, "z")


def test_elastic_net_optimality(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(150, 3))
    y = x @ [2, 0, -1] + rng.normal(0, 0.1, 150)
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)], "a double, b double, c double, y double")
    m = models.fit_elastic_net(df, ["a", "b", "c"], "y", 0.3, 0.5)
    z = (x - x.mean(0)) / x.std(0)
    w = m.weights * x.std(0)
    g = z.T @ (y - y.mean() - z @ w) / 150 - 0.15 * w
    assert np.all(np.where(w != 0, np.abs(g - 0.15 * np.sign(w)) < 1e-8, np.abs(g) <= 0.15 + 1e-8))


def test_preparation(spark):
    df = spark.createDataFrame([(1.0, "x"), (None, "y"), (3.0, "x"), (5.0, None)], "v double, k string")
    how = models.fit_preparation(df, ["v"], ["k"])
    out = models.prepare(df.union(spark.createDataFrame([(None, "new")], "v double, k string")), how).collect()
    assert how.categories == {"k": ["x", "y"]} and how.names == ["z__v", "missing__v", "is__k__0", "is__k__1"]
    assert sum(r["z__v"] for r in out[:4]) == pytest.approx(0) and out[4]["is__k__0"] == out[4]["is__k__1"] == 0 and out[4]["missing__v"] == 1
    with pytest.raises(ValueError):
        models.fit_preparation(df, [], ["k"], most=1)


def test_bootstraps_have_the_numbers_of_the_reference(spark, data):
    from barloom import registry

    grid = registry.queries()["bootstrap_circular_grid"](spark, data).collect()
    assert {(r.block_length, r.seed, r.repetitions) for r in grid} == {(b, s, 2_000) for b in (10, 15, 20) for s in (42, 123, 2026)} and len(grid) == 9
    assert [r.repetitions for r in registry.queries()["bootstrap_non_circular_full"](spark, data).collect()] == [500]
