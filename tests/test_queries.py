"""Every general query against its SQL on the smallest tables; those that SQL cannot express against
plain Python over the same rows."""

import shutil
import unicodedata

import numpy as np
import pytest

from barloom import registry
from tests.oracle import compare, views


def text_compatibility_form(df, con):
    import hashlib

    def form(text):
        plain = unicodedata.normalize("NFKC", text)
        return " ".join(plain.replace("​", "").replace("﻿", "").split())

    texts = dict(con.execute("select doc_id, text from documents").fetchall())
    got = {r.doc_id: r.text_hash for r in df.collect()}
    assert set(got) == set(texts)
    assert all(got[i] == (None if t is None else hashlib.sha256(form(t).encode()).hexdigest()) for i, t in texts.items())


def p5_fences(df, con):
    """Sketched quantiles place the fences, so a few rows near a fence may differ from exact ones."""
    rows = con.execute("""select source_row_number, upper(trim(source)) as s, hour(ingested_at) as h, ln(high / low) as spread, ln("close" / "open") as move from inspect_schema
        where "open" > 0 and high > 0 and low > 0 and "close" > 0 and not (isnan("open") or isnan(high) or isnan(low) or isnan("close"))""").fetchall()
    groups = {}
    for r in rows:
        groups.setdefault(r[1:3], []).append(r)
    want = set()
    for own in groups.values():
        spread, move = (np.array([r[k] for r in own]) for k in (3, 4))
        (a, b), (c, d) = (np.quantile(v, [0.25, 0.75], method="inverted_cdf") for v in (spread, move))
        hit = (spread > b + 6 * (b - a)) | (move < c - 6 * (d - c)) | (move > d + 6 * (d - c)) | (spread == 0) & (a > 0)
        want |= {r[0] for r, k in zip(own, hit) if k}
    got = {r.source_row_number for r in df.collect()}
    assert want and len(got ^ want) <= 0.1 * len(want) + 2


PLAIN = {f.__name__: f for f in (text_compatibility_form, p5_fences)}


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, data, name):
    df = registry.queries()[name](spark, data)
    if name in PLAIN:
        PLAIN[name](df, views(data))
    else:
        compare(df, views(data), registry.oracle_sql()[name])


@pytest.fixture(scope="module")
def many_series(data, tmp_path_factory):
    """The smallest tables with more than a thousand series: 80 days of each, repeated under other tickers."""
    path = str(tmp_path_factory.mktemp("many"))
    shutil.copy(f"{data}/analyze_prototypes.parquet", path)
    views(data).execute(f"""copy (select b.* replace (b.source_row_number * 250 + k as source_row_number, case when k = 0 then b.ticker else trim(b.ticker) || 'X' || k end as ticker)
        from inspect_schema b, range(250) r(k) where feature_date between date '2023-06-12' and date '2023-08-31') to '{path}/inspect_schema.parquet' (format parquet)""")
    return path


@pytest.mark.parametrize("name", ["alpha_by_offset", "baseline_b2"])
def test_more_than_a_thousand_series(spark, many_series, name):
    con = views(many_series)
    assert con.execute("select count(distinct (source, upper(trim(ticker)))) from inspect_schema").fetchone()[0] > 1_000
    compare(registry.queries()[name](spark, many_series), con, registry.oracle_sql()[name])


def test_entry_has_rows(spark, data):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_every_query_is_held_against_something():
    assert set(registry.oracle_sql()) | set(PLAIN) == set(registry.queries())
