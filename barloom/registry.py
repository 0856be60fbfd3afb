"""All general queries and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import anomalies
from barloom.plans import catalog, fitted, forecasts, market, news, representations, selection, targets  # noqa: F401  (plans register their queries)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomalies.bad_bars(table(spark, sf_dir, "inspect_schema"), "source_row_number").select(F.col("id").alias("source_row_number"))


def p5_flags_by_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomalies.flags_by_series(table(spark, sf_dir, "inspect_schema"), "source_row_number")


def p5_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomalies.fenced_bars(table(spark, sf_dir, "inspect_schema"), "source_row_number").withColumnRenamed("id", "source_row_number")


# The definitions written out: frozen runs by the ranks of dates, spikes by a walk over each series' closes.
P5 = f"""WITH RECURSIVE k AS (SELECT source_row_number AS id, upper(trim(source)) AS so, upper(trim(ticker)) AS ti, upper(trim(source)) || '/' || upper(trim(ticker)) AS s, CAST(feature_date AS DATE) AS d, {", ".join(f'CASE WHEN isnan("{c}") THEN NULL ELSE "{c}" END AS "{c}"' for c in anomalies.FIELDS)} FROM inspect_schema),
  kn AS (SELECT * FROM k WHERE s IS NOT NULL AND d IS NOT NULL),
  im AS (SELECT id FROM k WHERE "open" <= 0 OR high <= 0 OR low <= 0 OR "close" <= 0 OR high < "open" OR high < low OR high < "close" OR low > "open" OR low > high OR low > "close"),
  fv AS (SELECT DISTINCT s, d, f, v FROM ({" UNION ALL ".join(f"SELECT s, d, '{c}' AS f, {chr(34)}{c}{chr(34)} AS v FROM kn" for c in anomalies.FIELDS)}) WHERE v IS NOT NULL),
  fd AS (SELECT s, f, d, row_number() OVER (PARTITION BY s, f ORDER BY d) AS p FROM (SELECT DISTINCT s, f, d FROM fv)),
  fr AS (SELECT *, p - row_number() OVER (PARTITION BY s, f, v ORDER BY p) AS island FROM fv JOIN fd USING (s, f, d)),
  fz AS (SELECT s, d, f, v FROM (SELECT *, count(*) OVER (PARTITION BY s, f, v, island) AS run FROM fr) WHERE run >= 6),
  fo AS ({" UNION ".join(f"SELECT id FROM kn JOIN fz ON fz.s = kn.s AND fz.d = kn.d AND f = '{c}' AND v = kn.{chr(34)}{c}{chr(34)}" for c in anomalies.FIELDS)}),
  dc AS (SELECT s, d, ln(arg_min("close", id)) AS x FROM kn WHERE "close" > 0 GROUP BY s, d), ls AS (SELECT s, list(x ORDER BY d) AS x, list(d ORDER BY d) AS ds, count(*) AS n FROM dc GROUP BY s HAVING count(*) >= 3),
  lm AS (SELECT *, 15 * list_aggregate(list_transform(range(1, n), lambda j: abs(x[j + 1] - x[j])), 'median') AS reach FROM ls),
  wk AS (SELECT s, 1::BIGINT AS i, x[1] AS base, NULL::BIGINT AS a, NULL::BIGINT AS b, NULL::DOUBLE AS l, NULL::DOUBLE AS r FROM lm
    UNION ALL SELECT s, CASE WHEN near OR back IS NULL THEN i + 1 ELSE back + 1 END, CASE WHEN near OR back IS NULL THEN x[i + 1] ELSE x[back + 1] END, CASE WHEN NOT near AND back IS NOT NULL THEN i END, CASE WHEN NOT near THEN back END, base, CASE WHEN NOT near THEN x[back + 1] END
    FROM (SELECT *, abs(x[i + 1] - base) <= reach AS near, coalesce(list_filter(ends, lambda j: abs(x[j + 1] - base) <= reach)[1], list_filter(ends, lambda j: (j = n - 1 OR abs(x[j + 2] - x[j + 1]) <= reach) AND list_min(list_transform(range(i, j), lambda q: abs(x[q + 1] - x[j + 1]))) > reach)[1]) AS back
      FROM (SELECT wk.s, i, base, x, n, reach, range(i + 1, least(i + 3, n - 1) + 1) AS ends FROM wk JOIN lm ON lm.s = wk.s WHERE i < n - 1))),
  bd AS (SELECT wk.s, q.q FROM wk JOIN lm ON lm.s = wk.s, LATERAL (SELECT unnest(range(a, b)) AS q) q WHERE a IS NOT NULL AND NOT (abs(x[q.q + 1] - l) <= reach OR abs(x[q.q + 1] - r) <= reach)),
  ok AS (SELECT lm.s, ds[q.q + 1] AS od, x[q.q + 1] AS ox FROM lm, LATERAL (SELECT unnest(range(n)) AS q) q WHERE NOT EXISTS (SELECT 1 FROM bd WHERE bd.s = lm.s AND bd.q = q.q)),
  ed AS (SELECT s, min(d) AS low_d, max(d) AS high_d FROM kn GROUP BY s),
  nb AS (SELECT id, any_value(kn.s) AS s, arg_max(ox, od) FILTER (WHERE od < d) AS before, arg_min(ox, od) FILTER (WHERE od > d) AS after FROM kn JOIN ok ON ok.s = kn.s GROUP BY id),
  sp AS (SELECT DISTINCT kn.id FROM kn JOIN nb ON nb.id = kn.id JOIN lm ON lm.s = kn.s JOIN ed ON ed.s = kn.s, LATERAL (VALUES ("open"), (high), (low), ("close")) pr(p) WHERE d > low_d AND d < high_d AND p > 0 AND abs(ln(p) - before) > reach AND abs(ln(p) - after) > reach)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**catalog.QUERIES, **{f.__name__: f for f in (p5_found, p5_flags_by_series, p5_fences)}}


def oracle_sql() -> dict[str, str]:
    return catalog.SQL | {
        "p5_found": f"{P5} SELECT id AS source_row_number FROM im UNION SELECT id FROM fo UNION SELECT id FROM sp",
        "p5_flags_by_series": f"""{P5} SELECT so AS source, ti AS ticker, count(*) AS n_rows, count(*) FILTER (WHERE id IN (SELECT id FROM fo)) AS n_frozen, count(*) FILTER (WHERE id IN (SELECT id FROM sp)) AS n_spikes, count(*) FILTER (WHERE id IN (SELECT id FROM im)) AS n_impossible FROM k GROUP BY ALL""",
    }
