"""Queries p1 to p9 (without p5, which is general) over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import clusters, layout, mixing, neardup, packing, residue, spans, tokens
from barloom.session import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _split_sides(events: DataFrame) -> DataFrame:
    split = F.lower(F.trim("split"))
    return events.withColumn("side", F.when(split == "train", 1).when(split.isin("validation", "test"), 2).otherwise(0))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _split_sides(table(spark, sf_dir, "analyze_prototypes"))
    near = neardup.near_duplicates(events, "event_id", "text", width=3, threshold=0.6, side_col="side")
    return neardup.overlapping(near).select(F.col("id").alias("event_id"))


def p1_by_split_and_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "analyze_prototypes")
    keys = events.select("event_id", F.lower(F.trim("split")).alias("split"), "source").filter("split in ('validation', 'test')")
    found = p1_found(spark, sf_dir).withColumn("hit", F.lit(1))
    return keys.join(found, "event_id", "left").groupBy("split", "source").agg(F.count("*").alias("n_events"), F.count("hit").alias("n_overlapping"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clusters.vector_clusters(table(spark, sf_dir, "event_vectors"), "event_id", "embedding", threshold=0.7)
    return clusters.memberships(found).filter("id <> first_id").select(F.col("first_id").alias("first_event_id"), F.col("id").alias("event_id"))


def p2_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clusters.vector_clusters(table(spark, sf_dir, "event_vectors"), "event_id", "embedding", threshold=0.7)
    out = clusters.describe(found)
    cosines = [F.round(F.get("typical_cosines", F.lit(k)), 7).alias(f"cosine_{k + 1}") for k in range(3)]
    return out.select(F.col("first_id").alias("first_event_id"), "n_members", F.array_join("typical_ids", ",").alias("typical_ids"), *cosines)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "analyze_prototypes")
    near = neardup.near_duplicates(events, "event_id", "text", width=3, threshold=0.6)
    return neardup.all_pairs(near).select(F.col("id_a").alias("event_id_a"), F.col("id_b").alias("event_id_b"))


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "analyze_prototypes")
    near = neardup.near_duplicates(events, "event_id", "text", width=3, threshold=0.6)
    return neardup.groups(near).withColumnRenamed("id", "event_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = residue.residue(table(spark, sf_dir, "inspect_schema"), "source_row_number", "text")
    return found.select(F.col("id").alias("source_row_number"))


def p4_by_source_and_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = table(spark, sf_dir, "inspect_schema")
    found = residue.residue(bars, "source_row_number", "text").withColumnRenamed("id", "source_row_number")
    return found.join(bars.select("source_row_number", "source"), "source_row_number").groupBy("source", "kind").agg(F.count("*").alias("n_rows"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, members = layout.layout_duplicates(table(spark, sf_dir, "analyze_prototypes"), "event_id", "text")
    return layout.copies(kept, members).select(F.col("kept").alias("kept_event_id"), F.col("id").alias("copy_event_id"))


def p6_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event per text with its number of copies; texts that stand once are listed with 1."""
    kept, members = layout.layout_duplicates(table(spark, sf_dir, "analyze_prototypes"), "event_id", "text")
    gone = layout.copies(kept, members).select("id")
    counts = kept.select(F.col("kept").alias("id"), "n_copies")
    alone = members.select("id").distinct().join(gone, "id", "left_anti").join(counts, "id", "left")
    return alone.select(F.col("id").alias("event_id"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"))


def _limits(spark: SparkSession, sf_dir: str) -> dict[str, int]:
    return {r.limit_name: r.capacity_tokens for r in table(spark, sf_dir, "pack_limits").collect()}


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = written(tokens.token_counts(table(spark, sf_dir, "documents"), ["doc_id"], "text"), "sizes")
    return packing.pack(sizes, _limits(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def p7_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fills(p7_packed(spark, sf_dir), _limits(spark, sf_dir))


def p7_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of a packing, per capacity: every document whole in it, none cut that fits, no
    container over its capacity, none left half empty beside another one."""
    limits = _limits(spark, sf_dir)
    packed = written(p7_packed(spark, sf_dir), "packed")
    sizes = tokens.token_counts(table(spark, sf_dir, "documents"), ["doc_id"], "text")
    whole = packed.groupBy("limit_name", "doc_id").agg(F.sum("n_tokens").alias("placed"), F.count("*").alias("n_pieces"))
    names = F.broadcast(spark.createDataFrame([(k, int(v)) for k, v in limits.items()], "limit_name string, capacity long"))
    both = sizes.crossJoin(names).join(whole, ["limit_name", "doc_id"], "left")  # one row per capacity
    docs = both.groupBy("limit_name").agg(F.count("*").alias("n_documents"), F.count_if(F.coalesce("placed", F.lit(-1)) != F.col("n_tokens")).alias("n_not_whole"), F.count_if((F.col("n_tokens") <= F.col("capacity")) & (F.col("n_pieces") > 1)).alias("n_cut_in_vain"))
    filled = packing.fills(packed, limits).groupBy("limit_name").agg(F.count_if(F.col("fill") > 1).alias("n_over_capacity"), (F.count_if(F.col("fill") <= 0.5) <= 1).alias("at_most_one_half_empty"))
    return docs.join(filled, "limit_name")


def p8_drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = written(tokens.token_counts(table(spark, sf_dir, "documents"), ["doc_id", "source"], "text"), "sizes")
    return mixing.mix(sizes, table(spark, sf_dir, "mixture_targets")).withColumnRenamed("id", "doc_id")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(p8_drawn(spark, sf_dir).withColumnRenamed("doc_id", "id"), table(spark, sf_dir, "mixture_targets"))


def p8_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of a drawing, per listed source with documents: repeats within their cap, no
    document twice in an epoch, and the reached share within one document of the target."""
    targets = table(spark, sf_dir, "mixture_targets")
    drawn = written(p8_drawn(spark, sf_dir), "drawn").withColumnRenamed("doc_id", "id")
    shares = mixing.shares(drawn, targets)
    total, largest = drawn.agg(F.sum("n_tokens"), F.max("n_tokens")).first()
    twice = drawn.groupBy("source", "id", "epoch").agg(F.count("*").alias("n")).groupBy("source").agg(F.max("n").alias("most_per_epoch"))
    room = F.lit(2.0 * (largest or 0) / (total or 1))
    have = table(spark, sf_dir, "documents").filter("text is not null").select("source").distinct()
    rows = shares.join(have, "source", "left_semi").join(twice, "source", "left")
    return rows.select("source", "target_share", (F.col("most_repeats") <= F.col("max_repeats")).alias("within_repeats"), (F.coalesce("most_per_epoch", F.lit(0)) <= 1).alias("once_an_epoch"), (F.abs(F.col("reached_share") - F.col("target_share")) <= room).alias("near_target"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = spans.shared_spans(table(spark, sf_dir, "documents"), "doc_id", "text", length=200)
    return spans.sharing_pairs(shared).select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = spans.shared_spans(table(spark, sf_dir, "documents"), "doc_id", "text", length=200, pairs=False)
    return spans.shared_shares(shared).withColumnRenamed("id", "doc_id")


def p9_shares_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares of every document, those shorter than a run included."""
    docs = table(spark, sf_dir, "documents")
    return spans.all_shares(spans.shared_spans(docs, "doc_id", "text", length=200, pairs=False), docs, "doc_id", "text", length=200).withColumnRenamed("id", "doc_id")


def p9_repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.repeated_lines(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_by_split_and_source, p2_found, p2_clusters, p3_found, p3_groups, p4_found, p4_by_source_and_kind, p6_found, p6_kept, p7_packed, p7_fills, p7_audit, p8_drawn, p8_shares, p8_audit, p9_found, p9_shares, p9_shares_all, p9_repeated_lines)}


# The words of a text: runs of letters and digits, and a point or comma directly between two digits.
WORDS = r"[\p{L}\p{N}]*\p{Nd}(?:[.,]\p{Nd}(?:[\p{L}\p{N}]*\p{Nd})?)*[\p{L}\p{N}]*|[\p{L}\p{N}]+"


def _words(of: str) -> str:
    return f"regexp_extract_all(lower({of}), '{WORDS}')"


GRAMS = f"""t AS (SELECT event_id, lower(trim(split)) AS split, {_words('text')} AS w FROM analyze_prototypes WHERE text IS NOT NULL),
g AS (SELECT DISTINCT event_id, split, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE concat_ws(' ', w[i], w[i + 1], w[i + 2]) END AS s
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT event_id, count(*) AS n FROM g GROUP BY event_id)"""


def oracle_sql() -> dict[str, str]:
    near2 = """v AS MATERIALIZED (SELECT DISTINCT event_id, embedding::DOUBLE[] AS e FROM event_vectors WHERE embedding IS NOT NULL AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
          e AS MATERIALIZED (SELECT a.event_id AS x, b.event_id AS y FROM v a JOIN v b ON a.event_id <> b.event_id AND list_cosine_similarity(a.e, b.e) >= 0.7),
          cc(x, y) AS (SELECT event_id, event_id FROM v UNION SELECT cc.x, e.y FROM cc JOIN e ON cc.y = e.x)"""
    near = "JOIN n na ON na.event_id = x JOIN n nb ON nb.event_id = y WHERE 10 * c >= 6 * (na.n + nb.n - c)"
    p1 = f"""WITH {GRAMS}, pr AS (SELECT a.event_id AS x, b.event_id AS y, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.split IN ('validation', 'test') AND b.split = 'train' GROUP BY ALL),
      found AS (SELECT DISTINCT x AS event_id FROM pr {near})"""
    parts = f"list_filter(string_split_regex(text, '[|;\\r\\n\\x0b\\x0c\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda x: len({_words('x')}) > 0)"
    p6 = f"""WITH p AS (SELECT event_id, text, {parts} AS parts FROM analyze_prototypes WHERE text IS NOT NULL),
      f AS (SELECT *, len(parts) > 1 AND len(list_filter(parts, lambda x: contains(x, ':') AND len({_words("split_part(x, ':', 1)")}) > 0)) = len(parts) AS fields FROM p),
      c AS (SELECT event_id, CASE WHEN fields THEN array_to_string(list_sort(list_transform(parts, lambda x: array_to_string({_words('x')}, ' '))), '|') ELSE array_to_string({_words('text')}, ' ') END AS canon FROM f),
      k AS (SELECT *, min(event_id) OVER (PARTITION BY canon) AS kept, count(*) OVER (PARTITION BY canon) AS n_copies FROM c WHERE canon <> '')"""
    p9 = """WITH w AS (SELECT DISTINCT doc_id, hash(substr(text, i, 200)) AS h FROM (SELECT doc_id, text, unnest(range(1, len(text) - 198)) AS i FROM documents WHERE len(text) >= 200))"""
    return {
        "p1_found": f"{p1} SELECT event_id FROM found",
        "p1_by_split_and_source": f"""{p1} SELECT lower(trim(split)) AS split, source, count(*) AS n_events, count(found.event_id) AS n_overlapping
          FROM analyze_prototypes LEFT JOIN found USING (event_id) WHERE lower(trim(split)) IN ('validation', 'test') GROUP BY ALL""",
        "p2_found": f"""WITH RECURSIVE {near2}
          SELECT min(y) AS first_event_id, x AS event_id FROM cc GROUP BY x HAVING min(y) <> x""",
        "p3_found": f"WITH {GRAMS}, pr AS (SELECT a.event_id AS x, b.event_id AS y, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.event_id < b.event_id GROUP BY ALL) SELECT x AS event_id_a, y AS event_id_b FROM pr {near}",
        "p2_clusters": f"""WITH RECURSIVE {near2}, me AS MATERIALIZED (SELECT min(y) AS first, x AS event_id FROM cc GROUP BY x), sz AS (SELECT first, count(*) AS n FROM me GROUP BY first HAVING count(*) > 1), vu AS MATERIALIZED (SELECT first, event_id, e, list_transform(e, lambda q: q / sqrt(list_dot_product(e, e))) AS u FROM me JOIN v USING (event_id)),
          mu AS MATERIALIZED (SELECT first, list(t ORDER BY i) AS m FROM (SELECT first, i, sum(q) AS t FROM (SELECT first, generate_subscripts(u, 1) AS i, unnest(u) AS q FROM vu) GROUP BY ALL) GROUP BY first),
          rk AS (SELECT first, n, event_id, round(list_cosine_similarity(e, m), 9) AS c, row_number() OVER (PARTITION BY first ORDER BY round(list_cosine_similarity(e, m), 9) DESC, event_id) AS k FROM vu JOIN mu USING (first) JOIN sz USING (first))
          SELECT first AS first_event_id, max(n) AS n_members, string_agg(event_id, ',' ORDER BY k) AS typical_ids, {", ".join(f"round(max(c) FILTER (WHERE k = {j}), 7) AS cosine_{j}" for j in (1, 2, 3))} FROM rk WHERE k <= 3 GROUP BY first""",
        "p3_groups": f"""WITH RECURSIVE {GRAMS}, cl AS (SELECT event_id, md5(string_agg(s, '|' ORDER BY s)) AS print FROM g GROUP BY event_id), pr AS (SELECT a.event_id AS x, b.event_id AS y, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.event_id < b.event_id GROUP BY ALL), near AS (SELECT x, y FROM pr {near}),
          ed AS (SELECT x, y FROM near UNION ALL SELECT y, x FROM near), cc(x, y) AS (SELECT event_id, event_id FROM n UNION SELECT cc.x, ed.y FROM cc JOIN ed ON cc.y = ed.x), gr AS (SELECT x AS event_id, min(y) AS group_id, count(*) AS group_size FROM cc GROUP BY x),
          lk AS (SELECT a.print, count(DISTINCT b.print) AS n_links FROM ed JOIN cl a ON a.event_id = ed.x JOIN cl b ON b.event_id = ed.y WHERE a.print <> b.print GROUP BY a.print), cn AS (SELECT print, count(*) AS n_copies FROM cl GROUP BY print)
          SELECT event_id, group_id, group_size, coalesce(n_links, 0) AS n_links, n_copies FROM gr JOIN cl USING (event_id) JOIN cn USING (print) LEFT JOIN lk USING (print)""",
        "p7_audit": "SELECT limit_name, (SELECT count(*) FROM documents WHERE text IS NOT NULL) AS n_documents, 0::BIGINT AS n_not_whole, 0::BIGINT AS n_cut_in_vain, 0::BIGINT AS n_over_capacity, true AS at_most_one_half_empty FROM pack_limits",
        "p8_audit": "SELECT source, target_share, true AS within_repeats, true AS once_an_epoch, true AS near_target FROM mixture_targets WHERE source IN (SELECT source FROM documents WHERE text IS NOT NULL)",
        "p9_repeated_lines": r"""WITH li AS (SELECT doc_id, generate_subscripts(parts, 1) AS k, unnest(parts) AS raw FROM (SELECT doc_id, string_split(replace(text, chr(13), chr(10)), chr(10)) AS parts FROM documents WHERE text IS NOT NULL)),
          pl AS (SELECT *, sum(len(raw) + 1) OVER (PARTITION BY doc_id ORDER BY k) - len(raw) - 1 AS start, count(*) FILTER (WHERE raw <> '') OVER (PARTITION BY doc_id ORDER BY k) - 1 AS line FROM li),
          un AS (SELECT *, trim(regexp_replace(lower(raw), '[\t-\r\x{1c}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')) AS unit FROM pl WHERE raw <> ''),
          ct AS (SELECT *, count(*) OVER (PARTITION BY unit) AS n_copies, row_number() OVER (PARTITION BY unit ORDER BY doc_id, line) AS place FROM un WHERE unit <> '')
          SELECT doc_id, line::BIGINT AS line, start::BIGINT AS start, (start + len(raw))::BIGINT AS stop, n_copies, place = 1 AS kept FROM ct WHERE n_copies > 1""",
        "p6_found": f"{p6} SELECT kept AS kept_event_id, event_id AS copy_event_id FROM k WHERE event_id <> kept",
        "p6_kept": f"{p6} SELECT event_id, n_copies FROM k WHERE event_id = kept",
        "p9_found": f"{p9} SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM w a JOIN w b ON a.h = b.h AND a.doc_id < b.doc_id",
        "p9_shares": """WITH o AS (SELECT doc_id, i, hash(substr(text, i, 200)) AS h FROM (SELECT doc_id, text, unnest(range(1, len(text) - 198)) AS i FROM documents WHERE len(text) >= 200)),
          s AS (SELECT h FROM (SELECT DISTINCT doc_id, h FROM o) GROUP BY h HAVING count(*) > 1),
          iv AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM o SEMI JOIN s USING (h)),
          c AS (SELECT doc_id, sum(least(coalesce(gap, 200), 200)) AS covered FROM iv GROUP BY doc_id),
          d AS (SELECT doc_id, len(text) AS n_chars, count(*) OVER (PARTITION BY text) AS n_copies FROM documents WHERE len(text) >= 200)
          SELECT doc_id, n_chars, coalesce(covered, 0)::BIGINT AS shared_chars, n_copies, coalesce(covered, 0) / n_chars AS shared_share FROM d LEFT JOIN c USING (doc_id)""",
        "p9_shares_all": """WITH o AS (SELECT doc_id, i, hash(substr(text, i, 200)) AS h FROM (SELECT doc_id, text, unnest(range(1, len(text) - 198)) AS i FROM documents WHERE len(text) >= 200)),
          s AS (SELECT h FROM (SELECT DISTINCT doc_id, h FROM o) GROUP BY h HAVING count(*) > 1),
          iv AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM o SEMI JOIN s USING (h)),
          c AS (SELECT doc_id, sum(least(coalesce(gap, 200), 200)) AS covered FROM iv GROUP BY doc_id),
          d AS (SELECT doc_id, len(text) AS n_chars, count(*) OVER (PARTITION BY text) AS n_copies FROM documents WHERE text IS NOT NULL)
          SELECT doc_id, n_chars, coalesce(covered, 0)::BIGINT AS shared_chars, n_copies, coalesce(coalesce(covered, 0) / nullif(n_chars, 0), 0) AS shared_share FROM d LEFT JOIN c USING (doc_id)""",
    }
