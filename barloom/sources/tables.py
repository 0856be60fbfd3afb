"""Reading, writing and finding tables; caches as anti joins; schema resolution on the driver."""

from __future__ import annotations

import re
from functools import reduce
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = {".parquet": "parquet", ".csv": "csv", ".json": "json", ".jsonl": "jsonl", ".ndjson": "jsonl"}


def read_table(spark: SparkSession, path: str, *, columns: list[str] | None = None, schema: str | None = None) -> DataFrame:
    """Read by suffix: parquet, csv (with header), json (one array or object) or jsonl.

    Without a schema csv columns are strings (no inference pass over the data).  An unknown suffix is an
    error.
    """
    kind = FORMATS.get(PurePosixPath(path.rstrip("/")).suffix.lower())
    if kind is None:
        raise ValueError(f"unsupported table format: {path}")
    reader = spark.read.schema(schema) if schema else spark.read
    if kind == "csv":
        df = reader.option("header", True).csv(path)
    elif kind == "json":
        df = reader.option("multiLine", True).json(path)
    else:
        df = reader.json(path) if kind == "jsonl" else reader.parquet(path)
    return df.select(*columns) if columns else df


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Write by suffix (parquet or csv); Spark's commit protocol makes the result appear at once."""
    kind = FORMATS.get(PurePosixPath(path.rstrip("/")).suffix.lower())
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if kind == "parquet":
        writer.parquet(path)
    elif kind == "csv":
        writer.option("header", True).csv(path)
    else:
        raise ValueError(f"unsupported table format: {path}")


def discover(candidates: list[str], preferred: list[str], configured: str | None = None) -> str:
    """The configured path, else the first preferred name present, else the only candidate."""
    if configured:
        return configured
    by_name = {PurePosixPath(c).name: c for c in candidates}
    for name in preferred:
        if name in by_name:
            return by_name[name]
    if len(candidates) == 1:
        return candidates[0]
    raise ValueError(f"expected one table, found {len(candidates)}: {sorted(by_name)}")


def first_existing(spark: SparkSession, paths: list[str]) -> str:
    """The first path that exists on its file system."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(conf).exists(path):
            return p
    raise FileNotFoundError(", ".join(paths))


def tagged_union(parts: dict[str, DataFrame], tag: str = "split") -> DataFrame:
    """Rows of all parts with the name of theirs; columns a part lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (df.withColumn(tag, F.lit(name)) for name, df in parts.items()))


def plain(name: str) -> str:
    return re.sub(r"[^a-z0-9]", "", name.lower())


def resolve_columns(columns: list[str], wanted: dict[str, dict], overrides: dict[str, str] | None = None) -> dict[str, str]:
    """Column of each wanted field: override, then alias (punctuation and case apart), then full pattern.

    `wanted` maps a field to {aliases, pattern, required}.  More than one hit of a step, or none for a
    required field, is an error.
    """
    out: dict[str, str] = {}
    for field, rule in wanted.items():
        if field in (overrides or {}):
            if overrides[field] not in columns:
                raise ValueError(f"{field}: no column {overrides[field]}")
            out[field] = overrides[field]
            continue
        names = {plain(a) for a in [field, *rule.get("aliases", ())]}
        hits = [c for c in columns if plain(c) in names]
        if not hits and rule.get("pattern"):
            hits = [c for c in columns if re.fullmatch(rule["pattern"], c, re.I)]
        if len(hits) > 1:
            raise ValueError(f"{field}: ambiguous columns {hits}")
        if hits:
            out[field] = hits[0]
        elif rule.get("required", True):
            raise ValueError(f"{field}: no column found")
    return out


def news_columns(columns: list[str], patterns: dict[str, str]) -> dict[str, list[str]]:
    """Columns of each news level in natural order; a column of two levels is an error."""

    def natural(c: str) -> list:
        return [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", c)]

    out = {level: sorted((c for c in columns if re.search(p, c, re.I)), key=natural) for level, p in patterns.items()}
    seen: dict[str, str] = {}
    for level, names in out.items():
        for c in names:
            if c in seen:
                raise ValueError(f"column {c} belongs to {seen[c]} and {level}")
            seen[c] = level
    return out


def feature_columns(df: DataFrame, prefix: str = "", exclude: tuple[str, ...] = (), level: str | None = None) -> list[str]:
    """Numeric columns by prefix, without excluded tokens, optionally of one news level."""
    numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    return [f.name for f in df.schema.fields if f.dataType.simpleString() in numeric and f.name.startswith(prefix) and not any(t in f.name for t in exclude) and (level is None or f"__{level}__" in f.name)]


def cache_misses(items: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Items whose key the cache lacks: what remains to be computed."""
    return items.join(cache.select(*keys).distinct(), keys, "left_anti")


def from_cache(items: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Items with their cached values; a repeated cache row counts once."""
    return items.join(cache.dropDuplicates(keys), keys)
