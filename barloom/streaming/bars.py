"""Bars from a stream of measurements (an extension: the batch operators have no streaming counterpart)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.session import shared_dir


def windowed_bars(stream: DataFrame, entity: str, ts: str, value: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Open, high, low, close and count per entity and tumbling window; rows later than `late` are dropped.

    Works on a stream (append mode, with the watermark as bound of the state) and on a batch alike.
    """
    timed = stream.withColumn("__ts", F.col(ts).cast("timestamp"))
    timed = timed.withWatermark("__ts", late) if stream.isStreaming else timed
    return timed.groupBy(F.window("__ts", width).alias("w"), F.col(entity).alias("entity")).agg(
        F.min_by(value, "__ts").alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, "__ts").alias("close"), F.count("*").alias("n_rows")
    ).select("entity", F.col("w.start").alias("start"), "open", "high", "low", "close", "n_rows")


def run_once(spark: SparkSession, path: str, schema: str, **how) -> DataFrame:
    """Stream everything that is there now into a table of the shared folder and return that table.

    Windows that the watermark has not closed when the input ends are not part of it; see `run_whole`.
    """
    at = f"{shared_dir(spark)}/bars-{uuid.uuid4().hex}"
    bars = windowed_bars(spark.readStream.schema(schema).parquet(path), **how)
    query = bars.writeStream.format("parquet").option("path", f"{at}/table").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(bars.schema).parquet(f"{at}/table")


def run_whole(spark: SparkSession, path: str, schema: str, **how) -> DataFrame:
    """The streamed table, and for a finite input also the windows that were still open at its end.

    Those come from the same files as a batch, so that events of a closed window that came too late
    for the stream change nothing.
    """
    closed = run_once(spark, path, schema, **how)
    whole = windowed_bars(spark.read.schema(schema).parquet(path), **how)
    end = closed.agg(F.max("start").alias("closed"))
    rest = whole.crossJoin(F.broadcast(end)).filter("closed is null or start > closed").drop("closed")
    return closed.unionByName(rest)
