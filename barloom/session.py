"""Session factory and the few places where a plan is cut and written."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one key from which it is handled as hot. The number of hot keys is at most
#: HOT_KEYS whatever the size of the data, because the limit rises with the row count.
HOT_ROWS = 100_000
HOT_KEYS = 1_000


def session(app: str = "barloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the operators expect (UTC, adaptive execution)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or the one set on the context.

    Only where neither is set (tests on one machine) a local folder is made and set.
    """
    sc = spark.sparkContext
    if named := sc.getConf().get("spark.checkpoint.dir", None):
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(named)
        return named
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set; on a cluster it must name a shared folder")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="barloom-"))
    return sc._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a frame to the shared folder and read it back: its lineage ends there, so a lost
    executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by `written` that no plan will read again."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        if files := df.inputFiles():
            folder = sc._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that nothing refers to any more.

    Spark frees them only when the driver happens to collect its garbage; between two large stages
    that may be too late for the executors' disks.  The scheduler still holds the last job, so an
    empty one takes its place first.
    """
    spark.range(1, numPartitions=1).write.format("noop").mode("overwrite").save()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def input_bytes(df: DataFrame) -> int:
    """Bytes of the tables that the plan reads, as far as their sizes are known."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return sum(s for s in sizes if s < 1 << 60)


def gathered(df: DataFrame, *keys: str | Column, size: int, share: int = 256 << 20) -> DataFrame:
    """Rows with equal keys in one partition each.  The partitions number spark.sql.shuffle.partitions,
    or as many as keep `size` bytes at `share` a partition where that is more."""
    least = -(-size // share)
    if least > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return df.repartition(least, *keys)
    return df.repartition(*keys)


def ranged(df: DataFrame, key: str, *, size: int, share: int = 256 << 20) -> DataFrame:
    """Rows in ranges of a key, equal keys together; as many partitions as `gathered` takes."""
    least = -(-size // share)
    if least > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return df.repartitionByRange(least, key)
    return df.repartitionByRange(key)


def spread(df: DataFrame, small: int = 32 << 20) -> DataFrame:
    """A table of one small file is one task, whatever it costs per row: deal its rows to all cores.

    Tables of several files, or of a size that Spark splits by itself, stay as they are.
    """
    if 0 < input_bytes(df) <= small and len(df.inputFiles()) == 1:
        return df.repartition(df.sparkSession.sparkContext.defaultParallelism)
    return df
