"""Session settings and tables that outlive executors."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

_local_dir: str | None = None
_written: list[str] = []


def local_session(cpus: int | str = "*", memory: str = "16g", **conf) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own session."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("parcelwise")
    settings = {
        **SESSION_CONF,
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named in spark.checkpoint.dir.

    Only a local master may fall back to a folder of its own.
    """
    global _local_dir
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="parcelwise-")
    return _local_dir


def new_path(spark: SparkSession) -> str:
    """An unused path in the shared folder, which `release` deletes."""
    path = f"{shared_dir(spark)}/parcelwise-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def durable(df: DataFrame) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back.

    Used where later steps must see the same rows again (sampled range cuts,
    repeated passes). A written table survives lost executors, keeps column
    pruning, and its file size lets Spark itself choose or refuse a broadcast.
    """
    spark = df.sparkSession
    path = new_path(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts_for(spark: SparkSession, size: int, per_task: int) -> int | None:
    """Partitions for a shuffle of `size` in portions of `per_task`, so that a task's memory stays
    the same as data grows; None where no more than the cores are needed and Spark may choose.

    Never fewer than the session's own number: adaptive plans may shuffle both sides of a join once more to have that.
    """
    parts = -(-size // per_task)
    if parts <= spark.sparkContext.defaultParallelism:
        return None
    return max(parts, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """`df` dealt by keys in so many partitions; joins, groups and windows on these keys take them as they are."""
    return df.repartition(parts, *keys) if parts else df


def release(spark: SparkSession) -> None:
    """Delete what this process wrote at paths of `new_path`, as `durable` does. Frames that read them end too."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)


def small_table(spark: SparkSession, columns: dict[str, list]) -> DataFrame:
    """A constant table. From Arrow it becomes a local relation, whose known size
    lets Spark broadcast it without a hint."""
    return spark.createDataFrame(pa.table(columns))
