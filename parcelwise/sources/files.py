"""Policy files, decision logs and dataset exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from parcelwise.sources.schema import DECISION_LOG


def read_policy_docs(spark: SparkSession, path: str) -> DataFrame:
    """One row per .md file: source (file name) and its whole text."""
    return (
        spark.read.option("pathGlobFilter", "*.md")
        .text(path, wholetext=True)
        .select(F.col("_metadata.file_name").alias("source"), F.col("value").alias("text"))
    )


def read_decision_log(spark: SparkSession, path: str) -> DataFrame:
    """Decisions of a JSON-lines log. Blank and broken lines, and records without an
    id, are skipped; a bare NaN is read as NaN."""
    return (
        spark.read.schema(DECISION_LOG)
        .option("mode", "DROPMALFORMED")
        .json(path)
        .where(F.col("return_id").isNotNull())
    )


def log_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def append_decisions(records: DataFrame, path: str) -> None:
    """Add records to a JSON-lines log. Its lines repeat much, so files are compressed."""
    records.write.mode("append").option("compression", "gzip").json(path)


def append_escalations(records: DataFrame, path: str) -> None:
    append_decisions(records.where(F.col("outputs.verdict") == "Escalate"), path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_split(matrix: DataFrame, path: str) -> None:
    """Train and test datasets, one folder per split."""
    matrix.write.mode("overwrite").partitionBy("split").parquet(path)
