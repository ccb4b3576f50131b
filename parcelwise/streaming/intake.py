"""The backlog batch as a stream: new return files are triaged once each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def triage_new_returns(
    spark: SparkSession,
    source: str,
    schema,
    decide: Callable[[DataFrame], DataFrame],
    log_path: str,
    queue_path: str,
    checkpoint: str,
) -> StreamingQuery:
    """Triage all return files not seen yet, then stop.

    decide: plan from a micro-batch of returns to decision records; it joins the
    stored tables for history. The stream checkpoint remembers the files read. Each
    micro-batch writes to its own folder, so a repeated batch replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        records = decide(batch.dropDuplicates(["return_id"])).persist()
        try:
            records.write.mode("overwrite").json(f"{log_path}/batch={number}")
            records.where("outputs.verdict = 'Escalate'").write.mode("overwrite").json(
                f"{queue_path}/batch={number}"
            )
        finally:
            records.unpersist()

    return (
        spark.readStream.schema(schema)
        .parquet(source)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
