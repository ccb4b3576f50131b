"""Restartable batches over the backlog of undecided returns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from parcelwise.functions.columns import blank_to_null
from parcelwise.operators.profile import verdict_summary
from parcelwise.operators.text import audit_record
from parcelwise.plans.triage import case_record_fields, restrict_to, split_valid
from parcelwise.session import durable
from parcelwise.sources.files import (
    append_decisions, append_escalations, log_exists, read_decision_log,
)
from parcelwise.sources.schema import Tables


def next_batch(returns: DataFrame, processed: DataFrame, n: int) -> DataFrame:
    """The n newest returns that are not processed yet."""
    if n < 1:
        raise ValueError("batch size must be at least 1")
    return (
        returns.select("return_id", "return_request_date")
        .join(processed.select("return_id"), "return_id", "left_anti")
        .orderBy(F.desc("return_request_date"), "return_id")
        .limit(n)
    )


def with_probes(returns: DataFrame, probes: DataFrame) -> DataFrame:
    """Add image_path and custom_reason of the first probe (by case id) of each return.

    Probes are reduced per return before the join; blanks count as missing.
    """
    first = probes.groupBy(F.col("assigned_return_id").alias("return_id")).agg(
        F.min(F.struct("case_id", "image_path", "customer_custom_text")).alias("p")
    )
    return returns.join(
        first.select(
            "return_id",
            blank_to_null(F.col("p.image_path")).alias("image_path"),
            blank_to_null(F.col("p.customer_custom_text")).alias("custom_reason"),
        ),
        "return_id",
        "left",
    )


def run_batch(
    tables: Tables,
    log_path: str,
    queue_path: str,
    n: int,
    decide: Callable[[Tables], DataFrame],
    stamp: str,
    probes: DataFrame | None = None,
) -> DataFrame:
    """Decide the next n returns, append them to the log, and count the verdicts.

    decide: plan from tables to decided cases with verdict, confidence, reasoning,
    risk_score and rule_score. probes: texts and pictures to attach to the cases. Rows
    unfit for triage are logged with the verdict Invalid and their faults as reasoning, so
    they are not drawn again. Running again after a failure repeats only returns that are
    not in the log; the queue follows the log and gets every escalation it lacks.
    """
    spark = tables.returns.sparkSession
    if log_exists(spark, log_path):
        processed = read_decision_log(spark, log_path).select("return_id")
    else:
        processed = spark.createDataFrame([], "return_id string")
    batch = durable(next_batch(tables.returns, processed, n))
    decided = decide(restrict_to(tables, batch)).join(batch.select("return_id"), "return_id", "left_semi")
    if probes is not None:
        decided = with_probes(decided, probes)
    valid, rejected = split_valid(decided)
    told = rejected.withColumns({"verdict": F.lit("Invalid"), "confidence": F.lit("0.0"), "reasoning": F.col("faults")})
    unfit = audit_record(told, case_record_fields(told), F.lit(stamp))
    records = durable(
        audit_record(
            valid.withColumn("confidence", F.col("confidence").cast("string")),
            case_record_fields(valid),
            F.lit(stamp),
        ).unionByName(unfit)
    )
    append_decisions(records, log_path)
    logged = read_decision_log(spark, log_path)
    if log_exists(spark, queue_path):
        logged = logged.join(read_decision_log(spark, queue_path).select("return_id"), "return_id", "left_anti")
    append_escalations(durable(logged), queue_path)
    return verdict_summary(records.select(F.col("outputs.verdict").alias("verdict")))
