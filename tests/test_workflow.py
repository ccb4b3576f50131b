"""Files, restartable batches, single cases and the file stream."""

import json

import pytest
from pyspark.sql import functions as F

from parcelwise.operators.text import audit_record
from parcelwise.plans import backlog, triage
from parcelwise.plans.catalog import confidence, documented
from parcelwise.session import durable, shared_dir
from parcelwise.sources import files
from parcelwise.sources.mart import mart
from parcelwise.streaming.intake import triage_new_returns


def test_policy_docs(spark, tmp_path):
    (tmp_path / "b.md").write_text("# B\n\nline", encoding="utf-8")
    (tmp_path / "a.md").write_text("é", encoding="utf-8")
    (tmp_path / "c.txt").write_text("no")
    rows = files.read_policy_docs(spark, str(tmp_path)).orderBy("source").collect()
    assert [(r["source"], r["text"]) for r in rows] == [("a.md", "é"), ("b.md", "# B\n\nline")]


def test_tolerant_log(spark, tmp_path):
    good = {"timestamp": "t", "return_id": "r1", "inputs": {"risk_score": 0.5, "rule_score": 0.1}, "outputs": {"verdict": "Escalate"}}
    lines = [
        json.dumps(good), "", "   ", "{broken", json.dumps({"timestamp": "x"}),
        json.dumps({**good, "return_id": "r2"}).replace("0.5", "NaN"),
    ]
    (tmp_path / "log.jsonl").write_text("\n".join(lines))
    rows = files.read_decision_log(spark, str(tmp_path / "log.jsonl")).orderBy("return_id").collect()
    assert [r["return_id"] for r in rows] == ["r1", "r2"]
    assert rows[1]["inputs"]["risk_score"] != rows[1]["inputs"]["risk_score"]


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b", "train"), (2, None, "test")], "id int, t string, split string")
    files.write_csv(df, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert {r["t"] for r in back.collect()} == {"a,b", None}
    files.write_split(df, str(tmp_path / "split"))
    assert (tmp_path / "split" / "split=train").is_dir()


def decider(m):
    def decide(tables):
        rows = triage.cases(tables).join(
            m.scored.select("return_id", F.col("fraud_probability").alias("risk_score")), "return_id"
        )
        rows = triage.decide_cases(triage.with_signals(rows, confidence()))
        return triage.with_dossier(triage.final_verdict(rows).withColumn("fraud_probability", F.col("risk_score")))

    return decide


def test_batches_resume_where_the_log_ends(spark, data, tmp_path):
    m = mart(spark, data)
    log, queue = str(tmp_path / "log"), str(tmp_path / "queue")
    newest = [
        r["return_id"]
        for r in m.returns.orderBy(F.desc("return_request_date"), "return_id").limit(7).collect()
    ]
    counts = [
        backlog.run_batch(m.tables, log, queue, n, decider(m), "2024-01-01 00:00:00").first()
        for n in (3, 4)
    ]
    assert [sum(c) for c in counts] == [3, 4]
    logged = files.read_decision_log(spark, log).collect()
    assert {r["return_id"] for r in logged} == set(newest) and len(logged) == 7
    escalated = {r["return_id"] for r in logged if r["outputs"]["verdict"] == "Escalate"}
    assert {r["return_id"] for r in files.read_decision_log(spark, queue).collect()} == escalated
    # A batch restricted to its users decides exactly as the whole table does.
    whole = {r["return_id"]: r["verdict"] for r in documented(m).where(F.col("return_id").isin(newest)).collect()}
    assert whole == {r["return_id"]: r["outputs"]["verdict"] for r in logged}
    with pytest.raises(ValueError):
        backlog.next_batch(m.returns, m.returns, 0)


def test_one_case(spark, data):
    m = mart(spark, data)
    some = m.returns.first()["return_id"]
    assert triage.one_case(m.returns, some).count() == 1
    with pytest.raises(ValueError):
        triage.one_case(m.returns, "no such id")


def test_faulty_rows_are_set_aside(spark, data):
    m = mart(spark, data)
    rows = triage.cases(m.tables)
    broken = rows.withColumn("category", F.when(F.col("product_id") % 3 > 0, F.col("category")))
    valid, rejected = triage.split_valid(broken)
    assert valid.count() + rejected.count() == rows.count()
    assert {r["faults"] for r in rejected.select("faults").distinct().collect()} == {"no category"}


def test_stream_triages_each_file_once(spark, data, tmp_path):
    m = mart(spark, data)
    source, log = tmp_path / "in", str(tmp_path / "log")
    returns = durable(m.returns)
    first = returns.where("days_left_to_return > 5").limit(20)
    stored = m.scored.select("return_id", F.col("fraud_probability").alias("risk_score"))

    def decide(batch):
        rows = batch.select("return_id").join(stored, "return_id").withColumns(
            {
                "rule_score": F.lit(0.0), "triggered_rules": F.array().cast("array<struct<rule_id:string,rule_name:string,description:string,score:double>>"),
                "verdict": F.when(F.col("risk_score") < 0.3, "Auto-Approve").otherwise("Escalate"),
                "confidence": F.lit("Medium"), "reasoning": F.lit("score"),
            }
        )
        return audit_record(rows, ["return_id"], F.lit("t"))

    def run():
        triage_new_returns(
            spark, str(source), returns.schema, decide, log, str(tmp_path / "queue"), str(tmp_path / "ckpt")
        ).awaitTermination()
        return spark.read.json(log).count()

    first.write.parquet(str(source))
    n = first.count()
    assert run() == n
    assert run() == n
    returns.where("days_left_to_return = 0").limit(5).write.mode("append").parquet(str(source))
    assert run() == n + 5


class FakeSession:
    """Settings of a cluster session, without a cluster."""

    def __init__(self, folder, set_by_code=None):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = self
        self.master = "spark://host:7077"
        self.getCheckpointDir = lambda: set_by_code


def test_shared_dir_is_named_by_the_session():
    assert shared_dir(FakeSession("hdfs://ns/shared/")) == "hdfs://ns/shared"
    assert shared_dir(FakeSession(None, "hdfs://ns/code")) == "hdfs://ns/code"
    with pytest.raises(ValueError):
        shared_dir(FakeSession(None))
