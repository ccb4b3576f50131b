"""Shuffles of whole tables take more tasks as data grows, with the same rows."""

import os
import random
from dataclasses import replace
from datetime import date

import pytest
from pyspark.sql import functions as F

from parcelwise.config import ALL_FEATURES, ModelParams
from parcelwise.operators import block_max, features, ml, retrieval, scale
from parcelwise.operators.features import full_features
from parcelwise.operators.state import as_of_state, return_state
from parcelwise.plans import catalog, triage
from parcelwise.session import parts_for, spread
from parcelwise.sources import files, mart as marts


def same(a, b):
    b = b.select(*a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_parts_follow_the_size(spark):
    assert parts_for(spark, 800, 100) is None  # 8 cores
    assert parts_for(spark, 801, 100) == 9 and parts_for(spark, 80_000, 100) == 800


def test_no_fewer_parts_than_the_session(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        assert parts_for(spark, 900, 100) == 40 and parts_for(spark, 80_000, 100) == 800
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_risk_comes_with_the_return(spark, data, tmp_path):
    """Decided cases are those of a join by return_id, without that join unless an id repeats."""
    m = marts.mart(spark, data)
    rows = catalog.signals(m)
    risk = m.scored.select("return_id", F.col("fraud_probability").alias("risk_score"))
    want = triage.with_signals(catalog.ruled(m).join(risk, "return_id"), catalog.confidence(), catalog.bursts(m))
    assert rows.columns == want.columns
    plain = [c for c in rows.columns if c != "triggered_rules"]
    assert m.risk_tables is not None and same(rows.select(plain), want.select(plain))
    for name in ("lineitem", "orders", "part", "supplier"):
        os.symlink(f"{data}/{name}.parquet", tmp_path / f"{name}.parquet")
    users = spark.read.parquet(f"{data}/customer.parquet")
    users.union(users.limit(200)).write.parquet(str(tmp_path / "customer.parquet"))
    assert marts.Mart(spark, str(tmp_path)).risk_tables is None


def test_few_training_partitions(spark):
    """Histograms are sent by no more partitions than there are cores."""
    rng = random.Random(1)
    rows = [(*(float(rng.random()) for _ in ALL_FEATURES), i % 2) for i in range(400)]
    matrix = spark.createDataFrame(rows, [*ALL_FEATURES, "target"]).repartition(40)
    seen = []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(ml.Pipeline, "fit", lambda self, df: seen.append(df.rdd.getNumPartitions()))
        ml.train(matrix, ModelParams(rounds=1))
    assert seen == [8]


def test_tables_in_many_parts(spark, data, monkeypatch):
    """Orders that no return names are left out of the triage tables; states and features stay."""
    few = marts.Mart(spark, data)
    assert few.parts is None
    monkeypatch.setattr(marts, "TASK_LINES", 300)
    many = marts.Mart(spark, data)
    assert many.parts == 20
    assert same(few.orders, many.orders) and same(few.scored, many.scored)
    assert many.tables.orders.count() < many.orders.count()
    state = return_state(many.requests, parts=many.parts)
    assert state.rdd.getNumPartitions() == 20
    assert same(as_of_state(few.requests, few.orders), as_of_state(many.requests, many.orders, 20))
    want, got = full_features(few.tables), full_features(many.tables)
    assert got.columns == want.columns and got.rdd.getNumPartitions() == 20 and same(want, got)
    plan = marts.scored_requests(many)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "hashpartitioning(user_id" in plan and "return_request_date" not in "".join(x for x in plan.splitlines() if "hashpartitioning" in x)
    hot = many.orders.select("user_id").distinct()
    assert same(want, full_features(many.tables, hot))


def test_split_features_store_what_they_need(spark, data, monkeypatch):
    """Marked rows are stored without columns that no feature is made of, and the features stay the same."""
    stored, plain = [], scale.durable
    monkeypatch.setattr(scale, "durable", lambda df: stored.append(df.columns) or plain(df))
    m = marts.Mart(spark, data)
    want = full_features(m.tables).select("return_id", *ALL_FEATURES, "target")
    got = catalog.full_features_split(m)
    wide = [c for c in stored if "_hot" in c]
    assert len(wide) == 1 and {"order_id", "delivery_date", "fraud_type"}.isdisjoint(wide[0])
    assert same(want, got)


def test_stored_rows_hold_no_made_columns(spark, data, monkeypatch):
    """Ids, draws and what the score tells are made where rows are read; the matrix is not stored beside the features."""
    stored, plain = [], marts.durable
    for module in (marts, catalog):
        monkeypatch.setattr(module, "durable", lambda df: stored.append({*df.columns}) or plain(df))
    m = marts.Mart(spark, data)
    assert {"return_id", "order_id", "label_draw", "fraud_probability", "label"} < {*m.scored.columns}
    found = catalog.matrix(m)
    assert len(stored) > 4 and found.count() == m.returns.count()
    for columns in stored:
        assert {"order_id", "label_draw", "fraud_probability", "category_str"}.isdisjoint(columns)
    assert not any({"fraud_score", "return_id"} <= columns for columns in stored)


def test_sellers_join_as_they_are_stored(spark, data):
    """Their size is known then, and returns need not be dealt by seller."""
    m = marts.Mart(spark, data)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "50k")
        plan = full_features(m.tables).select("return_id", *ALL_FEATURES)._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "hashpartitioning(seller_id" not in plan.split("== Physical Plan ==")[1]


def test_hot_users_that_the_table_lacks(spark, data):
    """The mark comes with the user; histories are the same for users of whom nothing else is known."""
    m = marts.Mart(spark, data)
    tables = replace(m.tables, users=m.users.where("user_id % 3 > 0"))
    columns = ["return_id", "user_id", *ALL_FEATURES, "target"]
    hot = m.orders.select("user_id").distinct()
    marked = features._star(tables, None, hot)
    assert marked.where("_hot").count() == marked.count() > 0
    assert same(full_features(tables).select(columns), full_features(tables, hot).select(columns))


def test_orders_named_by_a_return_stay(spark, tmp_path, data, monkeypatch):
    """Of lines with one order_id, returned and not, both are orders of the return."""
    monkeypatch.setattr(marts, "TASK_LINES", 1)
    for name in ("orders", "part"):
        os.symlink(f"{data}/{name}.parquet", tmp_path / f"{name}.parquet")
    lines = spark.read.parquet(f"{data}/lineitem.parquet").where("l_returnflag = 'R'").limit(40)
    kept = lines.withColumn("l_returnflag", lines["l_returnflag"].substr(2, 1))
    lines.union(kept).write.parquet(str(tmp_path / "lineitem.parquet"))
    m = marts.Mart(spark, str(tmp_path))
    assert m.placed.where("asked").count() == 80


def test_index_in_many_parts(spark, monkeypatch):
    words = "red green blue amber violet grey".split()
    rows = [(i % 150, " ".join(words[(i * k) % 6] for k in range(1, 3 + i % 5))) for i in range(160)]
    chunks = spark.createDataFrame([*rows, (None, "red red")], "chunk_id long, text string")
    queries = spark.createDataFrame([(1, "red blue"), (2, "grey amber amber")], "query_id long, query string")
    few = retrieval.build_index(chunks)
    monkeypatch.setattr(retrieval, "TASK_CHARS", 20)
    monkeypatch.setattr(retrieval, "TASK_POSTINGS", 10)
    many = retrieval.build_index(chunks)
    assert len(many.postings.inputFiles()) > 20 and retrieval.posting_parts(many) > 8
    assert same(few.postings, many.postings) and same(few.terms, many.terms)
    found = retrieval.bm25_topk(queries, many)
    monkeypatch.undo()
    assert same(retrieval.bm25_topk(queries, few), found)
    monkeypatch.setattr(block_max, "posting_parts", lambda index: 30)
    once = retrieval.build_index(spark.createDataFrame(rows[:150], "chunk_id long, text string"))
    assert same(retrieval.bm25_topk(queries, once), block_max.pruned_bm25(queries, block_max.build_tiles(once)))


def test_log_files_are_compressed(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([(f"r{i}", date(2024, 1, 1)) for i in range(2000)], "return_id string, day date")
    files.append_decisions(rows.coalesce(1), path)
    plain = sum(len(f'{{"return_id":"r{i}","day":"2024-01-01"}}\n') for i in range(2000))
    assert sum(os.path.getsize(f"{path}/{f}") for f in os.listdir(path)) < plain / 4
    assert files.read_decision_log(spark, path).count() == 2000
