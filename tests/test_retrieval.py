"""Chunking, BM25, vector search and fusion against direct computation."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelwise.config import RetrievalParams
from parcelwise.operators import retrieval


def packed(text, size, sep):
    """Expected chunks of one long section, from the rule: start a new chunk when the
    open one is not empty and would pass the size, ignoring the joiner."""
    parts, out, current = text.split(sep), [], ""
    for part in parts:
        if current and len(current) + len(part) > size:
            out.append(current.strip())
            current = part
        else:
            current = current + sep + part if current else part
    if current.strip():
        out.append(current.strip())
    return out


def expected_chunks(text, size, sep):
    out = []
    for i, section in enumerate(text.split("\n## ")):
        body = section.strip() if i == 0 else "## " + section.strip()
        if len(body) > size:
            out.extend(packed(body, size, sep))
        elif body:
            out.append(body)
    return out


def random_text(rng):
    words = ["alpha", "bé", "c c", "\t", " ", "x" * 30, "Über", "## no", "　pad "]
    text = ""
    for _ in range(rng.randrange(0, 40)):
        text += rng.choice(words) + rng.choice([" ", "\n", "\n\n", "\n\n\n\n", "\n## ", "\n\n## ", ""])
    return text


@pytest.mark.parametrize("sep", ["\n\n", "\n"])
def test_chunks_of_random_texts(spark, sep):
    rng = random.Random(11)
    docs = [(f"d{i:03d}", random_text(rng)) for i in range(300)]
    docs += [("empty", ""), ("blank", " \n\n "), ("long", "y" * 900), ("mark", "a\n## \n## b")]
    params = RetrievalParams(max_chunk_size=60)
    df = spark.createDataFrame(docs, "source string, text string")
    rows = retrieval.chunk_documents(df, params, paragraph_mark=sep).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["source"], r["section_no"], r["part_no"])):
        got.setdefault(r["source"], []).append(r["text"])
        assert r["section"] == r["text"].split("\n")[0][:80]
    for source, text in docs:
        assert got.get(source, []) == expected_chunks(text, 60, sep), source


CORPUS = [
    (1, "refund policy for damaged items"), (2, "Refund window is ten days"), (3, "seller policy policy"),
    (4, "shipping and delivery"), (5, "refund refund refund damaged"), (6, "  "), (7, "policy for delivery of damaged goods"),
]


def bm25(query, corpus=CORPUS, k1=1.5, b=0.75):
    docs = {i: t.lower().split() for i, t in corpus}
    n = len(docs)
    mean = sum(map(len, docs.values())) / n
    df = {}
    for words in docs.values():
        for w in set(words):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    average = sum(idf.values()) / len(idf)
    idf = {w: (0.25 * average if v < 0 else v) for w, v in idf.items()}
    out = {}
    for i, words in docs.items():
        score = sum(
            idf.get(w, 0) * words.count(w) * (k1 + 1) / (words.count(w) + k1 * (1 - b + b * len(words) / mean))
            for w in query.lower().split()
        )
        out[i] = round(score, 6)
    return out


@pytest.fixture(scope="module")
def index(spark):
    return retrieval.build_index(spark.createDataFrame(CORPUS, "chunk_id long, text string"))


def test_bm25(spark, index):
    queries = [(1, "damaged refund"), (2, "policy policy delivery"), (3, "unknown words"), (4, "refund")]
    df = spark.createDataFrame(queries, "query_id long, query string")
    got = {}
    for r in retrieval.bm25_topk(df, index, n=3).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["chunk_id"], r["score"]))
    for q, text in queries:
        want = sorted(((i, s) for i, s in bm25(text).items() if s > 0), key=lambda x: (-x[1], x[0]))[:3]
        assert got.get(q, []) == want


def test_index_survives_saving(spark, index, tmp_path):
    retrieval.save_index(index, str(tmp_path))
    again = retrieval.load_index(spark, str(tmp_path))
    df = spark.createDataFrame([(1, "refund policy")], "query_id long, query string")
    assert retrieval.bm25_topk(df, again).collect() == retrieval.bm25_topk(df, index).collect()


def test_zero_scores_fill_only_on_request(spark, index):
    df = spark.createDataFrame([(3, "unknown")], "query_id long, query string")
    chunks = spark.createDataFrame([(i,) for i, _ in CORPUS], "chunk_id long")
    got = retrieval.bm25_topk(df, index, n=4, include_zero=chunks).orderBy("rank").collect()
    assert [(r["chunk_id"], r["score"]) for r in got] == [(1, 0.0), (2, 0.0), (3, 0.0), (4, 0.0)]


def test_vector_search(spark):
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(200, 8))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors[150] = vectors[20]
    queries = vectors[[20, 3]]
    docs = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    asked = [(i, [float(x) for x in v]) for i, v in enumerate(queries)]
    schema = "id long, embedding array<double>"
    v = spark.createDataFrame(docs, schema).withColumnRenamed("id", "chunk_id").repartition(6)
    q = spark.createDataFrame(asked, schema).withColumnRenamed("id", "query_id")
    for block in (1, 100):
        rows = retrieval.vector_topk(q, v, 5, block).orderBy("query_id", "rank").collect()
        for k in (0, 1):
            scores = np.round(vectors @ queries[k], 6)
            want = np.lexsort((np.arange(200), -scores))[:5].tolist()
            assert [r["chunk_id"] for r in rows if r["query_id"] == k] == want
    assert retrieval.vector_topk(q.limit(0), v, 5).count() == 0


def test_fusion_ties(spark):
    schema = "query_id long, chunk_id long, rank long"
    lexical = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3)], schema)
    vector = spark.createDataFrame([(1, 20, 1), (1, 12, 2), (1, 11, 3)], schema)
    got = [(r["chunk_id"], r["rrf_score"]) for r in retrieval.rrf_fuse(lexical, vector).orderBy("rank").collect()]
    # 11 and 12 swap ranks, so they tie; the better lexical rank wins. So do 10 and 20.
    both = round(1 / 62 + 1 / 63, 5)
    assert got == [(11, both), (12, both), (10, round(1 / 61, 5)), (20, round(1 / 61, 5))]


def test_context_in_rank_order(spark):
    fused = spark.createDataFrame([(1, 7, 2), (1, 8, 1)], "query_id long, chunk_id long, rank long")
    chunks = spark.createDataFrame([(7, "a.md", "seven"), (8, "b.md", "eight")], "chunk_id long, source string, text string")
    row = retrieval.policy_context(fused, chunks).first()
    assert row["context"] == "[Source: b.md]\neight\n\n[Source: a.md]\nseven"


def test_query_texts(spark):
    rows = [("Books", "damaged", "refund", 0, 1, 12.5, 3), ("Toys", None, "replace", 1, 0, 7.0, 0)]
    df = spark.createDataFrame(rows, "category string, reason_category string, return_type string, is_non_returnable int, within_return_window int, order_value double, days_left_to_return int")
    got = df.select(retrieval.case_query(df).alias("a"), retrieval.policy_query(df).alias("b")).collect()
    assert got[0]["a"] == "Books damaged refund return returnable within return window order value 12.5 days left 3"
    assert "non-returnable outside return window" in got[1]["a"]
    assert got[0]["b"] == "Books damaged return returnable policy"


def test_policies_of_cases(spark):
    docs = spark.createDataFrame(
        [("a.md", "# Rules\nGeneral words\n## Books returnable\nBooks damaged may be returned"), ("b.md", "## Toys\nnon-returnable Toys policy")],
        "source string, text string",
    )
    chunks = retrieval.chunk_documents(docs)
    index = retrieval.build_index(chunks)
    schema = "return_id string, category string, reason_category string, is_non_returnable int"
    cases = spark.createDataFrame([("1", "Books", "damaged", 0), ("2", "Books", "damaged", 0), ("3", "Toys", "x", 1)], schema)
    got = {r["return_id"]: (r["retrieved_clause"], r["policy_source"], len(r["policy_passages"])) for r in retrieval.case_policies(cases, chunks, index).collect()}
    assert got == {"1": ("## Books returnable", "a.md", 2), "2": ("## Books returnable", "a.md", 2), "3": ("## Toys", "b.md", 1)}
    none = spark.createDataFrame([("4", "Zz", "yy", None)], schema)
    lost = retrieval.case_policies(none, docs.limit(0).selectExpr("source", "text", "'' section", "'' chunk_id"), index).first()
    assert lost["retrieved_clause"] is None
