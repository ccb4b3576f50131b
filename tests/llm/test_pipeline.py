from itertools import combinations

from edge import none, rows

import corpus_pipeline
from parcelwise.llm import perplexity, pii, quality_model


def test_stages(spark, data):
    documents = docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, data)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen.append(docs)
        if name != "best_fit_packing":
            assert docs.columns == columns
    want = {r.doc_id for r in perplexity.judge(documents).where("kept").collect()}
    assert {r.doc_id for r in seen[0].collect()} == want
    labels = spark.read.parquet(f"{data}/labels.parquet")
    assert {r.doc_id for r in seen[1].collect()} == {r.doc_id for r in quality_model.score_documents(seen[0], labels).where("predicted = 1").collect()}
    # One of each group of texts that five-word shingles link at 0.8, by a plain comparison.
    sets = {}
    for r in seen[1].collect():
        w = (r.text or "").encode().lower().split()
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    label = {k: k for k in sets}
    for a, b in combinations(sorted(sets), 2):
        shared = len(sets[a] & sets[b])
        if sets[a] == sets[b] or shared >= 0.8 * (len(sets[a]) + len(sets[b]) - shared):
            old, new = max(label[a], label[b]), min(label[a], label[b])
            label = {k: new if v == old else v for k, v in label.items()}
    assert {r.doc_id for r in seen[2].collect()} == set(label.values())
    assert seen[2].count() == seen[3].count()
    field = pii.train(seen[2])
    texts = {r.doc_id: r.text for r in seen[2].collect()}
    for r in seen[3].collect():
        base, more = pii.find_spans(texts[r.doc_id], field)
        assert r.text == pii.mask(texts[r.doc_id], base + more) and not pii.base_spans(r.text)
    assert {r.doc_id for r in seen[4].collect()} == set(texts)


def test_run(spark, data):
    got = corpus_pipeline.run(spark, data)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and got.count() > 0


def test_stages_take_odd_rows(spark, data):
    for table in (rows(spark), none(spark)):
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, table, data)
            if name != "best_fit_packing":
                assert got.columns == table.columns
            got.collect()
