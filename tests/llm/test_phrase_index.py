import hashlib
import random
from collections import Counter

import pytest
from edge import LONG, none, rows

from parcelwise.llm import phrase_index as px


def words(text):
    out, now = [], ""
    for c in (text or "") + " ":
        c = chr(ord(c) + 32) if "A" <= c <= "Z" else c
        if c.isascii() and not ("0" <= c <= "9" or "a" <= c <= "z"):
            out += [now] if now else []
            now = ""
        else:
            now += c
    return out


def plain(docs, items, size=10):
    out = []
    for doc_id, text in docs:
        w, hit, ids = words(text), set(), set()
        for item_id, item in items:
            v = words(item)
            k = min(size, len(v))
            wins = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if k else set()
            for i in range(len(w) - k + 1) if k else []:
                if tuple(w[i : i + k]) in wins:
                    hit.update(range(i, i + k))
                    ids.add(str(item_id))
        digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(ids), digest, bool(hit)))
    return out


def same(got, want):
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


def near_documents(docs, item, size, span):
    """Documents with all words of a window within `span` words, by trying each stretch."""
    out = set()
    for d, text in enumerate(docs):
        for win in px.windows(item, size):
            need = Counter(win)
            if any(not need - Counter(text[i : i + span]) for i in range(len(text))):
                out.add(d)
    return out


@pytest.fixture(scope="module")
def made():
    """Documents of few words with passages of the items, whole, cut, shuffled and spread out."""
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [rng.choices(vocabulary, k=rng.choice((1, 4, 9, 10, 11, 25))) for _ in range(30)]
    docs = []
    for _ in range(150):
        text = rng.choices(vocabulary, k=rng.randrange(60))
        for item in rng.sample(items, 2):
            part = item[rng.randrange(3) :][: rng.choice((5, 10, 12, 30))]
            if rng.random() < 0.4:
                rng.shuffle(part)
            if rng.random() < 0.3:
                part.insert(rng.randrange(len(part) + 1), "other")
            text += part + rng.choices(vocabulary, k=rng.randrange(4))
        docs.append(text if rng.random() < 0.9 else [])
    return docs, items


def test_contamination_equals_a_plain_search(spark, made):
    docs, items = made
    d = [(i, ", ".join(t).upper()) for i, t in enumerate(docs)]
    b = [(i, " ".join(t)) for i, t in enumerate(items)]
    got = px.contamination(spark.createDataFrame(d, "doc_id long, text string"), spark.createDataFrame(b, "item_id long, text string"))
    want = plain(d, b)
    same(got.collect(), want)
    assert any(r[3] > 1 for r in want) and any(not r[5] for r in want)


@pytest.mark.parametrize("chunk", [1, 300, 10**6])
def test_chunks_and_segments_do_not_matter(spark, made, chunk):
    """Many chunks of items and small segments give the same matches as one of each."""
    docs, items = made
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(docs)], "doc_id long, text string").repartition(3)
    b = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    index = px.build_index(d, 500)
    ids = {r.segment: r.doc_ids for r in index.where("term IS NULL").collect()}
    assert len(ids) > 6
    got = px.search(index, b, chunk_chars=chunk).collect()
    exact, near = set(), set()
    for r in got:
        (exact if r.kind == "exact" else near).add((ids[r.segment][r.document], r.item_id))
        text, item = docs[ids[r.segment][r.document]], items[r.item_id]
        part = text[r.start : r.start + r.length]
        if r.kind == "exact":
            assert any(part[: len(w)] == w for w in px.windows(item)) and any(part[-len(w) :] == w for w in px.windows(item))
        else:
            assert len(part) == r.length <= max(15, len(item)) and any(not Counter(w) - Counter(part) for w in px.windows(item))
    same_items = {(x[0], i) for i in range(len(items)) for x in plain(list(enumerate(docs_text(docs))), [(i, " ".join(items[i]))]) if x[5]}
    assert exact == same_items
    want = {(d, i) for i, item in enumerate(items) for d in near_documents(docs, item, 10, max(15, min(10, len(item))))}
    assert near == want - exact and near


def docs_text(docs):
    return [" ".join(t) for t in docs]


def test_index_holds_every_word(spark, made):
    import numpy as np

    docs, _ = made
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(docs)], "doc_id long, text string")
    index = px.build_index(d, 700).collect()
    heads = {r.segment: (r.doc_ids, r.n_words) for r in index if r.term is None}
    got = {i: [None] * len(t) for i, t in enumerate(docs)}
    for r in index:
        if r.term is not None:
            ids, sizes = heads[r.segment]
            starts = [sum(sizes[:k]) + k for k in range(len(sizes))]
            for p in np.frombuffer(r.positions, f"<u{r.width}").tolist():
                k = max(i for i, s in enumerate(starts) if s <= p)
                got[ids[k]][p - starts[k]] = r.term
    assert got == dict(enumerate(docs))


def test_query_and_sql(spark, data):
    import duckdb

    got = px.query(spark, data)
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    theirs = db.sql(px.SQL)
    assert sorted(theirs.columns) == sorted(got.columns)
    same(got.collect(), theirs.df()[got.columns].itertuples(index=False, name=None))
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    want = plain(docs, items)
    same(got.collect(), want)
    assert 0 < sum(r[5] for r in want) < len(want)


def test_edges(spark):
    table = rows(spark)
    b = [(1, "quick brown fox number 7 jumps over it the quick brown"), (1, "Some Words"), (2, None), (3, " - "), (None, "漢字"), (4, "of some words of some words of some words of some")]
    items = spark.createDataFrame(b, "item_id long, text string").withColumn("segment", px.F.lit(7))
    got = px.contamination(table, items).collect()
    assert len(got) == 9
    by = {r.doc_id: r for r in got}
    assert by[1].n_hit == 2 and by[1].n_items == 1 and by[2].n_words == by[3].n_words == by[7].n_words == 0
    assert by[4].n_words == 9 * 6000 and by[4].n_hit == 9 * 6000 - 7 and not by[2].contaminated
    assert by[8].n_hit == 9 and by[8].n_items == 0 and sum(r.doc_id == 5 for r in got) == 2
    assert not any(r.contaminated for r in px.contamination(table, items.limit(0)).collect())
    assert px.contamination(none(spark), items).count() == 0
    assert LONG.split()[0] == "The"
