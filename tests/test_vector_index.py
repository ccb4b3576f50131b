"""Pruned vector search against direct computation."""

import numpy as np
import pytest

from parcelwise.operators import vector_index as vi
from parcelwise.operators.retrieval import vector_topk


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def tables(spark, x, q, ids=None):
    vectors = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "chunk_id long, embedding array<float>")
    queries = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(q)], "query_id long, embedding array<float>")
    return queries, vectors


def best(x, q, n):
    s = np.round(q.astype("f4").astype("f8") @ x.astype("f4").astype("f8").T, 6)
    return {(k, int(i)): s[k, i] for k in range(len(q)) for i in np.lexsort((np.arange(len(x)), -s[k]))[:n]}


def rows(df):
    return {(r.query_id, r.chunk_id): r.score for r in df.collect()}


@pytest.mark.parametrize("shard,block", [(20_000, 4096), (150, 4096), (20_000, 7), (90, 11)])
def test_exhaustive_search_over_many_groups(spark, shard, block):
    rng = np.random.default_rng(1)
    x, q = unit(rng.standard_normal((600, 8))), unit(rng.standard_normal((40, 8)))
    queries, vectors = tables(spark, x, q)
    got, want = rows(vector_topk(queries, vectors, 5, block, shard)), best(x, q, 5)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_recall_without_structure(spark):
    """Directions at random, the worst case: the sketches do the work."""
    rng = np.random.default_rng(2)
    x = unit(rng.standard_normal((3000, 32)))
    queries, vectors = tables(spark, x, x[::20])
    index = vi.build_cells(vectors)
    exact = vector_topk(queries, vectors)
    found = vi.pruned_topk(queries, index)
    r, w = vi.recall(found, exact).first(), vi.search_work(queries, index).first()
    assert r.neighbours == 3000 and r.recall >= 0.9
    assert w.pairs == 150 * 3000 and w.scored < w.pairs / 5
    truth = rows(vector_topk(queries, vectors, 3000))
    got = rows(found)
    assert len(got) == 3000 and all(abs(truth[k] - v) < 2e-6 for k, v in got.items())
    ranks = sorted((r.query_id, r["rank"], -r.score) for r in found.collect())
    assert [(q, k) for q, k, _ in ranks] == [(q, k) for q in range(150) for k in range(1, 21)]
    assert all(a[2] <= b[2] for a, b in zip(ranks, ranks[1:]) if a[0] == b[0])


def test_clear_groups_need_few_cells(spark):
    rng = np.random.default_rng(3)
    centres = unit(rng.standard_normal((30, 24)))
    x = unit(np.repeat(centres, 60, axis=0) + 0.02 * rng.standard_normal((1800, 24)))
    queries, vectors = tables(spark, x, x[::20])
    index = vi.build_cells(vectors, vi.CellParams(cells=40))
    w = vi.search_work(queries, index).first()
    assert w.probes < w.cells / 4 and w.compared < w.pairs / 4
    assert vi.recall(vi.pruned_topk(queries, index), vector_topk(queries, vectors)).first().recall >= 0.9


def test_shards_and_blocks_do_not_matter(spark):
    rng = np.random.default_rng(4)
    x = unit(rng.standard_normal((500, 16)))
    queries, vectors = tables(spark, x, x[::5])
    one = rows(vi.pruned_topk(queries, vi.build_cells(vectors)))
    many = rows(vi.pruned_topk(queries, vi.build_cells(vectors, vi.CellParams(shard=30, block=9))))
    assert one == many


def test_copies(spark):
    """A vector that most rows hold, asked by most queries: the smallest ids, as exactly."""
    rng = np.random.default_rng(5)
    x = unit(rng.standard_normal((400, 16)))
    x[100:] = x[100]
    queries, vectors = tables(spark, x, x[::4])
    index = vi.build_cells(vectors, vi.CellParams(copies=20))
    assert index.vectors == 120
    got = rows(vi.pruned_topk(queries, index))
    want = best(x, x[::4], 20)
    common = {k for k in want if k[0] >= 25}
    assert common <= got.keys() and len(got) == 2000
    with pytest.raises(ValueError):
        vi.pruned_topk(queries, index, 21)


def test_short_lists_are_filled_exactly(spark):
    rng = np.random.default_rng(6)
    x = unit(rng.standard_normal((300, 16)))
    queries, vectors = tables(spark, x, x[:10])
    index = vi.build_cells(vectors)
    narrow = vi.CellIndex(index.lists, index.sizes, index.centres, index.vectors, 1, 0, index.params)
    got, want = rows(vi.pruned_topk(queries, narrow, 5)), best(x, x[:10], 5)
    assert got.keys() == want.keys()


def test_missing_and_few(spark):
    some = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0])]
    vectors = spark.createDataFrame(some, "chunk_id long, embedding array<float>")
    queries = spark.createDataFrame(some[:2], "query_id long, embedding array<float>")
    index = vi.build_cells(vectors)
    assert rows(vi.pruned_topk(queries, index)) == {(1, 1): 1.0, (1, 3): 0.0}
    assert rows(vi.pruned_topk(queries.limit(0), index)) == {}
    empty = vi.build_cells(vectors.limit(0))
    assert rows(vi.pruned_topk(queries, empty)) == {}
