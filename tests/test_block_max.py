"""Block-max search against the exhaustive one."""

import random

import pytest
from pyspark.sql import functions as F

from parcelwise.operators import block_max, retrieval


@pytest.fixture(scope="module")
def made(spark):
    """Chunks of very different lengths with frequent and rare words, and queries of each."""
    rng = random.Random(4)
    common, rare = [f"c{i}" for i in range(12)], [f"r{i}" for i in range(900)]
    def text(k):
        return " ".join(rng.choice(common) if rng.random() < 0.6 else rng.choice(rare) for _ in range(k))
    chunks = [(f"k{i:04d}", text(rng.choice((3, 20, 60, 200)))) for i in range(700)]
    chunks += [(f"copy{i}", chunks[5][1]) for i in range(40)] + [("empty", "")]
    queries = [(i, text(rng.choice((1, 5, 30)))) for i in range(25)]
    queries += [(90, "nowhere else"), (91, "r1 r1 r2"), (92, ""), (93, chunks[5][1]), (94, " ".join(common))]
    chunks = spark.createDataFrame(chunks, "chunk_id string, text string")
    return chunks, spark.createDataFrame(queries, "query_id long, query string"), retrieval.build_index(chunks)


def rows(df):
    return {(r.query_id, r.chunk_id, round(r.score, 5), r["rank"]) for r in df.collect()}


@pytest.mark.parametrize("tile,block,left_out,n", [(8, 200_000, 0.4, 20), (1, 30, 1.0, 5), (64, 200_000, 0.0, 20), (8, 100, 0.7, 1)])
def test_same_rows(spark, made, tile, block, left_out, n):
    chunks, queries, index = made
    tiles = block_max.build_tiles(index, tile=tile)
    assert rows(block_max.pruned_bm25(queries, tiles, n, block, left_out)) == rows(retrieval.bm25_topk(queries, index, n))


def test_tiles_hold_every_posting(spark, made):
    import numpy as np

    _, _, index = made
    got = {}
    for r in block_max.build_tiles(index).tiles.collect():
        assert len(r.chunks) <= block_max.TILE
        ends, at, impact = (np.frombuffer(x, t) for x, t in ((r.ends, "<i4"), (r.rows, "<i4"), (r.impacts, "<f8")))
        term = np.repeat(np.arange(len(ends)), np.diff(np.append(0, ends)))
        got |= {(r.chunks[c], r.terms[t]): v for t, c, v in zip(term.tolist(), at.tolist(), impact.tolist())}
    mean = index.mean_length
    want = {(r.chunk_id, r.term): r.tf * 2.5 / (r.tf + 1.5 * (0.25 + 0.75 * r.dl / mean)) for r in index.postings.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_work_is_less(spark, made):
    """Rare words decide, so most postings of frequent ones are not scored."""
    chunks, _, index = made
    queries = spark.createDataFrame([(i, f"r{i} r{i + 1} c1 c2 c3") for i in range(40)], "query_id long, query string")
    w = block_max.search_work(queries, block_max.build_tiles(index), 3).first()
    asked = retrieval.query_terms(queries, index).join(index.terms.select("term", "df"), "term").agg(F.sum("df")).first()[0]
    assert w.exhaustive == asked and 0 < w.scored < asked


def test_nothing_to_search(spark, made):
    chunks, queries, index = made
    tiles = block_max.build_tiles(index)
    assert block_max.pruned_bm25(queries.limit(0), tiles).count() == 0
    none = retrieval.build_index(chunks.limit(0))
    assert block_max.pruned_bm25(queries, block_max.build_tiles(none)).count() == 0
