"""Pruned vector search: coarse cells, inverted lists, bit sketches and exact scores.

Vectors are dealt to the nearest of some k-means centres. A query visits the lists of its
nearest cells only, compares sketches there (signs along random hyperplanes), and scores
exactly what lies within a sketch radius. The number of cells to visit and the radius are
tuned together on a bounded sample for a wanted recall, at the least expected work: vectors
in clear groups need few cells, vectors without any lean on the sketches.

Copies of one vector stand in the index as often as a search can return them (`copies`), so
a vector that holds a third of the rows costs no more than others. Lists above `shard` rows
and blocks of queries above `block` are split; a group is one shard and one block.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from parcelwise.config import RetrievalParams
from parcelwise.operators.retrieval import vector_topk
from parcelwise.operators.scale import top_n
from parcelwise.session import durable


@dataclass(frozen=True)
class CellParams:
    #: Cells; none: half the square root of the number of vectors, up to max_cells.
    cells: int | None = None
    max_cells: int = 4096
    #: Rows that centres, probes and radius are fitted on, and rows of these asked in tuning.
    sample: int = 10_000
    asked: int = 256
    #: Bits of a sketch; a multiple of 64.
    bits: int = 512
    #: Wanted share of the true neighbours, and how many of them count.
    recall: float = 0.95
    neighbours: int = RetrievalParams.vector_candidates
    #: Exact scores cost so many sketch comparisons.
    score_cost: float = 12.0
    iterations: int = 10
    copies: int = 100
    shard: int = 20_000
    block: int = 4096
    seed: int = 7


@dataclass(frozen=True)
class CellIndex:
    """lists(cell, shard, chunk_id, embedding, sketch), sizes(cell, shards), and what was fitted."""

    lists: DataFrame
    sizes: DataFrame
    centres: np.ndarray
    vectors: int
    probes: int
    radius: int
    params: CellParams


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("float64")
    return flat.reshape(len(column), -1)


def sketches(x: np.ndarray, bits: int, seed: int) -> np.ndarray:
    """Rows of bits / 64 words: on which side of each random hyperplane a vector lies."""
    planes = np.random.default_rng(seed).standard_normal((x.shape[1], bits))
    return np.packbits(x @ planes > 0, axis=1).view("<u8")


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of each row of a and each row of b."""
    out = np.zeros((len(a), len(b)), np.uint16)
    for i in range(a.shape[1]):
        out += np.bitwise_count(a[:, i, None] ^ b[None, :, i])
    return out


def tune(x: np.ndarray, centres: np.ndarray, params: CellParams) -> tuple[int, int]:
    """Cells to visit and sketch radius with the least work at the wanted recall, on a sample."""
    cells, q = len(centres), x[: params.asked]
    if len(x) < 3:
        return cells, params.bits
    home = (x @ centres.T).argmax(1)
    scores = q @ x.T
    scores[np.arange(len(q)), np.arange(len(q))] = -np.inf
    k = min(params.neighbours, len(x) - 1)
    near = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    order = np.argsort(-(q @ centres.T), axis=1)
    place = np.argsort(order, axis=1)  # of each cell in a query's order
    apart = distances(sketches(q, params.bits, params.seed), sketches(x, params.bits, params.seed))
    ranks = np.take_along_axis(place, home[near], axis=1).ravel()
    bits = np.take_along_axis(apart, near, axis=1).ravel()
    visited = np.cumsum(np.take_along_axis(np.bincount(home, minlength=cells)[None, :], order, axis=1), axis=1).mean(0) / len(x)
    passing = np.cumsum(np.bincount(apart.ravel(), minlength=params.bits + 1)) / apart.size
    best = (np.inf, cells, params.bits)
    for probes in range(1, cells + 1):
        inside = ranks < probes
        if inside.mean() < params.recall:
            continue
        radius = int(np.quantile(bits[inside], min(1.0, params.recall / inside.mean()), method="higher"))
        work = visited[probes - 1] * (1 + params.score_cost * passing[radius])
        best = min(best, (work, probes, radius))
    return best[1], best[2]


def _distinct(rows: DataFrame, key: str, copies: int) -> DataFrame:
    """Rows with an embedding; of equal ones those with the `copies` smallest keys."""
    some = rows.select(key, F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("embedding").isNotNull())
    return top_n(some, ["embedding"], [key], copies, "copy").drop("copy")


def build_cells(vectors: DataFrame, params: CellParams = CellParams()) -> CellIndex:
    """The index of vectors (chunk_id, embedding of unit length). Rows without an embedding
    take no part. Of equal embeddings the `copies` smallest ids are held: more can't be among
    the best of a search for that many."""
    rows = durable(_distinct(vectors, "chunk_id", params.copies))
    n = rows.count()
    chosen = rows.orderBy(F.xxhash64(F.lit(params.seed), "chunk_id"), "chunk_id").limit(params.sample)
    sample = chosen.select("embedding").toArrow()
    x = _matrix(sample["embedding"]) if sample.num_rows else np.zeros((0, 1))
    cells = max(1, min(params.cells or round(n**0.5 / 2), params.max_cells, len(x)))
    if cells > 1:
        fit = KMeans(k=cells, distanceMeasure="cosine", initMode="random", maxIter=params.iterations, seed=params.seed)
        points = durable(chosen.select(array_to_vector("embedding").alias("features")))
        centres = np.array(fit.fit(points).clusterCenters())
    else:
        centres = np.ones((1, x.shape[1]))
    centres = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    probes, radius = tune(x, centres, params)
    kind = dict(vectors.dtypes)["chunk_id"]
    bits, seed = params.bits, params.seed

    def assign(batches):
        for batch in batches:
            m = _matrix(batch.column("embedding"))
            cell = (m @ centres.T).argmax(1).astype(np.int32)
            words = [w.tobytes() for w in sketches(m, bits, seed)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell), batch.column("chunk_id"), batch.column("embedding"), pa.array(words, pa.binary())],
                ["cell", "chunk_id", "embedding", "sketch"],
            )

    found = durable(rows.mapInArrow(assign, f"cell int, chunk_id {kind}, embedding array<double>, sketch binary"))
    counts = found.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / params.shard).cast("int").alias("shards"))
    sizes = durable(counts)  # one row for each cell
    lists = found.join(sizes, "cell").withColumn("shard", F.pmod(F.xxhash64("chunk_id"), F.col("shards")).cast("int")).drop("shards")
    return CellIndex(lists, sizes, centres, n, probes, radius, params)


def _cell_search(schema: pa.Schema, n: int, radius: int, at_once: int = 64, count: bool = False):
    """Task function over a shard's vectors and a block's queries: the n best vectors of each
    query, or with `count` how many were compared and scored."""

    def words(column) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(len(column), -1)

    def search(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        if not vectors.num_rows or not queries.num_rows:
            return schema.empty_table()
        ids, names = vectors["chunk_id"].to_numpy(), queries["query_id"].to_numpy()
        x, q, a, b = _matrix(vectors["embedding"]), _matrix(queries["embedding"]), words(vectors["sketch"]), words(queries["sketch"])
        asked, found, score, scored = [], [], [], 0
        for first in range(0, len(q), at_once):
            i, j = np.nonzero(distances(b[first : first + at_once], a) <= radius)
            scored += len(i)
            if count:
                continue
            i += first
            s = np.round(np.einsum("ij,ij->i", q[i], x[j]), 6)
            order = np.lexsort((ids[j], -s, i))
            i, j, s = i[order], j[order], s[order]
            start = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1]))) if len(i) else i
            place = np.arange(len(i)) - np.repeat(start, np.diff(np.append(start, len(i))))
            top = place < n
            asked.append(names[i[top]])
            found.append(ids[j[top]])
            score.append(s[top])
        if count:
            return pa.table({"compared": [len(x) * len(q)], "scored": [scored]}, schema=schema)
        columns = [np.concatenate(c) for c in (asked, found, score)]
        return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)

    return search


def _visits(queries: DataFrame, index: CellIndex) -> DataFrame:
    """Each query once for each shard of each cell it visits, in blocks of about params.block."""
    centres, probes, bits, seed = index.centres, index.probes, index.params.bits, index.params.seed
    kind = dict(queries.dtypes)["query_id"]

    def route(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                some = batch.slice(start, 1024)
                m = _matrix(some.column("embedding"))
                cells = np.argpartition(-(m @ centres.T), probes - 1, axis=1)[:, :probes].astype(np.int32)
                row = pa.array(np.repeat(np.arange(len(m)), probes))
                words = pa.array([w.tobytes() for w in sketches(m, bits, seed)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cells.ravel()), some.column("query_id").take(row), some.column("embedding").take(row), words.take(row)],
                    ["cell", "query_id", "embedding", "sketch"],
                )

    routed = queries.mapInArrow(route, f"cell int, query_id {kind}, embedding array<double>, sketch binary")
    every = F.explode(F.sequence(F.lit(0), F.col("shards") - 1))
    return routed.join(index.sizes, "cell").withColumn("shard", every).drop("shards")


def _groups(queries: DataFrame, index: CellIndex, run, schema: str) -> DataFrame:
    blocks = -(-max(queries.count(), 1) // index.params.block)
    right = _visits(queries, index).withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    left = index.lists
    # With one block of queries, as ever but for very many, no vector moves twice.
    left = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))) if blocks > 1 else left.withColumn("block", F.lit(0))
    keys = ["cell", "shard", "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)


def pruned_topk(queries: DataFrame, index: CellIndex, n: int = RetrievalParams.vector_candidates) -> DataFrame:
    """Inner-product search in the index: query_id, chunk_id, score, rank, as `vector_topk` gives
    but for the neighbours that lie outside of the visited cells or the radius.

    queries: query_id, embedding. Equal query vectors are searched once. A query with fewer
    than n results within its cells is searched exhaustively, so no list is short.
    """
    if n > index.params.copies:
        raise ValueError("the index holds too few copies of equal vectors for this n")
    types = dict(queries.dtypes)["query_id"], dict(index.lists.dtypes)["chunk_id"]
    schema = f"query_id {types[0]}, chunk_id {types[1]}, score double"
    asked = queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("embedding").isNotNull())
    once = durable(_distinct(asked, "query_id", 1))
    arrow = to_arrow_schema(T._parse_datatype_string(schema))
    cells = _groups(once, index, _cell_search(arrow, n, index.radius), schema)
    best = durable(top_n(cells, ["query_id"], [F.desc("score"), "chunk_id"], n, "rank"))
    full = best.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min(n, index.vectors))
    short = durable(once.join(full, "query_id", "left_anti"))
    if not short.isEmpty():
        again = vector_topk(short, index.lists.select("chunk_id", "embedding"), n, index.params.block, index.params.shard)
        best = best.join(short.select("query_id"), "query_id", "left_anti").unionByName(again)
    # Copies of a query get the rows of the one that was searched.
    names = once.withColumnRenamed("query_id", "_first")
    of = asked.join(names, "embedding").select("query_id", "_first")
    return of.join(best.withColumnRenamed("query_id", "_first"), "_first").select("query_id", "chunk_id", "score", "rank")


def search_work(queries: DataFrame, index: CellIndex) -> DataFrame:
    """One row: cells, probes, radius, pairs of distinct queries and held vectors, pairs whose sketches
    were compared, and pairs scored."""
    asked = queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
    once = durable(_distinct(asked, "query_id", 1))
    schema = "compared bigint, scored bigint"
    arrow = to_arrow_schema(T._parse_datatype_string(schema))
    cells = _groups(once, index, _cell_search(arrow, 1, index.radius, count=True), schema)
    return cells.agg(
        F.lit(len(index.centres)).cast("bigint").alias("cells"),
        F.lit(index.probes).cast("bigint").alias("probes"),
        F.lit(index.radius).cast("bigint").alias("radius"),
        F.lit(once.count() * index.vectors).cast("bigint").alias("pairs"),
        F.coalesce(F.sum("compared"), F.lit(0)).alias("compared"),
        F.coalesce(F.sum("scored"), F.lit(0)).alias("scored"),
    )


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: how many rows of the exact search there are, how many the other search found,
    and their share. Neighbours count by id."""
    hit = exact.select("query_id", "chunk_id").join(found.select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left")
    n = F.count(F.lit(1))
    return hit.agg(n.alias("neighbours"), F.count("hit").alias("found"), (F.count("hit") / n).alias("recall"))
