"""BM25 search over block-max tiles: nothing but the best rows of a task is shuffled.

Chunks are ordered by length and cut into tiles of a few chunks. A tile is one row with the
postings of its chunks, term by term, and the greatest impact of each term in it (a posting's
impact is its BM25 factor without the query's weight). A frequent term's list is thereby split
over all tiles, and no list or key grows with the corpus.

Queries go out in blocks of bounded size. A task scans its tiles and keeps the n best chunks
of each query. In a tile it first adds up a query's bounds, term by term, and passes over the
tile if they stay below the query's threshold. Else it leaves out as many terms as can't
reach a share of the threshold together, those with the longest lists for their bound first,
scores the others, and adds the left out ones for the chunks that may still reach the
threshold. Thresholds come from a first scan, which scores only the most promising tiles, and rise
with the best rows a task has found. The result is that of the exhaustive search.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from parcelwise.config import RetrievalParams
from parcelwise.operators.retrieval import LexicalIndex, posting_parts, query_terms
from parcelwise.operators.scale import top_n
from parcelwise.session import durable, spread

#: Chunks of a tile.
TILE = 8
#: Share of the threshold that left out terms may reach together.
LEFT_OUT = 0.4
#: Tiles that a task scores in the first scan for each query, those with the greatest bounds so far.
PROMISING = 4
#: Query words of a block, about.
BLOCK_TERMS = 200_000
#: Scores are compared after rounding to six digits.
SLACK = 1e-6


@dataclass(frozen=True)
class TileIndex:
    """tiles(chunks, terms, ends, rows, impacts): the chunk ids of a tile, its terms, where each
    term's postings end, and the chunk number and impact of each posting, as packed numbers."""

    lexical: LexicalIndex
    tiles: DataFrame
    params: RetrievalParams


def build_tiles(index: LexicalIndex, params: RetrievalParams = RetrievalParams(), tile: int = TILE) -> TileIndex:
    """The tiles of an index. A range of chunks by length goes to one task, which packs them."""
    tf = F.col("tf").cast("double")
    norm = params.k1 * (1.0 - params.b + params.b * F.col("dl") / F.lit(float(index.mean_length)))
    parts = posting_parts(index)
    rows = spread(index.postings, parts, "chunk_id", "dl").select("chunk_id", "dl", F.struct("term", (tf * (params.k1 + 1.0) / (tf + norm)).alias("impact")).alias("t"))
    # One row for each chunk, as large as its text.
    chunks = durable(rows.groupBy("chunk_id", "dl").agg(F.sort_array(F.collect_list("t")).alias("terms")))
    kind = dict(chunks.dtypes)["chunk_id"]
    names = ["chunks", "terms", "ends", "rows", "impacts"]

    def pack(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            while held.num_rows >= tile:
                yield one(held.slice(0, tile))
                held = held.slice(tile)
        if held is not None and held.num_rows:
            yield one(held)

    def one(table: pa.Table) -> pa.RecordBatch:
        lists = table["terms"].combine_chunks()
        flat = lists.flatten()
        row = np.repeat(np.arange(table.num_rows, dtype=np.int32), np.diff(lists.offsets.to_numpy()))
        term = pa.compute.dictionary_encode(flat.field("term"))
        code = term.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        ends = np.cumsum(np.bincount(code, minlength=len(term.dictionary))).astype("<i4")
        impact = flat.field("impact").to_numpy()[order].astype("<f8")
        values = [pa.array([ends.tobytes()]), pa.array([row[order].astype("<i4").tobytes()]), pa.array([impact.tobytes()])]
        listed = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (table["chunk_id"].combine_chunks(), term.dictionary)]
        return pa.RecordBatch.from_arrays([*listed, *values], names)

    schema = f"chunks array<{kind}>, terms array<string>, ends binary, rows binary, impacts binary"
    ranges = [parts] if parts else []
    ordered = chunks.repartitionByRange(*ranges, "dl", "chunk_id").sortWithinPartitions("dl", "chunk_id").drop("dl")
    return TileIndex(index, durable(ordered.mapInArrow(pack, schema)), params)


@dataclass(frozen=True)
class _Words:
    """The words of a block of queries: of word k those at starts[k] to starts[k + 1]."""

    names: list
    ids: dict[str, int]
    starts: np.ndarray
    query: np.ndarray
    weight: np.ndarray


def _words(rows: pa.Table) -> _Words:
    names = sorted(set(rows["query_id"].to_pylist()))
    number = {q: i for i, q in enumerate(names)}
    rows = rows.sort_by("term")
    term, ids = rows["term"].to_pylist(), {}
    code = np.array([ids.setdefault(t, len(ids)) for t in term], np.int64)
    starts = np.searchsorted(code, np.arange(len(ids) + 1))
    query = np.array([number[q] for q in rows["query_id"].to_pylist()], np.int64)
    return _Words(names, ids, starts, query, rows["weight"].to_numpy())


def _expand(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All places from each start on, as many as its count."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


class _Tile:
    """A tile's terms that the queries ask for, as entries (query, term, weight, bound)."""

    def __init__(self, row: dict, words: _Words):
        self.chunks = row["chunks"]
        found = [(i, words.ids[t]) for i, t in enumerate(row["terms"].to_pylist()) if t in words.ids]
        at, word = (np.array(x, np.int64) for x in (zip(*found) if found else ((), ())))
        ends = np.frombuffer(row["ends"], "<i4").astype(np.int64)
        self.rows, self.impacts = np.frombuffer(row["rows"], "<i4"), np.frombuffer(row["impacts"], "<f8")
        starts = np.concatenate(([0], ends[:-1]))
        top = np.maximum.reduceat(self.impacts, starts)
        counts = words.starts[word + 1] - words.starts[word]
        place = _expand(words.starts[word], counts)
        self.query, self.weight = words.query[place], words.weight[place]
        term = np.repeat(at, counts)
        self.first, self.count = starts[term], ends[term] - starts[term]
        self.bound = np.maximum(self.weight * top[term], 0.0)

    def keep(self, mask: np.ndarray) -> None:
        for name in ("query", "weight", "first", "count", "bound"):
            setattr(self, name, getattr(self, name)[mask])

    def gains(self, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell (query and chunk as one number) and gain of each posting of the chosen entries."""
        place = _expand(self.first[mask], self.count[mask])
        query, weight = (np.repeat(x[mask], self.count[mask]) for x in (self.query, self.weight))
        return query * len(self.chunks) + self.rows[place], weight * self.impacts[place]


def _score(tile: _Tile, threshold: np.ndarray, left_out: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Cells that may reach their query's threshold, their scores, and postings scored."""
    n = len(threshold)
    wide = len(tile.chunks)
    total = np.bincount(tile.query, tile.bound, n)
    tile.keep((total >= threshold)[tile.query])
    if not len(tile.query):
        return np.zeros(0, np.int64), np.zeros(0), 0
    # Long lists with small bounds first; the entries of a query stand together.
    order = np.lexsort((tile.bound, -tile.count / np.maximum(tile.bound, 1e-12), tile.query))
    tile.keep(order)
    sums = np.cumsum(tile.bound)
    begin = np.flatnonzero(np.concatenate(([True], tile.query[1:] != tile.query[:-1])))
    upto = sums - np.repeat(sums[begin] - tile.bound[begin], np.diff(np.append(begin, len(sums))))
    out = upto < left_out * threshold[tile.query]
    slack = np.bincount(tile.query, np.where(out, tile.bound, 0.0), n)
    cell, gain = tile.gains(~out)
    scored = len(cell)
    sums = np.bincount(cell, gain, n * wide)
    hit = np.zeros(n * wide, bool)
    hit[cell] = True
    maybe = hit & (sums + np.repeat(slack, wide) >= np.repeat(threshold, wide))
    some = out & maybe.reshape(n, wide).any(1)[tile.query]
    cell, gain = tile.gains(some)
    kept = maybe[cell]
    cell, gain = cell[kept], gain[kept]
    scored += len(cell)
    sums += np.bincount(cell, gain, n * wide)
    found = np.flatnonzero(maybe)
    return found, np.round(sums[found], 6), scored


def _scan(words: _Words, n: int, thresholds: np.ndarray, first: bool, left_out: float, count: bool = False):
    """Task function over tiles: the n best (query, chunk_id, score) of each query; with
    `first` of the promising tiles only; with `count` the number of postings scored."""

    def run(batches):
        size, scored, kind = len(words.names), 0, None
        limit, top = thresholds.copy(), np.zeros((size, PROMISING))
        query, ids, score = np.zeros(0, np.int64), [], np.zeros(0)

        def best():
            nonlocal query, ids, score
            keys = np.array(ids)
            order = np.lexsort((keys, -score, query)) if len(query) else np.zeros(0, np.int64)
            q = query[order]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            order = order[place < n]
            query, ids, score = query[order], keys[order].tolist(), score[order]
            last = order_last(query, score)
            limit[last[0]] = np.maximum(limit[last[0]], last[1] - SLACK)

        def order_last(q, s):
            """Queries with n rows and the score of the last."""
            ends = np.flatnonzero(np.append(q[1:] != q[:-1], True)) if len(q) else np.zeros(0, np.int64)
            full = ends[(np.diff(np.append(-1, ends)) == n)]
            return q[full], s[full]

        for batch in batches:
            kind = batch.column("chunks").type.value_type
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                row = {"chunks": row["chunks"].as_py(), "terms": row["terms"].values} | {c: row[c].as_py() for c in ("ends", "rows", "impacts")}
                tile = _Tile(row, words)
                if not len(tile.query):
                    continue
                own = limit
                if first:
                    total = np.bincount(tile.query, tile.bound, size)
                    least = top.argmin(1)
                    better = total > top[np.arange(size), least]
                    top[better, least[better]] = total[better]
                    own = np.where(better, limit, np.inf)
                cell, value, k = _score(tile, own, left_out)
                scored += k
                good = value > 0
                cell, value = cell[good], value[good]
                query = np.concatenate((query, cell // len(tile.chunks)))
                ids += [tile.chunks[x] for x in (cell % len(tile.chunks)).tolist()]
                score = np.concatenate((score, value))
                if len(query) > 4 * n * size + 1000:
                    best()
        if count:
            yield pa.RecordBatch.from_pydict({"scored": pa.array([scored], pa.int64())})
        elif len(query):
            best()
            names = pa.array(words.names).take(pa.array(query))
            yield pa.RecordBatch.from_arrays([names, pa.array(ids, kind), pa.array(score)], ["query_id", "chunk_id", "score"])

    return run


def _blocks(queries: DataFrame, index: TileIndex, block_terms: int):
    """The words of each block of queries. A block is bounded by the hash of the query, so the
    driver holds one at a time."""
    weight = (F.col("qtf") * F.col("idf")).alias("weight")
    terms = durable(query_terms(queries, index.lexical).select("query_id", "term", weight))
    blocks = -(-terms.count() // block_terms)
    for k in range(blocks):
        rows = terms.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k) if blocks > 1 else terms
        found = rows.toArrow()
        if found.num_rows:
            yield _words(found)


def _thresholds(words: _Words, index: TileIndex, n: int, schema: str, left_out: float) -> np.ndarray:
    none = np.zeros(len(words.names))
    found = index.tiles.mapInArrow(_scan(words, n, none, True, left_out), schema)
    last = top_n(found, ["query_id"], [F.desc("score"), "chunk_id"], n, "rank").where(F.col("rank") == n)
    known = {r["query_id"]: r["score"] - SLACK for r in last.select("query_id", "score").collect()}
    return np.array([known.get(q, 0.0) for q in words.names])


def pruned_bm25(
    queries: DataFrame, index: TileIndex, n: int | None = None, block_terms: int = BLOCK_TERMS, left_out: float = LEFT_OUT
) -> DataFrame:
    """Best n chunks per query: query_id, chunk_id, score, rank, equal to `bm25_topk`."""
    n = n or index.params.lexical_candidates
    schema = f"query_id {dict(queries.dtypes)['query_id']}, chunk_id {dict(index.lexical.postings.dtypes)['chunk_id']}, score double"
    out = queries.sparkSession.createDataFrame([], schema)
    for words in _blocks(queries, index, block_terms):
        limits = _thresholds(words, index, n, schema, left_out)
        out = out.unionByName(index.tiles.mapInArrow(_scan(words, n, limits, False, left_out), schema))
    return top_n(out, ["query_id"], [F.desc("score"), "chunk_id"], n, "rank")


def search_work(
    queries: DataFrame, index: TileIndex, n: int | None = None, block_terms: int = BLOCK_TERMS, left_out: float = LEFT_OUT
) -> DataFrame:
    """One row: postings that the exhaustive search scores, those that both scans score, and the share."""
    n = n or index.params.lexical_candidates
    schema = f"query_id {dict(queries.dtypes)['query_id']}, chunk_id {dict(index.lexical.postings.dtypes)['chunk_id']}, score double"
    some = queries.sparkSession.createDataFrame([], "scored bigint")
    for words in _blocks(queries, index, block_terms):
        limits = _thresholds(words, index, n, schema, left_out)
        for first, start in ((True, np.zeros(len(limits))), (False, limits)):
            some = some.union(index.tiles.mapInArrow(_scan(words, n, start, first, left_out, count=True), "scored bigint"))
    asked = query_terms(queries, index.lexical).select("term").join(index.lexical.terms.select("term", "df"), "term")
    whole = asked.agg(F.coalesce(F.sum("df"), F.lit(0)).alias("exhaustive")).withColumn("one", F.lit(1))
    work = some.agg(F.coalesce(F.sum("scored"), F.lit(0)).alias("scored")).withColumn("one", F.lit(1))
    return whole.join(work, "one").select("exhaustive", "scored", F.try_divide("scored", "exhaustive").alias("share"))
