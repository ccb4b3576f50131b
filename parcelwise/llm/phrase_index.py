"""Benchmark decontamination with a distributed positional inverted index.

The index of a corpus is a table of segments, each over a block of documents: for each of a
segment's terms the list of its positions. A segment numbers its words through all its
documents, with a gap of one between two documents, so no phrase reaches across. A common
term's list is thereby cut by segments and none grows with the corpus.

Benchmark items are cut into windows of WORDS consecutive words. Within a segment a
window's lists are moved by the terms' offsets and intersected, beginning with the rarest:
what is left are the places of exact phrases. A second search keeps places of the rarest
term that have all other terms near by: proximity matches, whose words may stand in any
order within NEAR words.

Items meet segments in a stated query set, in chunks of bounded size: a group holds one
segment's lists of one chunk's terms. Nothing is broadcast and no list of all documents exists.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from parcelwise.llm.common import BLOCK_CHARS, blocks
from parcelwise.session import durable

#: Words of a window; an item of fewer is one window.
WORDS = 10
#: Words that a proximity match may span.
NEAR = 15
#: Characters of items searched together; larger benchmarks are searched in several chunks.
CHUNK_CHARS = 4_000_000

_KEEP = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
#: UTF-8 bytes to words: A-Z in lower case, all but 0-9, a-z and non-ASCII to spaces.
TABLE = bytes(x if x in _KEEP else x + 32 if 0x41 <= x <= 0x5A else 32 for x in range(256))


def words_of(text: str) -> list[bytes]:
    """The words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of a text with A-Z in lower case, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(TABLE).split()


def postings(texts: list[list[bytes]]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The terms of the texts, all their positions term by term, and where each term's end.

    Words are numbered through all texts with a gap of one between two."""
    ids = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(texts)))}
    sizes = np.array([len(t) for t in texts], np.int64)
    word = np.fromiter(map(ids.__getitem__, chain.from_iterable(texts)), np.int32, int(sizes.sum()))
    at = np.arange(len(word)) + np.repeat(np.arange(len(texts)), sizes)
    wide = len(word) + len(texts) >= 1 << 32
    order = np.argsort(word, kind="stable")
    return list(ids), at[order].astype("<u8" if wide else "<u4"), np.cumsum(np.bincount(word, minlength=len(ids)))


def build_index(documents: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The stored index of documents (doc_id, text, others): segment, term, width, positions.

    A segment's row without a term lists its documents: doc_ids, and n_words of each. Null
    texts have no words. Segments are numbered by task and block.
    """
    kind = dict(documents.dtypes)["doc_id"]

    def run(batches):
        task, number = TaskContext.get().partitionId(), 0
        names = ("segment", "term", "width", "positions", "doc_ids", "n_words")
        for rows, texts in blocks(batches, block_chars):
            words = [words_of(t) for t in texts]
            segment, number = (task << 32) + number, number + 1
            ids = rows.column("doc_id")
            head = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            counts = pa.array([[len(w) for w in words]], pa.list_(pa.int64()))
            columns = [pa.array([segment]), pa.nulls(1, pa.string()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), head, counts]
            yield pa.RecordBatch.from_arrays(columns, names)
            terms, places, ends = postings(words)
            starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
            for i in range(0, len(terms), 20_000):
                some = terms[i : i + 20_000]
                n, a, b = len(some), int(starts[i]), int(ends[i + len(some) - 1])
                offsets = (np.append(starts[i : i + n], b) - a) * places.itemsize
                lists = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(places[a:b])])
                columns = [
                    pa.array(np.full(n, segment)),
                    pa.array(some, pa.binary()).cast(pa.string()),
                    pa.array(np.full(n, places.itemsize, np.int32)),
                    lists.cast(pa.binary()),
                    pa.nulls(n, head.type),
                    pa.nulls(n, counts.type),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"segment bigint, term string, width int, positions binary, doc_ids array<{kind}>, n_words array<bigint>"
    return durable(documents.select("doc_id", "text").mapInArrow(run, schema))


def phrase(lists: list[np.ndarray]) -> np.ndarray:
    """Where a phrase begins: the positions p with p + i in the i-th list for each i."""
    order = sorted(range(len(lists)), key=lambda i: len(lists[i]))
    first = order[0]
    found = lists[first][lists[first] >= first] - first
    for i in order[1:]:
        if not len(found):
            break
        at = np.searchsorted(lists[i], found + i)
        at[at == len(lists[i])] = 0
        found = found[lists[i][at] == found + i]
    return found


def proximity(words: list[bytes], lists: dict[bytes, np.ndarray], span: int, starts: np.ndarray, skip: np.ndarray) -> list[tuple[int, int, int]]:
    """Places (document, first word, length) that hold all the words, in any order, within `span`
    words of a document: the shortest around each occurrence of the rarest word. Documents
    marked in `skip` are left out."""
    need = Counter(words)
    order = sorted(need, key=lambda w: len(lists[w]))
    rare = order[0]
    around = lists[rare]
    for w in order[1:]:
        if not len(around):
            return []
        own = lists[w]
        low = np.searchsorted(own, np.maximum(around, span - 1) - (span - 1))
        high = np.searchsorted(own, around + (span - 1), side="right")
        around = around[high - low >= need[w]]
    docs = np.searchsorted(starts, around, side="right") - 1
    out = set()
    for p, d in zip(around[~skip[docs]].tolist(), docs[~skip[docs]].tolist(), strict=True):
        begin, end = int(starts[d]), int(starts[d + 1]) if d + 1 < len(starts) else p + span
        near = []
        for w in order:
            a, b = np.searchsorted(lists[w], (max(p - span + 1, begin), min(p + span, end)))
            near += [(int(x), w) for x in lists[w][a:b]]
        near.sort()
        have, left, best = Counter(), 0, None
        missing = sum(need.values())
        for at, w in near:
            have[w] += 1
            missing -= have[w] <= need[w]
            while not missing:
                first, v = near[left]
                if at - first < span and first <= p <= at and (best is None or at - first < best[1] - best[0]):
                    best = (first, at)
                have[v] -= 1
                missing += have[v] < need[v]
                left += 1
        if best:
            out.add((d, best[0] - begin, best[1] - best[0] + 1))
    return sorted(out)


def windows(words: list[bytes], size: int = WORDS) -> list[list[bytes]]:
    """All runs of `size` words; a shorter item is one, one without words has none."""
    if len(words) <= size:
        return [words] if words else []
    return [words[i : i + size] for i in range(len(words) - size + 1)]


def search_segment(
    lists: dict[bytes, np.ndarray], items: list[list[bytes]], starts: np.ndarray, size: int = WORDS, near: int | None = NEAR
) -> Iterator[tuple[int, int, str, int, int]]:
    """(document, item, kind, first word, length) for each stretch of a segment's documents
    that an item's windows match. `starts`: the position of each document's first word.

    Stretches of kind exact are unions of phrases, word numbers are the document's own. Those
    of kind near are given for documents in which the item has no exact one.
    """
    for item, words in enumerate(items):
        found, hit = [], np.zeros(len(starts), bool)
        whole = [w for w in windows(words, size) if all(x in lists for x in w)]
        for w in whole:
            at = phrase([lists[x] for x in w])
            if len(at):
                found.append(np.column_stack((at, at + len(w))))
        if found:
            ends = np.concatenate(found)
            ends = ends[np.lexsort((ends[:, 1], ends[:, 0]))]
            top = np.maximum.accumulate(ends[:, 1])
            cut = np.flatnonzero(np.concatenate(([True], ends[1:, 0] > top[:-1])))
            first, last = ends[cut, 0], np.append(top[cut[1:] - 1], top[-1])
            docs = np.searchsorted(starts, first, side="right") - 1
            hit[docs] = True
            for d, a, n in zip(docs.tolist(), (first - starts[docs]).tolist(), (last - first).tolist(), strict=True):
                yield d, item, "exact", a, n
        for w in whole if near else []:
            for d, a, n in proximity(w, lists, max(near, len(w)), starts, hit):
                yield d, item, "near", a, n


def search(index: DataFrame, items: DataFrame, size: int = WORDS, near: int | None = NEAR, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Matches of items (item_id, text) in the index: segment, document (its number there),
    item_id, kind (exact or near), start and length in words. No near ones if `near` is null.

    Items go in chunks by the hash of their row, so a group stays bounded for any benchmark.
    """
    asked = items.select("item_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    chars = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    chunks = -(-max(chars, 1) // chunk_chars)
    asked = durable(asked.withColumn("chunk", F.pmod(F.xxhash64("item_id", "text"), F.lit(chunks))))
    item_kind = dict(items.dtypes)["item_id"]

    def term_lists(batches):
        for batch in batches:
            for chunk, text in zip(batch.column("chunk").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = sorted(set(words_of(text)))
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk] * len(found), pa.int64()), "term": pa.array(found, pa.binary()).cast(pa.string())})

    terms = durable(asked.select("chunk", "text").mapInArrow(term_lists, "chunk bigint, term string").distinct())
    lists = index.where("term IS NOT NULL").select("segment", "term", "width", "positions").join(terms, "term")
    heads = index.where("term IS NULL").select(F.col("segment").alias("of"), "n_words")
    # One row for each chunk, of bounded size. Stored, so that Spark knows the size.
    sets = durable(asked.groupBy("chunk").agg(F.collect_list(F.struct("item_id", "text")).alias("items")))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(chunks - 1).cast("bigint")))
    tasks = heads.withColumn("chunk", every).join(sets, "chunk")
    kind_type = "segment bigint, document int, item_id " + item_kind + ", kind string, start bigint, length bigint"

    def run(found: pa.Table, task: pa.Table) -> pa.Table:
        schema = pa.schema([("segment", pa.int64()), ("document", pa.int32()), ("item_id", task.schema.field("items").type.value_type.field("item_id").type),
                            ("kind", pa.string()), ("start", pa.int64()), ("length", pa.int64())])
        if not task.num_rows or not found.num_rows:
            return schema.empty_table()
        sizes = np.array(task["n_words"][0].as_py(), np.int64)
        starts = np.cumsum(sizes + 1) - sizes - 1
        rows, columns = task["items"][0].as_py(), [found[c].to_pylist() for c in ("term", "width", "positions")]
        lists = {t.encode("utf-8", "surrogatepass"): np.frombuffer(p, f"<u{w}").astype(np.int64) for t, w, p in zip(*columns, strict=True)}
        got = list(search_segment(lists, [words_of(r["text"]) for r in rows], starts, size, near))
        segment = task["of"][0].as_py()
        values = zip(*[(segment, d, rows[i]["item_id"], k, a, n) for d, i, k, a, n in got], strict=True) if got else [[]] * 6
        return pa.Table.from_arrays([pa.array(v, f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

    return lists.groupBy("chunk", "segment").cogroup(tasks.groupBy("chunk", "of")).applyInArrow(run, kind_type)


def contamination(documents: DataFrame, items: DataFrame, size: int = WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document
    (doc_id, text, others), against items (item_id, text, others).

    A word is hit if it lies in an occurrence of a window of any item. Null and empty texts
    have no words and no hits, an item without words matches nothing, and items that share an
    item_id count once. Null doc_ids and repeated rows each give a row. Without items nothing
    is hit; an empty table gives no rows.
    """
    index = build_index(documents)
    found = search(index, items, size, None)
    end = F.col("start") + F.col("length")
    # Words that no stretch before (by first word) holds; a window holds one document's stretches.
    order = Window.partitionBy("segment", "document").orderBy("start", "length")
    before = F.coalesce(F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fresh = found.withColumn("fresh", F.greatest(F.lit(0), end - F.greatest("start", before)))
    hits = fresh.groupBy("segment", "document").agg(
        F.sum("fresh").alias("n_hit"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("ids")
    )
    rows = index.where("term IS NULL").select("segment", F.posexplode(F.arrays_zip("doc_ids", "n_words")).alias("document", "row"))
    rows = rows.select("segment", "document", F.col("row")["doc_ids"].alias("doc_id"), F.col("row")["n_words"].alias("n_words"))
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return rows.join(hits, ["segment", "document"], "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def query(spark: SparkSession, path: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/benchmark.parquet"))


_UPPER, _LOWER = string.ascii_uppercase, string.ascii_lowercase
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = rf"""
    WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
      items AS MATERIALIZED (SELECT item_id, {_WORDS} AS ws, least(len(ws), {WORDS}) AS k FROM benchmark),
      wins AS MATERIALIZED (SELECT DISTINCT item_id, k, array_to_string(ws[i:i + k - 1], ' ') AS w
        FROM (SELECT item_id, k, ws, unnest(range(1, len(ws) - k + 2)) AS i FROM items WHERE k > 0)),
      grams AS MATERIALIZED (SELECT r, k, i, array_to_string(ws[i:i + k - 1], ' ') AS w
        FROM (SELECT r, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM wins))),
      found AS MATERIALIZED (SELECT r, item_id, grams.k, i FROM grams JOIN wins ON grams.k = wins.k AND grams.w = wins.w),
      hit AS (SELECT r, count(DISTINCT place) AS n FROM (SELECT r, unnest(range(i, i + k)) AS place FROM found) GROUP BY r),
      ids AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s
        FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY r)
    SELECT doc_id, len(ws) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(ids.n, 0) AS n_items,
      sha256(coalesce(ids.s, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
    FROM docs LEFT JOIN hit ON docs.r = hit.r LEFT JOIN ids ON docs.r = ids.r"""
