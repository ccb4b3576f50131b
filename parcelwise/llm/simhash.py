"""SimHash near-duplicates through deletion-variant signatures.

A fingerprint of 64 bits is cut into two segments of 32. Two fingerprints that differ in
at most three bits differ in at most one bit of one segment, so they share a variant of
that segment with one bit struck out. Every segment's 32 variants are the index: equal
variants bring candidates together, and each pair is verified.

Buckets hold distinct fingerprints, streamed in key order. A bucket of up to BUCKET
fingerprints is compared whole inside its task, which emits a spanning forest of its
links, never all pairs. A larger one is indexed again by the variants of the two halves
of the other segment; such a bucket leaves at most 2 + 16 bits free, so it is bounded.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from parcelwise.llm.common import map_texts
from parcelwise.session import durable

SHINGLE = 3
SEED = 42
MAX_BITS = 3
BUCKET = 512


def fingerprint(words: list[bytes], shingle: int = SHINGLE) -> int:
    """Bit i is set if it is set in over half the shingles' hashes; 0 without words."""
    if not words:
        return 0
    text = b" ".join(words)
    sizes = [len(w) + 1 for w in words]
    starts = list(accumulate(sizes, initial=0))
    ends = starts[shingle:] if len(words) >= shingle else [starts[-1]]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(text[a : b - 1], SEED) for a, b in zip(starts, ends)], "<u8")
    n, ones = len(hashes), np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint's 64 bits as a long."""

    def run(texts, others):
        found = [fingerprint(x.encode("utf-8", "surrogatepass").lower().split(), shingle) for x in texts]
        return {"fp": pa.array(np.array(found, np.uint64).view(np.int64))}

    return map_texts(documents.select("doc_id", "text"), run, "fp long")


def _variants(value: np.ndarray, bits: int) -> np.ndarray:
    """Rows: the values; columns: each bit struck out."""
    return value[:, None] & ~(np.uint64(1) << np.arange(bits, dtype=np.uint64))[None, :]


def _first_keys(fp: np.ndarray) -> np.ndarray:
    """Two times 32 keys a fingerprint: segment (bit 37), bit struck out (bits 32 to 36), rest."""
    tag = np.arange(32, dtype=np.uint64)[None, :] << np.uint64(32)
    low, high = fp & np.uint64(0xFFFFFFFF), fp >> np.uint64(32)
    return np.concatenate((_variants(low, 32) | tag, _variants(high, 32) | tag | np.uint64(1 << 37)), axis=1)


def _second_keys(key: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """Two times 16 keys for a fingerprint of a large bucket: variants of the other segment's
    halves, as (half, bit, rest)."""
    other = np.where(key >> np.uint64(37) & np.uint64(1), fp & np.uint64(0xFFFFFFFF), fp >> np.uint64(32))
    tag = np.arange(16, dtype=np.uint64)[None, :] << np.uint64(16)
    low, high = other & np.uint64(0xFFFF), other >> np.uint64(16)
    return np.concatenate((_variants(low, 16) | tag, _variants(high, 16) | tag | np.uint64(1 << 20)), axis=1)


def forest(fp: np.ndarray, bits: int = MAX_BITS, block: int = BUCKET) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints: every link's ends are
    joined by it, with fewer links than fingerprints."""
    left, right = [], []
    rest = np.arange(len(fp))
    while len(rest):
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            hit = np.full(len(rest), -1)
            for i in range(0, len(front), block):
                some = front[i : i + block]
                for j in range(0, len(rest), 8192):
                    near = np.bitwise_count(fp[rest[j : j + 8192], None] ^ fp[None, some]) <= bits
                    found = near.any(1)
                    hit[j : j + 8192][found] = some[near[found].argmax(1)]
            new = hit >= 0
            left.append(hit[new])
            right.append(rest[new])
            front, rest = rest[new], rest[~new]
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def _links(names: list[str], limit: int | None, bits: int):
    """A function over batches sorted by the key columns `names`, then fp: the links of
    each bucket, and the rows of buckets over `limit` as they are (b null)."""

    def bucket(keys: np.ndarray, fp: np.ndarray):
        # fp is sorted, so copies within a bucket stand together
        fp = fp[np.concatenate(([True], fp[1:] != fp[:-1]))]
        a, b = forest(fp, bits)
        return fp[a], fp[b]

    def out(key, a, b):
        signed = lambda x: pa.array(np.ascontiguousarray(x).view(np.int64))
        return pa.RecordBatch.from_pydict({"key": signed(key), "a": signed(a), "b": signed(b) if b is not None else pa.nulls(len(a), pa.int64())})

    def run(batches):
        keys, fps, over = np.zeros((0, len(names)), np.uint64), np.zeros(0, np.uint64), None
        for batch in batches:
            new = np.stack([batch.column(c).to_numpy().view(np.uint64) for c in names], axis=1)
            keys, fps = np.concatenate((keys, new)), np.concatenate((fps, batch.column("fp").to_numpy().view(np.uint64)))
            if over is not None:  # the bucket that ran over goes on
                same = (keys == over).all(1)
                n = len(same) if same.all() else int(same.argmin())
                if n:
                    yield out(keys[:n, 0], fps[:n], None)
                    keys, fps = keys[n:], fps[n:]
                if not len(fps):
                    continue
                over = None
            yield from pieces(keys, fps)
            starts = bounds(keys)
            a = starts[-2]
            keys, fps = keys[a:], fps[a:]
            if limit and len(fps) > limit:
                over = keys[0]
                yield out(keys[:, 0], fps, None)
                keys, fps = keys[:0], fps[:0]
        if len(fps):
            yield from pieces(keys, fps, last=True)

    def bounds(keys):
        return np.concatenate(([0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, [len(keys)]))

    def pieces(keys, fps, last=False):
        """Links of all whole buckets; the last one may go on in the next batch."""
        starts = bounds(keys)
        if not last:
            starts = starts[:-1]
        sizes = np.diff(starts)
        two = starts[:-1][sizes == 2]
        a, b = fps[two], fps[two + 1]
        near = (np.bitwise_count(a ^ b) <= bits) & (a != b)
        if near.any():
            yield out(keys[two[near], 0], a[near], b[near])
        for i in np.flatnonzero(sizes > 2).tolist():
            s, e = starts[i], starts[i + 1]
            if limit and e - s > limit:
                yield out(keys[s:e, 0], fps[s:e], None)
            else:
                a, b = bucket(keys[s:e], fps[s:e])
                if len(a):
                    yield out(np.full(len(a), keys[s, 0]), a, b)

    return run


def links(distinct: DataFrame, bits: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that connect all fingerprints of `distinct` (column fp, no repeats) that
    are linked by pairs with at most `bits` (3) differing bits."""

    def first(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            for i in range(0, len(fp), 4096):
                some = fp[i : i + 4096]
                keys = _first_keys(some)
                yield pa.RecordBatch.from_pydict({"key": pa.array(keys.ravel().view(np.int64)), "fp": pa.array(np.repeat(some, 64).view(np.int64))})

    def second(batches):
        for batch in batches:
            key, fp = (batch.column(c).to_numpy().view(np.uint64) for c in ("key", "a"))
            for i in range(0, len(fp), 4096):
                k, f = key[i : i + 4096], fp[i : i + 4096]
                keys = _second_keys(k, f)
                yield pa.RecordBatch.from_pydict({"key": pa.array(np.repeat(k, 32).view(np.int64)), "half": pa.array(keys.ravel().view(np.int64)), "fp": pa.array(np.repeat(f, 32).view(np.int64))})

    indexed = distinct.mapInArrow(first, "key long, fp long")
    found = durable(
        indexed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_links(["key"], bucket, bits), "key long, a long, b long")
    )
    large = found.where("b is null").mapInArrow(second, "key long, half long, fp long")
    more = large.repartition("key", "half").sortWithinPartitions("key", "half", "fp").mapInArrow(_links(["key", "half"], None, bits), "key long, a long, b long")
    return found.where("b is not null").select("a", "b").union(more.select("a", "b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (a, b): the smallest node reachable.

    Alternates two steps until nothing changes: every node's larger neighbours are linked
    to its smallest neighbour, then its smaller ones and itself are. Each round's edges are
    written to the shared folder, so lineage stays short and no executor is needed again.
    """
    now = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Large star: node's neighbours above it are linked to the least of all and itself.
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # Small star: its neighbours below it and itself are linked to the least of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        new = durable(small.where("a <> b").distinct())
        changed = new.exceptAll(now).limit(1).count() + now.exceptAll(new).limit(1).count()
        now = new
        if not changed:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))


def near_duplicates(documents: DataFrame, shingle: int = SHINGLE, bits: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document.

    Null and empty texts have fingerprint zero, which links like any other. Equal
    fingerprints are one node, so thousands of copies cost no pairs. Null doc_ids are rows
    of their own and never a component_id unless the whole group has none. Repeated rows
    are kept; an empty table gives no rows.
    """
    prints = durable(fingerprints(documents, shingle))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("node"))
    found = durable(links(nodes.select("fp"), bits, bucket))
    linked = found.select(F.col("a").alias("fp")).union(found.select(F.col("b").alias("fp"))).distinct()
    # Fingerprints stand for their nodes here; the smallest doc_id is taken at the end.
    labels = components(found)
    group = linked.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"))
    least = nodes.join(group, "fp").groupBy("component").agg(F.min("node").alias("least"))
    of_print = group.join(least, "component").select("fp", "least")
    classes = nodes.join(of_print, "fp", "left").select("fp", F.coalesce("least", "node").alias("component_id"))
    return prints.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def query(spark: SparkSession, path: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{path}/documents.parquet"))
