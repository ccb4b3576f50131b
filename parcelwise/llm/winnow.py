"""Document fingerprints by winnowing.

Rolling hashes of all K-grams of characters are taken; of every WINDOW neighbouring ones
the smallest is kept, the rightmost of equals. Any passage of K + WINDOW - 1 characters
that two texts share leaves a common fingerprint in both, and none is shorter than K.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession, functions as F

from parcelwise.llm.common import blocks

K = 16
#: Texts that share 23 characters share a hash.
WINDOW = 8
BASE = 0x100000001B3 | 1 << 45
#: Documents in a range of neighbours, about.
RANGE_ROWS = 5_000


def gram_hashes(points: np.ndarray, k: int = K) -> np.ndarray:
    """A 32-bit hash of each k-gram of code points. k is a power of two: polynomial hashes of
    2, 4, ... characters are put together from two halves. Shorter texts are one gram."""
    h = points.astype(np.uint64) + np.uint64(1)
    if 0 < len(h) < k:
        total = 0
        for p in h.tolist():
            total = (total * BASE + p) & 0xFFFFFFFFFFFFFFFF
        h = np.array([total], np.uint64)
    else:
        step, power = 1, BASE
        while step < k:
            h = h[:-step] * np.uint64(power & 0xFFFFFFFFFFFFFFFF) + h[step:]
            power, step = power * power & 0xFFFFFFFFFFFFFFFF, 2 * step
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return h >> np.uint64(32)


def winnow(text: str, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (u32) and positions (code points) that the text keeps. A text with fewer than
    `window` grams keeps its smallest; an empty one keeps none."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    h = gram_hashes(points, k)
    if not len(h):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    places = np.arange(len(h), dtype=np.uint64)
    # The hash above, then the place counted from the right: the minimum is the rightmost.
    least = (h << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - places)
    size, step = min(window, len(h)), 1
    while 2 * step <= size:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if step < size:
        least = np.minimum(least[: len(least) - (size - step)], least[size - step :])
    kept = least[np.concatenate(([True], least[1:] != least[:-1]))]
    return (kept >> np.uint64(32)).astype(np.uint32), (np.uint64(0xFFFFFFFF) - (kept & np.uint64(0xFFFFFFFF))).astype(np.int64)


def as_text(hashes: np.ndarray, places: np.ndarray) -> str:
    """Hash and position of each kept gram, 8 hex digits each."""
    return np.stack([hashes, places.astype(np.uint32)], axis=1).astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared hashes over all hashes of two fingerprints; 1 for two empty ones."""
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def fingerprints(documents: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """doc_id, hash, place: the kept grams of every document, for matching passages."""

    def run(batches):
        for rows, texts in blocks(batches):
            kept = [winnow(t, k, window) for t in texts]
            counts = [len(h) for h, _ in kept]
            place = pa.array(np.repeat(np.arange(len(texts)), counts))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": rows.column("doc_id").take(place),
                    "hash": pa.array(np.concatenate([h for h, _ in kept]).astype(np.int64)),
                    "place": pa.array(np.concatenate([p for _, p in kept])),
                }
            )

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, hash long, place long")


def with_next(documents: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Rows (doc_id, text) dealt into ranges of doc_id, as (part, last, doc_id, text) sorted by
    part, last, doc_id, text: `last` rows are copies of the next range's first documents,
    so each document's follower stands behind it. The table's first documents follow its
    last ones. Texts move once; the driver holds two numbers for each range."""
    ids = documents.select("doc_id")
    n = ids.where("doc_id is not null").count()
    parts = max(1, -(-n // range_rows))
    cuts = ids.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], max(10_000, 10 * parts))).first()[0] if parts > 1 else []
    splits = [-np.inf, *sorted({float(c) for c in cuts}), np.inf]
    if len(splits) == 2:
        splits.insert(1, 0.0)
    bucket = Bucketizer(splits=splits, inputCol="_id", outputCol="_part")
    placed = lambda df: bucket.transform(df.withColumn("_id", F.coalesce(F.col("doc_id").cast("double"), F.lit(-1.7e308)))).drop("_id").withColumn("_part", F.col("_part").cast("int"))
    # Null doc_ids are in the first range and before all others.
    found = placed(ids).groupBy("_part").agg(F.min("doc_id").alias("id"), F.max(F.col("doc_id").isNull()).alias("none"))
    firsts = sorted((r["_part"], None if r["none"] else r["id"]) for r in found.collect())
    before = [(firsts[i - 1][0], firsts[i][1]) for i in range(len(firsts))]
    spark = documents.sparkSession
    table = pa.table({"_to": pa.array([a for a, _ in before], pa.int32()), "_first": pa.array([b for _, b in before], pa.int64())})
    follow = spark.createDataFrame(table)
    both = placed(documents).join(F.broadcast(follow), F.col("doc_id").eqNullSafe(F.col("_first")), "left")
    targets = F.array_compact(F.array(F.struct(F.col("_part").alias("part"), F.lit(0).alias("last")), F.when(F.col("_to").isNotNull(), F.struct(F.col("_to").alias("part"), F.lit(1).alias("last")))))
    dealt = both.select(F.explode(targets).alias("_t"), "doc_id", F.coalesce("text", F.lit("")).alias("text")).select("_t.part", "_t.last", "doc_id", "text")
    order = ["part", "last", F.col("doc_id").asc_nulls_first(), "text"]
    # Range numbers are partition numbers, so no task gets two ranges by chance.
    return dealt.repartitionById(parts, F.col("part")).sortWithinPartitions(*order)


def compare_edited(documents: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """Per document: n_chars, the digest of its edited text, both fingerprints, and how alike
    they and the next document's are.

    The edited text ends in the next document's beginning instead of its own second half.
    Null texts are empty; documents with equal doc_id follow one another by text; null
    doc_ids come first; a lone document follows itself; an empty table gives no rows.
    """

    def row(here, there):
        (doc_id, text, own), (_, follower, next_own) = here, there
        half = len(text) // 2
        edited = text[: len(text) - half] + follower[:half]
        changed = winnow(edited, k, window)
        return (
            doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), as_text(*own), as_text(*changed),
            likeness(own[0], changed[0]), likeness(own[0], next_own[0]),
        )

    names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())

    def run(batches):
        held, at, ended = None, None, False
        for rows, texts in blocks(batches):
            out = []
            for part, last, doc_id, text in zip(rows.column("part").to_pylist(), rows.column("last").to_pylist(), rows.column("doc_id").to_pylist(), texts, strict=True):
                if part != at:
                    held, at, ended = None, part, False
                if ended:  # further copies of the next range's first doc_id
                    continue
                now = (doc_id, text, winnow(text, k, window))
                if held is not None:
                    out.append(row(held, now))
                held, ended = now, bool(last)
            if out:
                yield pa.RecordBatch.from_pydict({n: pa.array(list(v), t) for n, v, t in zip(names, zip(*out, strict=True), kinds, strict=True)})

    ordered = with_next(documents.select(F.col("doc_id").cast("long"), "text"))
    return ordered.mapInArrow(
        run,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )


def query(spark: SparkSession, path: str) -> DataFrame:
    return compare_edited(spark.read.parquet(f"{path}/documents.parquet"))
