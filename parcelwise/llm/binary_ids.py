"""Token ids as patched frame-of-reference files.

A segment file holds the ids of consecutive documents in blocks of BLOCK ids. A block
stores its minimum, the ids less the minimum packed at the width that PERCENTILE of
them need, and an exception list (place, high bits) for the others. The block index
gives each block's start, so any range of ids is read without the blocks before it.

Layout, little-endian: magic `PFR1`; u32 documents, u64 ids, u32 blocks; i64 document
ids; u8 flags (1: the id is null); u64 ids per document; u64 block starts, relative to
the first block; the blocks. A block: u32 minimum, u8 width, u16 exceptions, the packed
ids (bit i of an id at bit i of its field, fields from the lowest bit on), u8 places,
u32 high parts.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from parcelwise.llm.common import blocks, encoder
from parcelwise.session import durable

BLOCK = 128
PERCENTILE = 90
#: Ids after which a segment is closed, at the end of a document.
SEGMENT_IDS = 1_000_000
END_ID = 2
MAGIC = b"PFR1"


def pack_blocks(ids: np.ndarray, percentile: int = PERCENTILE) -> tuple[bytes, np.ndarray]:
    """The blocks of an id array, and the start of each.

    All blocks of one width are packed together; the last, shorter block is filled
    with its minimum, and readers know the number of ids."""
    n = len(ids)
    if not n:
        return b"", np.zeros(0, np.uint64)
    count = -(-n // BLOCK)
    fill = np.full(count * BLOCK, 0, np.uint32)
    fill[:n] = ids
    fill[n:] = ids[(count - 1) * BLOCK :].min()
    table = fill.reshape(count, BLOCK)
    low = table.min(1)
    rest = table - low[:, None]
    kth = np.partition(rest, (BLOCK * percentile + 99) // 100 - 1, axis=1)[:, (BLOCK * percentile + 99) // 100 - 1]
    width = np.ceil(np.log2(kth.astype(np.float64) + 1)).astype(np.int64)
    over = rest >> width[:, None].astype(np.uint32) if width.max() < 32 else rest.astype(np.uint64) >> width[:, None].astype(np.uint64)
    packed: list[bytes] = [b""] * count
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        if w:
            bits = np.unpackbits(np.ascontiguousarray(rest[rows]).view(np.uint8).reshape(len(rows), BLOCK, 4), axis=2, bitorder="little")[:, :, :w]
            data = np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little")
            for r, row in zip(rows.tolist(), data, strict=True):
                packed[r] = row.tobytes()
    where, place = np.nonzero(over)
    high = over[where, place].astype("<u4")
    cuts = np.searchsorted(where, np.arange(count + 1))
    out, starts, at = [], np.zeros(count, np.uint64), 0
    place = place.astype(np.uint8)
    for i in range(count):
        a, b = cuts[i], cuts[i + 1]
        x = struct.pack("<IBH", low[i], width[i], b - a) + packed[i] + place[a:b].tobytes() + high[a:b].tobytes()
        starts[i] = at
        at += len(x)
        out.append(x)
    return b"".join(out), starts


def unpack_block(data: memoryview, at: int) -> np.ndarray:
    """The BLOCK ids of the block that starts at `at`."""
    low, width, n = struct.unpack_from("<IBH", data, at)
    at += 7
    size = width * BLOCK // 8
    ids = np.zeros(BLOCK, np.uint64)
    if width:
        bits = np.unpackbits(np.frombuffer(data, np.uint8, size, at), bitorder="little").reshape(BLOCK, width)
        wide = np.zeros((BLOCK, 32), np.uint8)
        wide[:, :width] = bits
        ids += np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()
    at += size
    places = np.frombuffer(data, np.uint8, n, at)
    ids[places] |= np.frombuffer(data, "<u4", n, at + n).astype(np.uint64) << np.uint64(width)
    return (ids + np.uint64(low)).astype("<u4")


def write_segment(docs: list[tuple[int | None, bytes]], percentile: int = PERCENTILE) -> bytes:
    """A segment file of (doc_id, ids) in the order given."""
    ids = np.frombuffer(b"".join(x for _, x in docs), "<u4")
    body, starts = pack_blocks(ids, percentile)
    return b"".join(
        (
            MAGIC,
            struct.pack("<IQI", len(docs), len(ids), len(starts)),
            np.array([d or 0 for d, _ in docs], "<i8").tobytes(),
            np.array([d is None for d, _ in docs], np.uint8).tobytes(),
            np.array([len(x) // 4 for _, x in docs], "<u8").tobytes(),
            starts.astype("<u8").tobytes(),
            body,
        )
    )


class Segment:
    """Reads a segment file; blocks are decoded as they are asked for."""

    def __init__(self, data: bytes):
        self.data = memoryview(data)
        if bytes(self.data[:4]) != MAGIC:
            raise ValueError("not a segment file")
        docs, self.n_ids, count = struct.unpack_from("<IQI", self.data, 4)
        at = 20
        self.doc_ids = np.frombuffer(self.data, "<i8", docs, at)
        at += 8 * docs
        self.nulls = np.frombuffer(self.data, np.uint8, docs, at)
        at += docs
        self.counts = np.frombuffer(self.data, "<u8", docs, at).astype(np.int64)
        at += 8 * docs
        self.starts = np.frombuffer(self.data, "<u8", count, at)
        self.body = at + 8 * count

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids start (inclusive) to stop of the segment."""
        if stop <= start:
            return np.zeros(0, "<u4")
        first, last = start // BLOCK, (stop - 1) // BLOCK
        got = self._many(first, last + 1)
        return got[start - first * BLOCK : stop - first * BLOCK]

    def _many(self, first: int, stop: int) -> np.ndarray:
        """The ids of consecutive blocks; blocks of one width are unpacked together."""
        at = self.starts[first:stop].astype(np.int64) + self.body
        raw = np.frombuffer(self.data, np.uint8)
        head = raw[at[:, None] + np.arange(7)]
        low = np.ascontiguousarray(head[:, :4]).view("<u4").ravel()
        width, count = head[:, 4].astype(np.int64), np.ascontiguousarray(head[:, 5:7]).view("<u2").ravel().astype(np.int64)
        out = np.zeros((len(at), BLOCK), np.uint32)
        for w in np.unique(width):
            rows = np.flatnonzero(width == w)
            if w:
                bits = np.unpackbits(raw[at[rows, None] + 7 + np.arange(w * BLOCK // 8)], axis=1, bitorder="little").reshape(len(rows), BLOCK, w)
                wide = np.zeros((len(rows), BLOCK, 32), np.uint8)
                wide[:, :, :w] = bits
                out[rows] = np.packbits(wide, axis=2, bitorder="little").view("<u4").reshape(len(rows), BLOCK)
        own = np.repeat(np.arange(len(at)), count)
        nth = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
        lists = at + 7 + width * (BLOCK // 8)
        place = raw[lists[own] + nth]
        high = np.ascontiguousarray(raw[(lists[own] + count[own] + 4 * nth)[:, None] + np.arange(4)]).view("<u4").ravel()
        out[own, place] |= (high.astype(np.uint64) << width[own].astype(np.uint64)).astype(np.uint32)
        return (out + low[:, None]).ravel().astype("<u4")


def write_ids(
    documents: DataFrame,
    tokenizer: str,
    end_id: int | None = END_ID,
    segment_ids: int = SEGMENT_IDS,
    percentile: int = PERCENTILE,
) -> DataFrame:
    """Encode the documents and write segment files in ascending doc_id order.

    The texts are dealt by doc_id range once and encoded where they land, so ids are
    never shuffled. Each segment file is a row (part, at, n_ids, segment) of a table in
    the shared folder: Spark's committer keeps lost tasks from leaving half files, on any
    store Spark writes. part is the range, `at` the number of ids of that range before
    the segment. Null texts are empty; null doc_ids come first; rows with equal doc_id are
    kept, ordered by text; an empty table gives no segment.
    """
    ordered = (
        documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .repartitionByRange(F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    )

    def run(batches):
        part, at, held, size = TaskContext.get().partitionId(), 0, [], 0

        def closed():
            return pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part], pa.int32()),
                    "at": pa.array([at], pa.int64()),
                    "n_ids": pa.array([size], pa.int64()),
                    "segment": pa.array([write_segment(held, percentile)], pa.binary()),
                }
            )

        end = b"" if end_id is None else struct.pack("<I", end_id)
        own = encoder(tokenizer)
        for rows, texts in blocks(batches):
            for doc_id, ids in zip(rows.column("doc_id").to_pylist(), own.encode(texts), strict=True):
                held.append((doc_id, ids + end))
                size += len(held[-1][1]) // 4
                if size >= segment_ids:
                    yield closed()
                    at, held, size = at + size, [], 0
        if held:
            yield closed()

    return durable(ordered.mapInArrow(run, "part int, at long, n_ids long, segment binary"))


def read_ids(segments: DataFrame, with_ids: bool = False) -> DataFrame:
    """Per document of the segment files: doc_id, start (ids of all documents before it),
    n_tokens, ids_crc32, and with_ids the ids themselves.

    Only one total per range reaches the driver, as many as the writing had partitions.
    """
    spark = segments.sparkSession
    totals = {r.part: r.n for r in segments.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    before, base = {}, 0
    for part in sorted(totals):
        before[part] = base
        base += totals[part]

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                part, at, data = (one.column(c)[0].as_py() for c in ("part", "at", "segment"))
                own = Segment(data)
                ids = own.read(0, own.n_ids)
                ends = np.cumsum(own.counts)
                each = [ids[b - n : b].tobytes() for b, n in zip(ends.tolist(), own.counts.tolist(), strict=True)]
                out = {
                    "doc_id": pa.array(own.doc_ids, pa.int64(), mask=own.nulls.astype(bool)),
                    "start": pa.array(before[part] + at + ends - own.counts, pa.int64()),
                    "n_tokens": pa.array(own.counts, pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(x) for x in each], pa.int64()),
                }
                yield pa.RecordBatch.from_pydict(out | ({"ids": pa.array(each, pa.binary())} if with_ids else {}))

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return segments.select("part", "at", "segment").mapInArrow(run, schema)


def query(spark: SparkSession, path: str) -> DataFrame:
    documents = spark.read.parquet(f"{path}/documents.parquet")
    return read_ids(write_ids(documents, public_tokenizers.path("byte_bpe_50k.json")))
