"""Sum-of-squares packing of documents into sequences of a fixed number of tokens.

Every document is encoded and given an end id; documents longer than a sequence are cut
into pieces. Each piece goes where the squared counts of open sequences per residual gap
become smallest: into the open sequence whose gap g changes that sum least, or into a
new one. Pieces are dealt into shards by a hash, and each shard packs its own, so the
work spreads; the loss is a few part-filled sequences a shard.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from parcelwise.llm.common import blocks, encoder
from parcelwise.session import durable

CAPACITY = 4096
END_ID = 1
#: Pieces in a shard, about; shards are as many as the table needs.
SHARD_PIECES = 50_000


def pieces(documents: DataFrame, tokenizer: str, end_id: int = END_ID, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every document's pieces."""

    def run(batches):
        end = np.array([end_id], "<u4").tobytes()
        own = encoder(tokenizer)
        for rows, texts in blocks(batches):
            place, piece, start, parts = [], [], [], []
            for i, ids in enumerate(own.encode(texts)):
                ids += end
                for k in range(-(-len(ids) // (4 * capacity))):
                    place.append(i)
                    piece.append(k)
                    start.append(k * capacity)
                    parts.append(ids[4 * k * capacity : 4 * (k + 1) * capacity])
            out = {
                "doc_id": rows.column("doc_id").take(pa.array(place, pa.int64())),
                "piece": pa.array(piece, pa.int32()),
                "start": pa.array(start, pa.int64()),
                "length": pa.array([len(x) // 4 for x in parts], pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(x) for x in parts], pa.int64()),
            }
            yield pa.RecordBatch.from_pydict(out | ({"ids": pa.array(parts, pa.binary())} if with_ids else {}))

    return documents.select("doc_id", "text").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    )


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, placed in the order given.

    open_[g] counts open bins with gap g. An item of size s in a bin of gap g changes the
    sum of squares by 2 (open_[g - s] - open_[g]) + 2, or by 1 - 2 open_[g] if it fills the
    bin; a new bin adds 2 open_[capacity - s] + 1. The smallest gap wins ties.
    """
    open_ = np.zeros(capacity + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    used = 0
    for i, s in enumerate(lengths.tolist()):
        here = open_[s:]
        change = 2 * (open_[: capacity + 1 - s] - here) + 2
        change[0] = 1 - 2 * here[0]
        change[here == 0] = 1 << 60
        g = int(change.argmin())
        new = 2 * int(open_[capacity - s]) + 1 if s < capacity else 0
        if change[g] <= new:
            gap = g + s
            b = stacks[gap].pop()
            open_[gap] -= 1
        else:
            gap, b = capacity, used
            used += 1
        bins[i], offsets[i] = b, capacity - gap
        if gap > s:
            open_[gap - s] += 1
            stacks[gap - s].append(b)
    return bins, offsets


def _pack(key, rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Pack one shard, longest pieces first; equal lengths by hash."""
    order = rows.sort_values(["length", "_mix", "doc_id", "piece"], ascending=[False, True, True, True], kind="stable")
    b, at = sum_of_squares(order["length"].to_numpy(), capacity)
    return order.drop(columns=["_mix", "_shard"]).assign(sequence_id=(int(key[0]) << 40) + b, offset=at)


def pack_documents(
    documents: DataFrame,
    tokenizer: str,
    end_id: int = END_ID,
    capacity: int = CAPACITY,
    shard_pieces: int = SHARD_PIECES,
    with_ids: bool = False,
) -> DataFrame:
    """Every piece with its sequence_id and offset.

    Null texts count as empty and hold the end id alone; repeated rows are packed each
    for itself; an empty table gives no rows. The pieces are written once, since both
    their number and their places are needed. A sequence_id holds the shard above bit 40.
    """
    cut = durable(pieces(documents, tokenizer, end_id, capacity, with_ids))
    shards = max(1, -(-cut.count() // shard_pieces))
    sizes = cut.select("doc_id", "piece", "start", "length", "ids_crc32")
    mixed = sizes.withColumn("_mix", F.xxhash64("doc_id", "piece", "ids_crc32"))
    # Whole lengths are dealt round by hash, so each shard sees the same mix of lengths.
    dealt = mixed.withColumn("_shard", F.pmod("_mix", F.lit(shards)).cast("int"))

    def run(key, rows):
        return _pack(key, rows, capacity)

    packed = dealt.groupBy("_shard").applyInPandas(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
    if not with_ids:
        return packed
    ids = cut.select("doc_id", "piece", "ids_crc32", "ids").dropDuplicates(["doc_id", "piece", "ids_crc32"])
    return packed.join(ids.withColumnsRenamed({"doc_id": "_d", "piece": "_p", "ids_crc32": "_c"}), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("piece") == F.col("_p")) & (F.col("ids_crc32") == F.col("_c"))).drop("_d", "_p", "_c")


def query(spark: SparkSession, path: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{path}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
