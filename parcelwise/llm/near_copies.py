"""Near copies for the corpus pipeline: SimHash candidates, verified by exact Jaccard.

A document's fingerprint has 192 bits over its distinct five-word shingles, cut into 12
segments of 16. Two fingerprints that differ in at most 23 bits differ in at most one bit
of one segment, so they share a variant of it with one bit struck out; of pairs further
apart most do. Pairs that differ in at most BITS of the first 128 bits are candidates, and
copies if the Jaccard similarity of their sets of shingles is at least LIKE.

A first round links each fingerprint of a bucket to the first near one only. Each round after
it takes from a bucket, for any two groups that the links so far leave apart, the pair of
nearest fingerprints, and so on until no new link is found. So neither a cluster of many
copies nor its members that are unlike each other cost a square of pairs. Two groups meet in
many buckets and each brings its own nearest pair. A last round takes all pairs of groups
still apart that were not tried, as a pair further apart by fingerprint may be alike where the
nearest is not. In these rounds a pair that counts of its shingles show to be unlike is no
pair: members of a cluster that have much of their own bring no pairs with each other. No
candidate that is alike is left out: the groups are the components of all of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from parcelwise.llm.common import map_texts
from parcelwise.llm.simhash import components
from parcelwise.session import durable

SHINGLE = 5
LIKE = 0.8
SEGMENTS = 12
#: Bits of 128 that candidates differ in at most. At similarity 0.8 some 19 do, +- 4.
BITS = 30


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes], n: int = SHINGLE) -> set[bytes]:
    """The distinct runs of n words; fewer words are one shingle, none have none."""
    if len(words) <= n:
        return {b" ".join(words)} if words else set()
    return {b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)}


def fingerprint(parts: set[bytes]) -> np.ndarray:
    """Three words of 64 bits; a bit is set if it is in over half the shingles' hashes."""
    hashes = np.frombuffer(b"".join([xxhash.xxh3_128_digest(x) + xxhash.xxh3_64_digest(x, 1) for x in parts]), np.uint8).reshape(-1, 24)
    ones = np.zeros(192, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)], axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes)).view("<u8")


def _keys(words: list[np.ndarray]) -> np.ndarray:
    """192 keys a fingerprint: segment (from bit 20), bit struck out (from bit 16), rest."""
    parts = np.stack(words, axis=1).view("<u2").astype(np.int32)
    bit = np.arange(16, dtype=np.int32)
    rest = parts[:, :, None] & ~(1 << bit)[None, None, :]
    return (rest | bit << 16 | (np.arange(SEGMENTS, dtype=np.int32) << 20)[None, :, None]).reshape(len(parts), 16 * SEGMENTS)


def _first_shared(key: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Whether pairs in a bucket, with these differing bits, share no segment before that of the bucket, as far as
    their first 128 bits tell. So a pair counts in few of the up to 192 buckets it is in."""
    parts = np.stack([high, low], axis=1).view("<u2")
    return ~((np.bitwise_count(parts) <= 1) & (np.arange(8) < (key >> 20)[:, None])).any(1)


#: Classes that a document's shingles are counted in, up to COUNT in each; four bits a class.
CLASSES, COUNT = 64, 15
#: What tells how many shingles two documents share at most: number of shingles, of those that no other document
#: has, of those beyond COUNT in their class, and the counts by class.
SHARED = {"size": "int", "own": "int", "over": "int"} | {f"class_{k}": "long" for k in range(CLASSES // 16)}


def _counts(parts: list[int]) -> tuple[int, np.ndarray]:
    """Shingles beyond COUNT in their class, and the counts by class, for hashes of shingles."""
    counts = np.bincount(np.array(parts, np.int64) & CLASSES - 1, minlength=CLASSES)
    most = np.minimum(counts, COUNT).astype(np.uint8)
    return int(len(parts) - most.sum()), (most[::2] | most[1::2] << 4).view(np.int64)


def _may_be_alike(one: list[np.ndarray], two: list[np.ndarray], like: float) -> np.ndarray:
    """Whether pairs with these columns of SHARED may have a Jaccard similarity of `like`; true of all that have."""
    size, own, over = ((x.astype(np.int64), y.astype(np.int64)) for x, y in zip(one[:3], two[:3]))
    shared = np.minimum(size[0] - own[0], size[1] - own[1])
    a, b = (np.stack(x[3:], axis=1).view(np.uint8) for x in (one, two))
    each = np.minimum(a & 15, b & 15).sum(1, dtype=np.int64) + np.minimum(a >> 4, b >> 4).sum(1, dtype=np.int64)
    shared = np.minimum(shared, each + np.minimum(*over))
    return shared >= like / (1 + like) * (size[0] + size[1]) - 1e-6


#: Near pairs held at once before they are reduced to the nearest of any two groups, or handed on.
HELD_PAIRS = 2_000_000


def _near(bits: int, apart: bool, like: float = LIKE, every: bool = False):
    """A function over rows (key, node, high, low, label, out) sorted by key and node: the near
    pairs of each bucket that share no segment before it. With `apart` the nearest of any two labels
    that may be alike, by columns of SHARED behind the others, or with `every` all of these; else for each row one. out: the bit that the key strikes out. Pairs with the same one share the bucket of
    bit 0 too and count there; a row that has such a near row brings no other, as it is in a pair already."""

    def nearest(held):
        """Of the pairs (bucket, label, other label, distance, a, b) the nearest for each two labels of a bucket."""
        key, one, two, far, a, b = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((b, a, far, two, one, key))
        key, one, two, far, a, b = (x[order] for x in (key, one, two, far, a, b))
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])))
        return [tuple(x[new] for x in (key, one, two, far, a, b))]

    def pairs(key, node, high, low, label, out, *shared):
        zero = (key >> 16 & 15) == 0
        high, low = high.view(np.uint64), low.view(np.uint64)  # bits of signed numbers count by absolute value
        at = np.arange(len(key))
        place = at - np.maximum.accumulate(np.where(np.concatenate(([True], key[1:] != key[:-1])), at, 0))
        first, after = np.full(len(key), -1), np.full(len(key), -1)
        linked = np.zeros(len(key), bool)
        rows, shift, held = np.flatnonzero(place >= 1), 1, []
        while len(rows):
            other = rows - shift
            x, y = high[rows] ^ high[other], low[rows] ^ low[other]
            far = np.bitwise_count(x) + np.bitwise_count(y)
            near = far <= bits
            same = near & ~zero[rows] & (out[rows] == out[other])
            linked[rows[same]] = linked[other[same]] = True
            near &= ~same
            near[near] = _first_shared(key[rows[near]], x[near], y[near])
            if apart:
                near &= label[rows] != label[other]
                if near.any():
                    i, j = rows[near], other[near]
                    near[near] = _may_be_alike([x[i] for x in shared], [x[j] for x in shared], like)
                if near.any():
                    i, j = other[near], rows[near]
                    held.append((key[i], np.minimum(label[i], label[j]), np.maximum(label[i], label[j]), far[near], node[i], node[j]))
                    if sum(len(x[0]) for x in held) > HELD_PAIRS:
                        if every:
                            yield tuple(np.concatenate(x) for x in [*zip(*held)][4:])
                        held = [] if every else nearest(held)
            else:
                first[rows[near]] = other[near]
                after[other[near]] = rows[near]
            shift += 1
            rows = rows[place[rows] >= shift]
        # A row with later near ones only brings one of them, unless that one brings this row.
        some = np.flatnonzero((first >= 0) & ~linked)
        alone = np.flatnonzero((first < 0) & (after >= 0) & ~linked)
        alone = alone[(first[after[alone]] != alone) | linked[after[alone]]]
        if len(some):
            yield np.concatenate((node[first[some]], node[alone])), np.concatenate((node[some], node[after[alone]]))
        if held:
            yield tuple(np.concatenate(x) for x in [*zip(*held)][4:]) if every else nearest(held)[0][4:]

    def run(batches):
        held = None
        for batch in batches:
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            last = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            whole, held = [x[:last] for x in held], [x[last:] for x in held]
            if last:
                for a, b in pairs(*whole):
                    yield pa.RecordBatch.from_pydict({"a": pa.array(a), "b": pa.array(b)})
        if held is not None and len(held[0]):
            for a, b in pairs(*held):
                yield pa.RecordBatch.from_pydict({"a": pa.array(a), "b": pa.array(b)})

    return run


def candidates(nodes: DataFrame, bits: int, apart: bool, like: float = LIKE, every: bool = False) -> DataFrame:
    """Pairs (a, b), a < b, of nodes (node, high, low, more, label; with `apart` SHARED too) at most `bits` apart that
    share a key; see `_near`."""
    shared = SHARED if apart else {}

    def spread(batches):
        for batch in batches:
            node, high, low, more, label, *others = (c.to_numpy() for c in batch.columns)
            for i in range(0, len(node), 2048):
                s = slice(i, i + 2048)
                parts = np.stack([high[s], low[s], more[s]], axis=1).view("<u2")
                struck = (parts[:, :, None] >> np.arange(16, dtype=np.uint16) & 1).astype(bool).ravel()
                columns = {"key": _keys([high[s], low[s], more[s]]).ravel(), "out": struck} | {k: np.repeat(v[s], 16 * SEGMENTS) for k, v in (("node", node), ("high", high), ("low", low), ("label", label), *zip(shared, others))}
                yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in columns.items()})

    more = "".join(f", {k} {t}" for k, t in shared.items())
    index = nodes.select("node", "high", "low", "more", "label", *shared).mapInArrow(spread, f"key int, out boolean, node long, high long, low long, label long{more}").select("key", "node", "high", "low", "label", "out", *shared)
    ordered = index.repartition("key").sortWithinPartitions("key", "node")
    return ordered.mapInArrow(_near(bits, apart, like, every), "a long, b long").distinct()


def shingle_sets(nodes: DataFrame, documents: DataFrame, shingle: int) -> DataFrame:
    """node, parts (hashes of its shingles) and SHARED of each of the nodes (node, copy, h)."""

    def sets(texts, others):
        words = [words_of(t) for t in texts]
        parts = [[x - (1 << 63) for x in map(xxhash.xxh3_64_intdigest, shingles(w, shingle))] for w in words]
        over, classes = zip(*map(_counts, parts))
        return {
            "same": [xxhash.xxh3_128_hexdigest(b" ".join(w)) for w in words],
            "parts": pa.array(parts, pa.list_(pa.int64())),
            "size": pa.array(map(len, parts), pa.int32()),
            "over": pa.array(over, pa.int32()),
        } | {f"class_{k}": pa.array(c) for k, c in enumerate(np.stack(classes).T)}

    wanted = nodes.select("node", "copy", "h")
    texts = documents.select(F.xxhash64("text").alias("h"), "text").join(wanted, "h").select("node", "copy", "text")
    types = "same string, parts array<long>" + "".join(f", {k} {t}" for k, t in SHARED.items() if k != "own")
    found = durable(map_texts(texts, sets, types).where("same = copy").dropDuplicates(["node"]).drop("copy", "same"))
    lone = found.select("node", F.explode("parts").alias("part")).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node"))
    own = lone.where("n = 1").groupBy("node").agg(F.count(F.lit(1)).cast("int").alias("own"))
    return found.join(own, "node", "left").select("node", "parts", *[F.coalesce(k, F.lit(0)).alias(k) for k in SHARED])


def verified(pairs: DataFrame, sets: DataFrame, like: float) -> DataFrame:
    """The pairs whose sets of shingles have a Jaccard similarity of at least `like`."""
    found = sets.select("node", "parts")
    both = pairs.join(found.toDF("a", "x"), "a").join(found.toDF("b", "y"), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(shared / (F.size("x") + F.size("y") - shared) >= like).select("a", "b")


def near_copies(documents: DataFrame, shingle: int = SHINGLE, like: float = LIKE, bits: int = BITS) -> DataFrame:
    """doc_id and component_id, the smallest doc_id of its group of near copies, of every document.

    Texts with the same words are one node. Null and empty texts are copies of one another.
    Null doc_ids are never a component_id unless the whole group has none. Repeated rows
    are kept; an empty table gives no rows.
    """
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def prints(texts, _):
        words = [words_of(t) for t in texts]
        found = np.stack([fingerprint(shingles(w, shingle)) for w in words]).view(np.int64)
        return {"copy": [xxhash.xxh3_128_hexdigest(b" ".join(w)) for w in words], "high": pa.array(found[:, 0]), "low": pa.array(found[:, 1]), "more": pa.array(found[:, 2])}

    made = durable(map_texts(rows.withColumn("h", F.xxhash64("text")), prints, "copy string, high long, low long, more long"))
    nodes = made.groupBy("copy").agg(F.min("doc_id").alias("least"), F.min("h").alias("h"), *[F.first(c).alias(c) for c in ("high", "low", "more")])
    nodes = durable(nodes.withColumn("node", F.monotonically_increasing_id()))
    pairs = durable(candidates(nodes.withColumn("label", F.col("node")), bits, False))
    # All nodes with a near pair are in pairs; most of them are in one group with it by now.
    ends = durable(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct())
    active = nodes.join(ends, "node", "left_semi")
    sets = durable(shingle_sets(active, rows, shingle))
    active = durable(active.join(sets.drop("parts"), "node"))
    good, tried = durable(verified(pairs, sets, like)), pairs
    while True:
        labels = durable(components(good).withColumnRenamed("component", "label"))
        grouped = active.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        rest = durable(candidates(grouped, bits, True, like).join(tried, ["a", "b"], "left_anti"))
        more, tried = durable(verified(rest, sets, like)), durable(tried.union(rest))
        if more.isEmpty():
            break
        good = durable(good.union(more))
    # A pair further apart by fingerprint than the nearest of its groups may be alike all the same.
    rest = durable(candidates(grouped, bits, True, like, every=True).join(tried, ["a", "b"], "left_anti"))
    more = durable(verified(rest, sets, like))
    if not more.isEmpty():
        labels = durable(components(good.union(more)).withColumnRenamed("component", "label"))
    group = nodes.select("copy", "node", "least").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = group.groupBy("label").agg(F.min("least").alias("component_id"))
    classes = group.join(least, "label").select("copy", "component_id")
    return made.select("doc_id", "copy").join(classes, "copy").select("doc_id", "component_id")
