import random

import numpy as np
import pytest
import xxhash
from edge import none, rows
from pyspark.sql import functions as F

from parcelwise.llm import simhash


def plain_fingerprint(text):
    words = [w for w in (text or "").translate({i: i + 32 for i in range(65, 91)}).encode().split()]
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """{fingerprint: smallest index of its component} by comparing all."""
    values = sorted(set(prints))
    v = np.array(values, np.uint64)
    label = list(range(len(v)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(v)):
        for j in np.flatnonzero(np.bitwise_count(v[i] ^ v[i + 1 :]) <= 3).tolist():
            a, b = root(i), root(i + 1 + j)
            label[max(a, b)] = min(a, b)
    return {x: root(i) for i, x in enumerate(values)}


def test_groups_of_documents(spark, data):
    documents = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r.doc_id: r.text for r in documents.collect()}
    prints = {k: plain_fingerprint(t) for k, t in texts.items()}
    group = plain_components(prints.values())
    least = {}
    for k in sorted(prints):
        least.setdefault(group[prints[k]], k)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(documents).collect()}
    assert got == {k: (f"{p:016x}", least[group[p]]) for k, p in prints.items()}


@pytest.mark.parametrize("bucket", [512, 4])
def test_links_keep_every_component(spark, bucket):
    rng = random.Random(8)
    made = []
    for _ in range(12):  # clusters, chains and lone ones
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 30])):
            made.append(x)
            made.append(x ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 4))))
            if rng.random() < 0.5:
                x = made[-1]
    made += [rng.getrandbits(32) | made[0] >> 32 << 32 for _ in range(20)]  # one segment in common
    made = sorted({m & (1 << 64) - 1 for m in made})
    signed = np.array(made, np.uint64).view(np.int64).tolist()
    found = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), bucket=bucket).collect()
    label = {s: s for s in signed}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for r in found:
        assert bin((r.a ^ r.b) & (1 << 64) - 1).count("1") <= 3
        a, b = root(r.a), root(r.b)
        label[a] = b
    want = plain_components(made)
    groups = {}
    for m, s in zip(made, signed, strict=True):
        groups.setdefault(want[m], set()).add(root(s))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 103), (103, 101), (200, 200)] + [(300, 300 + rng.randint(1, 50)) for _ in range(30)]
    got = {r.node: r.component for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and got[103] == got[101] == 100 and 200 not in got
    assert {v for k, v in got.items() if k > 300} == {300}
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_edges(spark):
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(rows(spark)).collect()}
    zero = "0" * 16
    assert {(2, zero, 2), (3, zero, 2), (7, zero, 2)} <= got
    assert {c for d, _, c in got if d in (1, 5)} == {1} and any(d is None for d, _, _ in got)
    assert simhash.near_duplicates(rows(spark)).count() == 9
    assert simhash.near_duplicates(none(spark)).count() == 0
    copies = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("the same words again and again").alias("text"))
    assert [r.component_id for r in simhash.near_duplicates(copies).select("component_id").distinct().collect()] == [0]
