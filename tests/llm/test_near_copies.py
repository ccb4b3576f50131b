import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from edge import none, rows
from pyspark.sql import functions as F

import corpus_pipeline
from parcelwise.llm import near_copies, simhash


def jaccard(a, b):
    a, b = (set(zip(*(t.lower().split()[i:] for i in range(5)))) for t in (a, b))
    return len(a & b) / len(a | b)


def edited(text, n, rng):
    words = text.split()
    for i in rng.sample(range(len(words)), n):
        words[i] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def texts():
    """60 texts of 200 words and four copies of each with 1 to 12 words changed."""
    rng = random.Random(3)
    vocabulary = [f"v{i}" for i in range(3000)]
    own = [" ".join(rng.choices(vocabulary, k=200)) for _ in range(60)]
    return own + [edited(t, n, rng) for t in own for n in (1, 3, 5, 12)]


def test_stage_drops_edited_copies(spark, texts):
    """Each copy alike enough goes, and nothing else; three bits find few of them."""
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    groups = [[k, *range(60 + 4 * k, 64 + 4 * k)] for k in range(60)]
    label = list(range(len(texts)))
    for group in groups:
        for a, b in combinations(group, 2):
            if jaccard(texts[a], texts[b]) >= 0.8:
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if x == old else x for x in label]
    want = set(label)
    assert want <= kept and len(kept - want) <= 0.1 * (len(texts) - len(want))
    narrow = simhash.near_duplicates(docs).where("doc_id = component_id").count()
    assert narrow > len(kept)


def test_unlike_texts_stay(spark):
    """Texts near by their fingerprints but not alike stay."""
    some = [(i, " ".join(["same"] * 300 + [f"x{i}{j}" for j in range(i, i + 4)])) for i in range(6)]
    docs = spark.createDataFrame(some, "doc_id long, text string")
    assert near_copies.near_copies(docs, bits=128).where("doc_id = component_id").count() == 6


def test_large_clusters(spark):
    """A cluster whose members are chained only: the second round finds what the first left."""
    rng = random.Random(4)
    words = [f"v{i}" for i in range(400)]
    chain = []
    for i in range(12):
        chain.append((i, " ".join(words)))
        words[20 * i : 20 * i + 4] = [f"n{i}{j}" for j in range(4)]
    rng.shuffle(chain)
    docs = spark.createDataFrame(chain, "doc_id long, text string").repartition(4)
    assert near_copies.near_copies(docs, bits=60).where("doc_id = component_id").count() == 1


def test_a_cluster_of_unlike_copies(spark):
    """800 copies of one text with 1 to 60 words changed, most pairs too unlike to be linked: few pairs
    are verified, and the groups are those of a plain comparison."""
    rng = random.Random(9)
    own = " ".join(f"v{rng.randrange(5000)}" for _ in range(150))
    texts = [own] + [edited(own, rng.choice((1, 2, 4, 6, 12, 20)), rng) for _ in range(800)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()}
    sets = [set(zip(*(t.split()[i:] for i in range(5)))) for t in texts]
    label, front, seen = {}, [], set()
    for k in range(len(sets)):
        if k in seen:
            continue
        front, seen = [k], seen | {k}
        while front:
            a = front.pop()
            label[a] = k
            near = [b for b in range(len(sets)) if b not in seen and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
            seen.update(near)
            front += near
    wrong = sum(got[k] != label[k] for k in label)
    assert len(set(label.values())) > 50 and wrong <= 0.02 * len(label)


def test_unlike_members_bring_no_square_of_pairs(spark, monkeypatch):
    """300 copies of one text with four words changed are near by fingerprint and all unlike; some are alike by fewer
    changes. Hardly more pairs than members are verified."""
    rng, tried, plain = random.Random(10), [], near_copies.verified
    monkeypatch.setattr(near_copies, "verified", lambda pairs, *more: tried.append(pairs.count()) or plain(pairs, *more))
    own = " ".join(f"v{rng.randrange(5000)}" for _ in range(150))
    texts = [edited(own, 4, rng) for _ in range(300)] + [edited(own, 1, rng) for _ in range(5)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()}
    assert len({got[k] for k in range(300, 305)}) == 1 and 0 < sum(tried) < 20 * 305


def test_pairs_that_are_alike_are_never_left_out(spark):
    """Also with more shingles than the counts hold, and one document's shingles all in the other."""
    rng = random.Random(11)
    texts = ["", "a", "a b"]
    for n in (20, 200, 4000):
        own = " ".join(f"v{rng.randrange(9000)}" for _ in range(n))
        texts += [own, own[: len(own) * 9 // 10]] + [edited(own, max(1, n * k // 100), rng) for k in (1, 1, 2, 2, 4)]
    docs = spark.createDataFrame([(k, t, f"c{k}") for k, t in enumerate(texts)], "h long, text string, name string")
    nodes = docs.selectExpr("h as node", "text").withColumn("h", F.xxhash64("text")).toPandas()
    nodes["copy"] = [near_copies.xxhash.xxh3_128_hexdigest(b" ".join(near_copies.words_of(t))) for t in nodes["text"]]
    found = near_copies.shingle_sets(spark.createDataFrame(nodes[["node", "copy", "h"]]), docs.select("text"), 5)
    table = found.toPandas().sort_values("node").reset_index(drop=True)
    sets = [set(x) for x in table["parts"]]
    assert len(sets) == len(texts) and [*table["size"]] == [len(s) for s in sets]
    columns, alike, left_out = [table[c].to_numpy() for c in near_copies.SHARED], 0, 0
    for a, b in combinations(range(1, len(texts)), 2):
        may = near_copies._may_be_alike([c[[a]] for c in columns], [c[[b]] for c in columns], 0.8)[0]
        is_alike = len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
        assert may or not is_alike
        alike, left_out = alike + is_alike, left_out + (not may)
    assert alike > 15 and left_out > 100


def test_groups_are_those_of_all_candidates(spark):
    """Texts made from one another by changes of few words: also where the nearest fingerprints of two groups are unlike,
    a pair further apart that is alike links them. Compared with a plain walk over all pairs that share a key."""
    rng = random.Random(2)
    made = [[f"v{rng.randrange(5000)}" for _ in range(60)]]
    while len(made) < 250:
        text = list(rng.choice(made))
        for i in rng.sample(range(60), rng.choice((1, 1, 2, 3))):
            text[i] = f"w{rng.randrange(60)}"
        made.append(text)
    texts = [" ".join(t) for t in made]
    sets = [near_copies.shingles(near_copies.words_of(t)) for t in texts]
    prints = np.stack([near_copies.fingerprint(s) for s in sets])
    keys = [set(k) for k in near_copies._keys(list(prints.T)).tolist()]
    label = list(range(len(texts)))
    for a, b in combinations(range(len(texts)), 2):
        far = int(np.bitwise_count(prints[a, :2] ^ prints[b, :2]).sum())
        if far <= 30 and keys[a] & keys[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            old, new = max(label[a], label[b]), min(label[a], label[b])
            label = [new if x == old else x for x in label]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()}
    assert [got[k] for k in range(len(texts))] == label


def found_pairs(prints, bits=30):
    """Pairs that the first round makes of fingerprints (n rows of three words), before repeats go."""
    prints = np.asarray(prints, np.uint64)
    key = near_copies._keys(list(prints.T)).ravel()
    node = np.repeat(np.arange(len(prints)), 192)
    order = np.lexsort((node, key))
    out = (prints.view("<u2")[:, :, None] >> np.arange(16, dtype=np.uint16) & 1).astype(bool).ravel()
    columns = [key[order], node[order], *(prints[node[order], k].view(np.int64) for k in (0, 1)), node[order], out[order]]
    batch = pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["key", "node", "high", "low", "label", "out"])
    return [p for b in near_copies._near(bits, False)(iter([batch])) for p in zip(*(c.to_pylist() for c in b.columns))]


def test_a_near_pair_comes_once():
    """300 copies a few bits apart make some pairs each, not one in each of 192 buckets."""
    rng = np.random.default_rng(5)
    own = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    prints = np.repeat(own[None], 300, axis=0)
    for row in prints:
        for bit in rng.integers(0, 192, 4):
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    pairs = found_pairs(np.unique(prints, axis=0))
    assert {x for p in pairs for x in p} == set(range(len(np.unique(prints, axis=0)))) and len(pairs) < 10 * 300


def test_each_print_with_a_near_one_is_found():
    """The third is near the first and the second, which are far apart; they share all their buckets."""
    own, one, two = (np.array(x, "<u2") for x in ([7] * 12, [7] * 12, [7] * 12))
    one[1:8] ^= 0x000F << 4
    two[1:8] ^= 0xF000
    prints = np.stack([two.view("<u8"), one.view("<u8"), own.view("<u8")])
    assert {x for p in found_pairs(prints) for x in p} == {0, 1, 2}


def test_edges(spark):
    got = near_copies.near_copies(rows(spark)).collect()
    assert len(got) == 9 and {r.component_id for r in got if r.doc_id in (1, 5)} == {1}
    assert {r.component_id for r in got if r.doc_id in (2, 3, 7)} == {2}
    assert {r.component_id for r in got if r.doc_id is None} == {None}
    assert near_copies.near_copies(none(spark)).count() == 0
