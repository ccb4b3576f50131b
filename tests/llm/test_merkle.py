import hashlib
import zlib

import numpy as np
import pytest
from edge import none, rows
from pyspark.sql import functions as F

from parcelwise.llm import merkle


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def veb(levels, fan):
    """The nodes (depth, place) of a whole tree in van Emde Boas order, by its definition."""
    if levels == 1:
        return [(0, 0)]
    top = levels // 2
    out = veb(top, fan)
    for j in range(fan**top):
        out += [(top + d, j * fan**d + i) for d, i in veb(levels - top, fan)]
    return out


@pytest.mark.parametrize("fan,levels", [(2, 1), (2, 2), (2, 5), (2, 6), (3, 4), (8, 3), (8, 5)])
def test_addresses(fan, levels):
    order = veb(levels, fan)
    assert len(order) == merkle.size_of(levels, fan)
    for depth in range(levels):
        at = merkle.addresses(levels, depth, np.arange(fan**depth), fan)
        assert [order[a] for a in at] == [(depth, i) for i in range(fan**depth)]


def tree(leaves, fan=8):
    """The levels of a tree, leaves first."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([sha("".join(now[i : i + fan])) for i in range(0, len(now), fan)])
    return levels


def climb(levels, place, digest, fan=8):
    """The siblings on the way up, and the root from `digest` at `place`."""
    others = []
    for level in levels[:-1]:
        first = place - place % fan
        run = level[first : first + fan]
        others += run[: place - first] + run[place - first + 1 :]
        run = [*run[: place - first], digest, *run[place - first + 1 :]]
        digest, place = sha("".join(run)), place // fan
    return others, digest


def leaf(r, lower=False):
    text = r.text
    if lower and text is not None:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    values = (r.doc_id, getattr(r, "source", None), r.lang, getattr(r, "n_chars", None), text)
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain(docs, fan=8):
    """(doc_id, leaf, subroot, root, proof, folded root) of every row."""
    langs = {}
    for r in docs:
        langs.setdefault(r.lang, []).append(r)
    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in names:
        langs[name].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r)))
        trees[name] = tree([leaf(r) for r in langs[name]], fan)
    top = tree([trees[n][-1][0] for n in names], fan)
    root, out = top[-1][0], []
    for k, name in enumerate(names):
        for i, r in enumerate(langs[name]):
            tampered = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0
            a, at = climb(trees[name], i, leaf(r, tampered), fan)
            b, at = climb(top, k, at, fan)
            out.append((r.doc_id, leaf(r), trees[name][-1][0], root, sha("".join(a + b)), at, at == root))
    return out


def same(got, want):
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("height,fan", [(4, 8), (1, 8), (2, 8), (2, 2), (3, 3)])
def test_manifest(spark, data, height, fan):
    """Blocks of any height, over one or more rounds, give the plain tree's digests."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = merkle.manifest(docs, F.crc32(F.col("doc_id").cast("string")) % 3 == 0, height, fan).collect()
    same(got, plain(docs.collect(), fan))
    assert 0 < sum(not r.verified for r in got) < len(got) / 2


def test_query_and_sql(spark, data):
    import duckdb

    got = merkle.query(spark, data)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    relation = db.sql(merkle.SQL)
    assert sorted(relation.columns) == sorted(got.columns)
    same(got.collect(), relation.df()[got.columns].itertuples(index=False, name=None))


def test_many_langs(spark):
    """One lang for each row: the tree over the subroots has several rounds of its own."""
    docs = spark.range(700).selectExpr("id AS doc_id", "concat('t', id) AS text", "concat('l', id) AS lang", "'s' AS source", "1L AS n_chars")
    got = merkle.manifest(docs, F.crc32(F.col("doc_id").cast("string")) % 3 == 0, height=2).collect()
    same(got, plain(docs.collect()))


def test_edges(spark):
    from types import SimpleNamespace as Row

    table = rows(spark).withColumn("source", F.lit(None).cast("string")).withColumn("n_chars", F.lit(3).cast("long"))
    got = merkle.manifest(table, F.crc32(F.col("doc_id").cast("string")) % 3 == 0).collect()
    same(got, plain([Row(**r.asDict()) for r in table.collect()]))
    one = merkle.manifest(table.where("lang = 'fr'")).collect()
    assert len(one) == 1 and one[0].leaf == one[0].root == one[0].folded_root and one[0].proof_sha256 == sha("")
    empty = none(spark).withColumns({"source": F.lit(""), "n_chars": F.lit(1)})
    assert merkle.manifest(empty).count() == 0
