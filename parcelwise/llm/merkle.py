"""Merkle manifest of a table, stored in van Emde Boas blocks.

Leaves are digests of rows. Each tree (a lang) has its leaves in doc_id order and FAN
children a node. A block is an aligned subtree of up to FAN ** HEIGHT leaves. It is built in
one task and stored as one row whose nodes lie in van Emde Boas order: a subtree is cut at half
its height, its top comes first and its bottom subtrees follow one by one, each laid out the
same way. Addresses are computed from level and place, so both building and the search for
siblings work without pointers and touch few neighbouring runs of memory at every size.

Roots of blocks are the leaves of the next round, until a tree has one block. The subroots of
the trees form one more tree in the same way. Proofs go back down: a round's blocks get the
siblings above their root and add their own below it.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from parcelwise.operators.scale import BLOCK, range_blocks
from parcelwise.session import durable

FAN = 8
#: Levels of edges in a block; a whole one has FAN ** HEIGHT leaves.
HEIGHT = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
DIGEST = 32

Step = tuple[int, int, bytes]  # place in the run, nodes of the run, digests of the others


def size_of(levels: int, fan: int = FAN) -> int:
    """Nodes of a whole tree with so many levels of nodes."""
    return (fan**levels - 1) // (fan - 1)


def addresses(levels: int, depth: int, place: np.ndarray, fan: int = FAN) -> np.ndarray:
    """Van Emde Boas addresses of the nodes at `depth` (0: root), from left `place`, of a whole
    tree with `levels` levels of nodes."""
    base = np.zeros(len(place), np.int64)
    while levels > 1:
        top = levels // 2
        if depth < top:
            levels = top
            continue
        below = fan ** (depth - top)
        base += size_of(top, fan) + place // below * size_of(levels - top, fan)
        place, depth, levels = place % below, depth - top, levels - top
    return base


def height_of(total: int, fan: int = FAN) -> int:
    """Levels of edges of a tree with `total` leaves."""
    height = 0
    while total > 1:
        total, height = -(-total // fan), height + 1
    return height


def hashed(digests: bytes) -> bytes:
    """H of digests, which enter as hex text."""
    return hashlib.sha256(digests.hex().encode()).digest()


def build_block(leaves: np.ndarray, height: int, fan: int = FAN) -> np.ndarray:
    """The nodes (rows of 32 bytes) of an aligned subtree over `leaves`, in van Emde Boas order."""
    levels, n = height + 1, len(leaves)
    nodes = np.zeros((size_of(levels, fan), DIGEST), np.uint8)
    nodes[addresses(levels, height, np.arange(n), fan)] = leaves
    for depth in range(height - 1, -1, -1):
        below = addresses(levels, depth + 1, np.arange(n), fan)
        parents = addresses(levels, depth, np.arange(-(-n // fan)), fan)
        for i, parent in enumerate(parents.tolist()):
            run = nodes[below[fan * i : fan * i + fan]].tobytes()
            nodes[parent] = np.frombuffer(hashed(run), np.uint8)
        n = len(parents)
    return nodes


def siblings(nodes: np.ndarray, height: int, n: int, fan: int = FAN) -> Iterator[list[Step]]:
    """The steps from each of n leaves to the block's root, leaf by leaf."""
    # Steps are made from the root down, so that leaves share those of their parents.
    levels, counts, above = height + 1, [n], [[]]
    for _ in range(height):
        counts.append(-(-counts[-1] // fan))
    for depth in range(1, levels):
        own = counts[height - depth]
        at = addresses(levels, depth, np.arange(own), fan)
        steps = []
        for i in range(own):
            first = i - i % fan
            run = nodes[at[first : first + fan]].tobytes()
            place = i - first
            others = run[: DIGEST * place] + run[DIGEST * (place + 1) :]
            steps.append([(place, len(run) // DIGEST, others), *above[i // fan]])
        above = steps
    return iter(above)


def fold(leaf: bytes, steps: list[Step]) -> bytes:
    """The root from a leaf and the steps above it."""
    for place, _, others in steps:
        leaf = hashed(others[: DIGEST * place] + leaf + others[DIGEST * place :])
    return leaf


def block_rows(batches: Iterator[pa.RecordBatch], height: int, fan: int) -> Iterator[tuple[pa.RecordBatch, dict, list[list[Step]]]]:
    """Block by block: its row as a batch, its scalars, and the steps within the block."""
    for batch in batches:
        for i in range(batch.num_rows):
            one = batch.slice(i, 1)
            row = {c: one.column(c)[0].as_py() for c, t in zip(one.schema.names, one.schema.types) if not pa.types.is_list(t)}
            nodes = np.frombuffer(row["nodes"], np.uint8).reshape(-1, DIGEST)
            yield one, row, list(siblings(nodes, min(height, height_of(row["total"], fan)), row["n"], fan))


def packed(steps: list[Step]) -> bytes:
    """Steps as bytes: place, nodes of the run, digests."""
    return b"".join(bytes((place, n)) + others for place, n, others in steps)


def unpacked(data: bytes) -> list[Step]:
    steps, at = [], 0
    while at < len(data):
        place, n = data[at], data[at + 1]
        end = at + 2 + DIGEST * (n - 1)
        steps.append((place, n, data[at + 2 : end]))
        at = end
    return steps


def leaf_digest(text: Column | None = None, fields: tuple[str, ...] = FIELDS) -> Column:
    """H of a row: each field as `-` if null, else its UTF-8 byte count, `:` and its value;
    `text` may stand in for the column of that name."""
    parts = []
    for name in fields:
        value = text if text is not None and name == "text" else F.col(name).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def numbered(leaves: DataFrame, order: list[str]) -> DataFrame:
    """Adds place (from 0, by `order` within a tree) and total, the tree's leaves.

    Rows are cut into ranges of (tree, order), so a large tree spans many tasks; the rows
    before a range are added from one row for each range and tree.
    """
    cut = range_blocks(leaves, ["tree", *[F.asc_nulls_first(c) for c in order]])
    window = Window.partitionBy(BLOCK, "tree").orderBy(*[F.asc_nulls_first(c) for c in order])
    counts = cut.groupBy("tree", BLOCK).agg(F.count(F.lit(1)).alias("_n"))
    blocks = Window.partitionBy("tree").orderBy(BLOCK)
    before = F.coalesce(F.sum("_n").over(blocks.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("tree", BLOCK, before.alias("_before"), F.sum("_n").over(Window.partitionBy("tree")).alias("total"))
    rows = cut.withColumn("_row", F.row_number().over(window))
    return rows.join(counts, ["tree", BLOCK]).withColumn("place", F.col("_before") + F.col("_row") - 1).drop("_before", "_row", BLOCK)


def build_blocks(leaves: DataFrame, keep: list[str], height: int = HEIGHT, fan: int = FAN) -> DataFrame:
    """The blocks (tree, block, total, n, nodes, and the leaves' columns `keep` as arrays) of
    leaves (tree, place, total, digest). A group holds fan ** height leaves at most."""
    types = dict(leaves.dtypes)
    schema = "tree string, block bigint, total bigint, n int, root binary, nodes binary" + "".join(f", `{c}` array<{types[c]}>" for c in keep)

    def build(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        total, n = rows["total"][0].as_py(), rows.num_rows
        found = np.frombuffer(b"".join(rows["digest"].to_pylist()), np.uint8).reshape(n, DIGEST)
        nodes = build_block(found, min(height, height_of(total, fan)), fan)
        made = {
            "tree": rows["tree"][:1],
            "block": rows["_block"][:1],
            "total": rows["total"][:1],
            "n": pa.array([n], pa.int32()),
            "root": pa.array([nodes[0].tobytes()], pa.binary()),
            "nodes": pa.array([nodes.tobytes()], pa.binary()),
        }
        for c in keep:
            values = rows[c].combine_chunks()
            made[c] = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), values)
        return pa.table(made)

    cut = leaves.withColumn("_block", F.floor(F.col("place") / fan**height).cast("bigint"))
    return cut.groupBy("tree", "_block").applyInArrow(build, schema)


def forest(leaves: DataFrame, keep: list[str], height: int = HEIGHT, fan: int = FAN) -> list[DataFrame]:
    """The stored blocks of each round, from the leaves (tree, place, total, digest) up; each
    tree's last block holds its root."""
    rounds = [durable(build_blocks(leaves, keep, height, fan))]
    while True:
        done = F.col("total") <= fan**height
        if rounds[-1].where(~done).isEmpty():
            return rounds
        above = rounds[-1].where(~done).select(
            "tree", F.col("block").alias("place"), F.ceil(F.col("total") / fan**height).alias("total"), F.col("root").alias("digest")
        )
        rounds.append(durable(build_blocks(above, [], height, fan)))


def roots(rounds: list[DataFrame], height: int = HEIGHT, fan: int = FAN) -> DataFrame:
    """(tree, digest): the root of each tree."""
    tops = [r.where(F.col("total") <= fan**height).select("tree", F.col("root").alias("digest")) for r in rounds]
    out = tops[0]
    for t in tops[1:]:
        out = out.union(t)
    return out


def steps_down(rounds: list[DataFrame], above: DataFrame, height: int = HEIGHT, fan: int = FAN) -> DataFrame:
    """The lowest round's blocks with `steps` from their root up: those of `above` (tree,
    steps, others) for the tree's root, and those within the rounds between."""
    names = [c for c in above.columns if c not in ("tree", "steps")]
    types = dict(above.dtypes)
    schema = ", ".join(["tree string", "block bigint", "steps binary", *[f"`{c}` {types[c]}" for c in names]])

    def down(batches):
        for one, row, steps in block_rows(batches, height, fan):
            first, n = row["block"] * fan**height, row["n"]
            yield pa.RecordBatch.from_pydict(
                {
                    "tree": pa.array([row["tree"]] * n, pa.string()),
                    "block": pa.array(range(first, first + n), pa.int64()),
                    "steps": pa.array([packed(s) + row["steps"] for s in steps], pa.binary()),
                }
                | {c: pa.array([row[c]] * n, one.column(c).type) for c in names}
            )

    found = None
    for r in reversed(rounds):
        with_root = r.where(F.col("total") <= fan**height).join(above, "tree")
        if found is not None:  # blocks below those of the round above
            with_root = with_root.unionByName(r.where(F.col("total") > fan**height).join(found, ["tree", "block"]))
        if r is rounds[0]:
            return with_root
        found = durable(with_root.select("tree", "block", "total", "n", "nodes", "steps", *names).mapInArrow(down, schema))
    raise ValueError("no rounds")


def changed(column: Column) -> Column:
    """A-Z in lower case."""
    return F.translate(column, string.ascii_uppercase, string.ascii_lowercase)


def manifest(documents: DataFrame, tampered: Column | None = None, height: int = HEIGHT, fan: int = FAN) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every document.

    `tampered` names the rows whose text is lower-cased (A-Z) before the check; null means
    not. Nulls in any field count as `-`, so they differ from empty values. Leaves with equal
    doc_ids go by digest, null doc_ids come first, and a null lang is a tree of its own.
    Repeated rows are leaves of their own; an empty table gives no rows. Only digests, doc_id
    and lang are shuffled, never a text.
    """
    tampered = F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False))
    lower = F.when(tampered, leaf_digest(changed(F.col("text").cast("string"))))
    # "" sorts before "=" with any name behind it: the null lang is first.
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))
    # Stored, as cutting into ranges reads its input twice: texts are read and hashed once.
    leaves = durable(documents.select("doc_id", tree.alias("tree"), leaf_digest().alias("digest"), lower.alias("other")))
    rounds = forest(numbered(leaves, ["doc_id", "digest"]), ["doc_id", "digest", "other"], height, fan)
    tops = durable(roots(rounds, height, fan))
    upper = numbered(tops.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), ["name"])
    top_rounds = forest(upper, ["name", "digest"], height, fan)
    whole = roots(top_rounds, height, fan).select("tree", F.lit(b"").alias("steps"), F.col("digest").alias("root_"))
    blocks = steps_down(top_rounds, whole, height, fan)

    def tree_steps(batches):
        for one, row, steps in block_rows(batches, height, fan):
            yield pa.RecordBatch.from_pydict(
                {
                    "tree": one.column("name")[0].values,
                    "steps": pa.array([packed(s) + row["steps"] for s in steps], pa.binary()),
                    "subroot_": one.column("digest")[0].values,
                    "root_": pa.array([row["root_"]] * row["n"], pa.binary()),
                }
            )

    above = durable(blocks.select("total", "n", "nodes", "name", "digest", "steps", "root_").mapInArrow(tree_steps, "tree string, steps binary, subroot_ binary, root_ binary"))
    lowest = steps_down(rounds, above, height, fan)
    kind = dict(documents.dtypes)["doc_id"]

    def verify(batches):
        for one, row, steps in block_rows(batches, height, fan):
            leaves, others = (one.column(c)[0].as_py() for c in ("digest", "other"))
            n, more, root = row["n"], unpacked(row["steps"]), row["root_"]
            tail = b"".join(s[2] for s in more)
            folded = [fold(leaf if other is None else other, own + more) for leaf, other, own in zip(leaves, others, steps, strict=True)]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": one.column("doc_id")[0].values,
                    "leaf": [x.hex() for x in leaves],
                    "subroot": [row["subroot_"].hex()] * n,
                    "root": [root.hex()] * n,
                    "proof_sha256": [hashed(b"".join(s[2] for s in own) + tail).hex() for own in steps],
                    "folded_root": [x.hex() for x in folded],
                    "verified": [x == root for x in folded],
                }
            )

    columns = ["total", "n", "nodes", "doc_id", "digest", "other", "steps", "subroot_", "root_"]
    schema = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return lowest.select(*columns).mapInArrow(verify, schema)


def _sql(levels: int = 8, langs: int = 4) -> str:
    """The same rows in DuckDB SQL, level by level, for trees of up to 8 ** levels leaves."""
    value = lambda x: f"coalesce(strlen(CAST({x} AS VARCHAR)) || ':' || {x}, '-')"
    row = lambda text: "sha256(" + " || ".join(map(value, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    shift = f"[ascii(d){', -1' * 8}]"
    parts = [f"""
      crc AS MATERIALIZED (SELECT doc_id AS id, xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(
        string_split(CAST(doc_id AS VARCHAR), ''), lambda d: {shift}))),
        lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END)) AS h
        FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)),
      leaves AS MATERIALIZED (SELECT d.doc_id, coalesce('=' || lang, '') AS tree, {row("text")} AS h,
        CASE WHEN crc.h % 3 = 0 THEN {row("translate(text, '" + string.ascii_uppercase + "', '" + string.ascii_lowercase + "')")} END AS other
        FROM documents d LEFT JOIN crc ON d.doc_id = crc.id),
      f0 AS MATERIALIZED (SELECT doc_id, tree, h AS leaf, coalesce(other, h) AS cur, '' AS proof,
        row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS place FROM leaves),
      n0 AS MATERIALIZED (SELECT tree, place AS i, leaf AS h FROM f0)"""]  # fmt: skip

    def level(k: int, key: str) -> None:
        """Nodes n(k+1) and folded rows f(k+1) from n(k) and f(k); key: the tree of a row."""
        run = "OVER (PARTITION BY tree, i // 8 ORDER BY i ROWS BETWEEN"
        parts.append(f"""
      s{k} AS MATERIALIZED (SELECT tree, i, count(*) OVER (PARTITION BY tree) AS m,
        coalesce(string_agg(h, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lo,
        coalesce(string_agg(h, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS hi FROM n{k}),
      n{k + 1} AS MATERIALIZED (SELECT n.tree, n.i // 8 AS i,
        CASE WHEN max(m) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY n.i)) END AS h
        FROM n{k} n JOIN s{k} s ON n.tree = s.tree AND n.i = s.i GROUP BY n.tree, n.i // 8),
      f{k + 1} AS MATERIALIZED (SELECT f.* EXCLUDE (cur, proof, place), f.place // 8 AS place,
        CASE WHEN m = 1 THEN cur ELSE sha256(lo || cur || hi) END AS cur,
        CASE WHEN m = 1 THEN proof ELSE proof || lo || hi END AS proof
        FROM f{k} f JOIN s{k} s ON s.tree = {key} AND f.place = s.i)""")  # fmt: skip

    for k in range(levels):
        level(k, "f.tree")
    top = levels + 1
    parts.append(f"""
      sub AS MATERIALIZED (SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS place FROM n{levels}),
      n{top} AS MATERIALIZED (SELECT '' AS tree, place AS i, h FROM sub),
      f{top} AS MATERIALIZED (SELECT f.* EXCLUDE (place), sub.h AS subroot, sub.place FROM f{levels} f JOIN sub ON f.tree = sub.tree)""")
    for k in range(top, top + langs):
        level(k, "''")
    end = top + langs
    return f"""WITH {",".join(parts)}
    SELECT doc_id, leaf, subroot, n.h AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = n.h AS verified
    FROM f{end} f CROSS JOIN n{end} n"""


SQL = _sql()


def query(spark: SparkSession, path: str) -> DataFrame:
    documents = spark.read.parquet(f"{path}/documents.parquet")
    return manifest(documents, F.crc32(F.col("doc_id").cast("string")) % 3 == 0)
