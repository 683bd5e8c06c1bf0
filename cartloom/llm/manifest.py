"""Merkle manifest of a data set: one tree of digests per language, and one tree over their roots.

A leaf is the digest of a row. The leaves of a tree stand in order of ``doc_id``; while more than
one node remains, every two consecutive ones become the digest of both, and a last one without a
partner becomes the digest of itself alone.

Trees are cut into blocks of ``HEIGHT`` levels above their leaves. A block is one row that holds
its nodes in van Emde Boas order: the upper half of its levels first, then the subtrees below one
after another, each laid out alike. :func:`address` says where a node of a level lies. The roots
of the blocks are the leaves of the blocks of the next tier, and so on until one block remains.
Siblings are read by the same arithmetic, from the last tier down: each block gets the path of
its own root, and hands a path to every leaf. So a task holds one block, and the number of tiers
grows with the logarithm of the rows.

Leaves are numbered from range partitions and their counts, so a language with most of the rows
is many small tasks.

Defined results: null fields are written ``-``; rows without an id come first; rows with equal
ids are ordered by their leaves, and equal rows are leaves side by side; a null language is a tree
of its own, first in order; other columns are not part of a leaf; an empty table gives an empty
result. A leaf without any sibling up to the root has the digest of no input as its proof.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartloom.operators.corpus import numbered
from cartloom.session import materialize

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
HEIGHT = 10
DIGEST = 32
#: One level of a path: no sibling, or a sibling to the left or right of the node.
ALONE, LEFT, RIGHT = 0, 1, 2
STEP = 1 + DIGEST


def leaf(values: Sequence[Column]) -> Column:
    """The digest of a row: every value with its size in bytes, ``-`` for null."""
    texts = [value.cast("string") for value in values]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Place of the ``index``-th node at ``depth`` in a tree of ``levels`` levels, the root at place 0."""
    index = np.asarray(index, np.int64)
    place = np.zeros(len(index), np.int64)
    while levels > 1:
        upper = levels // 2
        if depth < upper:
            levels = upper
            continue
        lower, depth = levels - upper, depth - upper
        subtree = index >> depth
        place += (1 << upper) - 1 + subtree * ((1 << lower) - 1)
        index = index & ((1 << depth) - 1)
        levels = lower
    return place


def parent(left: bytes, right: bytes = b"") -> bytes:
    return sha256((left.hex() + right.hex()).encode()).digest()


def build(leaves: Sequence[bytes], levels: int) -> bytes:
    """The nodes of a block in van Emde Boas order; places without a node are zero."""
    nodes = np.zeros(((1 << levels) - 1, DIGEST), np.uint8)
    row = list(leaves)
    for depth in range(levels - 1, -1, -1):
        nodes[address(levels, depth, np.arange(len(row)))] = np.frombuffer(b"".join(row), np.uint8).reshape(-1, DIGEST)
        row = [parent(*row[i : i + 2]) for i in range(0, len(row), 2)]
    return nodes.tobytes()


def paths(nodes: bytes, levels: int, count: int) -> list[bytes]:
    """For each of the ``count`` leaves of a block, its steps from the bottom to the block's root."""
    held = np.frombuffer(nodes, np.uint8).reshape(-1, DIGEST)
    steps = np.zeros((count, levels - 1, STEP), np.uint8)
    index = np.arange(count)
    for depth in range(levels - 1, 0, -1):
        step = steps[:, levels - 1 - depth]
        sibling, there = index ^ 1, ((count - 1) >> (levels - 1 - depth)) + 1
        has = sibling < there
        step[:, 0] = np.where(has, np.where(index & 1, LEFT, RIGHT), ALONE)
        step[has, 1:] = held[address(levels, depth, sibling[has])]
        index = index >> 1
    return [own.tobytes() for own in steps]


def steps_of(path: bytes) -> list[tuple[int, bytes]]:
    return [(path[at], path[at + 1 : at + STEP]) for at in range(0, len(path), STEP)]


def proof(path: bytes) -> bytes:
    """The digest of all siblings of a path, from bottom to top."""
    return sha256("".join(sibling.hex() for side, sibling in steps_of(path) if side != ALONE).encode()).digest()


def fold(digest: bytes, path: bytes) -> bytes:
    """The root that follows from a leaf and the siblings of its path."""
    for side, sibling in steps_of(path):
        digest = parent(digest) if side == ALONE else parent(sibling, digest) if side == LEFT else parent(digest, sibling)
    return digest


def _levels(count: int, height: int) -> int:
    """Levels of the blocks of a row of nodes: full ones if there are several, else as many as needed."""
    return min(height, (count - 1).bit_length()) + 1


class Forest:
    """The blocks of several trees: a table per tier, each written to the shared folder."""

    def __init__(self, nodes: DataFrame, height: int = HEIGHT) -> None:
        """``nodes`` holds (tree, position, count, digest, payload); ``count`` is the size of its tree."""
        self.height, self.payload = height, nodes.schema["payload"].dataType
        most = nodes.agg(F.max("count")).first()[0] or 0
        self.tiers, tier = [], nodes
        while most:
            blocks = materialize(self._blocks(tier), f"manifest-tier-{len(self.tiers)}")
            self.tiers.append(blocks)
            if most <= 1 << height:
                break
            most = -(-most >> height)
            more = F.col("count") > 1 << height
            tier = blocks.where(more).select(
                "tree", F.col("block").alias("position"),
                F.shiftright(F.col("count") + ((1 << height) - 1), height).alias("count"),
                F.substring("nodes", 1, DIGEST).alias("digest"), F.lit(None).cast(self.payload).alias("payload"),
            )

    def _blocks(self, nodes: DataFrame) -> DataFrame:
        height = self.height

        def lay_out(group: pa.Table) -> pa.Table:
            group = group.sort_by("position")
            count = group.column("count")[0].as_py()
            block = build(group.column("digest").to_pylist(), _levels(count, height))
            return pa.table({
                "tree": group.column("tree")[:1], "block": group.column("block")[:1], "count": pa.array([count], pa.int64()),
                "n": pa.array([group.num_rows], pa.int32()), "nodes": pa.array([block], pa.binary()),
                "payload": pa.array([group.column("payload").to_pylist()], pa.list_(group.schema.field("payload").type)),
            })

        payload = self.payload.simpleString()
        schema = f"tree string, block long, count long, n int, nodes binary, payload array<{payload}>"
        rows = nodes.withColumn("block", F.shiftright("position", height))
        return rows.groupBy("tree", "block").applyInArrow(lay_out, schema)

    def roots(self) -> DataFrame:
        """(tree, count, root) of every tree."""
        last = [t.where(F.col("count") <= 1 << self.height) for t in self._all_counts()]
        out = last[0]
        for more in last[1:]:
            out = out.unionByName(more)
        return out

    def _all_counts(self) -> list[DataFrame]:
        return [tier.select("tree", "count", F.substring("nodes", 1, DIGEST).alias("root")) for tier in self.tiers]

    def with_paths(self, above: DataFrame) -> DataFrame:
        """(tree, payload, leaf, path) of every leaf; ``above`` holds (tree, path) from each root on."""
        height, asked = self.height, None
        for number in range(len(self.tiers) - 1, -1, -1):
            tier = self.tiers[number]
            top = F.col("count") <= 1 << height
            own = above.select(F.col("tree").alias("own_tree"), F.lit(0).cast("long").alias("own_block"), F.col("path").alias("up"))
            held = tier.where(top).join(own.drop("own_block"), F.col("tree").eqNullSafe(F.col("own_tree")))
            held = held.drop("own_tree")
            if asked is not None:
                own = asked.select(F.col("tree").alias("own_tree"), F.col("position").alias("own_block"), F.col("path").alias("up"))
                same = F.col("tree").eqNullSafe(F.col("own_tree")) & (F.col("block") == F.col("own_block"))
                held = held.unionByName(tier.where(~top).join(own, same).drop("own_tree", "own_block"))
            asked = self._handed_down(held, number == 0)
            if number:
                asked = materialize(asked, f"manifest-paths-{number}")
        return asked

    def _handed_down(self, held: DataFrame, last: bool) -> DataFrame:
        height, payload = self.height, self.payload.simpleString()
        fields = f"payload {payload}, leaf binary, " if last else ""

        def hand_down(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {name: batch.column(name)[i].as_py() for name in ("block", "count", "n", "nodes", "up")}
                    levels, n = _levels(row["count"], height), row["n"]
                    found = [path + row["up"] for path in paths(row["nodes"], levels, n)]
                    tree = pa.array([batch.column("tree")[i].as_py()] * n, pa.string())
                    first = (row["block"] << height)
                    columns = {"tree": tree, "position": pa.array(np.arange(first, first + n)), "path": pa.array(found, pa.binary())}
                    if last:
                        at = address(levels, levels - 1, np.arange(n)) * DIGEST
                        leaves = [row["nodes"][a : a + DIGEST] for a in at.tolist()]
                        columns |= {"payload": batch.column("payload")[i].values, "leaf": pa.array(leaves, pa.binary())}
                    yield pa.RecordBatch.from_pydict({name: columns[name] for name in names})

        schema = f"tree string, position long, {fields}path binary"
        names = ["tree", "position", *(["payload", "leaf"] if last else []), "path"]
        return held.select("tree", "block", "count", "n", "nodes", *["payload"] * last, "up").mapInArrow(hand_down, schema)


def proofs(leaves: DataFrame, height: int = HEIGHT) -> DataFrame:
    """(lang, payload, leaf, path, subroot, root) of every row of (lang, doc_id, leaf, payload).

    ``leaf`` is given in hex; digests and paths come as bytes. ``payload`` is carried along.
    """
    written = materialize(leaves.withColumn("at", F.monotonically_increasing_id()), "manifest-leaves")
    order = F.struct("doc_id", "leaf", "at").alias("order")
    placed = numbered(written.select("lang", order, "leaf", "payload"), "lang", "order", "leaf", "payload")
    sizes = written.groupBy(F.col("lang").alias("own")).agg(F.count(F.lit(1)).alias("count"))
    nodes = placed.join(sizes, F.col("lang").eqNullSafe(F.col("own"))).select(
        F.col("lang").alias("tree"), "position", "count", F.unhex("leaf").alias("digest"), "payload"
    )
    forest = Forest(nodes, height)
    if not forest.tiers:
        return leaves.limit(0).select("lang", "payload", F.unhex("leaf").alias("leaf"), *[
            F.lit(None).cast("binary").alias(name) for name in ("path", "subroot", "root")
        ])
    roots = materialize(forest.roots(), "manifest-subroots")
    everything = F.lit("all").alias("whole")
    by_lang = numbered(roots.select(everything, F.struct("tree").alias("order"), "root", "tree"), "whole", "order", "root", "tree")
    crown = Forest(by_lang.select(
        F.col("whole").alias("tree"), "position", F.lit(roots.count()).cast("long").alias("count"),
        F.col("root").alias("digest"), F.struct(F.col("tree").alias("lang")).alias("payload"),
    ), height)
    root = crown.roots().first().root
    start = crown.roots().select("tree", F.lit(b"").alias("path"))
    up = materialize(
        crown.with_paths(start).select(
            F.col("payload.lang").alias("tree"), "path", F.col("leaf").alias("subroot"), F.lit(bytes(root)).alias("root")
        ), "manifest-crown")
    found = forest.with_paths(up.select("tree", "path"))
    ends = up.select(F.col("tree").alias("own"), "subroot", "root")
    return found.join(ends, F.col("tree").eqNullSafe(F.col("own"))).select(
        F.col("tree").alias("lang"), "payload", "leaf", "path", "subroot", "root"
    )


def verified(found: DataFrame, claimed: Column) -> DataFrame:
    """Adds ``proof`` and ``folded``, the root that follows from the digest ``claimed`` and the path."""

    @F.arrow_udf("struct<proof: binary, folded: binary>")
    def check(digests: pa.Array, own: pa.Array) -> pa.Array:
        rows = list(zip(digests.to_pylist(), own.to_pylist(), strict=True))
        return pa.StructArray.from_arrays(
            [pa.array([proof(path) for _, path in rows], pa.binary()),
             pa.array([fold(digest, path) for digest, path in rows], pa.binary())],
            names=["proof", "folded"],
        )

    return found.withColumn("check", check(claimed, F.col("path"))).select("*", "check.*").drop("check")
