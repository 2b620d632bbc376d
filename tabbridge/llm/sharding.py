"""Sharding by a k-d tree over document metadata.

A node of the tree holds a share of all bytes and the number of shards to make of it. It is
split along its widest metadata dimension (relative to the whole table) at the distributed
weighted quantile that leaves each child its shards' part of the bytes, until every leaf is
one shard of the target bytes. All nodes of a level are split in the same jobs.

A split point is found by histograms of ``2^bits`` bins, each round inside the bin where the
bytes cross the aim, so only (node, bin) sums are shuffled and no node's rows meet in a task.
The key of a row in a dimension is the dimension's code, then a hash of the text, then a hash
of the document. Rounds stop at the first bin no heavier than the tolerance, so equal texts
with equal metadata part only where their group is heavier than that.

Defined results: a null text has no bytes and no crc, null metadata counts as code 0, rows of
equal document id, text and metadata have one key and stay together, an empty table gives no
rows. Slots follow document id (null first), then text; equal rows in any order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabbridge.llm.staging import Scratch, result, scratch

CODE_BITS = 20
_ROUNDS = (14, 14, 14, 20)  # code and text hash, then document hash
_BITS = sum(_ROUNDS)
FIXED_BYTES = 16


def magnitude(value: Column) -> Column:
    """A code for sizes: their logarithm."""
    code = F.floor(F.log2(F.greatest(F.coalesce(value, F.lit(0)), F.lit(0)) + 1.0) * (1 << 15))
    return F.least(code, F.lit((1 << CODE_BITS) - 1)).cast("long")


def label(value: Column) -> Column:
    """A code for names."""
    return F.shiftright(F.coalesce(F.crc32(value.cast("binary")), F.lit(0)), 32 - CODE_BITS)


def _low(value: Column, bits: int) -> Column:
    return value.bitwiseAND(F.lit((1 << bits) - 1))


class Node(NamedTuple):
    """A node of the tree: its first shard and how many shards to make of it."""

    first: int
    parts: int
    axis: int = 0  # the dimension it is split along; 0 while it is not
    cut: int | None = None  # keys below go left; None where all rows do

    def children(self) -> tuple[Node, Node]:
        half = self.parts // 2
        return Node(self.first, half), Node(self.first + half, self.parts - half)


def _per_leaf(tree: dict[tuple[int, int], Node], node: Node, value: Callable[[Node], Column]) -> Column:
    """An expression over ``keys`` with the value of the leaf that a row falls into."""
    node = tree.get((node.first, node.parts), node)
    if not node.axis:
        return value(node)
    left, right = (_per_leaf(tree, child, value) for child in node.children())
    if node.cut is None:
        return left
    return F.when(F.element_at("keys", node.axis) < F.lit(node.cut), left).otherwise(right)


def _cuts(rows: DataFrame, aims: dict[int, float], tolerances: dict[int, float]) -> dict[int, int]:
    """Cuts of the nodes in ``rows`` (node, key, bytes).

    A round is one job over all open nodes; one row for each of them comes back.
    """
    found: dict[int, int] = {}
    state = {node: (0, 0) for node in aims}  # prefix of the bin, bytes below it
    left = _BITS
    for round_bits in _ROUNDS:
        left -= round_bits
        entries = [F.lit(x) for node, (prefix, _) in state.items() for x in (node, prefix)]
        inside = F.shiftright("key", left + round_bits) == F.try_element_at(F.create_map(*entries), F.col("node"))
        sums = rows.where(inside).groupBy("node", _low(F.shiftright("key", left), round_bits).alias("bin")).agg(F.sum("bytes").alias("weight"))
        below = F.create_map(*[F.lit(x) for node, (_, b) in state.items() for x in (node, float(b))])
        aim = F.create_map(*[F.lit(x) for node in state for x in (node, float(aims[node]))])
        upto = F.element_at(below, F.col("node")) + F.sum("weight").over(Window.partitionBy("node").orderBy("bin"))
        crossing = (
            sums.withColumn("upto", upto)
            .where(F.col("upto") >= F.element_at(aim, F.col("node")))
            .groupBy("node")
            .agg(F.min_by(F.struct("bin", "weight", "upto"), "bin").alias("at"))
            .select("node", "at.*")
        )
        later = {}
        for node, bin, weight, total in crossing.collect():
            before, place = total - weight, (state[node][0] << round_bits) + bin
            if left and weight > tolerances[node]:
                later[node] = (place, before)
            else:
                nearer = aims[node] - before <= total - aims[node]
                found[node] = (place + (0 if nearer else 1)) << left
        state = later
        if not state:
            break
    return found


def kd_shards(points: DataFrame, shards: int, dimensions: int, tolerance: float = 0.002) -> DataFrame:
    """Adds ``shard`` to staged points (bytes, keys); ``tolerance`` is a part of a shard.

    The tree is on the driver, ``shards - 1`` splits at most, and rows find their node by
    comparing keys, so no level writes the rows again.
    """
    ends = [
        f(F.shiftright(F.element_at("keys", i + 1), 42)).alias(f"{n}{i}") for i in range(dimensions) for n, f in (("a", F.min), ("b", F.max))
    ]
    root, tree, whole = Node(0, shards), {}, None
    level = [root] if shards > 1 else []
    while level:
        at = _per_leaf(tree, root, lambda n: F.lit(n.first if n.parts > 1 else -1))
        sums = points.groupBy(at.alias("node")).agg(F.sum("bytes").alias("total"), *ends).where("node >= 0")
        found = {r["node"]: r for r in sums.collect()}
        chosen = {}
        for node in level:
            r = found.get(node.first)
            if r is None:
                continue
            spans = [r[f"b{i}"] - r[f"a{i}"] for i in range(dimensions)]
            whole = whole or [max(1, s) for s in spans]
            widest = max(range(dimensions), key=lambda i: (spans[i] / whole[i], -i))
            chosen[node.first] = (node, widest + 1, r["total"])
        axes = {first: axis for first, (_, axis, _) in chosen.items()}
        key = _per_leaf(tree, root, lambda n: F.element_at("keys", axes.get(n.first, 1)))
        rows = points.select(at.alias("node"), key.alias("key"), "bytes")
        cuts = _cuts(
            rows,
            {f: t * (n.parts // 2) / n.parts for f, (n, _, t) in chosen.items()},
            {f: t / n.parts * tolerance for f, (n, _, t) in chosen.items()},
        ) if chosen else {}
        for first, (node, axis, _) in chosen.items():
            tree[node.first, node.parts] = node._replace(axis=axis, cut=cuts.get(first))
        level = [child for node, _, _ in chosen.values() for child in node.children() if child.parts > 1]
    return points.withColumn("shard", _per_leaf(tree, root, lambda n: F.lit(n.first)))


def number_groups(rows: DataFrame, group: str, order: Sequence[str], name: str, tables: Scratch) -> DataFrame:
    """Gapless numbers from 0 in each group, however large: ranges are sorted in parallel.

    Per range only (range, group, first row, rows) are gathered: at most ranges + groups rows.
    """
    ranged = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    placed = tables.put(ranged.withColumn("row", F.monotonically_increasing_id()))
    part = F.shiftright("row", 33)
    pieces = placed.groupBy(part.alias("part"), group).agg(F.min("row").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    return (
        placed.withColumn("part", part)
        .join(pieces, ["part", group])
        .withColumn(name, F.col("row") - F.col("first") + F.col("before"))
        .drop("part", "row", "first", "before")
    )


def shard_documents(docs: DataFrame, shards: int = 40, dims: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document.

    The law is ``bytes``: shard sizes are near equal. ``dims`` are codes below 2^20; by
    default the text's bytes and its language.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + FIXED_BYTES
    codes = list((dims or {"size": magnitude(size), "lang": label(F.col("lang"))}).values())
    crc = F.crc32(F.col("text").cast("binary"))
    text_hash, doc_hash = F.xxhash64(F.lit(1), "text"), F.xxhash64(F.lit(2), "doc_id", "text")
    tail = F.shiftleft(_low(text_hash, 22), 20) + _low(doc_hash, 20)
    with scratch(docs.sparkSession, "shards") as tables:
        points = tables.put(
            docs.select(
                "doc_id",
                size.alias("bytes"),
                crc.alias("text_crc32"),
                F.array(*[F.shiftleft(code.cast("long"), 42) + tail for code in codes]).alias("keys"),
            )
        )
        placed = kd_shards(points, shards, len(codes)).drop("keys")
        numbered = number_groups(placed, "shard", ["doc_id", "text_crc32", "bytes"], "slot", tables)
        return result(
            numbered.select(
                "doc_id",
                F.col("bytes").alias("size"),
                "text_crc32",
                F.lit("bytes").alias("law"),
                "shard",
                "slot",
                F.lit(None).cast("int").alias("grown_shard"),
            ),
            "shards",
        )
