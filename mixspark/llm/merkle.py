"""Merkle manifest of a dataset: one tree per source, and a tree over their roots.

Nodes have three children; a run of fewer at the end of a level becomes a node too. Only every fourth
level is stored. A proof needs the levels between: they are computed again from the stored nodes of
each aligned subtree (81 nodes at most), their siblings go into the proofs, and they are dropped. No
task holds more than a subtree, whatever the size of a source.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mixspark.llm.common import parts_for
from mixspark.sources.scratch import stored

FAN = 3
#: One level of these many is stored.
LEVELS = 4
CHUNK = FAN ** LEVELS
#: Nodes below that one file of a stored level stands for.
FILE_NODES = 1_000_000


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts put together."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(c: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value as text."""
    text = c.cast("string")
    return F.when(text.isNull(), "-").otherwise(
        F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def ranked(nodes: DataFrame, order: list[str]) -> DataFrame:
    """Add ``pos``, the place of a row in its tree by ``order`` (which must tell rows apart), and ``n``,
    the rows of the tree. Rows are sorted in ranges; a range knows how many rows of the tree lie in the
    ranges before it, so a tree of any size is spread over many tasks."""
    placed = stored(
        nodes.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
        .withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "ranked")
    runs = placed.groupBy("part", "tree").agg(F.min("at").alias("first"), F.count("*").alias("m"))
    tree = Window.partitionBy("tree")
    before = F.sum("m").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("part", "tree", "first", F.coalesce(before, F.lit(0)).alias("before"),
                       F.sum("m").over(tree).alias("n"))
    return placed.join(runs, ["part", "tree"]).withColumn(
        "pos", F.col("before") + F.col("at") - F.col("first")).drop("part", "at", "first", "before")


def lifted(level: Column, last: Column) -> Column:
    """The level above an array of digests; a whole tree that is one node stays as it is."""
    up = F.transform(F.sequence(F.lit(0), F.ceil(F.size(level) / F.lit(FAN)).cast("int") - 1),
                     lambda i: digest(F.array_join(F.slice(level, i * FAN + 1, FAN), "")))
    return F.when(last & (F.size(level) == 1), level).otherwise(up)


def subtrees(nodes: DataFrame, payload: list[str]) -> DataFrame:
    """Per aligned subtree: its stored nodes in order and the levels above them, ``a0`` to ``a4``."""
    cut = nodes.where("n > 1").groupBy("tree", "n", F.expr(f"pos div {CHUNK}").alias("chunk")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "digest", *payload))).alias("nodes"))
    cut = cut.withColumn("last", F.col("n") <= CHUNK).withColumn("a0", F.col("nodes.digest"))
    for k in range(LEVELS):
        cut = cut.withColumn(f"a{k + 1}", lifted(F.col(f"a{k}"), F.col("last")))
    return cut


def build(leaves: DataFrame) -> list[DataFrame]:
    """The stored levels 0, 4, 8, ... of all trees: (tree, pos, n, digest), n being the nodes of the
    tree on that level. A tree is on the levels up to the first where it is one node."""
    kept = [leaves]
    while True:
        size = kept[-1].agg(F.max("n").alias("n"), F.count("*").alias("nodes")).first()
        if (size["n"] or 0) <= 1:
            return kept
        up = subtrees(kept[-1], []).select(
            "tree", F.col("chunk").alias("pos"), F.expr(f"(n + {CHUNK - 1}) div {CHUNK}").alias("n"),
            F.col(f"a{LEVELS}")[0].alias("digest"))
        kept.append(stored(up.repartition(parts_for(size["nodes"], FILE_NODES)), "merkle"))


def roots(kept: list[DataFrame]) -> DataFrame:
    """(tree, digest): one row per tree."""
    out = None
    for level in kept:
        one = level.where("n = 1").select("tree", "digest")
        out = one if out is None else out.unionByName(one)
    return out


def _own_steps(i: Column) -> Column:
    """The siblings of member i of a subtree and of its ancestors in there, level by level."""
    steps = []
    for k in range(LEVELS):
        level = F.col(f"a{k}")
        at = F.floor(i / F.lit(FAN ** k)).cast("int")
        start = at - at % FAN
        pair = F.struct(F.array_join(F.slice(level, start + 1, at - start), "").alias("left"),
                        F.array_join(F.slice(level, at + 2, start + (FAN - 1) - at), "").alias("right"))
        steps.append(F.when(~(F.col("last") & (F.size(level) == 1)), pair))
    return F.array_compact(F.array(*steps))


def proofs(kept: list[DataFrame], tops: DataFrame, payload: list[str] = ()) -> DataFrame:
    """(tree, pos, digest, payload, steps, ...) for each leaf, ``steps`` being the digests to the left and
    to the right on the way up. ``tops`` has the steps above each tree's root, by tree; its other columns
    are handed down with them. Goes from the top to the leaves, one stored level at a time."""
    carry = [c for c in tops.columns if c not in ("tree", "steps")]
    above = None
    for k in reversed(range(len(kept))):
        more = list(payload) if k == 0 else []
        found = kept[k].where("n = 1").join(tops, "tree").select(
            "tree", "pos", "digest", *more, "steps", *carry)
        if above is not None:
            over = above.select("tree", F.col("pos").alias("chunk"), F.col("steps").alias("above"), *carry)
            cut = subtrees(kept[k], more).join(over, ["tree", "chunk"])
            members = F.transform("nodes", lambda m, i: F.struct(m.alias("node"), _own_steps(i).alias("own")))
            cut = cut.select("tree", F.explode(members).alias("m"), "above", *carry)
            found = found.unionByName(cut.select(
                "tree", "m.node.*", F.concat("m.own", "above").alias("steps"), *carry))
        above = found
    return above


def proof_digest(steps: Column) -> Column:
    """H of all siblings, level by level, left to right."""
    return digest(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), ""))


def folded(leaf: Column, steps: Column) -> Column:
    """The root that follows from a leaf and its proof."""
    return F.aggregate(steps, leaf, lambda h, s: digest(s["left"], h, s["right"]))


@dataclass
class Manifest:
    """The stored levels of the sources' trees and of the tree over their roots."""

    levels: list[DataFrame]
    top: list[DataFrame]
    payload: list[str]

    def root(self) -> str | None:
        """The digest of the whole dataset; None where it is empty."""
        row = roots(self.top).first()
        return row["digest"] if row else None

    def proofs(self) -> DataFrame:
        """(digest, payload, steps, subroot, root) for each row of the dataset."""
        root = roots(self.top).select("tree", F.array().cast("array<struct<left:string,right:string>>")
                                      .alias("steps"), F.col("digest").alias("root"))
        tops = proofs(self.top, root, ["name"]).select(
            F.col("name").alias("tree"), "steps", F.col("digest").alias("subroot"), "root")
        return proofs(self.levels, tops, self.payload).drop("tree", "pos")


def build_manifest(docs: DataFrame, leaf: Column, by: Column, order: Column, payload: dict[str, Column]) -> Manifest:
    """Trees over ``leaf`` per value of ``by``, leaves ascending by ``order`` (nulls first; rows of one
    order by their leaf, repeated rows as they come), and a tree over the subroots by the value of
    ``by`` (null first, then bytewise).

    ``payload`` names further columns that the proofs shall carry. Any column may be null, and null is a
    value of ``by`` of its own. An empty table has no root and no proofs. Other columns are not
    read."""
    rows = docs.select(
        F.when(by.isNull(), "").otherwise(F.concat(F.lit("="), by.cast("string"))).alias("tree"),
        order.alias("order"), leaf.alias("digest"), F.monotonically_increasing_id().alias("row"),
        *[c.alias(name) for name, c in payload.items()])
    levels = build(ranked(rows, ["order", "digest", "row"]).drop("order", "row"))
    names = roots(levels).select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    return Manifest(levels, build(ranked(names, ["name"])), list(payload))
