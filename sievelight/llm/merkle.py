"""A Merkle manifest of a dataset: leaf, proof and root per document, and what a claimed text folds to."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievelight.llm.common import shuffle_parts
from sievelight.session import written

# Fixed value: so many nodes have one parent.
FAN = 8
HEX = 64


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_hash(columns: list[Column]) -> Column:
    """Digest of a row: each value as ``bytes:value``, or ``-`` for null, one after the other."""
    def part(c: Column) -> Column:
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[part(c) for c in columns]).cast("binary"), 256)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add ``at`` and ``size``: the place of a row in its ``tree`` by ``order``, and the tree's rows.

    Rows are dealt to ranges of the order; the rows of a tree in earlier ranges, one number per range and
    tree, are added to the place in the range. No tree meets in one task.
    """
    ranges = rows.repartitionByRange(shuffle_parts(rows.sparkSession), "tree", *order)
    dealt = written(ranges.withColumn("_part", F.spark_partition_id()), "manifest-ranges")
    counts = dealt.groupBy("tree", "_part").agg(F.count("*").alias("_n"))
    tree = W.partitionBy("tree")
    counts = counts.select(
        "tree",
        "_part",
        (F.sum("_n").over(tree.orderBy("_part")) - F.col("_n")).alias("_before"),
        F.sum("_n").over(tree).alias("size"),
    )
    own = W.partitionBy("tree", "_part").orderBy(*order)
    placed = dealt.withColumn("_nth", F.row_number().over(own) - 1).join(counts, ["tree", "_part"])
    return placed.withColumn("at", F.col("_before") + F.col("_nth")).drop("_part", "_nth", "_before")


def height(size: int) -> int:
    """Levels above the leaves of a tree."""
    levels = 0
    while size > 1:
        size, levels = -(-size // FAN), levels + 1
    return levels


def climb(digests: list[str], levels: int) -> Iterator[list[str]]:
    """The texts of the runs of each level, from the nodes of a whole superblock up."""
    for _ in range(levels):
        runs = ["".join(digests[i : i + FAN]) for i in range(0, len(digests), FAN)]
        yield runs
        digests = [_hash(r) for r in runs]


def own_path(levels: list[list[str]], i: int) -> tuple[list[str], list[str]]:
    """Siblings to the left and to the right of node ``i`` on each level, as joined digests."""
    left, right = [], []
    for runs in levels:
        i, cut = i // FAN, i % FAN * HEX
        left.append(runs[i][:cut])
        right.append(runs[i][cut + HEX :])
    return left, right


def _block(depth: int) -> Column:
    return F.expr(f"at div {FAN**depth}").alias("_block")


def _reduced(nodes: DataFrame, depth: int) -> DataFrame:
    """One node per superblock: ``tree, at, size, digest`` of the level ``depth`` above (the top of a small tree)."""

    def run(key: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        digests, size = rows["digest"].tolist(), int(rows["size"].iloc[0])
        for runs in climb(digests, min(depth, height(size))):
            digests = [_hash(r) for r in runs]
        return pd.DataFrame({"tree": [key[0]], "at": [key[1]], "size": [-(-size // FAN**depth)], "digest": digests})

    grouped = nodes.select("tree", "at", "size", "digest").groupBy("tree", _block(depth))
    return grouped.applyInPandas(run, "tree string, at long, size long, digest string")


def _exchanged(nodes: DataFrame, outer: DataFrame, depth: int, schema: str, finish) -> DataFrame:
    """Cogroup nodes with the outer node of their superblock; ``finish(nodes, levels, outer)`` gives the rows."""

    def run(inner: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        inner = inner.sort_values("at", ignore_index=True)
        levels = list(climb(inner["digest"].tolist(), min(depth, height(int(inner["size"].iloc[0])))))
        return finish(inner, levels, above.iloc[0])

    return nodes.groupBy("tree", _block(depth)).cogroup(outer.groupBy("tree", "at")).applyInPandas(run, schema)


OUTER = "tree string, at long, subroot string, root string, lefts array<string>, rights array<string>"


def _outer_of(nodes: DataFrame, outer: DataFrame, depth: int) -> DataFrame:
    """The outer nodes of the level below: every node with its whole path to the root."""

    def finish(inner, levels, above):
        paths = [own_path(levels, i) for i in range(len(inner))]
        return pd.DataFrame(
            {
                "tree": inner["tree"],
                "at": inner["at"],
                "subroot": above["subroot"],
                "root": above["root"],
                "lefts": [left + list(above["lefts"]) for left, _ in paths],
                "rights": [right + list(above["rights"]) for _, right in paths],
            }
        )

    narrow = nodes.select("tree", "at", "size", "digest")
    return written(_exchanged(narrow, outer, depth, OUTER, finish), "manifest-outer")


def _levels(nodes: DataFrame, depth: int) -> list[DataFrame]:
    """The nodes, and the written nodes of superblocks of superblocks, until each tree is one node."""
    found = [nodes]
    while (found[-1].agg(F.max("size")).first()[0] or 1) > 1:
        found.append(written(_reduced(found[-1], depth), "manifest-nodes"))
    return found


def manifest(
    docs: DataFrame, columns: list[str], by: str, order: str, claimed: dict[str, Column], depth: int = 3
) -> DataFrame:
    """``order, leaf, subroot, root, proof, folded_root`` of every row.

    A row's leaf is the digest of ``columns``. The rows of each value of ``by`` are the leaves of a tree,
    ascending by ``order``; every FAN consecutive nodes have one parent until one node, the subroot,
    remains. Subroots, ordered by ``by`` (null first, then by UTF-8 bytes), are the leaves of the top tree.
    ``proof`` joins the hex digests of a row's siblings from its leaf to the root, left to right on each
    level. ``folded_root`` is what a row whose columns are replaced as ``claimed`` says folds to with these
    siblings; it equals ``root`` if nothing differs.

    Superblocks of FAN ** depth leaves are reduced to one node each, these again, and so on, until one node
    is left. On the way back the nodes of a superblock and its outer path, one row, are cogrouped: the task
    makes the lower levels again, joins both parts of each proof and folds. Leaves are made on the scan, so
    only digests are shuffled; a tree of any size is dealt by superblock.

    Null values have a form of their own in the leaf. Rows with a null ``order`` come first; rows with
    equal ones are leaves of their own, by digest, and equal rows are interchangeable. A tree of one leaf
    has that leaf as subroot. An empty table gives no rows. Other columns are left out.
    """
    claims = [claimed.get(c, F.col(c)) for c in columns]
    tree = F.when(F.col(by).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(by).cast("string")))
    rows = docs.select(
        F.col(order).alias("id"),
        tree.alias("tree"),
        leaf_hash([F.col(c) for c in columns]).alias("digest"),
        leaf_hash(claims).alias("claim"),
    )
    # Written first, so that texts are read and hashed once: range bounds take a pass of their own.
    leaves = written(numbered(written(rows, "manifest-rows"), ["id", "digest", "claim"]), "manifest-leaves")
    inside = _levels(leaves, depth)
    subroots = inside[-1].select(F.lit("").alias("tree"), F.col("tree").alias("by"), "digest")
    tops = written(numbered(subroots, ["by"]), "manifest-subroots")
    upper = _levels(tops, depth)
    root = upper[-1].select(
        "tree", F.lit(0).cast("long").alias("at"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"),
        F.array().cast("array<string>").alias("lefts"), F.array().cast("array<string>").alias("rights"),
    )
    outer = root
    for nodes in reversed(upper[:-1]):
        outer = _outer_of(nodes, outer, depth)
    # From the top tree down into the tree of each value.
    outer = tops.join(outer.drop("tree", "subroot"), "at").select(
        F.col("by").alias("tree"), F.lit(0).cast("long").alias("at"), F.col("digest").alias("subroot"), "root", "lefts", "rights"
    )
    for nodes in reversed(inside[1:-1]):
        outer = _outer_of(nodes, outer, depth)
    kind = docs.schema[order].dataType.simpleString()

    def finish(inner, levels, above):
        lefts, rights = list(above["lefts"]), list(above["rights"])
        beyond = "".join(a + b for a, b in zip(lefts, rights))
        proofs, folded = [], []
        for i, claim in enumerate(inner["claim"].tolist()):
            left, right = own_path(levels, i)
            proofs.append("".join(a + b for a, b in zip(left, right)) + beyond)
            for a, b in zip(left + lefts, right + rights):
                claim = _hash(a + claim + b)
            folded.append(claim)
        return pd.DataFrame(
            {
                "id": inner["id"],
                "leaf": inner["digest"],
                "subroot": above["subroot"],
                "root": above["root"],
                "proof": proofs,
                "folded_root": folded,
            }
        )

    schema = f"id {kind}, leaf string, subroot string, root string, proof string, folded_root string"
    return _exchanged(leaves, outer, depth, schema, finish).withColumnRenamed("id", order)
