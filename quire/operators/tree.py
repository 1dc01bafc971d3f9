"""Hierarchies of any depth as relations: inherited values and document order by pointer jumping.

A round lets every row point twice as far as before, so chains of n nodes take about log2(n)
rounds, each a join of rows with the rows that they point at, and no task holds a tree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import stored
from .prefix import with_sums_before


def _jump(rows: DataFrame, keys: list[str], to: str, merged: dict) -> DataFrame:
    """rows with what they point at taken in, and pointing where that pointed.

    keys tell rows apart, and to is a struct of the keys of another row, null at the end of a
    chain. merged gives columns anew from the row's own and from far.<column>, the other's.
    No chain is longer than there are rows; what still points at something after as many
    doublings runs in a circle and is left out.
    """
    names = [c for c in rows.columns if c not in (*keys, to)]
    rows = stored(rows)
    for _ in range(rows.count().bit_length() + 1):
        open_ = rows.where(F.col(to).isNotNull())
        if open_.isEmpty():
            break
        far = rows.select(F.struct(*keys).alias("__key"), F.struct(to, *names).alias("far"))
        met = open_.join(far, F.col(to) == F.col("__key"), "left")
        after = met.select(*keys, *[merged.get(c, F.col(c)).alias(c) for c in names], F.col(f"far.{to}").alias(to))
        rows = stored(rows.where(F.col(to).isNull()).unionByName(after))
    return rows.where(F.col(to).isNull())


def inherited(nodes: DataFrame, columns: list[str]) -> DataFrame:
    """nodes (doc_id, node, parent) with columns taken from the nearest ancestor that has them, itself first.

    The root's parent is null; a parent that is not there counts as none. Nodes that are
    their own ancestors are left out.
    """
    up = F.when(F.col("parent").isNotNull(), F.struct("doc_id", F.col("parent").alias("node")))
    narrow = nodes.select("doc_id", "node", *columns, up.alias("__up"))
    found = _jump(narrow, ["doc_id", "node"], "__up", {c: F.coalesce(F.col(c), F.col(f"far.{c}")) for c in columns})
    found = found.select("doc_id", "node", *columns)
    return nodes.drop(*columns).join(found, ["doc_id", "node"])


def leaves_in_order(nodes: DataFrame) -> DataFrame:
    """doc_id, node and page0 of the leaves (doc_id, node, parent, ord, leaf) in document order.

    ord orders the children of a node. A walk around the tree enters and leaves each node
    once; the leaves that a walk still has before it, counted by pointer jumping, number
    them. Roots of a document follow each other in the order of ord.
    """
    event = lambda node, side: F.struct("doc_id", node.alias("node"), F.lit(side).alias("side"))
    placed = stored(with_sums_before(nodes.select("doc_id", "node", "parent", "ord", "leaf"), ["doc_id", "parent"], ["ord", "node"], {"place": F.lit(1).cast("long")}))
    after = placed.select("doc_id", "parent", (F.col("place") - 1).alias("place"), F.col("node").alias("next"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("doc_id", "parent", "place")]
    placed = placed.alias("a").join(after.alias("b"), same, "left").select("a.*", "b.next")
    firsts = placed.where("place = 0 and parent is not null").select(F.col("doc_id").alias("__doc"), F.col("parent").alias("__node"), F.col("node").alias("child"))
    both = placed.join(firsts, (F.col("doc_id") == F.col("__doc")) & (F.col("node") == F.col("__node")), "left")
    child, following = F.col("child"), F.col("next")
    enter = both.select(
        "doc_id", "node", F.lit(0).alias("side"), F.col("leaf").cast("long").alias("n"),
        F.when(child.isNotNull(), event(child, 0)).otherwise(event(F.col("node"), 1)).alias("to"),
    )
    leave = both.select(
        "doc_id", "node", F.lit(1).alias("side"), F.lit(0).cast("long").alias("n"),
        F.when(following.isNotNull(), event(following, 0)).when(F.col("parent").isNotNull(), event(F.col("parent"), 1)).alias("to"),
    )
    walk = _jump(enter.unionByName(leave), ["doc_id", "node", "side"], "to", {"n": F.col("n") + F.coalesce(F.col("far.n"), F.lit(0))})
    ahead = walk.where("side = 0").select("doc_id", "node", "n").join(nodes.where("leaf").select("doc_id", "node"), ["doc_id", "node"])
    most = ahead.groupBy("doc_id").agg(F.max("n").alias("__most"))
    return ahead.join(most, "doc_id").select("doc_id", "node", (F.col("__most") - F.col("n")).cast("int").alias("page0"))


def pages_of_tree(nodes: DataFrame, attributes: list[str]) -> DataFrame:
    """doc_id, node, page0 and attributes of the pages of page trees.

    nodes has doc_id, node, parent, ord, leaf (whether it is a page) and attributes, which
    a page that lacks them takes from the nodes above it. Nodes in circles and what hangs
    on them are no pages.
    """
    full = inherited(nodes.select("doc_id", "node", "parent", "ord", "leaf", *attributes), attributes)
    full = stored(full)
    return leaves_in_order(full).join(full.where("leaf").select("doc_id", "node", *attributes), ["doc_id", "node"])
