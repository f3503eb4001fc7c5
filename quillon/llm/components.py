"""Connected components by contraction: each round hooks every node to its smallest neighbour and joins what is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _mapped(rows: DataFrame, key: str, table: DataFrame, out: str) -> DataFrame:
    """``rows`` (a written table) with ``out``, the parent of their ``key`` in ``table`` (node, parent), or the key itself.

    A key that very many rows have, as the smallest node of a large component, is broadcast.
    """
    counts = rows.groupBy(key).agg(F.count("*").alias("_n"))
    found = counts.join(table.select(F.col("node").alias(key), F.col("parent").alias(out)), key, "left")
    groups = common.saved(found.select(key, F.coalesce(out, key).alias(out), "_n"), "groups")
    total = groups.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    return common.attach(rows, groups, [key], "_n", total).drop("_n")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``edges``; root is the smallest node of its component.

    Self-loops, repeated edges and both directions are fine; edges with a null end are left out. Parents are
    smaller than their nodes, so pointers never form a cycle; every round at least halves each component's
    nodes. Tables of rounds are written to the shared folder. Minimums are summed up before they are shuffled,
    and a node with very many edges is joined by broadcast, so it meets them where they are.
    """
    left = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    left = common.saved(left.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while True:
        ends = left.select(F.col("b").alias("node"), F.col("a").alias("other")).unionByName(left.select(F.col("a").alias("node"), F.col("b").alias("other")))
        hooked = common.saved(ends.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("parent")), "hooked")
        parents = common.saved(_mapped(hooked, "parent", hooked, "up").select("node", F.col("up").alias("parent")), "parents")
        if labels is None:
            labels = parents.select("node", F.col("parent").alias("root"))
        else:
            labels = _mapped(labels, "root", parents, "up").select("node", F.col("up").alias("root"))
        labels = common.saved(labels, "labels")
        one = common.saved(_mapped(left, "a", parents, "pa"), "edges")
        moved = _mapped(one, "b", parents, "pb").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
        # A parent that isn't a root yet must stay joined to its own parent.
        chain = parents.where("parent <> node").join(parents.select(F.col("parent").alias("node")).distinct(), "node", "left_semi").select(F.col("parent").alias("a"), F.col("node").alias("b"))
        left = common.saved(moved.unionByName(chain).distinct(), "edges")
        if left.isEmpty():
            return labels
