"""The industry tree: closure, expansion to leaves, roll-up, ancestors.

The closure goes up one level per round, until no node has a parent left.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fjordbook.session import durable


def tree_closure(tree: DataFrame) -> DataFrame:
    """Every (ancestor, descendant) pair including a node with itself, and their distance.

    One join per level of the tree, whatever its depth. A tree that goes round in
    a circle is refused.
    """
    parents = durable(tree.select("kode", "parent_kode"))
    count = parents.count()
    rounds = [parents.select(F.col("kode").alias("forfader"), F.col("kode").alias("etterkommer"), F.lit(0).alias("avstand"))]
    up = parents.filter(F.col("parent_kode").isNotNull()).select(F.col("kode").alias("forfader"), F.col("parent_kode").alias("_over"))
    while True:
        if len(rounds) > count:
            raise ValueError("the tree goes round in a circle")
        above = durable(rounds[-1].join(up, "forfader").select(F.col("_over").alias("forfader"), "etterkommer", (F.col("avstand") + 1).alias("avstand")))
        if above.isEmpty():
            return reduce(DataFrame.unionByName, rounds)
        rounds.append(above)


def expand_to_leaves(tree: DataFrame, selected: DataFrame | list[str], leaf_level: int = 5) -> DataFrame:
    """Codes of all leaves at or under the selected nodes (a list, or a frame with ``kode``)."""
    closure = tree_closure(tree)
    if isinstance(selected, list):
        chosen = closure.filter(F.col("forfader").isin(selected))
    else:
        chosen = closure.join(selected.select(F.col("kode").alias("forfader")), "forfader", "left_semi")
    leaves = tree.filter(F.col("niva") == leaf_level).select(F.col("kode").alias("etterkommer"))
    return chosen.join(leaves, "etterkommer", "left_semi").select(F.col("etterkommer").alias("kode")).distinct()


def rollup(tree: DataFrame, companies: DataFrame, max_level: int = 4) -> DataFrame:
    """Companies per node, each counted in all its ancestors; unused nodes show zero.

    Companies are counted per code before anything is joined.
    """
    active = companies.filter(F.col("slettet_dato").isNull() & F.col("naeringskode1_kode").isNotNull())
    used = active.groupBy(F.col("naeringskode1_kode").alias("etterkommer")).agg(F.count(F.lit(1)).alias("n"))
    sums = tree_closure(tree).join(used, "etterkommer").groupBy(F.col("forfader").alias("kode")).agg(F.sum("n").alias("n"))
    return (
        tree.filter(F.col("niva") <= max_level).join(sums, "kode", "left")
        .select("kode", "navn", "niva", "parent_kode", F.coalesce("n", F.lit(0)).alias("antall"))
    )


def matching_nodes(tree: DataFrame, text: str) -> DataFrame:
    """Nodes whose code starts with ``text`` or whose name contains it."""
    hit: Column = F.lower("kode").startswith(text.lower()) | F.contains(F.lower("navn"), F.lit(text.lower()))
    return tree.filter(hit)


def ancestors_of(tree: DataFrame, matches: DataFrame) -> DataFrame:
    """The matched nodes and all their ancestors: what has to stay visible and opened."""
    chosen = matches.select(F.col("kode").alias("etterkommer"))
    shown = tree_closure(tree).join(chosen, "etterkommer", "left_semi")
    return shown.groupBy(F.col("forfader").alias("kode")).agg(F.min("avstand").alias("avstand"))


def covered_by(tree: DataFrame, ticked: DataFrame) -> DataFrame:
    """Nodes under a ticked node (not the ticked node itself)."""
    chosen = ticked.select(F.col("kode").alias("forfader"))
    under = tree_closure(tree).filter("avstand > 0").join(chosen, "forfader", "left_semi")
    return under.select(F.col("etterkommer").alias("kode")).distinct()


def without_redundant(tree: DataFrame, ticked: DataFrame) -> DataFrame:
    """The ticked nodes that no other ticked node already covers."""
    return ticked.join(covered_by(tree, ticked), "kode", "left_anti")
