"""Operators on trees of nodes: inheritance along paths, nearest ancestors, shared members.

The trees come from :func:`tarnbeck.operators.hierarchy.hierarchy`; a node's ancestors are the
members of its path, so every operator here is one explode and one join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnbeck.functions.states import UNKNOWN, all_of


def lineage(tree: DataFrame) -> DataFrame:
    """(node, ancestor, pos): a node's path in long form, the node itself included; pos 0 is the root."""
    return tree.where("path is not null").select("node", F.posexplode("path").alias("pos", "ancestor"))


def inherited_states(tree: DataFrame, states: DataFrame) -> DataFrame:
    """(node, state): all-combination of the states along each path; a node without a state is unknown.

    states: node, state, one row for each node.
    """
    own = states.select(F.col("node").alias("ancestor"), "state")
    joined = lineage(tree).join(own, "ancestor", "left").withColumn("state", F.coalesce("state", F.lit(UNKNOWN)))
    return joined.groupBy("node").agg(all_of("state").alias("state"))


def inherited_requirements(tree: DataFrame, requirements: DataFrame) -> DataFrame:
    """(node, requirement_id, from_node, distance): requirements of a node and of all its ancestors."""
    at = lineage(tree).withColumn("depth", F.max("pos").over(Window.partitionBy("node")))
    return at.join(requirements.select(F.col("node").alias("ancestor"), "requirement_id"), "ancestor").select("node", "requirement_id", F.col("ancestor").alias("from_node"), (F.col("depth") - F.col("pos")).alias("distance"))


def nearest_ancestor(tree: DataFrame, marked: DataFrame) -> DataFrame:
    """(node, nearest, distance): the closest marked node on the path, itself counted; no row without one."""
    hits = lineage(tree).join(marked.select(F.col(marked.columns[0]).alias("ancestor")).distinct(), "ancestor")
    best = hits.groupBy("node").agg(F.max_by("ancestor", "pos").alias("nearest"), F.max("pos").alias("at"))
    return best.join(tree.select("node", "depth"), "node").select("node", "nearest", (F.col("depth") - F.col("at")).alias("distance"))


def shared_members(members: DataFrame, group: str, branch: str, item: str) -> DataFrame:
    """(group, item): items that every branch of a group has. Null groups, branches and items do not count."""
    clean = members.where(F.col(group).isNotNull() & F.col(branch).isNotNull())
    need = clean.groupBy(group).agg(F.count_distinct(branch).alias("need"))
    have = clean.where(F.col(item).isNotNull()).groupBy(group, item).agg(F.count_distinct(branch).alias("have"))
    return have.join(need, group).where("have = need").select(group, item)


def fill_down(df: DataFrame, column: str, by: list[str], order: list[str], out: str) -> DataFrame:
    """The last value that is not null, at or before each row of its group."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(column, ignorenulls=True).over(w))
