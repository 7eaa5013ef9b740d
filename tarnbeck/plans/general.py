"""Queries of the general data-quality operators: hierarchies, broken references, packed values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnbeck.operators.hierarchy import all_descendants, all_nodes, cycles, descendants, hierarchy
from tarnbeck.operators.multivalue import split_paths, split_values
from tarnbeck.operators.orphans import Parent, Reference, broken_counts, broken_references
from tarnbeck.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cycles(table(spark, sf_dir, "taxonomy_relation"))


def p1_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root, depth and path of every node of a link; ``p1_all_nodes`` has the roots without links too."""
    tree = hierarchy(table(spark, sf_dir, "taxonomy_relation"))
    return tree.select("node", "root", "depth", "cycle_id", F.array_join("path", ">").alias("path"))


def p1_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The (ancestor, node) pairs of the trees with their distance, as far as its SQL walks; ``p1_all_descendants`` has those on and below cycles too."""
    return descendants(hierarchy(table(spark, sf_dir, "taxonomy_relation")))


def p1_all_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root, depth and path of every node, with or without a link."""
    tree = all_nodes(table(spark, sf_dir, "taxonomy_relation"))
    return tree.select("node", "root", "depth", "cycle_id", F.array_join("path", ">").alias("path"))


def p1_all_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All (ancestor, node) pairs with their distance, on and below cycles too."""
    return all_descendants(table(spark, sf_dir, "taxonomy_relation"))


def _parents(spark: SparkSession, sf_dir: str) -> list[Parent]:
    return [
        Parent("queries", table(spark, sf_dir, "queries"), "id"),
        Parent("taxonomy_node", table(spark, sf_dir, "taxonomy_node"), "id"),
        Parent("content_block", table(spark, sf_dir, "content_block"), "block_id", deleted=None),
        Parent("source_asset", table(spark, sf_dir, "source_asset"), "asset_id"),
    ]


def _references(spark: SparkSession, sf_dir: str) -> list[Reference]:
    return [
        Reference("reviews", "query_id", table(spark, sf_dir, "reviews"), "id", "queries"),
        Reference("taxonomy_relation", "parent_id", table(spark, sf_dir, "taxonomy_relation"), "id", "taxonomy_node"),
        Reference("content_block", "parent_id", table(spark, sf_dir, "content_block"), "block_id", "content_block"),
        Reference("evidence", "source_asset_id", table(spark, sf_dir, "evidence"), "evidence_id", "source_asset"),
    ]


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = broken_references(_parents(spark, sf_dir), _references(spark, sf_dir))
    return found.select("ref_table", "ref_field", "ref_id", "reason").distinct()


def p3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return broken_counts(_parents(spark, sf_dir), _references(spark, sf_dir))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "taxonomy_node").select(F.lit("taxonomy_node").alias("src"), F.col("id").alias("record_id"), "name")
    bridges = table(spark, sf_dir, "inspection_bridges").select(F.lit("inspection_bridges").alias("src"), F.col("bridge_id").alias("record_id"), "name")
    return nodes.unionByName(bridges).where("record_id is not null")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = split_values(_packed(spark, sf_dir), "name", least=2)
    return items.select("src", "record_id", "pos", "item").distinct()


def p6_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows the masks decide, and how many went through the scanner."""
    return split_paths(_packed(spark, sf_dir), "name", ["src"])


QUERIES = {f.__name__: f for f in (p1_found, p1_nodes, p1_descendants, p1_all_nodes, p1_all_descendants, p3_found, p3_counts, p6_found, p6_paths)}

_BROKEN = """
with refs as (
  select 'queries' pt, query_id k, 'reviews' ref_table, 'query_id' ref_field, id ref_id, created_at c from reviews
  union all select 'taxonomy_node', parent_id, 'taxonomy_relation', 'parent_id', id, created_at from taxonomy_relation
  union all select 'content_block', parent_id, 'content_block', 'parent_id', block_id, created_at from content_block
  union all select 'source_asset', source_asset_id, 'evidence', 'source_asset_id', evidence_id, created_at from evidence),
parents as (
  select 'queries' pt, id k, created_at c, deleted_at d from queries
  union all select 'taxonomy_node', id, created_at, deleted_at from taxonomy_node
  union all select 'content_block', block_id, created_at, null from content_block
  union all select 'source_asset', asset_id, created_at, deleted_at from source_asset),
keys as (select pt, k, min(c) pc, bool_or(d is not null) gone from parents where k is not null and k <> '' group by pt, k),
found as (
  select ref_table, ref_field, ref_id, r.c rc,
    case when keys.k is null then 'missing' when gone then 'deleted' when pc > r.c then 'late' end reason
  from refs r left join keys on keys.pt = r.pt and keys.k = r.k
  where r.k is not null and r.k <> '' and ref_id is not null and ref_id <> '')
"""

_DEPTH = 18  # doublings: chains of up to 2^18 links
_WALK = """
with links as (select child_id n, min(parent_id) p from taxonomy_relation
  where child_id <> '' and parent_id <> '' group by child_id),
s0 as (select n, p, n least from links)
""" + "".join(
    f", s{i + 1} as (select a.n, b.p, least(a.least, b.least) least from s{i} a join s{i} b on a.p = b.n)\n" for i in range(_DEPTH)
)

ORACLE = {
    # After 2^18 steps only chains that run into a cycle are left; from there on the walk stays on it.
    "p1_found": _WALK + f" select a.n node_id, b.least cycle_id from s{_DEPTH} a join s{_DEPTH} b on a.p = b.n",
    "p1_nodes": """
with recursive links as (select child_id n, min(parent_id) p from taxonomy_relation
  where child_id <> '' and parent_id <> '' group by child_id),
walk as (select p node, p root, 0::bigint depth, p path from (select distinct p from links where p not in (select n from links))
  union all select l.n, w.root, w.depth + 1, w.path || '>' || l.n from walk w join links l on l.p = w.node)
, """ + _WALK.strip().removeprefix("with links as (select child_id n, min(parent_id) p from taxonomy_relation\n  where child_id <> '' and parent_id <> '' group by child_id),\n") + f"""
select node, root, depth, cast(null as varchar) cycle_id, path from walk
union all select a.n, null, null, b.least, null from s{_DEPTH} a join s{_DEPTH} b on a.p = b.n""",
    "p1_descendants": """
with recursive links as (select child_id n, min(parent_id) p from taxonomy_relation
  where child_id <> '' and parent_id <> '' group by child_id),
walk as (select p node, [p] path from (select distinct p from links where p not in (select n from links))
  union all select l.n, list_append(w.path, l.n) from walk w join links l on l.p = w.node)
select path[i] ancestor, node, len(path) - i distance
from (select node, path, unnest(range(1, len(path))) i from walk)""",
    "p3_found": _BROKEN + " select distinct ref_table, ref_field, ref_id, reason from found where reason is not null",
    "p3_counts": _BROKEN + " , one as (select ref_table, ref_field, ref_id, max(rc) rc, min(reason) reason from found where reason is not null group by all)"
    " select ref_table, ref_field, strftime(rc, '%Y-%m') period, reason, count(*) n_references from one group by all",
    # Each walk up names a node once, so it ends where it would come round.
    "p1_all_descendants": """
with recursive links as (select child_id n, min(parent_id) p from taxonomy_relation
  where child_id <> '' and parent_id <> '' group by child_id),
up as (select n node, p ancestor, 1::bigint distance, [n] seen from links where n <> p
  union all select up.node, l.p, up.distance + 1, list_append(up.seen, up.ancestor) from up join links l on l.n = up.ancestor where l.p <> up.ancestor and not list_contains(up.seen, l.p))
select ancestor, node, distance from up""",
}
ORACLE["p1_all_nodes"] = ORACLE["p1_nodes"] + """
union all select distinct child_id, child_id, 0::bigint, null, child_id from taxonomy_relation
where child_id <> '' and child_id not in (select n from links) and child_id not in (select p from links)"""
