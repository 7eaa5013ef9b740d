"""Parent-child rows to full hierarchies, by tree contraction.

Every round rakes the leaves and splices out an independent set of unary-chain
nodes (those whose hash is smaller than that of their child and of their parent),
so a forest of any shape shrinks by a constant factor. The removals are written
round by round and then replayed backwards: a removed node takes root, depth and
path from the node it hung from. A core that no round can shrink is a node linked
to itself: the remains of a cycle, whose smallest member is carried along.

Shuffles are on node ids of the live rows only, which shrink geometrically; no
group is collected, and a parent with a third of all children costs a partial
count, not a task.
"""

from __future__ import annotations

from itertools import chain, repeat

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tarnbeck.session import materialize, remove, scratch_dir, write_out

RAKED, SPLICED = "raked", "spliced"
#: Rounds take turns with these seeds; few, so that generated code is reused.
SEEDS = 3
#: Rounds computed in one job before the forest is written out again: what a round removes rides through the job's later rounds, so the
#: first jobs, which see most rows, have one; the last number goes for all further jobs.
ROUNDS = (1, 1, 2, 4)


def clean_links(df: DataFrame, child: str = "child_id", parent: str = "parent_id") -> DataFrame:
    """(node, parent): each link once, without null or empty ends.

    A node named with several parents keeps the smallest one in the tree;
    :func:`extra_parents` reports the others.
    """
    links = df.select(F.col(child).cast("string").alias("node"), F.col(parent).cast("string").alias("parent"))
    links = links.where("node is not null and parent is not null and node != '' and parent != ''")
    return links.groupBy("node").agg(F.min("parent").alias("parent"))


def extra_parents(df: DataFrame, child: str = "child_id", parent: str = "parent_id") -> DataFrame:
    """(node, parent, kept_parent): links left out of the tree because the node has a smaller parent."""
    links = df.select(F.col(child).cast("string").alias("node"), F.col(parent).cast("string").alias("parent"))
    links = links.where("node is not null and parent is not null and node != '' and parent != ''")
    tree = clean_links(df, child, parent).withColumnRenamed("parent", "kept_parent")
    return links.join(tree, "node").where("parent != kept_parent").distinct()


def _round(live: DataFrame, turn: int, paths: bool) -> DataFrame:
    """One round: removed rows with their fate and turn, and kept ones, all with their new links.

    live: node, parent (null for a root), steps (links that the link to the parent
    stands for), least (smallest node spliced into that link), inner (those nodes, from
    the top), and fate, only, turn of rows that an earlier round removed; those are passed on as they are. Two message
    passings, each one explode and one aggregation by node, so the plan is one chain: children report to
    their parent, then spliced nodes hand their link to their only child. That child
    never hangs from a node removed in the same round: also a raked leaf takes the link over.
    """
    inner = lambda text: text if paths else ""
    order = lambda c: f"struct(xxhash64({c}, {turn % SEEDS}), {c})"
    sql = f"""
    WITH mine AS (
      SELECT node, struct(parent, steps, least {inner(", inner")}, fate, only, turn) AS me, fate IS NULL AND parent IS NOT NULL AND parent <> node AS moves FROM {{live}}),
    told AS (
      SELECT inline(filter(array(
        struct(node, me, CAST(NULL AS STRING) AS child),
        struct(CASE WHEN moves THEN me.parent END AS node, IF(false, me, NULL) AS me, node AS child)), x -> x.node IS NOT NULL)) FROM mine),
    seen AS (SELECT node, first(me, true) AS me, count(child) AS below, min(child) AS one FROM told GROUP BY node),
    judged AS (
      SELECT node, me, one, me.fate IS NULL AS live, CASE
        WHEN me.fate IS NOT NULL OR me.parent IS NULL OR me.parent = node THEN me.fate
        WHEN below = 0 THEN '{RAKED}'
        WHEN below = 1 AND {order("node")} < {order("one")} AND {order("node")} < {order("me.parent")} THEN '{SPLICED}' END AS fate FROM seen),
    stated AS (
      SELECT node, live AND fate = '{SPLICED}' AS hands, one, struct(me.parent, me.steps, me.least {inner(", me.inner")}, fate,
        IF(live, one, me.only) AS only, IF(live AND fate IS NOT NULL, {turn}, me.turn) AS turn) AS own FROM judged),
    passed AS (
      SELECT inline(filter(array(
        struct(node, own, IF(false, struct(node AS via, own.*), NULL) AS hand),
        struct(CASE WHEN hands THEN one END AS node, IF(false, own, NULL) AS own, struct(node AS via, own.*) AS hand)), x -> x.node IS NOT NULL)) FROM stated),
    met AS (SELECT node, first(own, true) AS own, first(hand, true) AS hand FROM passed GROUP BY node)
    SELECT node, own.fate, own.only, own.turn, IF(hand IS NULL, own.parent, hand.parent) AS parent, own.steps + coalesce(hand.steps, 0) AS steps,
      least(own.least, hand.via, hand.least) AS least {inner(", IF(hand IS NULL, own.inner, concat(hand.inner, array(hand.via), own.inner)) AS inner")}
    FROM met"""
    return live.sparkSession.sql(sql, live=live)


def contract(links: DataFrame, paths: bool = False, folder: str | None = None) -> tuple[list[DataFrame], DataFrame]:
    """The rounds' removals, and the core: roots, and one self-linked node for each cycle.

    links: node, parent, each node once. Parents that have no row of their own are roots.
    Each job of ROUNDS makes one write; how many rows could still move is observed on the way.
    """
    spark = links.sparkSession
    inner = ", CAST(array() AS array<string>) AS inner" if paths else ""
    live = spark.sql(
        f"""WITH ends AS (SELECT inline(array(struct(node, parent), struct(parent AS node, CAST(NULL AS STRING) AS parent))) FROM {{links}})
        SELECT node, max(parent) AS parent, IF(max(parent) IS NULL, 0L, 1L) AS steps, CAST(NULL AS STRING) AS least {inner},
          CAST(NULL AS STRING) AS fate, CAST(NULL AS STRING) AS only, CAST(NULL AS INT) AS turn FROM ends GROUP BY node""",
        links=links,
    )
    live = materialize(live, "forest", folder)
    rounds: list[DataFrame] = []
    first = 0
    for n in chain(ROUNDS, repeat(ROUNDS[-1])):
        step, seen, turns = live, Observation(), range(first, first + n)
        first += n
        for turn in turns:
            step = _round(step, turn, paths)
        moving = F.count_if(F.expr("fate IS NULL AND parent IS NOT NULL AND parent <> node")).alias("moving")
        step = materialize(step.observe(seen, moving, *(F.count_if(F.col("turn") == t).alias(f"turn_{t}") for t in turns)), "round", folder)
        rounds += [step.where(F.col("turn") == t) for t in turns if seen.get[f"turn_{t}"]]
        live = step.where("fate IS NULL")
        if not seen.get["moving"]:
            return rounds, live


def expand(rounds: list[DataFrame], core: DataFrame, paths: bool = False) -> DataFrame:
    """Replay the removals backwards: node, root, depth, cycle_id, on_cycle and, if asked for, path."""
    spark = core.sparkSession
    path = ", IF(parent IS NULL, array(node), NULL) AS path" if paths else ""
    seen = Observation()
    done = spark.sql(
        f"""SELECT node, IF(parent IS NULL, node, NULL) AS root, IF(parent IS NULL, 0L, NULL) AS depth,
          IF(parent IS NOT NULL, least(node, least), NULL) AS cycle_id, parent IS NOT NULL AS on_cycle {path} FROM {{core}}""",
        core=core,
    )
    schema, parts = done.schema, [write_out(done.observe(seen, F.count_if("on_cycle").alias("rings")), "grown")]
    path = ", concat(up.path, inner, array(r.node)) AS path" if paths else ""
    # A spliced node is on a cycle exactly if its only child is.
    ring = f"fate = '{SPLICED}' AND coalesce(ring.on_cycle, false)", "LEFT JOIN (SELECT node, on_cycle FROM {done} WHERE on_cycle) ring ON ring.node = only"
    for removed in reversed(rounds):
        done = spark.read.schema(schema).parquet(*parts)  # one scan, however many parts
        on_cycle, join = ring if seen.get["rings"] else ("false", "")
        grown = spark.sql(
            f"""SELECT r.node, up.root, up.depth + steps AS depth, up.cycle_id, {on_cycle} AS on_cycle {path}
            FROM {{removed}} r JOIN {{done}} up ON up.node = r.parent {join}""",
            removed=removed, done=done,
        )
        parts.append(write_out(grown, "grown"))
    return spark.read.schema(schema).parquet(*parts)


def hierarchy(df: DataFrame, child: str = "child_id", parent: str = "parent_id", paths: bool = True) -> DataFrame:
    """One row for each node of the links: node, root, depth, cycle_id, on_cycle, path.

    Root, depth and path (root first, the node last) are null for nodes on a cycle or
    whose chain of parents runs into one; cycle_id names the smallest node of that
    cycle, else null. Null and empty ends are no links, repeated rows count once, a node
    with several parents follows the smallest (see :func:`extra_parents`). An empty
    table gives an empty result. ``paths=False`` leaves out the arrays.
    """
    spark, folder = df.sparkSession, scratch_dir(df.sparkSession, "contraction")
    rounds, core = contract(clean_links(df, child, parent), paths, folder)
    tree = expand(rounds, core, paths)
    remove(spark, folder)  # the rounds; what was made of them stays
    return tree


def descendants(tree: DataFrame) -> DataFrame:
    """(ancestor, node, distance): every node below every ancestor, in long form, of the nodes with a path.

    Nodes on a cycle or below one have none; :func:`all_descendants` takes them too.
    """
    at = tree.where("path is not null").select("node", "depth", F.posexplode("path").alias("pos", "ancestor"))
    return at.where("ancestor != node").select("ancestor", "node", (F.col("depth") - F.col("pos")).alias("distance"))


def all_descendants(df: DataFrame, child: str = "child_id", parent: str = "parent_id") -> DataFrame:
    """(ancestor, node, distance): every node below every ancestor, on and below cycles too, in long form.

    The walk up from a node names each member of a cycle once, with the steps to it, and
    never the node itself. Above the cycle's entry, the member ``pos`` steps down from the smallest
    is ``(pos of the entry - pos) mod length`` steps away, so cycles are met by number, not walked.
    """
    links = materialize(clean_links(df, child, parent), "links")
    tree = hierarchy(links, "node", "parent")
    on_cycle = tree.where("on_cycle").select("node", "cycle_id")
    # The rings, opened above their smallest member, and what hangs from each member: forests both.
    ring = hierarchy(links.join(on_cycle, "node").where("node != cycle_id"), "node", "parent", paths=False)
    ring = materialize(on_cycle.join(ring.select("node", "depth"), "node", "left").select("cycle_id", F.col("node").alias("ancestor"), F.coalesce("depth", F.lit(0)).alias("pos")), "ring")
    hung = hierarchy(links.join(tree.where("cycle_id is not null and not on_cycle").select("node"), "node", "left_semi"), "node", "parent")
    below = hung.where("depth > 0").select("node", F.col("root").alias("entry"), F.col("depth").alias("steps"))
    below = below.unionByName(ring.select(F.col("ancestor").alias("node"), F.col("ancestor").alias("entry"), F.lit(0).cast("long").alias("steps")))
    size = ring.groupBy("cycle_id").agg(F.count("*").alias("length"))
    entries = ring.join(size, "cycle_id").select("cycle_id", F.col("ancestor").alias("entry"), F.col("pos").alias("entry_pos"), "length")
    met = below.join(entries, "entry").join(ring, "cycle_id").where("ancestor != entry")  # the entry's own pairs are in ``hung``
    around = met.select("ancestor", "node", (F.col("steps") + F.pmod(F.col("entry_pos") - F.col("pos"), "length")).alias("distance"))
    return descendants(tree).unionByName(descendants(hung)).unionByName(around)


def all_nodes(df: DataFrame, child: str = "child_id", parent: str = "parent_id", paths: bool = True) -> DataFrame:
    """:func:`hierarchy`, and each child without any link: one whose only rows have a null or empty parent is a root of depth 0."""
    tree = hierarchy(df, child, parent, paths)
    named = df.select(F.col(child).cast("string").alias("node")).where("node != ''").distinct()
    lone = named.join(tree.select("node"), "node", "left_anti")
    row = {"root": F.col("node"), "depth": F.lit(0).cast("long"), "cycle_id": F.lit(None).cast("string"), "on_cycle": F.lit(False), "path": F.array("node")}
    return tree.unionByName(lone.select(*(F.col("node") if c == "node" else row[c].alias(c) for c in tree.columns)))


def cycles(df: DataFrame, child: str = "child_id", parent: str = "parent_id") -> DataFrame:
    """(node_id, cycle_id): nodes on a cycle, and nodes whose chain of parents runs into one."""
    tree = hierarchy(df, child, parent, paths=False)
    return tree.where("cycle_id is not null").select(F.col("node").alias("node_id"), "cycle_id")
