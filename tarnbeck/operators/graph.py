"""Closures, bounded expansion and context over edge tables.

Breadth-first rounds as joins of a frontier with the edges; nodes seen are left out
by anti join. Each round is written to the shared folder, so lineage stays short and
a lost executor costs its tasks only. A frontier joins as it is: rows are only
ever counted on the driver.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tarnbeck.session import materialize, write_out


#: Steps of a closure that are computed in one job.
HOPS = 3


def closure(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(node, depth): all nodes reachable from any seed over (src, dst), with the fewest steps.

    Seeds have depth 0. Cycles end because a node is taken once, so it ends by itself. Null
    ends are no edges. Where nodes are left beyond ``max_depth`` steps, it is an error, no shorter result.

    A job takes HOPS steps. What a step reaches again from a node seen before is itself seen, or reached by an earlier step of
    the job, so the fewest steps stand and one anti join at the job's end does.
    """
    links = materialize(edges.select("src", "dst").where("src is not null and dst is not null and src != dst").distinct(), "edges")
    spark = edges.sparkSession
    start = seeds.select(F.col(seeds.columns[0]).alias("node")).where("node is not null").distinct().withColumn("depth", F.lit(0))
    parts, schema = [write_out(start, "front")], start.schema
    for depth in count(0, HOPS):
        front, seen = spark.read.schema(schema).parquet(parts[-1]).where(F.col("depth") == depth), spark.read.schema(schema).parquet(*parts)  # one scan, however many rounds
        met, step = None, front.select("node")
        for hop in range(depth + 1, depth + HOPS + 1):
            step = step.join(links, step.node == links.src).select(F.col("dst").alias("node")).distinct()
            at = step.withColumn("depth", F.lit(hop))
            met = at if met is None else met.unionByName(at)
        grown = Observation()
        fresh = met.groupBy("node").agg(F.min("depth").alias("depth")).join(seen.select("node"), "node", "left_anti")
        last = F.col("depth") == depth + HOPS
        beyond = F.lit(False) if max_depth is None else F.col("depth") > max_depth
        parts.append(write_out(fresh.observe(grown, F.count_if(last).alias("last"), F.count_if(beyond).alias("beyond")), "front"))
        if grown.get["beyond"]:
            raise ValueError(f"nodes are more than {max_depth} steps from the seeds, {grown.get['beyond']} of them among the next")
        if not grown.get["last"]:
            return spark.read.schema(schema).parquet(*parts)


def expand(edges: DataFrame, starts: DataFrame, max_depth: int = 8, max_nodes: int = 100) -> tuple[DataFrame, DataFrame]:
    """Bounded expansion of each start by itself: (reached, unexpanded).

    edges: edge_id, src, dst, verdict (only ``applicable`` ones are followed). reached: start, node, depth, path, n_th (order of discovery).
    unexpanded: start, edge_id, src, dst, reason: why an edge was not followed - its verdict, CYCLE (the target is on the path to the source), DEPTH_BUDGET, or
    NODE_BUDGET. Breadth first; within a level edges go in order of edge_id, so results are the same
    at every parallelism. A diamond is no cycle.
    """
    links = materialize(edges.select("edge_id", "src", "dst", "verdict").where("src is not null and dst is not null"), "edges")
    reached = materialize(starts.select(F.col(starts.columns[0]).alias("start")).where("start is not null").distinct().selectExpr("start", "start as node", "0 as depth", "array(start) as path", "1L as n_th"), "reached")
    front, left = reached, None
    for depth in range(1, max_depth + 2):
        out = front.drop("depth", "n_th").join(links, F.col("node") == F.col("src")).select("start", "edge_id", "src", "dst", "verdict", "path")
        reason = F.when(F.col("verdict") != "applicable", F.upper("verdict")).when(F.array_contains("path", F.col("dst")), "CYCLE")
        if depth > max_depth:
            reason = F.coalesce(reason, F.lit("DEPTH_BUDGET"))
        out = materialize(out.withColumn("reason", reason), "tried")
        new = out.where("reason is null").join(reached.select("start", F.col("node").alias("dst")), ["start", "dst"], "left_anti")
        first = new.groupBy("start", "dst").agg(F.min_by(F.struct("edge_id", "src", "path"), "edge_id").alias("by"))
        count = reached.groupBy("start").agg(F.max("n_th").alias("so_far"))
        order = Window.partitionBy("start").orderBy("by.edge_id", "dst")
        ranked = first.join(count, "start").withColumn("n_th", F.col("so_far") + F.row_number().over(order))
        ranked = materialize(ranked.select("start", F.col("dst").alias("node"), F.lit(depth).alias("depth"), F.concat("by.path", F.array("dst")).alias("path"), "n_th", "by.edge_id", "by.src"), "ranked")
        over = ranked.where(F.col("n_th") > max_nodes).selectExpr("start", "edge_id", "src", "node as dst", "'NODE_BUDGET' as reason")
        stop = out.where("reason is not null").select("start", "edge_id", "src", "dst", "reason").unionByName(over)
        left = stop if left is None else left.unionByName(stop)
        front = ranked.where(F.col("n_th") <= max_nodes).drop("edge_id", "src")
        if front.limit(1).count() == 0:
            break
        reached = reached.unionByName(front)
    return reached, left


def broken_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(code, edge_id, src, dst): edges whose ends are no nodes, self links, and repeated edges."""
    ids = nodes.select(F.col(nodes.columns[0]).alias("id")).distinct()
    no_dst = edges.join(ids, edges.dst == ids.id, "left_anti").select(F.lit("MISSING_TARGET").alias("code"), "edge_id", "src", "dst")
    no_src = edges.join(ids, edges.src == ids.id, "left_anti").select(F.lit("MISSING_SOURCE").alias("code"), "edge_id", "src", "dst")
    self_link = edges.where("src = dst").select(F.lit("SELF_LINK").alias("code"), "edge_id", "src", "dst")
    twice = edges.groupBy("src", "dst").agg(F.min("edge_id").alias("edge_id"), F.count_distinct("edge_id").alias("n")).where("n > 1").select(F.lit("DUPLICATE_LINK").alias("code"), "edge_id", "src", "dst")
    return no_dst.unionByName(no_src).unionByName(self_link).unionByName(twice)


def greedy_fit(items: Column, size: str, max_items: int, max_size: int) -> Column:
    """Which of an ordered array of structs fit a budget: each that still fits is kept, others are skipped.

    Returns the array with a boolean ``kept`` for each item; a later, smaller item may
    fit where an earlier one did not.
    """
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("total"), F.array().cast("array<boolean>").alias("kept"))

    def add(acc: Column, x: Column) -> Column:
        fits = (acc["n"] < max_items) & (acc["total"] + x[size] <= max_size)
        return F.struct(
            (acc["n"] + F.when(fits, 1).otherwise(0)).cast("long").alias("n"),
            (acc["total"] + F.when(fits, x[size]).otherwise(0)).cast("long").alias("total"),
            F.concat(acc["kept"], F.array(fits)).alias("kept"),
        )

    return F.aggregate(items, start, add)["kept"]
