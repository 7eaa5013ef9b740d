"""Retrieval quality: set metrics per query and strategy, and their micro averages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnbeck.functions.scalars import ratio


#: Strategies that are compared; every query is scored for each.
MAX_STRATEGIES = 100


def query_metrics(runs: DataFrame, hits: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """One row for each (query_id, strategy) of the label set.

    runs: query_id, strategy, status, latency_ms. hits: query_id, strategy, rank, record_id; ranks
    beyond ``k`` are cut before scoring. labels: query_id, record_id, relevant (boolean). A failed or
    missing run has no hits but keeps its denominators; every ratio is null on a zero one.
    """
    strategies = sorted(r[0] for r in runs.select("strategy").where("strategy is not null").distinct().limit(MAX_STRATEGIES + 1).collect())
    if len(strategies) > MAX_STRATEGIES:
        raise ValueError(f"more than {MAX_STRATEGIES} strategies")
    wanted = labels.groupBy("query_id").agg(F.count_if("relevant").alias("n_expected"))
    names = F.array(*map(F.lit, strategies)).cast("array<string>")
    base = wanted.withColumn("strategy", F.explode(names)).join(runs.select("query_id", "strategy", "status", "latency_ms"), ["query_id", "strategy"], "left")
    top = hits.where(F.col("rank") <= k).join(runs.where("status != 'failed'").select("query_id", "strategy"), ["query_id", "strategy"], "left_semi")
    judged = top.join(labels, ["query_id", "record_id"], "left").groupBy("query_id", "strategy").agg(
        F.count("*").alias("n_returned"), F.count_if("relevant").alias("n_relevant"), F.count_if(~F.col("relevant")).alias("n_bad"), F.count_if(F.col("relevant").isNull()).alias("n_unjudged")
    )
    out = base.join(judged, ["query_id", "strategy"], "left").fillna(0, ["n_returned", "n_relevant", "n_bad", "n_unjudged"])
    return _ratios(out.withColumn("status", F.coalesce("status", F.lit("missing"))))


def _ratios(df: DataFrame) -> DataFrame:
    rel, bad, un, ret = (F.col(c) for c in ("n_relevant", "n_bad", "n_unjudged", "n_returned"))
    return df.select(
        "*",
        ratio(rel, "n_expected").alias("recall"),
        ratio(rel, ret).alias("precision_lower"),
        ratio(rel + un, ret).alias("precision_upper"),
        ratio(rel, rel + bad).alias("judged_precision"),
        ratio(rel + bad, ret).alias("coverage"),
    )


def strategy_summary(metrics: DataFrame) -> DataFrame:
    """Micro averages of each strategy, failed runs, mean and largest latency."""
    sums = [F.sum(c).alias(c) for c in ("n_expected", "n_returned", "n_relevant", "n_bad", "n_unjudged")]
    out = metrics.groupBy("strategy").agg(*sums, F.count_if(F.col("status").isin("failed", "missing")).alias("n_failed"), F.avg("latency_ms").alias("mean_latency_ms"), F.max("latency_ms").alias("max_latency_ms"))
    return _ratios(out)


def label_errors(labels: DataFrame, hits: DataFrame) -> DataFrame:
    """(code, query_id, record_id): records labelled both ways, and records returned twice by one strategy."""
    both = labels.groupBy("query_id", "record_id").agg(F.count_distinct("relevant").alias("n")).where("n > 1").select(F.lit("LABEL_OVERLAP").alias("code"), "query_id", "record_id")
    twice = hits.groupBy("query_id", "strategy", "record_id").count().where("count > 1").select(F.lit("DUPLICATE_HIT").alias("code"), "query_id", "record_id")
    return both.unionByName(twice.distinct())
