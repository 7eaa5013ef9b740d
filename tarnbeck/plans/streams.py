"""Queries that run a stream over what is there and read its sink: the fold of a log equals the batch result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnbeck.session import scratch_dir, table
from tarnbeck.streaming import events


def stream_latest_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last action of each question and the number of its events, folded from the review log as a stream."""
    schema = table(spark, sf_dir, "reviews").schema
    log = events.read_events(spark, f"{sf_dir}/reviews.parquet*", schema)
    folder = scratch_dir(spark, "stream")
    fold = events.latest_states(log, "query_id", ["created_at", "id"], "action")
    events.run_to_table(fold, f"{folder}/out", f"{folder}/checkpoint", "complete").awaitTermination()
    last = spark.read.parquet(f"{folder}/out").withColumn("epoch", F.col("epoch").cast("long"))
    newest = last.agg(F.max("epoch")).first()[0]
    return last.where(F.col("epoch") == F.lit(newest)).select("query_id", "state", "n_events")


def stream_monthly_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review events once each, by month and action, with repeats of an id left out as they arrive."""
    schema = table(spark, sf_dir, "reviews").schema
    log = events.read_events(spark, f"{sf_dir}/reviews.parquet*", schema)
    at = log.where("id is not null").withColumn("at", F.col("created_at").cast("timestamp"))
    once = events.without_repeats(at, "id", "at", "3650 days")
    folder = scratch_dir(spark, "stream")
    events.run_to_table(once.select("id", "at", "action"), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    done = spark.read.parquet(f"{folder}/out")
    return done.groupBy(F.date_format("at", "yyyy-MM").alias("month"), "action").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (stream_latest_reviews, stream_monthly_reviews)}

ORACLE = {
    "stream_latest_reviews": "select query_id, arg_max(coalesce(action, chr(1)), strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') || id) as state, count(*) n_events from reviews where query_id <> '' group by query_id",
    "stream_monthly_reviews": "select strftime(created_at, '%Y-%m') as month, action, count(*) n from (select distinct id, created_at, action from reviews where id is not null) group by 1, 2",
}
