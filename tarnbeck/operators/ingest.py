"""Statuses of rows and pages on their way in: outcome rules, isolation of bad pages, retries, nested strings."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tarnbeck.session import materialize

#: What may become of a row; the last five are problems.
OUTCOMES = ("success", "duplicate", "quarantined", "source_missing", "identity_conflict", "unrecognized", "failed")


def with_outcome(df: DataFrame, rules: list[tuple[Column, str]], out: str = "outcome") -> DataFrame:
    """``df`` with the outcome of the first rule that holds; ``success`` if none does. A rule that is null does not hold."""
    outcome = F.lit("success")
    for test, name in reversed(rules):
        if name not in OUTCOMES:
            raise ValueError(name)
        outcome = F.when(test, name).otherwise(outcome)
    return df.withColumn(out, outcome)


def job_status(df: DataFrame, by: list[str], outcome: str = "outcome") -> DataFrame:
    """(by, status, n_...): completed if no row has a problem, else completed_with_problems; counts of each outcome."""
    counts = [F.count_if(F.col(outcome) == o).alias(f"n_{o}") for o in OUTCOMES]
    done = df.groupBy(*by).agg(*counts)
    problems = sum((F.col(f"n_{o}") for o in OUTCOMES[2:]), F.lit(0))
    return done.withColumn("status", F.when(problems == 0, "completed").otherwise("completed_with_problems"))


def page_status(blocks: DataFrame, by: list[str], issue: Column) -> DataFrame:
    """(by, n_blocks, n_bad, status): pages with an issue are isolated, pages without text need recognition.

    issue: a code or null for each block. ``NO_TEXT`` alone makes a page needs_ocr, any other code quarantined.
    """
    g = blocks.withColumn("__i", issue).groupBy(*by).agg(F.count("*").alias("n_blocks"), F.count("__i").alias("n_bad"), F.count_if(F.col("__i") == "NO_TEXT").alias("__no"))
    status = F.when(F.col("n_bad") > F.col("__no"), "quarantined").when(F.col("__no") == F.col("n_blocks"), "needs_ocr").otherwise("ok")
    return g.select(*by, "n_blocks", "n_bad", status.alias("status"))


def retry(done: DataFrame, again: DataFrame, keys: list[str], status: str, good: str = "ok") -> DataFrame:
    """Results with the failed ones replaced by their retry; good ones are kept as they are, and a failed one without a retry stays."""
    kept = done.where(F.col(status) == good)
    open_ = done.where((F.col(status) != good) | F.col(status).isNull())
    fresh = again.join(kept.select(*keys), keys, "left_anti").dropDuplicates(keys)
    return kept.unionByName(fresh.select(*done.columns)).unionByName(open_.join(fresh.select(*keys), keys, "left_anti").select(*done.columns))


def nested_strings(df: DataFrame, key: str, json: str, depth: int | None = None) -> DataFrame:
    """(key, pointer, value): all strings within JSON texts, with the pointer to each, down to ``depth`` levels, or to the last.

    Text that is no JSON gives none. Level by level: a node is taken apart once. Without ``depth`` each level is written
    out, until one holds nothing more to take apart.
    """
    spark = df.sparkSession
    level = df.select(key, F.lit("").alias("pointer"), F.try_parse_json(json).alias("v")).where("v is not null")
    out = None
    for n in count():
        kind = F.schema_of_variant("v")
        found = level.where(kind == "STRING").select(key, "pointer", F.try_variant_get("v", "$", "string").alias("value"))
        out = found if out is None else out.unionByName(found)
        if n == depth:
            return out
        inner = level.where(kind.startswith("ARRAY") | kind.startswith("OBJECT"))
        parts = inner.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).select(F.col("pos"), F.col("key").alias("__k"), F.col("value").alias("__v")))
        level = parts.select(key, F.concat("pointer", F.lit("/"), F.coalesce("__k", F.col("pos").cast("string"))).alias("pointer"), F.col("__v").alias("v"))
        if depth is None:
            seen = Observation()
            level = materialize(level.observe(seen, F.count("*").alias("n")), "level")
            if not seen.get["n"]:
                return out
