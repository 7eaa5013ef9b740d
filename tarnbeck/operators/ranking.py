"""Top rows of groups, scored candidates, decisions from scores, prefix and substring matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, out: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group. Spark cuts each task to its own ``k`` before the shuffle; ``order`` must end in a unique key."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)


def name_scores(names: DataFrame, terms: DataFrame, exact: int = 100, suffix: int = 83, inside: int = 76) -> DataFrame:
    """(term, name_id, score): names equal to, ending in or containing each term.

    names: name_id, name. terms: term. Substring matches go through the characters' pairs
    of the names, not through all pairs of rows: a term meets the names that hold
    its first two characters, then the whole term is tested.
    """
    pair = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2))))
    held = names.where("name is not null and name != ''").select("name_id", "name", F.explode(pair(F.col("name"))).alias("__pair"))
    asked = terms.where("length(term) >= 2").select("term").distinct().withColumn("__pair", F.substring("term", 1, 2))
    found = held.join(asked, "__pair").where(F.contains("name", "term"))
    score = F.when(F.col("name") == F.col("term"), exact).when(F.endswith("name", "term"), suffix).otherwise(inside)
    return found.groupBy("term", "name_id").agg(F.max(score).alias("score"))


def decide(scores: DataFrame, by: str, strong: int = 90) -> DataFrame:
    """(by, status, choice, n_candidates): one clear candidate is chosen, several need details, none is not covered.

    The choice is the best candidate if it alone reaches ``strong``, or if it is the only one; otherwise null.
    """
    best = scores.groupBy(by).agg(F.count("*").alias("n_candidates"), F.count_if(F.col("score") >= strong).alias("n_strong"), F.max_by("name_id", F.struct("score", "name_id")).alias("top"))
    one = (F.col("n_strong") == 1) | (F.col("n_candidates") == 1)
    return best.select(by, F.when(one, "name_match").otherwise("needs_details").alias("status"), F.when(one, F.col("top")).alias("choice"), "n_candidates")


def prefix_descendants(paths: DataFrame, resolved: str) -> DataFrame:
    """(path, n_resolved): for each path that is not resolved, the resolved ones below it.

    paths: path (array), and a boolean. Every proper prefix of a resolved path is a row of its own, so prefixes meet by equality.
    """
    below = paths.where(F.col(resolved)).select("path").distinct().select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("path") - 1, F.lit(1))), lambda n: F.slice("path", F.lit(1), n))).alias("prefix"), "path").where(F.size("prefix") < F.size("path"))
    counts = below.groupBy("prefix").agg(F.count("*").alias("n_resolved"))
    open_paths = paths.where(~F.col(resolved)).select("path").distinct()
    return open_paths.join(counts, open_paths.path == counts.prefix, "left").select("path", F.coalesce("n_resolved", F.lit(0)).alias("n_resolved"))
