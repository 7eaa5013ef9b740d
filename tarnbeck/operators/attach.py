"""Attaching one table's rows to another's: gaps, ordered lists, supersession, exclusions, facts with their sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnbeck.functions.states import APPLICABLE, CONFLICTING, NOT_APPLICABLE, UNKNOWN, all_of, invert


def affected(gaps: DataFrame, links: DataFrame) -> DataFrame:
    """(kind, id, n_gaps, gap_kinds): what each gap touches, by the typed links of gaps.

    gaps: gap_id, gap_kind. links: gap_id, kind, id. A thing's kinds of gaps are few, so the set is small.
    """
    j = links.where("kind is not null and id is not null").join(gaps, "gap_id").distinct()
    return j.groupBy("kind", "id").agg(F.count_distinct("gap_id").alias("n_gaps"), F.array_sort(F.collect_set("gap_kind")).alias("gap_kinds"))


def ordered_rows(df: DataFrame, by: list[str], order: list[str], out: str = "position") -> DataFrame:
    """``df`` with the position of each row in its group, from 1; a group of any size, sorted with spill."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def ordered_list(df: DataFrame, by: list[str], order: list[str], value: str, out: str, limit: int | None = None, bucket: Column | None = None) -> DataFrame:
    """(by, out, n): values of each group in order, of groups of any size; :func:`ordered_rows` has them in long form.

    ``bucket`` is any expression that never falls along the order: then a group's rows are sorted
    bucket by bucket in different tasks, and only the values meet in the one row that holds them.
    With ``limit``, groups beyond that many rows have a null list (and their count).
    """
    size, kept = df.groupBy(*by).agg(F.count("*").alias("n")), df
    if limit is not None:
        kept = df.join(size.where(f"n <= {limit}").select(*by), by, "left_semi")
    parts = kept.withColumn("__b", F.lit(0) if bucket is None else bucket).groupBy(*by, "__b").agg(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("__v")))).alias("__l"), F.count("*").alias("n"))
    parts = parts.select(*by, F.struct("__b", F.transform("__l", lambda x: x["__v"]).alias("__l")).alias("__p"), "n")
    lists = parts.groupBy(*by).agg(F.array_sort(F.collect_list("__p")).alias("__p"), F.sum("n").alias("n"))
    lists = lists.select(*by, F.flatten(F.transform("__p", lambda x: x["__l"])).alias(out), "n")
    return lists if limit is None else size.join(lists.drop("n"), by, "left").select(*by, out, "n")


def unsuperseded(df: DataFrame, key: str, previous: str) -> DataFrame:
    """Rows that no other row names as its previous one."""
    named = df.where(F.col(previous).isNotNull()).select(F.col(previous).alias(key)).distinct()
    return df.join(named, key, "left_anti")


def exclusion_states(exclusions: DataFrame, names: DataFrame) -> DataFrame:
    """(owner, exclusion_id, state): whether an exclusion holds for its owner.

    exclusions: owner, exclusion_id, state (of its predicate), names (array), explicit (only names decide). names: owner, name, verified. A verified name
    among those excluded makes it applicable; with known names, an explicit list without a hit is not applicable; else the predicate's state.
    """
    known = names.where("verified and name is not null").groupBy("owner").agg(F.collect_set("name").alias("__known"))
    j = exclusions.join(known, "owner", "left")
    hit = F.arrays_overlap("names", F.coalesce("__known", F.array().cast("array<string>")))
    state = F.when(F.col("state") == CONFLICTING, CONFLICTING).when(hit, APPLICABLE).when(F.col("explicit") & F.col("__known").isNotNull(), NOT_APPLICABLE).otherwise(F.coalesce("state", F.lit(UNKNOWN)))
    return j.select("owner", "exclusion_id", state.alias("state"))


def applicability(conditions: DataFrame, exclusions: DataFrame) -> DataFrame:
    """(owner, state): all of the conditions, and none of the exclusions. Both: owner, state."""
    parts = conditions.select("owner", "state").unionByName(exclusions.select("owner", invert("state").alias("state")))
    return parts.groupBy("owner").agg(all_of("state").alias("state"))


def facts_with_sources(facts: DataFrame, blocks: DataFrame, **wanted: str) -> DataFrame:
    """Facts that match exactly, each with its source block and a status.

    facts: fact_id, block_id, quote and any columns named in ``wanted`` (compared after white space is removed; an empty value is an error). blocks: block_id, text. status: ok, BLOCK_MISSING, or QUOTE_MISMATCH where the block does not hold the quote.
    """
    out = facts
    for column, value in wanted.items():
        if not value or not value.strip():
            raise ValueError(f"{column}: an empty filter")
        out = out.where(F.regexp_replace(column, r"(?U)\s+", "") == "".join(value.split()))
    j = out.join(blocks.select("block_id", "text").dropDuplicates(["block_id"]), "block_id", "left")
    status = F.when(F.col("text").isNull(), "BLOCK_MISSING").when(F.contains("text", "quote"), "ok").otherwise("QUOTE_MISMATCH")
    return j.withColumn("status", status).drop("text")
