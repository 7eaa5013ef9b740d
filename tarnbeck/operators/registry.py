"""Registering rows: idempotent inserts, first-wins identity, event logs, outcome counts, bindings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnbeck.functions.scalars import row_hash


def compare_incoming(existing: DataFrame, incoming: DataFrame, keys: list[str], content: list[str]) -> DataFrame:
    """``incoming`` keys once each, with outcome: new, duplicate (same content) or conflict.

    A key that comes several times with different content, or differs from what is
    there, is a conflict; nothing is overwritten. Null keys are left out.
    """
    def hashed(df: DataFrame, name: str) -> DataFrame:
        valid = df.dropna(subset=keys)
        h = row_hash(*content)
        return valid.groupBy(*keys).agg(F.min(h).alias(f"{name}_lo"), F.max(h).alias(f"{name}_hi"))

    both = hashed(incoming, "new").join(hashed(existing, "old"), keys, "left")
    outcome = F.when(F.col("new_lo") != F.col("new_hi"), "conflict").when(F.col("old_lo").isNull(), "new").when((F.col("old_lo") == F.col("new_lo")) & (F.col("old_hi") == F.col("new_lo")), "duplicate").otherwise("conflict")
    return both.select(*keys, outcome.alias("outcome"))


def insert_absent(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``incoming`` whose key is not there yet, one for each key: what an append has to write."""
    return incoming.dropna(subset=keys).dropDuplicates(keys).join(existing.select(*keys).distinct(), keys, "left_anti")


def first_wins(df: DataFrame, key: str, order: list[str], claims: list[str]) -> DataFrame:
    """``df`` with ``conflict``: whether a claim differs from that of the key's first row; missing values never conflict."""
    first = df.groupBy(key).agg(F.min_by(F.struct(*claims), F.struct(*order)).alias("__first"))
    differs = F.lit(False)
    for c in claims:
        a, b = F.col(c), F.col(f"__first.{c}")
        differs = differs | F.coalesce((a != b) & (a.cast("string") != "") & (b.cast("string") != ""), F.lit(False))
    return df.join(first, key).withColumn("conflict", differs).drop("__first")


def latest(events: DataFrame, key: str, order: list[str], value: str, out: str = "state") -> DataFrame:
    """(key, out): the value of each key's last event. Partial aggregation: a hot key sends one row from each task."""
    return events.where(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(out))


def with_previous(events: DataFrame, key: str, order: list[str], value: str, bucket: Column | None = None, out: str = "previous") -> DataFrame:
    """``events`` with the value of the row before in its key's order; null for the first.

    ``bucket`` is any expression that never falls along the order (the month of a
    timestamp): then a key's rows are sorted bucket by bucket in different tasks,
    and only the last row of each bucket meets the next, so a hot key is no single task's work.
    """
    if bucket is None:
        return events.withColumn(out, F.lag(value).over(Window.partitionBy(key).orderBy(*order)))
    b = events.withColumn("__b", bucket)
    within = Window.partitionBy(key, "__b").orderBy(*order)
    inner = b.withColumn("__n", F.row_number().over(within)).withColumn(out, F.lag(value).over(within))
    ends = b.groupBy(key, "__b").agg(F.max_by(F.col(value), F.struct(*order)).alias("__last"))
    carried = ends.withColumn("__before", F.lag("__last").over(Window.partitionBy(key).orderBy("__b"))).select(key, "__b", "__before")
    joined = inner.join(carried, (inner[key].eqNullSafe(carried[key])) & (inner["__b"].eqNullSafe(carried["__b"])), "left").drop(carried[key]).drop(carried["__b"])
    return joined.withColumn(out, F.when(F.col("__n") == 1, F.col("__before")).otherwise(F.col(out))).drop("__b", "__n", "__before")


def transitions(events: DataFrame, key: str, order: list[str], value: str, bucket: Column | None = None) -> DataFrame:
    """(from_value, to_value, n): how often one event follows another of the same key; events without a value are none. ``bucket`` as in :func:`with_previous`."""
    pairs = with_previous(events.where(F.col(value).isNotNull()), key, order, value, bucket, "from_value").where("from_value is not null")
    return pairs.groupBy("from_value", F.col(value).alias("to_value")).agg(F.count("*").alias("n"))


def outcome_counts(df: DataFrame, by: list[Column | str], column: str, values: list[str]) -> DataFrame:
    """Counts of each value as columns n_value, and of all others and of nulls."""
    counts = [F.count_if(F.col(column) == v).alias(f"n_{v}") for v in values]
    return df.groupBy(*by).agg(*counts, F.count_if(~F.col(column).isin(values)).alias("n_other"), F.count_if(F.col(column).isNull()).alias("n_null"))


def bind_in_tiers(left: DataFrame, key: str, tiers: list[DataFrame]) -> DataFrame:
    """(key, target, tier): targets by the first tier that has any; only unique ones bind, else target is null.

    Each tier is a frame (key, target). Keys without a target in any tier have tier null.
    """
    found = None
    for i, t in enumerate(tiers):
        part = t.select(key, "target", F.lit(i + 1).alias("tier")).where("target is not null")
        found = part if found is None else found.unionByName(part)
    best = found.groupBy(key, "tier").agg(F.count_distinct("target").alias("n"), F.min("target").alias("target")).groupBy(key).agg(F.min_by(F.struct("tier", "n", "target"), "tier").alias("b"))
    return left.select(key).distinct().join(best, key, "left").select(key, F.when(F.col("b.n") == 1, F.col("b.target")).alias("target"), F.col("b.tier").alias("tier"))


def revision_errors(revisions: DataFrame, key: str, previous: str) -> DataFrame:
    """(code, id): revisions that branch (two follow the same one) or follow one that is not there."""
    branch = revisions.where(F.col(previous).isNotNull()).groupBy(previous).agg(F.count_distinct(key).alias("n")).where("n > 1").select(F.lit("BRANCHED").alias("code"), F.col(previous).alias("id"))
    known = revisions.select(F.col(key).alias(previous)).distinct()
    lost = revisions.where(F.col(previous).isNotNull()).join(known, previous, "left_anti").select(F.lit("PREVIOUS_MISSING").alias("code"), F.col(key).alias("id")).distinct()
    return branch.unionByName(lost)
