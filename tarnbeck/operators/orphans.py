"""References to records that do not exist, were deleted, or came only later.

Parent keys and references are put into one long form and grouped by parent table
and key with partial aggregation, so a key with a third of all references costs
one row from each task. Groups that lack a parent row, or whose parent was deleted
or is later than the earliest reference, are the suspects; only they meet the
referring rows again, salted so that one hot key is spread over several tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tasks that a hot suspect key is spread over at least; the engine's adaptive skew join splits those that are still too large.
SALTS = 16
STATES = ("missing", "deleted", "late")


@dataclass(frozen=True)
class Parent:
    """A referred-to table: rows, key, and the columns that tell when it came and when it was deleted."""

    name: str
    rows: DataFrame
    key: str
    created: str = "created_at"
    deleted: str | None = "deleted_at"


@dataclass(frozen=True)
class Reference:
    """A referring field: rows, id of the referring row, the field, and the table it names."""

    table: str
    field: str
    rows: DataFrame
    row_id: str
    parent: str
    created: str = "created_at"
    expr: str | None = None


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _references(refs: list[Reference]) -> DataFrame:
    return _union(
        [
            r.rows.select(
                F.lit(r.parent).alias("parent_table"),
                F.expr(r.expr or r.field).cast("string").alias("key"),
                F.lit(r.table).alias("ref_table"),
                F.lit(r.field).alias("ref_field"),
                F.col(r.row_id).cast("string").alias("ref_id"),
                F.col(r.created).alias("ref_created"),
            ).where("key is not null and key != '' and ref_id is not null and ref_id != ''")
            for r in refs
        ]
    )


def _parents(parents: list[Parent]) -> DataFrame:
    return _union(
        [
            p.rows.select(
                F.lit(p.name).alias("parent_table"),
                F.col(p.key).cast("string").alias("key"),
                F.col(p.created).alias("parent_created"),
                (F.col(p.deleted).isNotNull() if p.deleted else F.lit(False)).alias("gone"),
            ).where("key is not null and key != ''")
            for p in parents
        ]
    )


def key_states(parents: list[Parent], refs: list[Reference]) -> DataFrame:
    """(parent_table, key, is_there, gone, parent_created, first_ref, n_refs): one row for each key."""
    up = _parents(parents).select("parent_table", "key", F.lit(True).alias("parent"), "gone", "parent_created", F.lit(None).cast("timestamp_ntz").alias("ref_created"), F.lit(0).alias("one"))
    down = _references(refs).select("parent_table", "key", F.lit(False).alias("parent"), F.lit(False).alias("gone"), F.lit(None).cast("timestamp_ntz").alias("parent_created"), "ref_created", F.lit(1).alias("one"))
    return (
        up.unionByName(down)
        .groupBy("parent_table", "key")
        .agg(F.max("parent").alias("is_there"), F.max("gone").alias("gone"), F.min("parent_created").alias("parent_created"), F.min("ref_created").alias("first_ref"), F.sum("one").alias("n_refs"))
    )


def broken_references(parents: list[Parent], refs: list[Reference]) -> DataFrame:
    """(ref_table, ref_field, ref_id, reason, ref_created, key): every broken reference, once.

    reason is ``missing`` when no parent row has the key, else ``deleted`` when a row
    of it was deleted, whenever, else ``late`` when its earliest row is later than the
    referring row. Null and empty keys and row ids are no case; repeated rows count
    once (with the latest date if the copies differ); a reference or parent without a
    date is never late. Empty tables give no rows, or only missing ones.
    """
    suspects = key_states(parents, refs).where("n_refs > 0 and (not is_there or gone or (parent_created > first_ref))").select("parent_table", "key", "is_there", "gone", "parent_created")
    spread = suspects.withColumn("salt", F.explode(F.array(*(F.lit(i) for i in range(SALTS)))))
    rows = _references(refs).withColumn("salt", F.pmod(F.xxhash64("ref_id"), F.lit(SALTS)).cast("int"))
    met = rows.join(spread, ["parent_table", "key", "salt"])
    reason = F.when(~F.col("is_there"), "missing").when(F.col("gone"), "deleted").when(F.col("parent_created") > F.col("ref_created"), "late")
    found = met.withColumn("reason", reason).where("reason is not null")
    return found.groupBy("ref_table", "ref_field", "ref_id", "key").agg(F.min("reason").alias("reason"), F.max("ref_created").alias("ref_created")).select("ref_table", "ref_field", "ref_id", "reason", "ref_created", "key")


def broken_counts(parents: list[Parent], refs: list[Reference]) -> DataFrame:
    """(ref_table, ref_field, period, reason, n_references): broken references for each month of the referring row.

    The counts are those of the groups by parent table and key, by field and month, so a key holds no more
    than one count for each field and month, and no reference is looked at again. Only where a parent came within the very month
    of some references are those of that key and month compared one by one. A repeated row counts once, in the month of its latest date.
    """
    near = ["parent_table", "key", "ref_table", "ref_field", "period"]
    one = _references(refs).groupBy("parent_table", "key", "ref_table", "ref_field", "ref_id").agg(F.min("ref_created").alias("at"), F.date_format(F.max("ref_created"), "yyyy-MM").alias("period"))
    months = one.groupBy(*near).agg(F.count("*").alias("n"), F.min("at").alias("first"), F.max("at").alias("last"))
    count = F.struct("ref_table", "ref_field", "period", "n", "first", "last")
    down = months.select("parent_table", "key", F.lit(False).alias("parent"), F.lit(False).alias("gone"), F.lit(None).cast("timestamp_ntz").alias("parent_created"), count.alias("count"))
    up = _parents(parents).select("parent_table", "key", F.lit(True).alias("parent"), "gone", "parent_created").withColumn("count", F.lit(None).cast(down.schema["count"].dataType))
    keys = up.unionByName(down).groupBy("parent_table", "key").agg(F.max("parent").alias("is_there"), F.max("gone").alias("gone"), F.min("parent_created").alias("parent_created"), F.collect_list("count").alias("counts"))
    reason = F.when(~F.col("is_there"), "missing").when(F.col("gone"), "deleted").when(F.col("parent_created") > F.col("first"), F.when(F.col("parent_created") > F.col("last"), "late").otherwise("some late"))
    found = keys.select("parent_table", "key", "is_there", "gone", "parent_created", F.inline("counts")).withColumn("reason", reason).where("reason is not null")
    within = one.join(found.where("reason = 'some late'").select(*near, "parent_created"), near).where("at < parent_created")
    counts = found.where("reason != 'some late'").select("ref_table", "ref_field", "period", "reason", "n")
    counts = counts.unionByName(within.select("ref_table", "ref_field", "period", F.lit("late").alias("reason"), F.lit(1).cast("long").alias("n")))
    return counts.groupBy("ref_table", "ref_field", "period", "reason").agg(F.sum("n").alias("n_references"))
