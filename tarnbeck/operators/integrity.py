"""Manifests, hash checks, snapshot differences, coverage and violation reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnbeck.functions.scalars import row_hash

#: Members of one manifest cell; a set's hash is the hash over its cells' hashes.
CELLS = 1024


def set_hash(df: DataFrame, by: list[str], member: Column, hot_cells: int = CELLS) -> DataFrame:
    """(by, n_members, manifest): a hash of each group's set of members, whatever their order.

    Members are hashed, spread over cells by hash, each cell hashed over its sorted
    members, and the cells (at most ``hot_cells`` of a group) over each other: a group
    with a third of all rows is never in one task.
    """
    h = df.select(*by, F.sha2(member.cast("string"), 256).alias("__h")).where("__h is not null").distinct()
    cell = F.conv(F.substring("__h", 1, 8), 16, 10).cast("long") % hot_cells
    cells = h.groupBy(*by, cell.alias("__cell")).agg(F.count("*").alias("__n"), F.sha2(F.array_join(F.array_sort(F.collect_list("__h")), ""), 256).alias("__c"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__cell", "__c"))), lambda x: x["__c"]), "")
    return cells.groupBy(*by).agg(F.sum("__n").alias("n_members"), F.sha2(joined, 256).alias("manifest"))


def verify_manifest(manifest: DataFrame, actual: DataFrame, key: str, check: str) -> DataFrame:
    """(key, status): verified, mismatch, missing (named but not there) or unlisted (there but not named)."""
    a, b = manifest.select(key, F.col(check).alias("__want")), actual.select(key, F.col(check).alias("__is"))
    both = a.join(b, key, "full_outer")
    status = F.when(F.col("__is").isNull(), "missing").when(F.col("__want").isNull(), "unlisted").when(F.col("__want") == F.col("__is"), "verified").otherwise("mismatch")
    return both.select(key, status.alias("status"))


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str], content: list[str]) -> DataFrame:
    """(keys, change): added, removed or changed by content hash; keys without a change have no row.

    Each key is expected once in a snapshot; if it comes with several contents, the set of them counts.
    """
    def signed(df: DataFrame, name: str) -> DataFrame:
        # Order-free signature of the key's contents, combined map-side: nothing is collected.
        one = df.dropna(subset=keys).select(*keys, row_hash(*content).alias("__h")).distinct()
        parts = [F.count("*").alias("n"), *(F.bit_xor(F.conv(F.substring("__h", at, 15), 16, 10).cast("long")).alias(f"x{at}") for at in (1, 16, 31, 46))]
        return one.groupBy(*keys).agg(*parts).select(*keys, F.concat_ws("-", "n", "x1", "x16", "x31", "x46").alias(name))

    both = signed(old, "__old").join(signed(new, "__new"), keys, "full_outer")
    change = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").when(F.col("__old") != F.col("__new"), "changed")
    return both.select(*keys, change.alias("change")).where("change is not null")


def coverage(items: DataFrame, key: str, uses: DataFrame, enabled: str) -> DataFrame:
    """(key, status, n_uses): retrievable, context_only or uncovered for each item.

    uses: key and a boolean ``enabled``, any number of rows for a key.
    """
    used = uses.groupBy(key).agg(F.count("*").alias("n_uses"), F.bool_or(F.coalesce(F.col(enabled), F.lit(False))).alias("__on"))
    out = items.select(key).where(F.col(key).isNotNull()).distinct().join(used, key, "left")
    return out.select(key, F.when(F.col("n_uses").isNull(), "uncovered").when(F.col("__on"), "retrievable").otherwise("context_only").alias("status"), "n_uses")


def violations(rules: dict[str, DataFrame]) -> DataFrame:
    """(code, id): the union of violation queries, each giving ids in its first column."""
    parts = [df.select(F.lit(code).alias("code"), F.col(df.columns[0]).cast("string").alias("id")) for code, df in rules.items()]
    return reduce(DataFrame.unionByName, parts).distinct()


def file_check(assets: DataFrame) -> DataFrame:
    """``assets`` (asset_id, storage_key, media_type) with status: malformed_id, misplaced, or ok by the content-addressed layout."""
    want = F.concat(F.lit("objects/"), F.substring("asset_id", 1, 2), F.lit("/"), F.col("asset_id"))
    status = F.when(~F.coalesce(F.col("asset_id").rlike("^[0-9a-f]{64}$"), F.lit(False)), "malformed_id").when(F.coalesce(F.col("storage_key") != want, F.lit(True)), "misplaced").otherwise("ok")
    return assets.withColumn("status", status)
