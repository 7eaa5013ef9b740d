"""Versions of documents over business dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnbeck.functions.scalars import empty_window, within
from tarnbeck.functions.states import APPLICABLE, CONFLICTING, NOT_APPLICABLE, UNKNOWN, any_of


def windows_from_dates(versions: DataFrame, family: str, start: str, version: str) -> DataFrame:
    """Policies where each version holds from its date up to, not including, the next date of its family.

    Versions with the same date hold together: they share the window.
    """
    dated = versions.where(F.col(family).isNotNull() & F.col(start).isNotNull()).select(F.col(family).alias("family"), F.col(version).alias("version_id"), F.col(start).alias("lower"))
    nexts = dated.select("family", "lower").distinct().withColumn("upper", F.lead("lower").over(Window.partitionBy("family").orderBy("lower")))
    return dated.join(nexts, ["family", "lower"]).select("family", "version_id", "lower", F.lit(True).alias("lower_inclusive"), "upper", F.lit(False).alias("upper_inclusive"))


def policy_states(dates: DataFrame, policies: DataFrame) -> DataFrame:
    """(case_id, family, version_id, state): each policy of the case's family against its business date.

    dates: case_id, family, business_date. policies: family, version_id, lower, lower_inclusive,
    upper, upper_inclusive. An empty window or an unknown date or flag is unknown. An equi
    join on the family; the interval is tested in the join, so only the family's own
    windows meet.
    """
    p = policies.select("family", "version_id", "lower", "lower_inclusive", "upper", "upper_inclusive")
    inside = within(F.col("business_date"), F.col("lower"), F.col("lower_inclusive"), F.col("upper"), F.col("upper_inclusive"))
    void = empty_window(F.col("lower"), F.col("lower_inclusive"), F.col("upper"), F.col("upper_inclusive"))
    state = F.when(void | inside.isNull(), UNKNOWN).when(inside, APPLICABLE).otherwise(NOT_APPLICABLE)
    return dates.select("case_id", "family", "business_date").join(p, "family").select("case_id", "family", "version_id", state.alias("state"))


def resolve(states: DataFrame, dates: DataFrame) -> DataFrame:
    """(case_id, state, version_id, n_applicable): the one version that holds, if there is exactly one.

    Several policies of a version combine by any. A conflicting version, or two
    applicable ones, conflict; an unknown one, or no version at all, leaves it unknown.
    """
    version = states.groupBy("case_id", "version_id").agg(any_of("state").alias("state"))
    seen = version.groupBy("case_id").agg(
        F.bool_or(F.col("state") == CONFLICTING).alias("clash"),
        F.count_if(F.col("state") == APPLICABLE).alias("n_applicable"),
        F.count_if(F.col("state") == UNKNOWN).alias("n_unknown"),
        F.min(F.when(F.col("state") == APPLICABLE, F.col("version_id"))).alias("winner"),
    )
    out = dates.select("case_id").distinct().join(seen, "case_id", "left")
    n = F.coalesce("n_applicable", F.lit(0))
    state = F.when(F.col("clash") | (n > 1), CONFLICTING).when(F.col("n_applicable").isNull() | (F.col("n_unknown") > 0), UNKNOWN).when(n == 1, APPLICABLE).otherwise(NOT_APPLICABLE)
    return out.select("case_id", state.alias("state"), F.when(state == APPLICABLE, F.col("winner")).alias("version_id"), F.col("n_applicable"))


def fold_dates(facts: DataFrame, keys: list[str], value: str, verified: str) -> DataFrame:
    """(keys, state, value): one date for each key: different ones conflict, an unverified one leaves it unknown."""
    out = facts.groupBy(*keys).agg(F.count_distinct(value).alias("n"), F.min(value).alias("v"), F.bool_and(F.coalesce(F.col(verified), F.lit(False)) & F.col(value).isNotNull()).alias("sure"))
    state = F.when(F.col("n") > 1, CONFLICTING).when(F.col("sure"), APPLICABLE).otherwise(UNKNOWN)
    return out.select(*keys, state.alias("state"), F.when(state == APPLICABLE, F.col("v")).alias("value"))


def bind_references(references: DataFrame, versions: DataFrame) -> DataFrame:
    """(reference_id, binding, version_id, n_targets): dated references bind to the same number, undated ones to the family.

    references: reference_id, designation, family, dated (boolean). versions: version_id,
    designation, family. binding is bound, ambiguous or unbound; version_id only where it is one.
    """
    dated = references.where("dated").join(versions.select("designation", "version_id"), "designation", "left").select("reference_id", "version_id")
    undated = references.where("not dated").join(versions.select("family", "version_id"), "family", "left").select("reference_id", "version_id")
    found = dated.unionByName(undated).groupBy("reference_id").agg(F.count_distinct("version_id").alias("n_targets"), F.min("version_id").alias("one"))
    binding = F.when(F.col("n_targets") == 1, "bound").when(F.col("n_targets") > 1, "ambiguous").otherwise("unbound")
    return found.select("reference_id", binding.alias("binding"), F.when(F.col("n_targets") == 1, F.col("one")).alias("version_id"), "n_targets")

