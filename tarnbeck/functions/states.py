"""Four-state logic: applicable, not_applicable, unknown, conflicting.

Unknown is never false and never zero. A conflict dominates; then, for *all*, a
false one, then an unknown one; for *any*, a true one, then an unknown one. Without
members *all* is applicable and *any* is not. Each operator comes for an array of
states and as an aggregate over rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

APPLICABLE, NOT_APPLICABLE, UNKNOWN, CONFLICTING = STATES = ("applicable", "not_applicable", "unknown", "conflicting")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def combine_all(states: Column | str) -> Column:
    s = _col(states)
    return F.when(F.array_contains(s, CONFLICTING), CONFLICTING).when(F.array_contains(s, NOT_APPLICABLE), NOT_APPLICABLE).when(F.array_contains(s, UNKNOWN), UNKNOWN).otherwise(APPLICABLE)


def combine_any(states: Column | str) -> Column:
    s = _col(states)
    return F.when(F.array_contains(s, CONFLICTING), CONFLICTING).when(F.array_contains(s, APPLICABLE), APPLICABLE).when(F.array_contains(s, UNKNOWN), UNKNOWN).otherwise(NOT_APPLICABLE)


def _seen(state: Column, value: str) -> Column:
    return F.coalesce(F.bool_or(state == value), F.lit(False))


def all_of(state: Column | str) -> Column:
    """Aggregate form of :func:`combine_all`; partial, so a hot group is combined map-side."""
    s = _col(state)
    return F.when(_seen(s, CONFLICTING), CONFLICTING).when(_seen(s, NOT_APPLICABLE), NOT_APPLICABLE).when(_seen(s, UNKNOWN), UNKNOWN).otherwise(APPLICABLE)


def any_of(state: Column | str) -> Column:
    s = _col(state)
    return F.when(_seen(s, CONFLICTING), CONFLICTING).when(_seen(s, APPLICABLE), APPLICABLE).when(_seen(s, UNKNOWN), UNKNOWN).otherwise(NOT_APPLICABLE)


def invert(state: Column | str) -> Column:
    s = _col(state)
    return F.when(s == APPLICABLE, NOT_APPLICABLE).when(s == NOT_APPLICABLE, APPLICABLE).otherwise(s)


def excludes(states: Column | str) -> Column:
    """Whether checks rule a record out: some not applicable, none conflicting."""
    s = _col(states)
    return F.array_contains(s, NOT_APPLICABLE) & ~F.array_contains(s, CONFLICTING)
