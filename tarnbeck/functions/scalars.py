"""Dates, numbers, hashes and intervals: values that are unknown stay null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def iso_date(c: Column | str) -> Column:
    """Strictly YYYY-MM-DD; anything else is null."""
    c = _c(c)
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c.try_cast("date"))


def decimal(c: Column | str) -> Column:
    """An exact decimal held as text; invalid and non-finite text is null."""
    c = _c(c)
    return F.when(c.rlike(r"^[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?$"), c.try_cast("decimal(38,18)"))


def ratio(a: Column | str, b: Column | str) -> Column:
    """Null where the denominator is zero or unknown."""
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double"))


def within(value: Column, lower: Column, lower_inclusive: Column, upper: Column, upper_inclusive: Column) -> Column:
    """Membership in an interval whose bounds say whether they belong; a null bound is open, a null flag makes it unknown (null)."""
    low = F.when(lower.isNull(), True).when(lower_inclusive.isNull(), F.lit(None)).when(value > lower, True).when(value == lower, lower_inclusive).otherwise(False)
    high = F.when(upper.isNull(), True).when(upper_inclusive.isNull(), F.lit(None)).when(value < upper, True).when(value == upper, upper_inclusive).otherwise(False)
    return F.when(value.isNull(), F.lit(None)).otherwise(low.cast("boolean") & high.cast("boolean"))


def empty_window(lower: Column, lower_inclusive: Column, upper: Column, upper_inclusive: Column) -> Column:
    """Whether two known bounds leave nothing between them."""
    return F.coalesce((lower > upper) | (lower == upper) & ~(lower_inclusive & upper_inclusive), F.lit(False))


def row_hash(*columns: Column | str) -> Column:
    """Content hash of a row: SHA-256 of its canonical JSON (keys as given, nulls kept)."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def named_id(namespace: str, *parts: Column | str) -> Column:
    """A deterministic id, shaped like a UUID, from a namespace and its parts."""
    h = F.sha2(F.concat_ws("\x1f", F.lit(namespace), *(F.coalesce(_c(p).cast("string"), F.lit("\x00")) for p in parts)), 256)
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def media_of(content: Column | str) -> Column:
    """Media type by the first bytes of a file."""
    head = F.hex(F.substring(_c(content), 1, 8))
    return F.when(head.startswith("255044462D"), "application/pdf").when(head.startswith("504B0304"), "application/zip").when(head.startswith("D0CF11E0A1B11AE1"), "application/msword").when(head.startswith("89504E47"), "image/png").when(head.startswith("FFD8FF"), "image/jpeg")
