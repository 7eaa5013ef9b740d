"""A search corpus put together from typed sources, the gaps that touch its records, and the edges of what depends on what."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnbeck.functions.scalars import named_id


def field(name: str, *texts: Column | str) -> Column:
    """Array of struct<field, ord, text>: the texts of a field that are neither null nor blank, in order."""
    parts = F.array(*(F.col(t) if isinstance(t, str) else t for t in texts))
    full = F.filter(parts, lambda t: t.isNotNull() & (F.trim(t) != ""))
    return F.transform(full, lambda t, i: F.struct(F.lit(name).alias("field"), i.alias("ord"), t.alias("text")))


def compose(parts: dict[str, DataFrame]) -> DataFrame:
    """(record_id, channel, fields): the records of all sources, tagged with the channel they come from.

    Each part: record_id, fields (arrays of :func:`field`, concatenated). A record that a source repeats counts
    once; null ids and records without any text are left out.
    """
    tagged = [p.select(F.col("record_id").cast("string").alias("record_id"), F.lit(name).alias("channel"), "fields") for name, p in sorted(parts.items())]
    rows = reduce(DataFrame.unionByName, tagged).where("record_id is not null and size(fields) > 0")
    return rows.groupBy("channel", "record_id").agg(F.max("fields").alias("fields")).select("record_id", "channel", "fields")


def long_texts(corpus: DataFrame) -> DataFrame:
    """(record_id, field, ord, text): a corpus as the searches take it."""
    return corpus.select("record_id", F.inline("fields")).select("record_id", "field", "ord", "text")


def with_gaps(rows: DataFrame, key: str, kind: str | Column, touched: DataFrame) -> DataFrame:
    """``rows`` (records or hits) with n_gaps and gap_kinds; 0 and an empty array where no gap touches them.

    touched: kind, id, n_gaps, gap_kinds, as :func:`tarnbeck.operators.attach.affected` makes them.
    """
    tagged = rows.withColumn("__kind", F.lit(kind) if isinstance(kind, str) else kind)
    met = tagged.join(touched.select(F.col("kind").alias("__kind"), F.col("id").alias(key), "n_gaps", "gap_kinds"), ["__kind", key], "left").drop("__kind")
    return met.withColumn("n_gaps", F.coalesce("n_gaps", F.lit(0))).withColumn("gap_kinds", F.coalesce("gap_kinds", F.array().cast("array<string>")))


def dependency_edges(parts: list[tuple[str, str, DataFrame]]) -> DataFrame:
    """(edge_id, kind, id, on_kind, on_id): what depends on what, of typed sources, each edge once.

    parts: kind, kind depended on, and a frame of (id, on_id). Null and empty ends are no edges. The id is made of
    the edge's content, so the same edge has the same id in every run.
    """
    tagged = [df.select(F.lit(kind).alias("kind"), F.col(df.columns[0]).cast("string").alias("id"), F.lit(on).alias("on_kind"), F.col(df.columns[1]).cast("string").alias("on_id")) for kind, on, df in parts]
    rows = reduce(DataFrame.unionByName, tagged).where("id != '' and on_id != ''").distinct()
    return rows.select(named_id("dependency", "kind", "id", "on_kind", "on_id").alias("edge_id"), "*")
