"""What is wrong with parsed blocks and the chunks made of them: one frame of offending ids for each code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnbeck.functions.scalars import row_hash
from tarnbeck.operators.hierarchy import cycles


def repeated_ids(df: DataFrame, key: str) -> DataFrame:
    """Ids that rows of different content share; whole copies are one row."""
    versions = df.groupBy(key).agg(F.count_distinct(row_hash(*(F.col(c) for c in df.columns))).alias("n"))
    return versions.where(F.col(key).isNull() | (F.col(key) == "") | (F.col("n") > 1)).select(F.coalesce(key, F.lit("")).alias("id"))


def bad_location(source: str) -> Column:
    """Whether a location lacks lines, ranges or pages, or they contradict each other."""
    s = lambda c: F.col(f"{source}.{c}")
    ranges, pages = s("line_ranges"), s("pdf_pages")
    good = s("line_start").between(1, s("line_end")) & (F.size(ranges) > 0) & (F.size(pages) > 0)
    good &= F.forall(ranges, lambda r: (F.size(r) == 2) & (F.get(r, 0) >= 1) & (F.get(r, 0) <= F.get(r, 1)))
    good &= (F.array_min(F.transform(ranges, lambda r: F.get(r, 0))) == s("line_start")) & (F.array_max(F.transform(ranges, lambda r: F.get(r, 1))) == s("line_end"))
    good &= F.forall(pages, lambda p: p >= 1) & (F.size(F.array_distinct(pages)) == F.size(pages))
    return ~F.coalesce(good, F.lit(False))


def issues(blocks: DataFrame, chunks: DataFrame) -> dict[str, DataFrame]:
    """The frames by code, for :func:`tarnbeck.operators.integrity.violations`.

    blocks: block_id, parse_id, parent_id, text_raw, source. chunks: chunk_id, parse_id, block_ids, retrieval_text,
    retrieval_enabled. Blocks and chunks meet by block id; a parse's texts are only asked whether any holds a mark, so none is collected.
    """
    ids = blocks.where("block_id != ''").select("block_id").distinct()
    links = blocks.where("block_id != '' and parent_id != ''").select("block_id", "parent_id").distinct()
    uses = chunks.where("chunk_id is not null").select("chunk_id", "parse_id", "retrieval_enabled", F.explode("block_ids").alias("block_id")).distinct()
    of = blocks.where("block_id != ''").groupBy("block_id").agg(F.min("parse_id").alias("block_parse"))
    met = uses.join(of, "block_id", "left")
    text = chunks.where("retrieval_text is not null").select("chunk_id", "parse_id", F.col("retrieval_text").alias("t"))
    explained = blocks.where("contains(text_raw, '式中')").select("parse_id").distinct()
    noted = F.regexp_extract_all("text_raw", F.lit(r"\[\^([^\]]+)\]\s*:"), F.lit(1))
    notes = blocks.select("parse_id", F.explode(noted).alias("label")).distinct()
    asked = text.select("chunk_id", "parse_id", F.explode(F.array_distinct(F.regexp_extract_all("t", F.lit(r"\[\^([^\]]+)\](?!\s*:)"), F.lit(1)))).alias("label"))
    usable = uses.where("retrieval_enabled").select("block_id").distinct()
    return {
        "BLOCK_ID_INVALID": repeated_ids(blocks, "block_id"),
        "CHUNK_ID_INVALID": repeated_ids(chunks, "chunk_id"),
        "PARENT_MISSING": links.join(ids.withColumnRenamed("block_id", "parent_id"), "parent_id", "left_anti").select("block_id"),
        "PARENT_CYCLE": cycles(links, "block_id", "parent_id").select("node_id"),
        "LOCATION_INVALID": blocks.where("block_id != ''").where(bad_location("source")).select("block_id"),
        "CHUNK_SOURCE_MISSING": chunks.where("block_ids is null or size(block_ids) = 0").select("chunk_id").unionByName(met.where("block_parse is null").select("chunk_id")),
        "CROSS_PARSE": met.where("block_parse != parse_id").select("chunk_id"),
        "FOOTNOTE_MISSING": asked.join(notes, ["parse_id", "label"], "left_anti").select("chunk_id"),
        "FORMULA_UNBALANCED": text.where("(length(t) - length(replace(t, '$$', ''))) / 2 % 2 = 1").select("chunk_id"),
        "FORMULA_VARIABLES_MISSING": text.where(F.col("t").rlike(r"\\tag\s*\{[^}]+\}") & ~F.contains("t", F.lit("式中"))).join(explained, "parse_id", "left_anti").select("chunk_id"),
        "COMPARISON_VALUE_MISSING": text.where(F.col("t").rlike(r"(?m)(?:<=|>=|[≤≥≦≧<>＜＞])[ \t|]*$")).select("chunk_id"),
        "COVERAGE_MISSING": blocks.where("block_id != '' and text_raw != ''").select("block_id").distinct().join(usable, "block_id", "left_anti"),
    }
