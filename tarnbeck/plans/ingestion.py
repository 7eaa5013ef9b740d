"""Queries of attaching, ingestion statuses and nested values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnbeck.operators import attach, ingest
from tarnbeck.session import table


def gap_attachment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence without quote or page, attached to its record and to its asset."""
    e = table(spark, sf_dir, "evidence").where("evidence_id is not null and (quote is null or pdf_page is null)")
    gaps = e.select(F.col("evidence_id").alias("gap_id"), F.when(F.col("quote").isNull(), "missing_quote").otherwise("missing_page").alias("gap_kind")).distinct()
    links = e.select(F.col("evidence_id").alias("gap_id"), F.lit("record").alias("kind"), F.col("record_id").alias("id")).unionByName(e.select(F.col("evidence_id").alias("gap_id"), F.lit("asset").alias("kind"), F.col("source_asset_id").alias("id")))
    out = attach.affected(gaps, links.where("id != ''"))
    return out.select("kind", "id", "n_gaps", F.array_join("gap_kinds", ",").alias("gap_kinds"))


def ordered_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequence of each question's review actions."""
    r = table(spark, sf_dir, "reviews").where("query_id != '' and id is not null").select("id", "query_id", "created_at", "action").distinct()
    out = attach.ordered_list(r, ["query_id"], ["created_at", "id"], "action", "actions", bucket=F.date_trunc("month", "created_at"))
    return out.select("query_id", F.array_join("actions", ">").alias("actions"), "n")


def leaf_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links whose child is no other link's parent."""
    r = table(spark, sf_dir, "taxonomy_relation").where("child_id != ''").select("child_id", F.expr("nullif(parent_id, '')").alias("parent_id")).distinct()
    return attach.unsuperseded(r, "child_id", "parent_id").select("child_id").distinct()


def arrival_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each question's rows by month of arrival, by the first rule that holds."""
    q = table(spark, sf_dir, "queries").distinct()
    rules = [
        (F.col("id").isNull(), "failed"),
        (F.col("deleted_at").isNotNull(), "quarantined"),
        (F.col("food").isNull() | (F.col("food") == ""), "source_missing"),
        (F.get_json_object("result", "$.status") != F.col("status"), "identity_conflict"),
        (F.col("status").isNull(), "unrecognized"),
        (F.col("ingested_at") > F.col("created_at") + F.expr("interval 7 days"), "duplicate"),
    ]
    rows = ingest.with_outcome(q, rules).withColumn("month", F.date_format("ingested_at", "yyyy-MM"))
    return ingest.job_status(rows, ["month"])


def page_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of each parse by the state of their blocks' text."""
    b = table(spark, sf_dir, "content_block").where("block_id is not null").select("block_id", "parse_id", "text_raw", "title", F.explode("source.pdf_pages").alias("page")).distinct()
    issue = F.when(F.col("text_raw").isNull() | (F.col("text_raw") == ""), "NO_TEXT").when(F.length("text_raw") > 5000, "OVERSIZED")
    out = ingest.page_status(b, ["parse_id", "page"], issue)
    return out.select("parse_id", F.col("page").cast("long").alias("page"), "n_blocks", "n_bad", "status")


def retried_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page statuses after the isolated pages were tried again."""
    first = page_statuses(spark, sf_dir)
    again = first.where("status = 'quarantined' and page % 2 = 0").withColumn("status", F.lit("ok")).withColumn("n_bad", F.lit(0).cast("long"))
    out = ingest.retry(first, again, ["parse_id", "page"], "status")
    return out.groupBy("status").agg(F.count("*").alias("n"), F.sum("n_bad").alias("n_bad"))


def result_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings within the questions' JSON results, by pointer."""
    q = table(spark, sf_dir, "queries").where("id is not null and result is not null").select("id", "result").distinct()
    return ingest.nested_strings(q, "id", "result", 2).groupBy("pointer", "value").agg(F.count("*").alias("n"))


def quoted_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of one kind whose text is checked against their block's text."""
    c = table(spark, sf_dir, "chunk").where("chunk_id is not null").dropDuplicates(["chunk_id"])
    facts = c.select(F.col("chunk_id").alias("fact_id"), F.col("block_ids")[0].alias("block_id"), F.substring_index("retrieval_text", "\n", -1).alias("quote"), "kind")
    blocks = table(spark, sf_dir, "content_block").where("block_id is not null").select("block_id", F.col("text_raw").alias("text"))
    out = attach.facts_with_sources(facts, blocks, kind="table_row")
    return out.groupBy("status").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (gap_attachment, ordered_reviews, leaf_nodes, arrival_outcomes, page_statuses, retried_pages, result_strings, quoted_evidence)}

_PAGES = """
with b as (select distinct block_id, parse_id, text_raw, title, unnest(source.pdf_pages) page from content_block where block_id is not null),
i as (select *, case when text_raw is null or text_raw = '' then 'NO_TEXT' when length(text_raw) > 5000 then 'OVERSIZED' end iss from b),
p as (select parse_id, page::bigint page, count(*) n_blocks, count(iss) n_bad, case when count(iss) > count(*) filter (iss = 'NO_TEXT') then 'quarantined' when count(*) filter (iss = 'NO_TEXT') = count(*) then 'needs_ocr' else 'ok' end status from i group by all)
"""
ORACLE = {
    "gap_attachment": """
with e as (select distinct evidence_id g, case when quote is null then 'missing_quote' else 'missing_page' end k, record_id, source_asset_id from evidence where evidence_id is not null and (quote is null or pdf_page is null)),
l as (select 'record' kind, record_id id, g, k from e where record_id <> '' union all select 'asset', source_asset_id, g, k from e where source_asset_id <> '')
select kind, id, count(distinct g) n_gaps, string_agg(distinct k, ',' order by k) gap_kinds from l group by kind, id""",
    "ordered_reviews": "select query_id, string_agg(action, '>' order by created_at, id) actions, count(*) n from (select distinct id, query_id, created_at, action from reviews where query_id <> '' and id is not null) group by query_id",
    "leaf_nodes": "select distinct child_id from taxonomy_relation where child_id <> '' and child_id not in (select parent_id from taxonomy_relation where parent_id <> '' and child_id <> '')",
    "arrival_outcomes": """
with q as (select distinct * from queries),
o as (select strftime(ingested_at, '%Y-%m') as month, case when id is null then 'failed' when deleted_at is not null then 'quarantined' when food is null or food = '' then 'source_missing'
  when json_extract_string(result, '$.status') <> status then 'identity_conflict' when status is null then 'unrecognized' when ingested_at > created_at + interval 7 day then 'duplicate' else 'success' end x from q)
select month, count(*) filter (x = 'success') n_success, count(*) filter (x = 'duplicate') n_duplicate, count(*) filter (x = 'quarantined') n_quarantined, count(*) filter (x = 'source_missing') n_source_missing,
  count(*) filter (x = 'identity_conflict') n_identity_conflict, count(*) filter (x = 'unrecognized') n_unrecognized, count(*) filter (x = 'failed') n_failed,
  case when count(*) filter (x not in ('success', 'duplicate')) = 0 then 'completed' else 'completed_with_problems' end status from o group by month""",
    "page_statuses": _PAGES + " select * from p",
    "retried_pages": _PAGES + ", r as (select case when status = 'quarantined' and page % 2 = 0 then 'ok' else status end status, case when status = 'quarantined' and page % 2 = 0 then 0 else n_bad end n_bad from p) select status, count(*) n, sum(n_bad)::bigint n_bad from r group by status",
    "result_strings": """select '/status' as pointer, json_extract_string(result, '$.status') as value, count(*) n from (select distinct id, result from queries where id is not null and result is not null) where json_type(result, '$.status') = 'VARCHAR' group by 2""",
    "quoted_evidence": """
with c as (select chunk_id, any_value(block_ids)[1] block_id, string_split(any_value(retrieval_text), chr(10))[-1] q, any_value(kind) kind from chunk where chunk_id is not null group by chunk_id),
b as (select block_id, any_value(text_raw) t from content_block where block_id is not null group by block_id)
select case when t is null then 'BLOCK_MISSING' when contains(t, q) then 'ok' else 'QUOTE_MISMATCH' end status, count(*) n from c left join b using (block_id) where kind = 'table_row' group by 1""",
}
