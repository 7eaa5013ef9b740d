"""Corpus, gap, dependency, bundle and text-form queries over the corpus tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnbeck.functions import text as tx
from tarnbeck.operators import attach, bundle, corpus, integrity, search
from tarnbeck.plans.retrieval import _CHUNKS, _NAMES, _compatible
from tarnbeck.session import table
from tarnbeck.sources.files import bundle_selection

# Everyday names and the names that lists use for them.
ALIASES = {
    "白萝卜": "萝卜", "土豆": "马铃薯", "西红柿": "番茄", "番薯": "甘薯", "红薯": "甘薯", "地瓜": "甘薯", "百香果": "西番莲",
    "酸奶": "发酵乳", "巴氏奶": "巴氏杀菌乳", "生牛乳": "生乳", "矿泉水": "饮用天然矿泉水", "纯净水": "饮用纯净水",
}


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    return corpus.compose({
        "accepted_body": t("chunk").where("retrieval_enabled").select(F.col("chunk_id").alias("record_id"), corpus.field("body", "retrieval_text").alias("fields")),
        "classification": t("taxonomy_node").select(F.col("id").alias("record_id"), corpus.field("name", "name").alias("fields")),
        "inspection_row": t("inspection_bridges").select(F.col("bridge_id").alias("record_id"), F.concat(corpus.field("project", "name"), corpus.field("table", "anchor")).alias("fields")),
        "catalog": t("documents").select(F.col("doc_id").alias("record_id"), F.concat(corpus.field("title", "title"), corpus.field("designation", "designation")).alias("fields")),
    })


def _touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps: assets that evidence names and that are missing or deleted touch the records of that evidence."""
    e = table(spark, sf_dir, "evidence").where("source_asset_id != '' and record_id != ''").select(F.col("source_asset_id").alias("gap_id"), F.lit("classification").alias("kind"), F.col("record_id").alias("id"))
    a = table(spark, sf_dir, "source_asset").where("asset_id is not null").groupBy(F.col("asset_id").alias("gap_id")).agg(F.bool_or(F.col("deleted_at").isNotNull()).alias("deleted"))
    named = e.select("gap_id").distinct().join(a, "gap_id", "left")
    gaps = named.where("deleted is null or deleted").select("gap_id", F.when(F.col("deleted").isNull(), "asset_missing").otherwise("asset_deleted").alias("gap_kind"))
    return attach.affected(gaps, e)


def corpus_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of each channel, their texts by field, and how many of them gaps touch."""
    r = corpus.with_gaps(_corpus(spark, sf_dir), "record_id", F.col("channel"), _touched(spark, sf_dir))
    rows = r.select("channel", "n_gaps", F.explode("fields").alias("f"))
    return rows.groupBy("channel", F.col("f.field").alias("field")).agg(F.count("*").alias("n_texts"), F.count_if(F.col("n_gaps") > 0).alias("n_with_gaps"), F.sum("n_gaps").alias("n_gaps"))


def hits_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names found in node names, with the gaps of the nodes they were found in."""
    names = table(spark, sf_dir, "taxonomy_node").where("id is not null").groupBy("id").agg(F.max("name").alias("text")).select(F.col("id").alias("record_id"), F.lit("name").alias("field"), F.lit(0).alias("ord"), "text")
    asked = table(spark, sf_dir, "canonical_food").select(F.col("entry_id").alias("phrase_id"), F.col("name").alias("phrase"))
    hits = search.phrase_hits(search.phrase_matches(names, asked, "literal_raw"))
    out = corpus.with_gaps(hits, "record_id", "classification", _touched(spark, sf_dir))
    return out.select("phrase_id", "record_id", "n_gaps", F.array_join("gap_kinds", ",").alias("gap_kinds"))


def dependency_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between records, assets, blocks, chunks and standards, counted by what depends on what."""
    t = lambda name: table(spark, sf_dir, name)
    edges = corpus.dependency_edges([
        ("classification", "asset", t("evidence").select("record_id", "source_asset_id")),
        ("classification", "classification", t("taxonomy_relation").select("child_id", "parent_id")),
        ("chunk", "block", t("chunk").select("chunk_id", F.explode("block_ids"))),
        ("block", "asset", t("content_block").select("block_id", "source.asset_id")),
        ("document", "standard", t("documents").select("doc_id", "designation")),
    ])
    return edges.groupBy("kind", "on_kind").agg(F.count("*").alias("n_edges"), F.count_distinct("edge_id").alias("n_ids"), F.count_distinct("on_id").alias("n_targets"))


def bundle_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with blocks and chunks: offending ids by code."""
    return integrity.violations(bundle.issues(table(spark, sf_dir, "content_block"), table(spark, sf_dir, "chunk"))).groupBy("code").agg(F.count("*").alias("n"))


def filter_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of standards asked for in other spellings than the stored ones."""
    wanted = {"designation": ["ｆｓ　１０００－２０１８", "fs1172—2016", "SQ 3017–2021"], "lang": [" ZH", "zh"]}
    return search.exact_search_forms(table(spark, sf_dir, "documents"), wanted).select("doc_id", "designation", "lang")


def unit_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many blocks of each kind hold formulas, comparisons or units to look at."""
    b = table(spark, sf_dir, "content_block").where("block_id is not null").groupBy("block_id").agg(F.max("kind").alias("kind"), F.max("text_raw").alias("t"))
    return b.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.size(tx.review_flags("t")) > 0).alias("n_flagged"))


def typed_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each typed food is looked up as."""
    q = table(spark, sf_dir, "queries").where("food is not null").select("food").distinct()
    return q.select("food", F.explode(tx.query_terms("food", ALIASES)).alias("term")).where("term != ''")


def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match form, search form and standard's number of every document's title and designation."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", tx.search_form("title").alias("title_form"), tx.match_form("title").alias("title_match"), tx.standard_form("designation").alias("standard"))


def excluded_foods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions whose food is no canonical name or alias, by month: what an exclusion list leaves."""
    c = table(spark, sf_dir, "canonical_food")
    known = c.select("name").unionByName(c.select(F.explode("aliases").alias("name"))).distinct()
    q = table(spark, sf_dir, "queries").where("food is not null").select("id", "food", F.date_format("created_at", "yyyy-MM").alias("month")).distinct()
    return q.join(known, q.food == known.name, "left_anti").groupBy("month").agg(F.count("*").alias("n"))


def content_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk of each content, the first by id, as a package would hold them."""
    return bundle_selection(table(spark, sf_dir, "chunk").where("chunk_id is not null").select("content_hash", "chunk_id", "kind"), "content_hash", ["chunk_id"])


QUERIES = {f.__name__: f for f in (corpus_records, hits_with_gaps, dependency_edges, bundle_issues, filter_spellings, unit_flags, typed_terms, text_forms, excluded_foods, content_bundle)}

_GAPS = """e as (select distinct source_asset_id a, record_id r from evidence where source_asset_id <> '' and record_id <> ''),
a as (select asset_id a, bool_or(deleted_at is not null) deleted from source_asset where asset_id is not null group by asset_id),
g as (select r, count(distinct e.a) n_gaps, string_agg(distinct case when deleted then 'asset_deleted' else 'asset_missing' end, ',' order by case when deleted then 'asset_deleted' else 'asset_missing' end) kinds
  from e left join a using (a) where deleted is null or deleted group by r)"""
_STANDARD = lambda c: f"""case when regexp_matches({c}, '(?i)^(GB(/T|T|/Z|Z)?|NY(/T|T)?|SN(/T|T)?|DB\\d*(/T|T)?|ISO|CAC|JJF|JJG|FS(/T|T)?|SQ(/T|T|/Z|Z)?)(\\d[\\d.]*(-\\d{{4}})?)$')
  then regexp_replace(upper(regexp_extract({c}, '(?i)^([A-Z]+\\d*(?:/[TZ])?)(\\d[\\d.]*(?:-\\d{{4}})?)$', 1)), '([A-Z0-9])([TZ])$', '\\1/\\2') || regexp_extract({c}, '(?i)^([A-Z]+\\d*(?:/[TZ])?)(\\d[\\d.]*(?:-\\d{{4}})?)$', 2) else {c} end"""  # noqa: E731

ORACLE = {
    "corpus_records": f"""with {_GAPS}, x as (
  select distinct 'accepted_body' channel, chunk_id id, 'body' field, max(retrieval_text) over (partition by chunk_id) t from chunk where retrieval_enabled and chunk_id is not null and trim(retrieval_text) <> ''
  union all select distinct 'classification', id, 'name', max(name) over (partition by id) from taxonomy_node where id is not null and trim(name) <> ''
  union all select distinct 'inspection_row', bridge_id, 'project', name from inspection_bridges where bridge_id is not null and trim(name) <> ''
  union all select distinct 'inspection_row', bridge_id, 'table', anchor from inspection_bridges where bridge_id is not null and trim(anchor) <> ''
  union all select 'catalog', doc_id::varchar, 'title', title from documents where trim(title) <> '' union all select 'catalog', doc_id::varchar, 'designation', designation from documents where trim(designation) <> '')
select channel, field, count(*) n_texts, count(n_gaps) n_with_gaps, coalesce(sum(n_gaps), 0)::bigint n_gaps from x left join g on channel = 'classification' and g.r = x.id group by channel, field""",
    "hits_with_gaps": f"""with {_GAPS}, {_NAMES} select entry_id phrase_id, n.id record_id, coalesce(n_gaps, 0) n_gaps, coalesce(kinds, '') gap_kinds
from names n join canonical_food c on contains(n.name, c.name) left join g on g.r = n.id""",
    "dependency_edges": """with x as (
  select distinct 'classification' kind, record_id id, 'asset' on_kind, source_asset_id o from evidence union select 'classification', child_id, 'classification', parent_id from taxonomy_relation
  union select 'chunk', chunk_id, 'block', unnest(block_ids) from chunk union select 'block', block_id, 'asset', source.asset_id from content_block union select 'document', doc_id::varchar, 'standard', designation from documents)
select kind, on_kind, count(*) n_edges, count(*) n_ids, count(distinct o) n_targets from x where id <> '' and o <> '' group by kind, on_kind""",
    "bundle_issues": """with recursive b as (select * from content_block where block_id <> ''), ids as (select distinct block_id from b), l as (select distinct block_id n, parent_id p from b where parent_id <> ''),
one as (select n, min(p) p from l group by n),
up as (select n, p, [n] seen, false ring from one union all select up.n, one.p, list_append(seen, up.p), list_contains(list_append(seen, up.p), one.p) from up join one on one.n = up.p where not ring and not list_contains(seen, up.p)),
uses as (select distinct chunk_id, parse_id, retrieval_enabled, unnest(block_ids) block_id from chunk where chunk_id is not null),
op as (select block_id, min(parse_id) bp from b group by block_id), met as (select * from uses left join op using (block_id)),
loc as (select block_id, source s, list_transform(source.line_ranges, lambda r: r[1]) lo, list_transform(source.line_ranges, lambda r: r[2]) hi from b),
x as (select 'BLOCK_ID_INVALID' code, block_id id from (select distinct * from content_block) group by block_id having block_id = '' or count(*) > 1
  union select 'CHUNK_ID_INVALID', chunk_id from (select distinct * from chunk) group by chunk_id having chunk_id = '' or count(*) > 1
  union select 'PARENT_MISSING', n from l where p not in (select block_id from ids) union select 'PARENT_CYCLE', n from up where list_contains(seen, p)
  union select 'LOCATION_INVALID', block_id from loc where not coalesce(s.line_start >= 1 and s.line_start <= s.line_end and len(lo) > 0 and len(s.pdf_pages) > 0 and list_min(lo) = s.line_start and list_max(hi) = s.line_end
    and list_min(lo) >= 1 and list_min(s.pdf_pages) >= 1 and len(list_distinct(s.pdf_pages)) = len(s.pdf_pages) and len(list_filter(s.line_ranges, lambda r: r[1] > r[2])) = 0, false)
  union select 'CHUNK_SOURCE_MISSING', chunk_id from chunk where block_ids is null or len(block_ids) = 0 union select 'CHUNK_SOURCE_MISSING', chunk_id from met where bp is null
  union select 'CROSS_PARSE', chunk_id from met where bp <> parse_id
  union select 'FOOTNOTE_MISSING', chunk_id from (select chunk_id, parse_id, unnest(regexp_extract_all(retrieval_text, '\\[\\^([^\\]]+)\\](?:[^:]|$)', 1)) l from chunk) q
    where not exists (select 1 from (select parse_id pi, unnest(regexp_extract_all(text_raw, '\\[\\^([^\\]]+)\\]\\s*:', 1)) m from content_block) w where w.pi = q.parse_id and w.m = q.l)
  union select 'FORMULA_UNBALANCED', chunk_id from chunk where (length(retrieval_text) - length(replace(retrieval_text, '$$', ''))) // 2 % 2 = 1
  union select 'FORMULA_VARIABLES_MISSING', chunk_id from chunk where regexp_matches(retrieval_text, '\\\\tag\\s*\\{[^}]+\\}') and not contains(retrieval_text, '式中') and parse_id not in (select parse_id from content_block where contains(text_raw, '式中') and parse_id is not null)
  union select 'COMPARISON_VALUE_MISSING', chunk_id from chunk where regexp_matches(retrieval_text, '(?m)(?:<=|>=|[≤≥≦≧<>＜＞])[ \\t|]*$')
  union select 'COVERAGE_MISSING', block_id from b where text_raw <> '' and block_id not in (select block_id from uses where retrieval_enabled and block_id is not null))
select code, count(*) n from x where id is not null group by code""",
    "filter_spellings": f"""with d as (select doc_id, designation, lang, {_compatible('designation')} f, {_compatible('lang')} l from documents)
select doc_id, designation, lang from d where upper(f) in ('FS1000-2018', 'FS1172-2016', 'SQ3017-2021') and l in ('zh', 'ZH')""",
    "unit_flags": """with b as (select block_id, max(kind) kind, max(text_raw) t from content_block where block_id is not null group by block_id)
select kind, count(*) n, count(*) filter (regexp_matches(t, '[<>=≤≥±×÷∑√^²³₀-₉]|(?:^|[^\\p{L}\\p{N}_])(?:mg|kg|g|mL|L|mmol|CFU)\\s*[/·]|\\p{Nd}\\s*%')) n_flagged from b group by kind""",
    "typed_terms": f"""with q as (select distinct food from queries where food is not null), f as (select food, lower(regexp_replace({_compatible('food').replace(f"'{tx.DASHES}', '{'-' * len(tx.DASHES)}'", "'', ''")}, '\\s', '', 'g')) t from q),
s as (select food, t from f union select food, case when length(regexp_replace(t, '^(?:新鲜|生鲜|鲜食|冷冻|冰鲜|鲜|生)', '')) >= 2 then regexp_replace(t, '^(?:新鲜|生鲜|鲜食|冷冻|冰鲜|鲜|生)', '') else t end from f),
a as (select unnest([{', '.join(f"'{k}'" for k in ALIASES)}]) k, unnest([{', '.join(f"'{v}'" for v in ALIASES.values())}]) v)
select food, t term from s where t <> '' union select food, v from s join a on a.k = s.t""",
    "text_forms": f"""with d as (select doc_id, {_compatible('title')} t, lower(regexp_replace({_compatible('title').replace(f"'{tx.DASHES}', '{'-' * len(tx.DASHES)}'", "'', ''")}, '\\s', '', 'g')) m, {_compatible('designation')} g from documents)
select doc_id, t title_form, m title_match, {_STANDARD('g')} standard from d""",
    "excluded_foods": """with k as (select name from canonical_food union select unnest(aliases) from canonical_food)
select strftime(created_at, '%Y-%m') as month, count(*) n from (select distinct id, food, created_at from queries where food is not null and food not in (select name from k where name is not null)) group by 1""",
    "content_bundle": "select content_hash, min(chunk_id) chunk_id, arg_min(kind, chunk_id) kind from chunk where chunk_id is not null and content_hash <> '' group by content_hash",
}
