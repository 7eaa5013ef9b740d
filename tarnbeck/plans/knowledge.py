"""Condition, taxonomy, version, registry, integrity and document queries over the corpus tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnbeck.functions import text as tx
from tarnbeck.functions.scalars import ratio
from tarnbeck.functions.states import any_of
from tarnbeck.operators import conditions, documents, graph, integrity, ranking, registry, taxonomy, versions
from tarnbeck.operators.hierarchy import hierarchy
from tarnbeck.plans.knowledge_sql import ORACLE  # noqa: F401
from tarnbeck.session import table


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each node; copies differ in nothing but may be incomplete."""
    return table(spark, sf_dir, "taxonomy_node").where("id is not null").dropDuplicates(["id"])


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "content_block").where("block_id is not null").dropDuplicates(["block_id"])


# -- facts and conditions -------------------------------------------------------------------
def _node_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts about nodes: packaging and process words of the name, one row from each."""
    n = _nodes(spark, sf_dir).where("name is not null")
    fact = lambda field, pattern, value, sure: F.when(F.col("name").rlike(pattern), F.struct(F.lit(field).alias("field"), F.lit(value).alias("value"), F.lit(sure).alias("verification_state")))
    facts = F.array_compact(F.array(
        fact("packaging", "罐头", "罐装", "verified"), fact("packaging", "饮料|汁", "瓶装", "verified"),
        fact("process", "熟制", "熟制", "verified"), fact("process", "速冻", "速冻", "verified"), fact("process", "生干", "生鲜", "unverified"),
        fact("food_part", "莲藕|萝卜", "根", "verified"), fact("food_part", "辣椒|番茄", "果", "conflicting"),
    ))
    rows = n.select("id", F.explode(facts).alias("f")).select("id", "f.*")
    return rows.select("id", "field", F.lit("string").alias("type"), "value", "verification_state", F.lit("sample_fact").alias("role"), F.lit("name").alias("source_ref"))


def fact_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = conditions.fold_facts(_node_facts(spark, sf_dir), ["id"], ["sample_fact", "document_fact"])
    return out.select("id", "field", "state", "value")


def _conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = conditions.fact_map(conditions.fold_facts(_node_facts(spark, sf_dir), ["id"]), ["id"])
    n = _nodes(spark, sf_dir).select("id", "condition").join(facts, "id", "left")
    n = n.withColumn("facts", F.coalesce("facts", F.create_map().cast(f"map<string,{conditions.FACT}>")))
    return conditions.evaluate_wrapped(n, "condition", "facts").select("id", "state")


def condition_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conditions(spark, sf_dir)


_TREE = {"op": "all", "args": [
    {"op": "range", "field": "l_quantity", "lower": "10", "upper": "24", "lower_inclusive": True, "upper_inclusive": False},
    {"op": "any", "args": [{"op": "in", "field": "l_returnflag", "value": ["A", "R"]}, {"op": "not", "arg": {"op": "gt", "field": "l_discount", "value": "0.05", "value_type": "number"}}]},
]}


def condition_compiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A literal tree over typed facts: range with flags, membership, negation."""
    li = table(spark, sf_dir, "lineitem")
    known = lambda c, kind: F.struct(F.when(F.col(c).isNull(), "unknown").otherwise("known").alias("state"), F.lit(kind).alias("type"), F.col(c).cast("string").alias("value"))
    facts = F.create_map(F.lit("l_quantity"), known("l_quantity", "number"), F.lit("l_returnflag"), known("l_returnflag", "string"), F.lit("l_discount"), known("l_discount", "number"))
    return li.withColumn("state", conditions.compile_condition(_TREE, facts)).groupBy("state", "l_returnflag").agg(F.count("*").alias("n"))


# -- taxonomy ----------------------------------------------------------------------------------
_TREES: dict[tuple[str, str], DataFrame] = {}


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree of the relation table: contracted once by a program for each folder of tables, read by all that need it."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _TREES:
        _TREES[key] = hierarchy(table(spark, sf_dir, "taxonomy_relation"))
    return _TREES[key]


def inherited_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review states along each path: approved counts as applicable, extracted as unknown."""
    s = _nodes(spark, sf_dir).select(F.col("id").alias("node"), F.when(F.col("review_state") == "approved", "applicable").when(F.col("review_state") == "machine_checked", "applicable").when(F.col("review_state") == "review_pending", "not_applicable").otherwise("unknown").alias("state"))
    return taxonomy.inherited_states(_tree(spark, sf_dir), s)


def inherited_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions with a structured tree, inherited from all ancestors."""
    r = _nodes(spark, sf_dir).where("condition.state = 'structured'").select(F.col("id").alias("node"), F.col("condition.ast_json").alias("requirement_id"))
    out = taxonomy.inherited_requirements(_tree(spark, sf_dir), r)
    return out.groupBy("node").agg(F.count("*").alias("n_requirements"), F.count_distinct("requirement_id").alias("n_kinds"), F.min("distance").cast("long").alias("nearest"))


def nearest_approved(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = _nodes(spark, sf_dir).where("review_state = 'approved' and kind = 'category'").select("id")
    return taxonomy.nearest_ancestor(_tree(spark, sf_dir), marked)


def shared_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families that every section of a chapter links to, by the canonical names among its bridges' targets."""
    b = table(spark, sf_dir, "inspection_bridges").dropDuplicates(["bridge_id"]).select(F.substring_index("section_id", "-", 1).alias("chapter"), "section_id", F.explode("targets").alias("name"))
    m = b.join(table(spark, sf_dir, "canonical_food").select("name", "family"), "name")
    return taxonomy.shared_members(m, "chapter", "section_id", "family")


def prefix_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clause paths that hold no table, with the number of table paths below them."""
    b = _blocks(spark, sf_dir).where(F.col("structural_key").rlike(r"^\d+(\.\d+)*$"))
    paths = b.groupBy(F.split("structural_key", r"\.").alias("path")).agg(F.bool_or(F.col("kind") == "table").alias("resolved"))
    return ranking.prefix_descendants(paths, "resolved").select(F.array_join("path", ".").alias("path"), "n_resolved")


# -- graphs ------------------------------------------------------------------------------------
def impact_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and their descendants that deleted assets reach: asset, evidence's record, child nodes."""
    e = table(spark, sf_dir, "evidence").where("source_asset_id != '' and record_id != ''").select(F.col("source_asset_id").alias("src"), F.col("record_id").alias("dst"))
    r = table(spark, sf_dir, "taxonomy_relation").where("parent_id != '' and child_id != ''").select(F.col("parent_id").alias("src"), F.col("child_id").alias("dst"))
    seeds = table(spark, sf_dir, "source_asset").where("deleted_at is not null").select("asset_id")
    out = graph.closure(e.unionByName(r), seeds)
    return out.groupBy("depth").agg(F.count("*").alias("n_nodes")).select(F.col("depth").cast("long").alias("depth"), "n_nodes")


def category_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expansion of every category."""
    return _expansion(spark, sf_dir, _nodes(spark, sf_dir).where("kind = 'category'").select("id"))


def _expansion(spark: SparkSession, sf_dir: str, starts: DataFrame) -> DataFrame:
    """Expansion of each start, three levels deep; the rest is counted by its reason."""
    r = table(spark, sf_dir, "taxonomy_relation").where("parent_id != '' and child_id != ''")
    edges = r.groupBy(F.col("parent_id").alias("src"), F.col("child_id").alias("dst")).agg(F.min("id").alias("edge_id"), any_of(F.when(F.col("has_evidence"), "applicable").otherwise("unknown")).alias("verdict"))
    reached, left = graph.expand(edges, starts, max_depth=3, max_nodes=1_000_000)
    a = reached.groupBy("start").agg(F.count("*").alias("n_reached"), F.max("depth").cast("long").alias("depth"))
    b = left.groupBy("start").agg(F.count_if(F.col("reason") == "DEPTH_BUDGET").alias("n_too_deep"), F.count_if(F.col("reason") == "UNKNOWN").alias("n_unknown"))
    return a.join(b, "start", "left").select("start", "n_reached", "depth", F.coalesce("n_too_deep", F.lit(0)).alias("n_too_deep"), F.coalesce("n_unknown", F.lit(0)).alias("n_unknown"))


def broken_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "taxonomy_relation").where("parent_id != '' and child_id != ''").select(F.col("id").alias("edge_id"), F.col("child_id").alias("src"), F.col("parent_id").alias("dst")).distinct()
    out = graph.broken_edges(edges, _nodes(spark, sf_dir).select("id"))
    return out.groupBy("code").agg(F.count_distinct("edge_id").alias("n"))


# -- versions ----------------------------------------------------------------------------------
def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("designation is not null and published_at is not null")
    return d.groupBy("designation").agg(F.min("published_at").alias("published_at")).withColumn("family", F.regexp_replace(tx.family_of("designation"), r"\.\d+$", ""))


def version_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version of each document's family in force 200 days after the document appeared."""
    policies = versions.windows_from_dates(_versions(spark, sf_dir), "family", "published_at", "designation")
    d = table(spark, sf_dir, "documents").where("designation is not null and published_at is not null")
    dates = d.select(F.col("doc_id").alias("case_id"), F.regexp_replace(tx.family_of("designation"), r"\.\d+$", "").alias("family"), (F.col("published_at") + F.expr("interval 200 days")).alias("business_date"))
    return versions.resolve(versions.policy_states(dates, policies), dates)


def version_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest two versions of each family by date, then by number."""
    best = ranking.top_k(_versions(spark, sf_dir), ["family"], [F.desc("published_at"), F.col("designation")], 2)
    return best.select("family", "designation", F.col("rank").cast("long").alias("rank"))


def bound_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standards cited in blocks against the documents' designations."""
    cited = _blocks(spark, sf_dir).select(F.explode(tx.standards_in("text_raw")).alias("designation")).distinct()
    refs = cited.select(F.col("designation").alias("reference_id"), "designation", tx.family_of("designation").alias("family"), F.col("designation").rlike(r"[-—–]\d{4}$").alias("dated"))
    have = table(spark, sf_dir, "documents").where("designation is not null").select("designation").distinct().withColumn("family", tx.family_of("designation")).withColumn("version_id", F.col("designation"))
    return versions.bind_references(refs, have)


def folded_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One date for each designation, if its documents agree on the day."""
    d = table(spark, sf_dir, "documents").where("designation is not null").select("designation", F.col("published_at").cast("date").alias("day"), (F.col("source") != "review_note").alias("verified"))
    out = versions.fold_dates(d, ["designation"], "day", "verified")
    return out.select("designation", "state", F.col("value").cast("string").alias("value"))


# -- registry ----------------------------------------------------------------------------------
_CUT = "timestamp_ntz '2025-01-01 00:00:00'"


def incoming_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that arrived from 2025 on against those there before: new, duplicate or conflict."""
    q = table(spark, sf_dir, "queries")
    out = registry.compare_incoming(q.where(f"ingested_at < {_CUT}"), q.where(f"ingested_at >= {_CUT}"), ["id"], ["food", "status", "owner"])
    return out.groupBy("outcome").agg(F.count("*").alias("n"))


def absent_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asset ids that evidence names and the registry lacks: what an insert-if-absent would write."""
    named = table(spark, sf_dir, "evidence").where("source_asset_id != ''").select(F.col("source_asset_id").alias("asset_id"))
    return registry.insert_absent(table(spark, sf_dir, "source_asset"), named, ["asset_id"])


def first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose title or language differs from that of the first document with their designation."""
    d = table(spark, sf_dir, "documents").where("designation is not null").select("doc_id", "designation", "title", "lang")
    out = registry.first_wins(d, "designation", ["doc_id"], ["title", "lang"])
    return out.where("conflict").select("doc_id", "designation")


def latest_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.latest(table(spark, sf_dir, "reviews"), "query_id", ["created_at", "id"], "action", "action")


def review_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "reviews").where("query_id != ''").select("id", "query_id", "created_at", "action").distinct()
    return registry.transitions(r, "query_id", ["created_at", "id"], "action", F.date_trunc("month", F.col("created_at").cast("timestamp")))


def monthly_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "queries").select("id", "status", F.date_format("created_at", "yyyy-MM").alias("month")).distinct()
    return registry.outcome_counts(q, ["month"], "status", ["matched", "no_match", "ambiguous", "needs_fact"])


def tiered_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bridge names bound to canonical entries: by name, else by alias, else by a target; unique ones only."""
    b = table(spark, sf_dir, "inspection_bridges").where("bridge_id is not null").dropDuplicates(["bridge_id"])
    c = table(spark, sf_dir, "canonical_food")
    other = c.select("entry_id", F.explode("aliases").alias("other_name"))
    tiers = [
        b.join(c, b.name == c.name).select("bridge_id", F.col("entry_id").alias("target")),
        b.join(other, b.name == other.other_name).select("bridge_id", F.col("entry_id").alias("target")),
        b.select("bridge_id", F.explode("targets").alias("t")).join(c, F.col("t") == c.name).select("bridge_id", F.col("entry_id").alias("target")),
    ]
    out = registry.bind_in_tiers(b, "bridge_id", tiers)
    return out.select("bridge_id", "target", F.col("tier").cast("long").alias("tier"))


# -- integrity ---------------------------------------------------------------------------------
def asset_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of distinct assets, and the hash of the set, for each media type."""
    a = table(spark, sf_dir, "source_asset").where("asset_id is not null")
    return integrity.set_hash(a, ["media_type"], F.col("asset_id"))


def file_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = integrity.file_check(table(spark, sf_dir, "source_asset"))
    return out.groupBy("media_type", "status").agg(F.count_distinct("asset_id").alias("n"))


def manifest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content hashes that chunks name against the hashes of their copies with the largest id of each block."""
    c = table(spark, sf_dir, "chunk").where("chunk_id is not null")
    named = c.select(F.col("block_ids")[0].alias("block_id"), F.sha2("retrieval_text", 256).alias("h")).groupBy("block_id").agg(F.min("h").alias("h"))
    actual = table(spark, sf_dir, "content_block").where("block_id is not null").select("block_id", F.sha2("text_raw", 256).alias("h")).groupBy("block_id").agg(F.min("h").alias("h"))
    out = integrity.verify_manifest(named, actual, "block_id", "h")
    return out.groupBy("status").agg(F.count("*").alias("n"))


def snapshot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews known at the end of 2024 against those of the last two years: added, removed, changed."""
    r = table(spark, sf_dir, "reviews")
    old = r.where(f"ingested_at < {_CUT}").select("query_id", "action")
    new = r.where("ingested_at >= timestamp_ntz '2024-01-01 00:00:00'").select("query_id", "action")
    out = integrity.snapshot_diff(old.where("query_id != ''"), new.where("query_id != ''"), ["query_id"], ["action"])
    return out.groupBy("change").agg(F.count("*").alias("n"))


def block_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    uses = table(spark, sf_dir, "chunk").dropDuplicates(["chunk_id"]).select(F.explode("block_ids").alias("block_id"), "retrieval_enabled")
    out = integrity.coverage(table(spark, sf_dir, "content_block"), "block_id", uses, "retrieval_enabled")
    return out.groupBy("status").agg(F.count("*").alias("n"), F.sum("n_uses").alias("n_uses"))


def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, e = table(spark, sf_dir, "chunk"), table(spark, sf_dir, "taxonomy_node"), table(spark, sf_dir, "evidence")
    b = table(spark, sf_dir, "content_block").select("block_id").distinct()
    used = c.select("chunk_id", F.explode("block_ids").alias("block_id"))
    out = integrity.violations({
        "CHUNK_TEXT_MISSING": c.where("retrieval_text is null or retrieval_text = ''").select("chunk_id"),
        "CHUNK_BLOCK_MISSING": used.join(b, "block_id", "left_anti").select("chunk_id"),
        "TOKEN_COUNT_UNKNOWN": c.where("token_count is null").select("chunk_id"),
        "NODE_NAME_MISSING": n.where("name is null or name = ''").select("id"),
        "CONDITION_UNEVIDENCED": n.where("condition.state = 'structured' and not condition.has_evidence").select("id"),
        "QUOTE_MISSING": e.where("quote is null or quote = ''").select("evidence_id"),
    })
    return out.groupBy("code").agg(F.count("*").alias("n"))


# -- documents ---------------------------------------------------------------------------------
def line_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each parse that its blocks cover, as ranges."""
    r = _blocks(spark, sf_dir).select("parse_id", F.explode("source.line_ranges").alias("r")).select("parse_id", F.col("r")[0].cast("long").alias("a"), F.col("r")[1].cast("long").alias("b"))
    return documents.merge_ranges(r, ["parse_id"], "a", "b")


def page_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive pages with evidence of each asset, as ranges."""
    e = table(spark, sf_dir, "evidence").where("source_asset_id != ''")
    return documents.line_ranges(e, ["source_asset_id"], "pdf_page")


def titles_filled_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _blocks(spark, sf_dir).withColumn("line_start", F.col("source.line_start"))
    out = taxonomy.fill_down(b, "title", ["parse_id"], ["line_start", "block_id"], "title_filled")
    return out.select("block_id", "title_filled")


def text_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of each block's text by its numbered lines."""
    lines = documents.text_lines(_blocks(spark, sf_dir), "block_id", "text_raw")
    out = documents.sections(lines, "block_id")
    return out.select("block_id", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), F.col("n_chars").cast("long").alias("n_chars"), F.col("heading").isNotNull().alias("has_heading"))


def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = documents.text_lines(_blocks(spark, sf_dir).where("contains(text_raw, '|')"), "block_id", "text_raw")
    out = documents.markdown_tables(lines, "block_id")
    return out.select("block_id", *(F.col(c).cast("long").alias(c) for c in ("table_no", "row_index", "column")), "value", "is_header", "missing")


def _limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = documents.text_lines(_blocks(spark, sf_dir).where("contains(text_raw, '|')"), "block_id", "text_raw")
    return documents.requirement_rows(documents.markdown_tables(lines, "block_id"), "block_id")


def requirement_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _limits(spark, sf_dir)
    return out.select("block_id", F.col("row_index").cast("long").alias("row_index"), "project", "unit", "comparator", "value", "method")


def limit_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.limit_conflicts(_limits(spark, sf_dir).where("project is not null and unit is not null"), ["block_id", "project"])


def greedy_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of each parse that fit 40 blocks and 3,000 characters."""
    b = _blocks(spark, sf_dir).where("parse_id is not null").select("parse_id", "block_id", F.struct(F.col("source.line_start"), F.col("block_id")).alias("o"), F.coalesce(F.length("text_raw"), F.lit(0)).alias("n"))
    out = documents.context(b, "parse_id", "block_id", "o", "n", 40, 3000)
    return out.select("parse_id", "block_id", "kept")


def standards_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often, and in how many parses, each standard is cited, with its family."""
    b = _blocks(spark, sf_dir).select("block_id", "parse_id", F.explode(tx.standards_in("text_raw")).alias("standard"))
    return b.groupBy("standard").agg(F.count("*").alias("n_blocks"), F.count_distinct("parse_id").alias("n_parses")).select("standard", tx.family_of("standard").alias("family"), "n_blocks", "n_parses")


def clause_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _blocks(spark, sf_dir).select(F.explode(tx.clauses_in("text_raw")).alias("clause"))
    return out.groupBy("clause").agg(F.count("*").alias("n_blocks"))


def designations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("designation is not null").select("designation").distinct()
    return d.select("designation", tx.family_of("designation").alias("family"), tx.year_of("designation").cast("long").alias("year"))


def text_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.array_join(tx.quality_flags("text"), ",").alias("flags"))
    return d.groupBy("flags").agg(F.count("*").alias("n"))


def pointer_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON pointers of evidence taken apart and put together again."""
    e = table(spark, sf_dir, "evidence").where("json_pointer is not null")
    part, n = F.regexp_extract("json_pointer", r"^/([^/]+)/(\d+)$", 1), F.regexp_extract("json_pointer", r"^/([^/]+)/(\d+)$", 2)
    same = F.concat(F.lit("/"), part, F.lit("/"), n) == F.col("json_pointer")
    return e.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.count_if(same).alias("n_same"), F.max(n.try_cast("long")).alias("largest"))


def distinct_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk for each content hash, the smallest id, if retrieval may use it."""
    c = table(spark, sf_dir, "chunk").where("retrieval_enabled and content_hash is not null and chunk_id is not null")
    return c.groupBy("content_hash").agg(F.min("chunk_id").alias("chunk_id"), F.count_distinct("chunk_id").alias("n_chunks"))


def evidence_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence joined to its record and its asset, missing ones kept, counted by what is there."""
    e = table(spark, sf_dir, "evidence").where("evidence_id is not null").dropDuplicates(["evidence_id"])
    n = _nodes(spark, sf_dir).select(F.col("id").alias("record_id"), "kind")
    a = table(spark, sf_dir, "source_asset").where("asset_id is not null").groupBy(F.col("asset_id").alias("source_asset_id")).agg(F.min("media_type").alias("media_type"))
    j = e.join(n, "record_id", "left").join(a, "source_asset_id", "left")
    return j.groupBy("kind", "media_type", "locator_quality").agg(F.count("*").alias("n"))


def evidence_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of evidence with a quote and with a page, for each kind of locator."""
    e = table(spark, sf_dir, "evidence").where("evidence_id is not null").dropDuplicates(["evidence_id"])
    g = e.groupBy("locator_quality").agg(F.count("*").alias("n"), F.count("quote").alias("q"), F.count("pdf_page").alias("p"))
    return g.select("locator_quality", "n", F.round(ratio("q", "n"), 6).alias("quoted"), F.round(ratio("p", "n"), 6).alias("paged"))


QUERIES = {
    f.__name__: f
    for f in (
        fact_fold, condition_states, condition_compiled, inherited_states, inherited_requirements, nearest_approved, shared_targets, prefix_descendants, impact_closure, category_expansion, broken_edges,
        version_intervals, version_order, bound_references, folded_dates, incoming_outcomes, absent_assets, first_wins, latest_reviews, review_transitions, monthly_outcomes, tiered_binding,
        asset_manifests, file_checks, manifest_status, snapshot_changes, block_coverage, violations, line_ranges, page_islands, titles_filled_down, text_sections, table_cells, requirement_rows,
        limit_conflicts, greedy_context, standards_usage, clause_citations, designations, text_quality, pointer_parts, distinct_content, evidence_trace, evidence_quality,
    )
}
