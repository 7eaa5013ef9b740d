"""Search, ranking and evaluation queries over the corpus tables."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnbeck.functions import text as tx
from tarnbeck.operators import evaluation, ranking, search
from tarnbeck.session import scratch_dir, table

FILTERS = {"lang": ["zh", "en"], "source": ["standard_clause", "guide_section", "lab_note"], "designation": ["FS 1000-2018", "FS 1172-2016", "SQ 3017-2021"]}
KEYS = {"lang", "source", "designation"}


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text for each chunk: copies of a chunk are one record."""
    rows = table(spark, sf_dir, "chunk").where("chunk_id is not null")
    return rows.groupBy("chunk_id").agg(F.max("retrieval_text").alias("text")).select(F.col("chunk_id").alias("record_id"), F.lit("body").alias("field"), F.lit(0).alias("ord"), "text")


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "taxonomy_node").where("id is not null")
    return rows.groupBy("id").agg(F.max("name").alias("text")).select(F.col("id").alias("record_id"), F.lit("name").alias("field"), F.lit(0).alias("ord"), "text")


def _phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "canonical_food").select(F.col("entry_id").alias("phrase_id"), F.col("name").alias("phrase"))


def exact_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.exact_search(table(spark, sf_dir, "documents"), search.prepare_filters(FILTERS, KEYS)).select("doc_id", "source", "designation")


def filter_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = search.filter_verdict(table(spark, sf_dir, "documents"), search.prepare_filters(FILTERS, KEYS))
    return out.groupBy("filter_ok", F.array_join("filter_missing", ",").alias("missing")).agg(F.count("*").alias("n"))


def metadata_unknown_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.metadata_unknown(table(spark, sf_dir, "documents"), search.prepare_filters(FILTERS, KEYS))


def catalog_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    label = F.lower(F.regexp_replace(F.concat_ws(" ", "title", "designation", "source"), r"\s+", ""))
    return d.where((F.col("source") == "standard_clause") & (F.contains(label, F.lit("术语")))).select("doc_id", "title")


def index_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index terms of the titles, with the number of titles that hold each."""
    d = table(spark, sf_dir, "documents").where("title is not null").select(F.col("doc_id").alias("record_id"), F.col("title").alias("text"))
    return search.postings(d).groupBy("token").agg(F.count("*").alias("n_records"))


_INDEXES: dict[tuple[str, str], str] = {}


def chunk_index(spark: SparkSession, sf_dir: str) -> str:
    """The index of the chunks' texts in the shared folder, written once by a program for each folder of tables."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _INDEXES:
        path = scratch_dir(spark, "phrases")
        search.build_index(_chunks(spark, sf_dir), path, parts=max(8, min(4096, spark.sparkContext.defaultParallelism)))
        _INDEXES[key] = path
    return _INDEXES[key]


def _index_hits(spark: SparkSession, sf_dir: str, mode: str, phrases: DataFrame | dict[str, str]) -> DataFrame:
    hits = search.phrase_hits(search.search_index(spark, chunk_index(spark, sf_dir), phrases, mode))
    return hits.select("phrase_id", "record_id", F.col("score").cast("long").alias("score"))


def index_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every canonical name against every chunk, as stored, by the index."""
    return _index_hits(spark, sf_dir, "literal_raw", _phrases(spark, sf_dir))


def index_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index_hits(spark, sf_dir, "normalized_phrase", _phrases(spark, sf_dir))


def index_ngram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index_hits(spark, sf_dir, "zh_ngram_phrase", _phrases(spark, sf_dir))


_PHRASE = "微生物限量"


def phrase_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One phrase against every chunk, as stored, by the index."""
    return _index_hits(spark, sf_dir, "literal_raw", {"one": _PHRASE})


def phrase_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index_hits(spark, sf_dir, "normalized_phrase", {"one": _PHRASE})


def phrase_ngram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index_hits(spark, sf_dir, "zh_ngram_phrase", {"one": _PHRASE})


def index_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of searches for names: by the index, without it, and without index or texts."""
    asked, gone = _phrases(spark, sf_dir), chunk_index(spark, sf_dir) + "/none"
    parts = {
        "index": search.index_report(spark, chunk_index(spark, sf_dir), asked, "literal_raw"),
        "scan": search.index_report(spark, gone, asked, "literal_raw", _chunks(spark, sf_dir)),
        "nothing": search.index_report(spark, gone, asked, "literal_raw"),
    }
    out = None
    for name, part in parts.items():
        counted = part.groupBy("status").agg(F.count("*").alias("n"), F.sum("total_count").alias("n_hits")).select(F.lit(name).alias("searched"), "status", "n", "n_hits")
        out = counted if out is None else out.unionByName(counted)
    return out


def lexical_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every canonical name against every chunk, as stored."""
    hits = search.phrase_hits(search.phrase_matches(_chunks(spark, sf_dir), _phrases(spark, sf_dir), "literal_raw"))
    return hits.select("phrase_id", "record_id", F.col("score").cast("long").alias("score"))


def lexical_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every canonical name against every node name, as stored, with the kind of match."""
    m = search.phrase_matches(_names(spark, sf_dir), _phrases(spark, sf_dir), "literal_raw")
    return m.select("phrase_id", "record_id", "kind", F.col("score").cast("long").alias("score"))


def lexical_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.phrase_hits(search.phrase_matches(_chunks(spark, sf_dir), _phrases(spark, sf_dir), "normalized_phrase"))
    return hits.select("phrase_id", "record_id", F.col("score").cast("long").alias("score"))


def posting_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles that hold all index terms of the title phrases asked for."""
    titles = table(spark, sf_dir, "documents").where("title is not null").select(F.col("doc_id").alias("record_id"), F.col("title").alias("text"))
    asked = table(spark, sf_dir, "documents").where("title is not null and doc_id % 100 = 0").select(F.col("title").alias("phrase_id"), F.col("title").alias("phrase")).distinct()
    return search.candidates(search.postings(titles), asked)


def search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.phrase_hits(search.phrase_matches(_names(spark, sf_dir), _phrases(spark, sf_dir), "literal_raw"))
    p = search.page(hits, limit=5, offset=5)
    return p.select("phrase_id", "record_id", F.col("score").cast("long").alias("score"), F.col("rank").cast("long").alias("rank"), "total_count", F.col("next_offset").cast("long").alias("next_offset"))


def search_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = table(spark, sf_dir, "taxonomy_node").where("review_state = 'approved'").select(F.col("id").alias("record_id"))
    return search.search_report(_names(spark, sf_dir), _phrases(spark, sf_dir), ok, "literal_raw")


def phrase_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First offset and number of occurrences of each name in each chunk."""
    m = search.phrase_matches(_chunks(spark, sf_dir), _phrases(spark, sf_dir), "literal_raw")
    s = tx.spans("form", "want")
    return m.select("phrase_id", "record_id", s[0]["start"].cast("long").alias("first_start"), tx.count_of("form", "want").cast("long").alias("n"))


def ir_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names searched in node names, judged by the nodes' names: equal ones are relevant, deleted ones are not."""
    nodes = table(spark, sf_dir, "taxonomy_node").where("id is not null").groupBy("id").agg(F.max("name").alias("name"), F.max(F.col("deleted_at").isNotNull()).alias("gone"))
    phrases = _phrases(spark, sf_dir)
    labels = nodes.join(phrases, nodes.name == phrases.phrase).select(F.col("phrase_id").alias("query_id"), F.col("id").alias("record_id"), (~F.col("gone")).alias("relevant"))
    hits = search.phrase_hits(search.phrase_matches(_names(spark, sf_dir), phrases, "literal_raw"))
    ranked = ranking.top_k(hits, ["phrase_id"], [F.desc("score"), F.col("record_id")], 10).select(F.col("phrase_id").alias("query_id"), F.lit("literal").alias("strategy"), "rank", "record_id")
    runs = phrases.select(F.col("phrase_id").alias("query_id"), F.lit("literal").alias("strategy"), F.when(F.length("phrase") % 7 == 0, "failed").otherwise("success").alias("status"), F.length("phrase").cast("double").alias("latency_ms"))
    out = evaluation.strategy_summary(evaluation.query_metrics(runs, ranked, labels, 10))
    return out.select("strategy", *(F.col(c).cast("long").alias(c) for c in ("n_expected", "n_returned", "n_relevant", "n_bad", "n_unjudged", "n_failed")), *(F.round(c, 6).alias(c) for c in ("recall", "precision_lower", "precision_upper", "judged_precision", "coverage", "mean_latency_ms", "max_latency_ms")))


def topk_per_namespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nodes of each namespace with the most evidence, then the shortest name, then the first."""
    e = table(spark, sf_dir, "evidence").where("record_id is not null").groupBy("record_id").agg(F.count_distinct("evidence_id").alias("n"))
    n = table(spark, sf_dir, "taxonomy_node").where("id is not null and namespace is not null").groupBy("namespace", "id").agg(F.max("name").alias("name"), F.min("ord").alias("ord"))
    joined = n.join(e, n.id == e.record_id)
    best = ranking.top_k(joined, ["namespace"], [F.desc("n"), F.length("name").asc_nulls_last(), F.col("ord"), F.col("id")], 5)
    return best.select("namespace", "id", F.col("n").alias("n_evidence"), F.col("rank").cast("long").alias("rank"))


def candidate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical names scored against the most typed values' stored forms."""
    terms = table(spark, sf_dir, "queries").where("food is not null").select(F.col("food").alias("term")).distinct()
    names = _phrases(spark, sf_dir).select(F.col("phrase_id").alias("name_id"), F.col("phrase").alias("name"))
    return ranking.name_scores(names, terms).select("term", "name_id", F.col("score").cast("long").alias("score"))


def decision_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = ranking.decide(candidate_scores(spark, sf_dir), "term")
    return d.groupBy("status").agg(F.count("*").alias("n_terms"), F.count("choice").alias("n_chosen"), F.sum("n_candidates").alias("n_candidates"))


def history_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest 60 questions of each owner, each once, by arrival."""
    q = table(spark, sf_dir, "queries").where("owner is not null and owner != ''").groupBy("owner", "id").agg(F.max("created_at").alias("at"))
    best = ranking.top_k(q, ["owner"], [F.desc("at"), F.desc("id")], 60)
    return best.select("owner", "id", F.col("rank").cast("long").alias("rank"))


QUERIES = {
    f.__name__: f
    for f in (
        exact_filter, filter_verdicts, metadata_unknown_counts, catalog_filter, index_tokens, index_literal, index_normalised, index_ngram, phrase_literal, phrase_normalised, phrase_ngram, index_states, lexical_literal, lexical_names, lexical_normalised, posting_candidates,
        search_page, search_status, phrase_spans, ir_evaluation, topk_per_namespace, candidate_scores, decision_status, history_page,
    )
}

def _compatible(sql: str) -> str:
    """SQL of the search form: compatibility characters by the Unicode tables, composed, one dash, no white space."""
    folded = {chr(c): unicodedata.normalize("NFKC", chr(c)) for lo, hi in ((0xA0, 0xD800), (0xF900, 0xFFF0)) for c in range(lo, hi)}
    one = {a: b for a, b in folded.items() if len(b) == 1 and a != b and unicodedata.normalize("NFC", a) != b}
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    out = f"translate({sql}, {quoted(''.join(one))}, {quoted(''.join(one.values()))})"
    for a in [chr(c) for c in range(0x3380, 0x33E0)] + ["…", "℃", "½", "¼", "¾", "ﬁ", "ﬂ", "№", "‰"]:
        if len(folded[a]) > 1:
            out = f"replace({out}, '{a}', {quoted(folded[a])})"
    return f"regexp_replace(translate(nfc_normalize({out}), '{tx.DASHES}', '{'-' * len(tx.DASHES)}'), '[\\s\\x0b\\x85\\x{{1680}}\\x{{2028}}\\x{{2029}}\\x{{3000}}]', '', 'g')"


_HAN = r"\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{20000}-\x{2ffff}"
_TOKENS = rf"""
  form as (select distinct doc_id, translate(regexp_replace(title, '\s', '', 'g'), '‐‑‒–—−﹘﹣－', '---------') t from documents where title is not null),
  han as (select doc_id, unnest(regexp_extract_all(t, '[{_HAN}]+')) p from form),
  word as (select doc_id, unnest(regexp_extract_all(t, '[A-Za-z0-9_]+(?:[./-][A-Za-z0-9_]+)*')) p from form)"""
_NAMES = "names as (select id, max(name) name from taxonomy_node where id is not null group by id)"
_CHUNKS = "chunks as (select chunk_id, max(retrieval_text) t from chunk where chunk_id is not null group by chunk_id)"
_HITS = f"with {_NAMES}, hits as (select entry_id phrase_id, id record_id, case when n.name = c.name then 1100 else 100 end score from names n join canonical_food c on contains(n.name, c.name))"

ORACLE = {
    "exact_filter": """select doc_id, source, designation from documents where lang in ('zh', 'en')
      and source in ('standard_clause', 'guide_section', 'lab_note') and designation in ('FS 1000-2018', 'FS 1172-2016', 'SQ 3017-2021')""",
    "filter_verdicts": """
with d as (select coalesce(lang, '') l, coalesce(source, '') s, coalesce(designation, '') g from documents),
v as (select l, s, g, l in ('zh', 'en') lo, s in ('standard_clause', 'guide_section', 'lab_note') so, g in ('FS 1000-2018', 'FS 1172-2016', 'SQ 3017-2021') go from d)
select lo and so and go filter_ok,
  concat_ws(',', case when l = '' then 'lang' end, case when (l = '' or lo) and s = '' then 'source' end, case when (l = '' or lo) and (s = '' or so) and g = '' then 'designation' end) missing,
  count(*) n from v group by all""",
    "metadata_unknown_counts": """
with d as (select coalesce(lang, '') l, coalesce(source, '') s, coalesce(designation, '') g from documents),
v as (select l, s, g, l = '' or l in ('zh', 'en') lo, s = '' or s in ('standard_clause', 'guide_section', 'lab_note') so from d)
select 'lang' as key, count(*) n from v where l = '' having count(*) > 0
union all select 'source', count(*) from v where lo and s = '' having count(*) > 0
union all select 'designation', count(*) from v where lo and so and g = '' having count(*) > 0""",
    "catalog_filter": """select doc_id, title from documents where source = 'standard_clause'
      and contains(lower(regexp_replace(concat_ws(' ', title, designation, source), '\\s+', '', 'g')), '术语')""",
    "index_tokens": f"""with {_TOKENS},
  tok as (select doc_id, 'c:' || unnest(string_split(p, '')) k from han union select doc_id, 'g:' || substr(p, i, 2) from han, range(1, 200) r(i) where i < length(p)
    union select doc_id, 'w:' || p from word union select doc_id, 'a:' || unnest(string_split(p, '')) from word union select doc_id, 'b:' || substr(p, i, 2) from word, range(1, 200) r(i) where i < length(p))
select k as token, count(*) n_records from tok where length(k) > 2 group by k""",
    "lexical_literal": f"with {_CHUNKS} select entry_id phrase_id, chunk_id record_id, 20::bigint score from chunks join canonical_food on contains(t, name)",
    "index_literal": f"with {_CHUNKS} select entry_id phrase_id, chunk_id record_id, 20::bigint score from chunks join canonical_food on contains(t, name)",
    **{
        k: f"with {_CHUNKS}, c as (select chunk_id, {_compatible('t')} f from chunks), n as (select entry_id, {_compatible('name')} w from canonical_food) select entry_id phrase_id, chunk_id record_id, 20::bigint score from c join n on contains(f, w)"
        for k in ("lexical_normalised", "index_normalised", "index_ngram")
    },
    "phrase_literal": f"with {_CHUNKS} select 'one' phrase_id, chunk_id record_id, 20::bigint score from chunks where contains(t, '{_PHRASE}')",
    **{k: f"with {_CHUNKS} select 'one' phrase_id, chunk_id record_id, 20::bigint score from chunks where contains({_compatible('t')}, '{_PHRASE}')" for k in ("phrase_normalised", "phrase_ngram")},
    "index_states": f"""with {_CHUNKS}, h as (select entry_id, count(chunk_id) n from canonical_food left join chunks on contains(t, name) group by entry_id)
select 'index' searched, case when n > 0 then 'success' else 'empty' end status, count(*) n, sum(n)::bigint n_hits from h group by 2
union all select 'scan', 'degraded', count(*), sum(n)::bigint from h union all select 'nothing', 'failed', count(*), null from h""",
    "lexical_names": f"""with {_NAMES} select entry_id phrase_id, id record_id, case when n.name = c.name then 'exact_name' else 'related_name' end kind,
      (case when n.name = c.name then 1100 else 100 end)::bigint score from names n join canonical_food c on contains(n.name, c.name)""",
    "posting_candidates": f"""with {_TOKENS},
  tok as (select doc_id, 'c:' || unnest(string_split(p, '')) k from han union select doc_id, 'g:' || substr(p, i, 2) from han, range(1, 200) r(i) where i < length(p)
    union select doc_id, 'a:' || unnest(string_split(p, '')) from word union select doc_id, 'b:' || substr(p, i, 2) from word, range(1, 200) r(i) where i < length(p)),
  asked as (select distinct title from documents where title is not null and doc_id % 100 = 0),
  one as (select distinct f.title, w.doc_id from asked f, (select doc_id, title from documents) w where w.title = f.title),
  rep as (select title, min(doc_id) doc_id from one group by title),
  parts as (select r.title, h.p, true c from rep r join han h using (doc_id) union select r.title, w.p, false from rep r join word w using (doc_id)),
  want as (select title, case when c then 'c:' else 'a:' end || p k from parts where length(p) = 1
    union select title, case when c then 'g:' else 'b:' end || substr(p, i, 2) from parts, range(1, 200) r(i) where i < length(p)),
  need as (select title, count(*) n from want group by title)
select w.title phrase_id, t.doc_id record_id from want w join tok t using (k) join need using (title) group by w.title, t.doc_id, n having count(*) = n""",
    "search_page": _HITS + """, r as (select *, row_number() over (partition by phrase_id order by score desc, record_id) as rank, count(*) over (partition by phrase_id) total_count from hits)
select phrase_id, record_id, score::bigint score, rank, total_count, case when total_count > 10 then 10::bigint end next_offset from r where rank between 6 and 10""",
    "search_status": _HITS + """, ok as (select distinct id from taxonomy_node where review_state = 'approved'),
c as (select phrase_id, count(*) found, count(*) filter (record_id in (select id from ok)) kept from hits group by phrase_id)
select entry_id phrase_id, case when kept > 0 then 'success' else 'empty' end status,
  case when kept > 0 then null when found > 0 then 'filter_mismatch' else 'no_literal_match' end empty_reason, coalesce(kept, 0) total_count
from canonical_food left join c on entry_id = phrase_id""",
    "phrase_spans": f"""with {_CHUNKS} select entry_id phrase_id, chunk_id record_id, (instr(t, name) - 1)::bigint first_start,
      ((length(t) - length(replace(t, name, ''))) // length(name))::bigint n from chunks join canonical_food on contains(t, name)""",
    "ir_evaluation": _HITS + """,
n as (select id, max(name) name, bool_or(deleted_at is not null) gone from taxonomy_node where id is not null group by id),
labels as (select entry_id q, id r, not gone relevant from n join canonical_food c on c.name = n.name),
top as (select * from (select *, row_number() over (partition by phrase_id order by score desc, record_id) rk from hits) where rk <= 10),
runs as (select entry_id q, length(name) % 7 = 0 failed, length(name)::double l from canonical_food),
per as (select q, count(*) filter (relevant) e from labels group by q),
j as (select t.phrase_id q, count(*) ret, count(*) filter (relevant) rel, count(*) filter (not relevant) bad, count(*) filter (relevant is null) un
  from top t join runs on runs.q = t.phrase_id and not failed left join labels on labels.q = t.phrase_id and labels.r = t.record_id group by t.phrase_id),
s as (select sum(e)::bigint n_expected, coalesce(sum(ret), 0)::bigint n_returned, coalesce(sum(rel), 0)::bigint n_relevant, coalesce(sum(bad), 0)::bigint n_bad, coalesce(sum(un), 0)::bigint n_unjudged,
  count(*) filter (failed) n_failed, avg(l) ml, max(l) xl from per join runs using (q) left join j using (q))
select 'literal' strategy, n_expected, n_returned, n_relevant, n_bad, n_unjudged, n_failed, round(n_relevant / n_expected, 6) recall, round(n_relevant / n_returned, 6) precision_lower,
  round((n_relevant + n_unjudged) / n_returned, 6) precision_upper, round(n_relevant / (n_relevant + n_bad), 6) judged_precision, round((n_relevant + n_bad) / n_returned, 6) coverage,
  round(ml, 6) mean_latency_ms, round(xl, 6) max_latency_ms from s""",
    "topk_per_namespace": """
with e as (select record_id, count(distinct evidence_id) n from evidence where record_id is not null group by record_id),
n as (select namespace, id, max(name) name, min(ord) ord from taxonomy_node where id is not null and namespace is not null group by namespace, id)
select namespace, id, n_evidence, rank from (select namespace, id, e.n n_evidence,
  row_number() over (partition by namespace order by e.n desc, length(name) asc nulls last, ord, id) as rank from n join e on n.id = e.record_id) where rank <= 5""",
    "candidate_scores": """
with t as (select distinct food term from queries where length(food) >= 2)
select term, entry_id name_id, (case when name = term then 100 when suffix(name, term) then 83 else 76 end)::bigint score from t join canonical_food on contains(name, term)""",
    "decision_status": """
with t as (select distinct food term from queries where length(food) >= 2),
s as (select term, entry_id, case when name = term then 100 when suffix(name, term) then 83 else 76 end score from t join canonical_food on contains(name, term)),
d as (select term, count(*) n, count(*) filter (score >= 90) strong from s group by term)
select case when strong = 1 or n = 1 then 'name_match' else 'needs_details' end status, count(*) n_terms, count(*) filter (strong = 1 or n = 1) n_chosen, sum(n)::bigint n_candidates from d group by 1""",
    "history_page": """
with q as (select owner, id, max(created_at) asked from queries where owner <> '' group by owner, id)
select owner, id, rank from (select owner, id, row_number() over (partition by owner order by asked desc, id desc) as rank from q) where rank <= 60""",
}
