"""Queries of the language-model operators, and their SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnbeck.llm.bpe import decode, encode
from tarnbeck.llm.canonical import map_to_canonical
from tarnbeck.llm.mixing import Mixture, deviations, mix_documents
from tarnbeck.llm.pieces import oversized, pieces
from tarnbeck.llm.reading import fit_reading_model, reading_levels
from tarnbeck.llm.unify_text import unify
from tarnbeck.session import spread, table


def _typed_foods(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = table(spark, sf_dir, "queries").select(F.lit("queries").alias("src"), F.col("id").alias("record_id"), F.col("food").alias("value"))
    named = table(spark, sf_dir, "taxonomy_node").where("kind = 'variety'").select(F.lit("taxonomy_node").alias("src"), F.col("id").alias("record_id"), F.col("name").alias("value"))
    return typed.unionByName(named).where("record_id is not null")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = map_to_canonical(_typed_foods(spark, sf_dir), "value", table(spark, sf_dir, "canonical_food"))
    return mapped.where("match in ('mapped', 'none')").select("src", "record_id", "entry_id").distinct()


def p2_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values without an entry, with the number of records that hold them."""
    mapped = map_to_canonical(_typed_foods(spark, sf_dir), "value", table(spark, sf_dir, "canonical_food"))
    return mapped.where("match = 'none'").groupBy("src", "value").agg(F.countDistinct("record_id").alias("n_records"))


def p2_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many records each stage decides: literal names, mentions by the automaton, token sets, slips, none."""
    mapped = map_to_canonical(_typed_foods(spark, sf_dir), "value", table(spark, sf_dir, "canonical_food"), stage="stage")
    return mapped.groupBy("src", "stage").agg(F.countDistinct("record_id").alias("n_records"))


_SPLIT = (("content_block", "block_id", "text_raw"), ("chunk", "chunk_id", "retrieval_text"))


def _limits(spark: SparkSession, sf_dir: str) -> dict[str, tuple[int, int]]:
    fields = [f"{name}.{column}" for name, _, column in _SPLIT]
    rows = table(spark, sf_dir, "piece_limits").where(F.col("field_name").isin(fields)).groupBy("field_name").agg(F.min("max_chars").alias("max_chars"), F.min("overlap_chars").alias("overlap_chars")).collect()  # one for each field asked for
    return {r.field_name: (r.max_chars, r.overlap_chars) for r in rows}


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name, key, column in _SPLIT:
        rows = table(spark, sf_dir, name).select(F.lit(name).alias("src"), F.col(key).alias("item_id"), column).where("item_id is not null")
        found = oversized(rows, column, *_limits(spark, sf_dir)[f"{name}.{column}"]).select("src", "item_id")
        out = found if out is None else out.unionByName(found)
    return out.distinct()


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of the texts beyond the limits."""
    out = None
    for name, key, column in _SPLIT:
        rows = table(spark, sf_dir, name).select(F.lit(name).alias("src"), F.col(key).alias("item_id"), column).where("item_id is not null")
        cut = pieces(rows, column, *_limits(spark, sf_dir)[f"{name}.{column}"], least_pieces=2)
        out = cut if out is None else out.unionByName(cut)
    return out.distinct()


def p4_rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of each text put together again: length and hash of what they make, whether all are within the limit and share the overlap."""
    limits = spark.createDataFrame([(f.split(".")[0], *v) for f, v in _limits(spark, sf_dir).items()], "src string, max_chars int, overlap int")
    parts = p4_pieces(spark, sf_dir).join(F.broadcast(limits), "src")
    one = parts.groupBy("src", "item_id", "overlap").agg(F.array_sort(F.collect_list(F.struct("piece_no", "start", "piece"))).alias("p"), F.min(F.length("piece") <= F.col("max_chars")).alias("within_limit"))
    text = F.array_join(F.transform("p", lambda x, i: F.when(i == 0, x["piece"]).otherwise(F.substr(x["piece"], F.col("overlap") + 1))), "")
    pairs = F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.right(F.get("p", i - 1)["piece"], F.col("overlap")) == F.left(F.get("p", i)["piece"], F.col("overlap")))
    return one.select("src", "item_id", F.length(text).cast("long").alias("n_chars"), F.sha2(text, 256).alias("text_hash"), "within_limit", F.forall(pairs, lambda x: x).alias("overlap_shared"))


def _unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = (("queries", "id", "food"), ("taxonomy_node", "id", "name"), ("content_block", "block_id", "text_raw"))
    out = None
    for name, key, column in parts:
        rows = table(spark, sf_dir, name).select(F.lit(name).alias("src"), F.col(key).alias("record_id"), F.col(column).alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return unify(out.where("record_id is not null"), "value")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unified(spark, sf_dir).where(F.size("kinds") > 0).select("src", "record_id").distinct()


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms that several different stored values share: the values that only now compare as equal."""
    same = _unified(spark, sf_dir).where("value is not null and unified != ''")
    counted = same.groupBy("src", F.sha2("unified", 256).alias("form_id"), F.xxhash64("value").alias("v")).agg(F.first("unified").alias("unified"), F.count("*").alias("n"))
    return counted.groupBy("src", "form_id").agg(F.first("unified").alias("unified"), F.count("*").alias("n_stored_forms"), F.sum("n").alias("n_rows")).where("n_stored_forms > 1").drop("form_id")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "text")


def _mixture(spark: SparkSession, sf_dir: str) -> Mixture:
    return mix_documents(spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text")), table(spark, sf_dir, "mix_targets"))


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every use of a document in the mixture; read in order of (slot, start, doc_id)."""
    return _mixture(spark, sf_dir).rows


def p7_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document turned back into its text: length in bytes and hash."""
    return decode(p7_ids(spark, sf_dir), "ids").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("text_hash"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source."""
    return _mixture(spark, sf_dir).shares


def p8_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most tokens by which each source is off its share at any moment of the mixture, and the bound: a block and uncut documents."""
    return deviations(_mixture(spark, sf_dir))


def p8_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each source with documents: no document beyond max_repeats, no use twice, never a block off its share."""
    m = _mixture(spark, sf_dir)
    once = m.rows.groupBy("source", "doc_id", "repeat").agg(F.count("*").alias("n")).groupBy("source").agg((F.max("n") == 1).alias("used_once"))
    off = deviations(m).select("source", (F.col("deviation") < F.col("allowed")).alias("within_block"))
    caps = m.shares.select("source", (F.col("most_repeats") <= F.col("max_repeats")).alias("within_repeats"))
    return once.join(off, "source").join(caps, "source")


def p9_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level and score of every document."""
    documents = table(spark, sf_dir, "documents")
    model = fit_reading_model(documents, table(spark, sf_dir, "reading_labels"))
    return reading_levels(spread(documents.select("doc_id", "text")), model).drop("text")


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors on each source, predicted without it: neither trees nor token difficulty nor the calibration saw it or copies of its texts."""
    model = fit_reading_model(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels"))
    return spark.createDataFrame([tuple(r.values()) for r in model.report] if model else [], "source string, n long, mean_abs_error double, within_half double")


def p9_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each source, how many documents have a level, all of them from 1 to 5."""
    levels = p9_levels(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return levels.groupBy("source").agg(F.count("reading_level").alias("n_levels"), F.count_if(F.col("reading_level").isNull()).alias("n_without"), F.coalesce(F.bool_and(F.col("reading_score").between(1, 5)), F.lit(True)).alias("in_range"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_levels(spark, sf_dir).where("reading_level >= 4").select("doc_id")


QUERIES = {f.__name__: f for f in (p2_found, p2_unmatched, p2_stages, p4_found, p4_pieces, p4_rejoined, p5_found, p5_groups, p7_ids, p7_decoded, p8_mixture, p8_shares, p8_deviation, p8_invariants, p9_levels, p9_report, p9_coverage, p9_found)}

ORACLE = {
    "p4_found": """
select distinct 'content_block' src, block_id item_id from content_block, piece_limits
where field_name = 'content_block.text_raw' and length(text_raw) > max_chars
union all select distinct 'chunk', chunk_id from chunk, piece_limits
where field_name = 'chunk.retrieval_text' and length(retrieval_text) > max_chars""",
    "p4_rejoined": """
with t as (select distinct 'content_block' src, block_id item_id, text_raw t from content_block, piece_limits where field_name = 'content_block.text_raw' and length(text_raw) > max_chars
  union all select distinct 'chunk', chunk_id, retrieval_text from chunk, piece_limits where field_name = 'chunk.retrieval_text' and length(retrieval_text) > max_chars)
select src, item_id, length(t)::bigint n_chars, sha256(t) text_hash, true within_limit, true overlap_shared from t where item_id is not null""",
    "p7_decoded": "select doc_id, octet_length(encode(coalesce(text, '')))::bigint n_bytes, sha256(coalesce(text, '')) text_hash from documents",
    "p9_coverage": r"""
select source, count(*) filter (regexp_matches(text, '[^\s\p{Z}\p{Cf}]')) n_levels, count(*) filter (not coalesce(regexp_matches(text, '[^\s\p{Z}\p{Cf}]'), false)) n_without, true in_range from documents group by source""",
    "p8_invariants": """
select source, true used_once, true within_block, true within_repeats from mix_targets
where target_share > 0 and max_repeats > 0 and source in (select source from documents where text <> '')""",
}
