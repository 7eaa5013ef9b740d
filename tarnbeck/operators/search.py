"""Exact and phrase search over records in long form: (record_id, field, ord, text).

Phrase search finds candidates by the rarest index term of each phrase and then
re-verifies the phrase itself, so an index term never decides. Phrases are a query
set: up to ``BROADCAST_PHRASES`` of them are broadcast (counted first), more are
joined by shuffle on the term.

:func:`build_index` writes the postings once, in order of the term, and
:func:`search_index` answers one phrase or many from them: it looks up how often the
phrases' terms occur, reads the postings of one term for each phrase, and only the
parts of the texts that hold candidates.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnbeck.functions.text import EXACT_NAME_BONUS, FIELD_WEIGHTS, OTHER_WEIGHT, filter_form, phrase_terms, search_form, search_form_of, symbols, tokens

MODES = ("literal_raw", "normalized_phrase", "zh_ngram_phrase")
BROADCAST_PHRASES = 50_000
#: Candidates (known from the term counts) up to which they are broadcast to the texts' parts; more are joined by shuffle.
BROADCAST_CANDIDATES = 500_000
#: The form of a text that each mode compares, and the folder of its index.
FORM = {"literal_raw": "raw", "normalized_phrase": "search", "zh_ngram_phrase": "search"}
KEYS = ["record_id", "field", "ord"]
MAX_VALUES, MAX_PAGE, MAX_PHRASE = 100, 1000, 256


class QueryError(ValueError):
    """A query argument that is not allowed; ``code`` is stable."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(f"{code}: {message}")
        self.code = code


# -- filters ------------------------------------------------------------------------------
def prepare_filters(filters: dict | None, allowed: set[str]) -> dict[str, list]:
    """Checked filters: known keys, 1 to MAX_VALUES values each, sorted and each once."""
    out = {}
    for key, value in (filters or {}).items():
        if key not in allowed:
            raise QueryError("QUERY_FILTER", f"unknown field {key}")
        values = list(value) if isinstance(value, (list, tuple, set)) else [value]
        if not 1 <= len(values) <= MAX_VALUES:
            raise QueryError("QUERY_FILTER", f"{key} needs 1 to {MAX_VALUES} values")
        out[key] = sorted(set(values))
    return out


def validate_page(limit: int, offset: int) -> None:
    if type(limit) is not int or not 1 <= limit <= MAX_PAGE or type(offset) is not int or offset < 0:
        raise QueryError("QUERY_PAGE", f"limit must be 1 to {MAX_PAGE}, offset not negative")


def validate_phrase(phrase: str) -> None:
    if not isinstance(phrase, str) or "\x00" in phrase or not phrase.strip() or len(phrase) > MAX_PHRASE:
        raise QueryError("QUERY_TEXT", f"a phrase has 1 to {MAX_PHRASE} characters")


def filter_verdict(df: DataFrame, filters: dict[str, list], columns: dict[str, str] | None = None) -> DataFrame:
    """``df`` with ``filter_ok`` and ``filter_missing``.

    A record passes if for every key one of its values is wanted. Missing metadata
    (null or '') is no match and is named in filter_missing, but only for keys before the first
    mismatch, in the order of ``filters``.
    """
    ok, alive, missing = F.lit(True), F.lit(True), F.array().cast("array<string>")
    for key, wanted in filters.items():
        name = (columns or {}).get(key, key)
        values = F.col(name) if dict(df.dtypes)[name].startswith("array") else F.array(F.col(name))
        values = F.filter(F.coalesce(values, F.array()), lambda v: v.isNotNull() & (v.cast("string") != ""))
        none, hit = F.size(values) == 0, F.arrays_overlap(values, F.array(*map(F.lit, wanted)))
        missing = F.when(alive & none, F.concat(missing, F.array(F.lit(key)))).otherwise(missing)
        ok = ok & ~none & F.coalesce(hit, F.lit(False))
        alive = alive & (none | F.coalesce(hit, F.lit(False)))
    return df.select("*", ok.alias("filter_ok"), missing.alias("filter_missing"))


def exact_search_forms(df: DataFrame, filters: dict[str, list], columns: dict[str, str] | None = None) -> DataFrame:
    """:func:`exact_search` in the form of each key (:func:`tarnbeck.functions.text.filter_form`), so that values spelled differently meet.

    Filter values without a form (blank ones, a year that is none) are an error.
    """
    out = df
    for key, wanted in filters.items():
        values = df.sparkSession.createDataFrame([(str(v),) for v in wanted], "v string").select(filter_form(key, "v")).collect()  # at most MAX_VALUES
        if any(r[0] is None for r in values):
            raise QueryError("QUERY_FILTER", f"{key} has a value without a form")
        name = (columns or {}).get(key, key)
        out = out.where(filter_form(key, name).isin(sorted({r[0] for r in values})))
    return out


def exact_search(df: DataFrame, filters: dict[str, list], columns: dict[str, str] | None = None) -> DataFrame:
    """Records that pass the filters (plain predicates, pushed to the scan where the columns are scalar)."""
    out = df
    for key, wanted in filters.items():
        name = (columns or {}).get(key, key)
        out = out.where(F.arrays_overlap(name, F.array(*map(F.lit, wanted))) if dict(df.dtypes)[name].startswith("array") else F.col(name).isin(wanted))
    return out


def metadata_unknown(df: DataFrame, filters: dict[str, list], columns: dict[str, str] | None = None) -> DataFrame:
    """(key, n): records whose missing metadata kept a key from matching."""
    return filter_verdict(df, filters, columns).select(F.explode("filter_missing").alias("key")).groupBy("key").agg(F.count("*").alias("n"))


# -- phrases ------------------------------------------------------------------------------
def postings(texts: DataFrame) -> DataFrame:
    """(token, record_id): the index, each pair once."""
    return texts.select("record_id", F.explode(tokens("text")).alias("token")).distinct()


def write_postings(index: DataFrame, path: str, partitions: int = 200) -> None:
    """The index sorted by token and id, so that a look-up reads the few files whose range holds the token; a frequent one is in several files."""
    index.repartitionByRange(partitions, "token", "record_id").sortWithinPartitions("token", "record_id").write.parquet(path)


def candidates(index: DataFrame, phrases: DataFrame) -> DataFrame:
    """(phrase_id, record_id): records that hold every index term of a phrase.

    For phrases few enough that their terms' postings can be listed; :func:`phrase_matches`
    goes by the rarest term only.
    """
    wanted = phrases.select("phrase_id", F.explode(tokens("phrase", query=True)).alias("token"))
    need = wanted.groupBy("phrase_id").agg(F.count("*").alias("need"))
    found = index.join(wanted, "token").groupBy("phrase_id", "record_id").agg(F.count("*").alias("have"))
    return found.join(need, "phrase_id").where("have = need").select("phrase_id", "record_id")


def phrase_matches(texts: DataFrame, phrases: DataFrame, mode: str = "zh_ngram_phrase") -> DataFrame:
    """Every (phrase, text) with the phrase in the text: phrase_id, record_id, field, ord, kind, score, form, want.

    literal_raw compares as stored; the other modes compare search forms. kind is
    ``exact_name`` (a name or project equal to the phrase), ``related_name`` or
    ``phrase_evidence``. Null and blank phrases match nothing. form and want are the
    compared texts. Phrases without letters, digits or Chinese characters go by their symbols.
    """
    form = _form(mode)
    asked = phrases.select("phrase_id", form("phrase").alias("want")).where("want is not null and trim(want) != ''").withColumn("terms", tokens("want", query=True, normalised=True))
    asked = asked.withColumn("terms", F.when(F.size("terms") > 0, F.col("terms")).otherwise(symbols("want")))
    held = _held(texts, mode)
    small = asked.count() <= BROADCAST_PHRASES
    hint = F.broadcast if small else (lambda d: d)
    wanted = asked.select("phrase_id", F.explode("terms").alias("term"))
    # Few phrases: the text itself rides along to the broadcast. Many: only its key is shuffled by term, and the text meets it again.
    ride = [*KEYS, *(["form"] if small else [])]
    spread = held.select(*ride, F.explode(F.concat(tokens("form", normalised=True), symbols("form"))).alias("term"))
    often = spread.join(hint(wanted.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))
    rarest = (
        wanted.join(often, "term", "left")
        .groupBy("phrase_id")
        .agg(F.min_by("term", F.struct(F.coalesce("n", F.lit(0)), "term")).alias("term"))
        .join(asked.select("phrase_id", "want").distinct(), "phrase_id")
    )
    found = spread.join(hint(rarest), "term").drop("term")
    if not small:
        found = found.join(held, KEYS)
    return _scored(found)


def _form(mode: str):  # noqa: ANN202
    if mode not in MODES:
        raise QueryError("QUERY_MODE", mode)
    return F.col if FORM[mode] == "raw" else search_form


def _held(texts: DataFrame, mode: str) -> DataFrame:
    return texts.select(*KEYS, _form(mode)("text").alias("form")).where("form is not null and form != ''")


def _scored(found: DataFrame) -> DataFrame:
    """Candidates whose text holds the phrase, with kind and score."""
    found = found.where(F.contains("form", "want")).select(*KEYS, "form", "phrase_id", "want")
    named = F.col("field").isin("name", "project")
    kind = F.when(named & (F.col("form") == F.col("want")), "exact_name").when(named, "related_name").otherwise("phrase_evidence")
    return found.withColumn("kind", kind).withColumn("score", weight("field") + F.when(F.col("kind") == "exact_name", EXACT_NAME_BONUS).otherwise(0))


# -- a prebuilt index -----------------------------------------------------------------------
def build_index(texts: DataFrame, path: str, parts: int = 32, modes: tuple[str, ...] = MODES) -> None:
    """Write the texts' forms, their postings and the terms' counts for ``modes`` below ``path``.

    Texts are in ``parts`` folders by the hash of their id, so that a search reads those with candidates only. Postings
    are in order of term and id, so a look-up skips all files and row groups whose range does not hold the
    term, and a term that a third of the texts hold is spread over several files. What is written last marks the index as whole.
    """
    spark = texts.sparkSession
    for form in sorted({FORM[m] for m in modes}):
        mode = next(m for m in modes if FORM[m] == form)
        at = f"{path}/{form}"
        held = _held(texts, mode).withColumn("part", F.pmod(F.xxhash64("record_id"), F.lit(parts)).cast("int"))
        held.repartition(parts, "part").sortWithinPartitions("part", *KEYS).write.partitionBy("part").parquet(f"{at}/texts")
        held = spark.read.schema(held.schema).parquet(f"{at}/texts")
        posts = held.select("part", *KEYS, F.explode(F.concat(tokens("form", normalised=True), symbols("form"))).alias("token"))
        write_postings(posts, f"{at}/postings", parts)
        counts = spark.read.schema(posts.schema).parquet(f"{at}/postings").groupBy("token").agg(F.count("*").alias("n"))
        counts.repartitionByRange(max(1, parts // 8), "token").sortWithinPartitions("token").write.parquet(f"{at}/terms")
        held.agg(F.count("*").alias("n_texts"), *(F.max(c).alias(c) for c in KEYS)).write.parquet(f"{at}/ready")  # one row, which also tells the keys' types


def _read_index(spark: SparkSession, path: str, mode: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Texts, postings and terms' counts; an index of no texts has no files to tell their columns."""
    at = f"{path}/{FORM[mode]}"
    types = dict(spark.read.parquet(f"{at}/ready").dtypes)
    keys = ", ".join(f"{c} {types[c]}" for c in KEYS)
    read = lambda name, schema: spark.read.schema(schema).parquet(f"{at}/{name}")
    return read("texts", f"{keys}, form string, part int"), read("postings", f"part int, {keys}, token string"), read("terms", "token string, n bigint")


def index_health(spark: SparkSession, path: str, mode: str) -> str:
    """``ready``, or ``missing`` where no whole index of the mode's form is there."""
    _form(mode)
    whole = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{FORM[mode]}/ready/_SUCCESS")
    return "ready" if whole.getFileSystem(spark._jsc.hadoopConfiguration()).exists(whole) else "missing"


def search_index(spark: SparkSession, path: str, phrases: DataFrame | dict[str, str], mode: str = "zh_ngram_phrase") -> DataFrame:
    """:func:`phrase_matches` by the index at ``path``. phrases: phrase_id and phrase, as a frame or a dictionary."""
    form = _form(mode)
    texts, posts, counts = _read_index(spark, path, mode)
    if isinstance(phrases, DataFrame):
        rows = phrases.select("phrase_id", "phrase").limit(BROADCAST_PHRASES + 1).collect()
        if len(rows) > BROADCAST_PHRASES:  # too many to broadcast: all terms are wanted anyway
            asked = phrases.select("phrase_id", form("phrase").alias("phrase"))
            return phrase_matches(texts.select(*KEYS, F.col("form").alias("text")), asked, "literal_raw")
        phrases = {r[0]: r[1] for r in rows}
    wants = {k: (v if FORM[mode] == "raw" else search_form_of(v)) for k, v in phrases.items() if v is not None}
    terms = {k: phrase_terms(w) for k, w in wants.items() if w.strip(" ")}
    every = sorted({t for ts in terms.values() for t in ts})
    counts = counts.where(F.col("token").isin(every)) if len(every) <= 1000 else counts.join(F.broadcast(spark.createDataFrame(pa.table({"token": every}))), "token")
    often = dict(tuple(r) for r in counts.collect()) if every else {}
    rarest = [(k, wants[k], min(ts, key=lambda t: (often[t], t))) for k, ts in terms.items() if all(t in often for t in ts)]
    total = sum(often[t] for _, _, t in rarest)
    ids = pa.int64() if any(isinstance(k, int) for k in phrases) else pa.string()
    columns = zip(*rarest) if rarest else ((), (), ())
    asked = spark.createDataFrame(pa.table([pa.array(c, t) for c, t in zip(columns, (ids, pa.string(), pa.string()))], names=["phrase_id", "want", "token"]))  # a local relation: no job
    if len(rarest) <= 1000:
        posts = posts.where(F.col("token").isin(sorted({t for _, _, t in rarest})))
    found = posts.join(F.broadcast(asked), "token").drop("token")
    return _scored(texts.join(F.broadcast(found) if total <= BROADCAST_CANDIDATES else found, ["part", *KEYS]))


def index_report(spark: SparkSession, path: str, phrases: DataFrame, mode: str = "zh_ngram_phrase", texts: DataFrame | None = None) -> DataFrame:
    """(phrase_id, status, total_count): the states of a search by an index that may be missing.

    ``success`` or ``empty`` by the index; ``degraded`` where it is missing and ``texts`` were searched through instead;
    ``failed``, with no count, where there are no texts either.
    """
    ready = index_health(spark, path, mode) == "ready"
    if not ready and texts is None:
        return phrases.select("phrase_id", F.lit("failed").alias("status"), F.lit(None).cast("long").alias("total_count"))
    hits = phrase_hits(search_index(spark, path, phrases, mode) if ready else phrase_matches(texts, phrases, mode))
    out = phrases.select("phrase_id").join(hits.groupBy("phrase_id").agg(F.count("*").alias("n")), "phrase_id", "left").select("phrase_id", F.coalesce("n", F.lit(0)).alias("total_count"))
    status = F.when(F.col("total_count") > 0, "success").otherwise("empty") if ready else F.lit("degraded")
    return out.select("phrase_id", status.alias("status"), "total_count")


def weight(field: str) -> Column:
    pairs = [x for k, v in FIELD_WEIGHTS.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(field)), F.lit(OTHER_WEIGHT))


def phrase_hits(matches: DataFrame) -> DataFrame:
    """(phrase_id, record_id, score, n_matches): one row for each hit."""
    return matches.groupBy("phrase_id", "record_id").agg(F.max("score").alias("score"), F.count("*").alias("n_matches"))


def page(hits: DataFrame, limit: int = 50, offset: int = 0, by: str = "phrase_id") -> DataFrame:
    """One page of each result: rank (from offset + 1), total_count and next_offset (null at the end).

    Spark prunes the ranking before its shuffle (window group limit), so a phrase found
    in a third of all records sends each task's best rows only.
    """
    validate_page(limit, offset)
    order = Window.partitionBy(by).orderBy(F.desc("score"), "record_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(f"rank <= {offset + limit}").where(f"rank > {offset}")
    total = hits.groupBy(by).agg(F.count("*").alias("total_count"))
    more = F.when(F.col("total_count") > offset + limit, F.lit(offset + limit))
    return ranked.join(total, by).withColumn("next_offset", more)


def search_report(texts: DataFrame, phrases: DataFrame, filters_ok: DataFrame | None = None, mode: str = "zh_ngram_phrase") -> DataFrame:
    """(phrase_id, status, empty_reason, total_count): success, or empty with the reason.

    filters_ok: record_ids that pass the metadata filters. The reasons are no_records, filter_mismatch (found, but
    filtered away, or nothing passes) and no_literal_match.
    """
    hits = phrase_hits(phrase_matches(texts, phrases, mode))
    kept = hits if filters_ok is None else hits.join(filters_ok.select("record_id"), "record_id", "left_semi")
    counts = hits.groupBy("phrase_id").agg(F.count("*").alias("found")).join(kept.groupBy("phrase_id").agg(F.count("*").alias("total_count")), "phrase_id", "left")
    empty = texts.limit(1).count() == 0
    out = phrases.select("phrase_id").join(counts, "phrase_id", "left").withColumn("total_count", F.coalesce("total_count", F.lit(0)))
    reason = F.when(F.col("total_count") > 0, F.lit(None)).when(F.lit(empty), "no_records").when(F.col("found") > 0, "filter_mismatch").otherwise("no_literal_match")
    return out.select("phrase_id", F.when(F.col("total_count") > 0, "success").otherwise("empty").alias("status"), reason.cast("string").alias("empty_reason"), "total_count")
