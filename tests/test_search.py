import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnbeck.functions import text as tx
from tarnbeck.operators import evaluation, search
from tarnbeck.operators.search import QueryError

TEXTS = "record_id string, field string, ord int, text string"
CORPUS = [("apple", "name", 0, "苹果"), ("juice", "name", 0, "苹果汁"), ("split", "body", 0, "苹果与果汁分别记载"), ("alkali", "name", 0, "总 碱 量"), ("formula", "name", 0, "Na₂CO₃")]
EXPECTED = {"苹果汁": {"juice"}, "苹果": {"apple", "juice", "split"}, "总碱量": {"alkali"}, "Na2CO3": {"formula"}, "未知短语": set()}


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(CORPUS, TEXTS)


def phrases(spark, *texts):
    return spark.createDataFrame([(t, t) for t in texts], "phrase_id string, phrase string")


def found(df):
    out = {}
    for r in search.phrase_hits(df).collect():
        out.setdefault(r["phrase_id"], set()).add(r["record_id"])
    return out


@pytest.mark.parametrize("mode", ["normalized_phrase", "zh_ngram_phrase"])
def test_closed_corpus(spark, corpus, mode):
    got = found(search.phrase_matches(corpus, phrases(spark, *EXPECTED), mode))
    assert {q: got.get(q, set()) for q in EXPECTED} == EXPECTED


def test_literal_mode(spark, corpus):
    got = found(search.phrase_matches(corpus, phrases(spark, *EXPECTED), "literal_raw"))
    assert got == {"苹果汁": {"juice"}, "苹果": {"apple", "juice", "split"}}


def test_kinds_and_scores(spark, corpus):
    rows = {r["record_id"]: (r["kind"], r["score"]) for r in search.phrase_matches(corpus, phrases(spark, "苹果")).collect()}
    assert rows == {"apple": ("exact_name", 1100), "juice": ("related_name", 100), "split": ("phrase_evidence", 20)}


def test_every_substring(spark):
    texts = [("a", "body", 0, "单项依据GB1886.1-2020判定，-18 °C。"), ("b", "title", 1, "x/y_z 12"), ("c", "body", 0, None), ("d", "body", 0, "")]
    df = spark.createDataFrame(texts, TEXTS)
    parts = sorted({t[3][i : i + n] for t in texts if t[3] for n in (1, 2, 3, 6) for i in range(len(t[3]) - n + 1) if t[3][i : i + n].strip()})
    got = found(search.phrase_matches(df, phrases(spark, *parts), "literal_raw"))
    assert got == {p: {t[0] for t in texts if t[3] and p in t[3]} for p in parts}


def test_many_phrases_take_the_other_way(spark, corpus, monkeypatch):
    monkeypatch.setattr(search, "BROADCAST_PHRASES", 1)
    got = found(search.phrase_matches(corpus, phrases(spark, *EXPECTED)))
    assert {q: got.get(q, set()) for q in EXPECTED} == EXPECTED


def test_null_and_repeated_phrases(spark, corpus):
    asked = spark.createDataFrame([("n", None), ("e", ""), ("b", "  "), ("q", "苹果"), ("q", "苹果")], "phrase_id string, phrase string")
    assert found(search.phrase_matches(corpus, asked)) == {"q": {"apple", "juice", "split"}}
    assert search.phrase_matches(corpus.limit(0), asked).count() == 0


def test_pages(spark, corpus):
    hits = search.phrase_hits(search.phrase_matches(corpus, phrases(spark, "苹果")))
    page = {r["record_id"]: (r["rank"], r["total_count"], r["next_offset"]) for r in search.page(hits, 2, 0).collect()}
    assert page == {"apple": (1, 3, 2), "juice": (2, 3, 2)}
    assert [(r["record_id"], r["rank"], r["next_offset"]) for r in search.page(hits, 2, 2).collect()] == [("split", 3, None)]


def test_candidates_are_a_superset(spark, corpus):
    asked = phrases(spark, *EXPECTED)
    index = search.postings(corpus)
    cand = {}
    for r in search.candidates(index, asked).collect():
        cand.setdefault(r["phrase_id"], set()).add(r["record_id"])
    assert all(want <= cand.get(q, set()) for q, want in EXPECTED.items())


def test_postings_on_disk(spark, corpus, tmp_path):
    search.write_postings(search.postings(corpus), str(tmp_path / "p"), 3)
    assert spark.read.parquet(str(tmp_path / "p")).where("token = 'g:苹果'").count() == 3


@pytest.mark.parametrize("bad", [{"x": "1"}, {"a": []}, {"a": list(range(101))}])
def test_bad_filters(bad):
    with pytest.raises(QueryError):
        search.prepare_filters(bad, {"a"})


@pytest.mark.parametrize("limit, offset", [(0, 0), (1001, 0), (5, -1), (True, 0), (1.5, 0)])
def test_bad_pages(limit, offset):
    with pytest.raises(QueryError):
        search.validate_page(limit, offset)


@pytest.mark.parametrize("phrase", ["", "  ", "a\x00", "x" * 257, None])
def test_bad_phrases(phrase):
    with pytest.raises(QueryError):
        search.validate_phrase(phrase)


def test_filters(spark):
    rows = [("1", "a", ["x", "y"]), ("2", "a", []), ("3", None, ["x"]), ("4", "b", ["x"]), ("5", "", None), ("6", "a", ["z"])]
    df = spark.createDataFrame(rows, "id string, k string, many array<string>")
    out = {r["id"]: (r["filter_ok"], r["filter_missing"]) for r in search.filter_verdict(df, {"k": ["a"], "many": ["x"]}).collect()}
    assert out == {"1": (True, []), "2": (False, ["many"]), "3": (False, ["k"]), "4": (False, []), "5": (False, ["k", "many"]), "6": (False, [])}
    assert {r["key"]: r["n"] for r in search.metadata_unknown(df, {"k": ["a"], "many": ["x"]}).collect()} == {"k": 2, "many": 2}
    assert [r["id"] for r in search.exact_search(df, {"k": ["a"], "many": ["x"]}).collect()] == ["1"]


def test_report(spark, corpus):
    asked = phrases(spark, "苹果汁", "未知短语", "总碱量")
    ok = spark.createDataFrame([("juice",)], "record_id string")
    got = {r["phrase_id"]: (r["status"], r["empty_reason"], r["total_count"]) for r in search.search_report(corpus, asked, ok).collect()}
    assert got == {"苹果汁": ("success", None, 1), "未知短语": ("empty", "no_literal_match", 0), "总碱量": ("empty", "filter_mismatch", 0)}
    assert {r["empty_reason"] for r in search.search_report(corpus.limit(0), asked).collect()} == {"no_records"}


def test_metrics(spark):
    labels = spark.createDataFrame([("q", "a", True), ("q", "b", True), ("q", "juice", False), ("p", "z", True)], "query_id string, record_id string, relevant boolean")
    runs = spark.createDataFrame([("q", "s", "success", 10.0), ("p", "s", "failed", 20.0)], "query_id string, strategy string, status string, latency_ms double")
    hits = spark.createDataFrame([("q", "s", 1, "a"), ("q", "s", 2, "juice"), ("q", "s", 3, "other"), ("q", "s", 4, "b"), ("p", "s", 1, "z")], "query_id string, strategy string, rank int, record_id string")
    m = {r["query_id"]: r for r in evaluation.query_metrics(runs, hits, labels, 3).collect()}
    q = m["q"]
    assert (q["recall"], round(q["precision_lower"], 6), round(q["precision_upper"], 6), q["judged_precision"], round(q["coverage"], 6)) == (0.5, 0.333333, 0.666667, 0.5, 0.666667)
    assert m["p"]["recall"] == 0 and m["p"]["precision_lower"] is None
    s = evaluation.strategy_summary(evaluation.query_metrics(runs, hits, labels, 3)).first()
    assert (s["n_expected"], s["n_relevant"], s["n_failed"], s["mean_latency_ms"], s["max_latency_ms"]) == (3, 1, 1, 15.0, 20.0)
    bad = labels.unionByName(spark.createDataFrame([("q", "a", False)], labels.schema))
    assert {tuple(r) for r in evaluation.label_errors(bad, hits.unionByName(hits.where("rank = 1").withColumn("rank", F.lit(9)))).collect()} == {("LABEL_OVERLAP", "q", "a"), ("DUPLICATE_HIT", "q", "a"), ("DUPLICATE_HIT", "p", "z")}


@pytest.mark.parametrize("mode", search.MODES)
def test_phrase_in_a_long_word(spark, mode):
    texts = spark.createDataFrame([("long", "body", 0, "编号" + "x" * 1200 + "QZ7" + "y" * 300 + "结束"), ("short", "body", 0, "QZ7")], TEXTS)
    assert found(search.phrase_matches(texts, phrases(spark, "QZ7", "xQ", "号x"), mode)) == {"QZ7": {"long", "short"}, "xQ": {"long"}, "号x": {"long"}}
    terms = {r["token"] for r in search.postings(texts.where("record_id = 'long'")).collect()}
    assert "b:QZ" in terms and "a:7" in terms and not any(t.startswith("w:") for t in terms)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="苹果汁aB1_./- 　－①ｇéア、。𩽾\u0301", max_size=12), min_size=20, max_size=40))
def test_terms_of_a_phrase_without_a_job(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", tx.search_form("t").alias("form"), tx.tokens("t", query=True).alias("terms"), tx.symbols(tx.search_form("t")).alias("symbols")).collect()
    for r in rows:
        assert tx.search_form_of(r["t"]) == r["form"]
        assert tx.phrase_terms(r["form"]) == (list(r["terms"]) or sorted(set(r["symbols"])))


@pytest.mark.parametrize("mode", search.MODES)
def test_index_equals_search_without_one(spark, tmp_path, monkeypatch, mode):
    texts = [("a", "body", 0, "单项依据GB1886.1-2020判定，-18 °C。"), ("b", "title", 1, "x/y_z 12"), ("c", "body", 0, None), ("d", "name", 0, "，。、"), ("e", "name", 0, "アイス苹果"), ("e", "body", 1, "苹果，苹果"), ("f", "body", 0, "")]
    corpus = spark.createDataFrame(texts, TEXTS)
    search.build_index(corpus, str(tmp_path / "i"), parts=3, modes=(mode,))
    wanted = {t[i:j] for *_, t in texts if t for i in range(len(t)) for j in range(i + 1, min(len(t), i + 5) + 1)} | {"没有", "", " ", "アz"}
    asked = phrases(spark, *sorted(wanted)).unionByName(spark.createDataFrame([("n", None)], "phrase_id string, phrase string"))
    want = sorted(map(tuple, search.phrase_matches(corpus, asked, mode).select("phrase_id", "record_id", "field", "ord", "kind", "score").collect()))
    cells = ("phrase_id", "record_id", "field", "ord", "kind", "score")
    assert sorted(map(tuple, search.search_index(spark, str(tmp_path / "i"), asked, mode).select(*cells).collect())) == want and len(want) > 100
    monkeypatch.setattr(search, "BROADCAST_PHRASES", 5)
    monkeypatch.setattr(search, "BROADCAST_CANDIDATES", 5)
    assert sorted(map(tuple, search.search_index(spark, str(tmp_path / "i"), asked, mode).select(*cells).collect())) == want
    assert {r["record_id"] for r in search.search_index(spark, str(tmp_path / "i"), {7: "苹果"}, mode).collect()} == {"e"}
    assert search.search_index(spark, str(tmp_path / "i"), {}, mode).count() == search.search_index(spark, str(tmp_path / "i"), {"x": None}, mode).count() == 0


def test_index_of_no_texts_and_states(spark, corpus, tmp_path):
    search.build_index(corpus.limit(0), str(tmp_path / "none"), parts=2)
    asked = phrases(spark, "苹果", "未知短语")
    assert search.search_index(spark, str(tmp_path / "none"), asked).count() == 0
    search.build_index(corpus, str(tmp_path / "i"), parts=2)
    states = lambda df: {r["phrase_id"]: (r["status"], r["total_count"]) for r in df.collect()}
    assert states(search.index_report(spark, str(tmp_path / "i"), asked)) == {"苹果": ("success", 3), "未知短语": ("empty", 0)}
    assert states(search.index_report(spark, str(tmp_path / "x"), asked, texts=corpus)) == {"苹果": ("degraded", 3), "未知短语": ("degraded", 0)}
    assert states(search.index_report(spark, str(tmp_path / "x"), asked)) == {"苹果": ("failed", None), "未知短语": ("failed", None)}
