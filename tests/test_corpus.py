import pytest
from pyspark.sql import functions as F

from tarnbeck.functions import text as tx
from tarnbeck.operators import bundle, corpus, integrity, search

BLOCK = "block_id string, parse_id string, parent_id string, text_raw string, source struct<line_start:int,line_end:int,line_ranges:array<array<int>>,pdf_pages:array<int>>"
GOOD = (1, 3, [[1, 2], [3, 3]], [1, 2])


def test_compose(spark):
    rows = spark.createDataFrame([("a", "x", None), ("a", "x", None), ("b", " ", ""), (None, "y", "z"), ("c", None, "w")], "record_id string, name string, other string")
    part = rows.select("record_id", F.concat(corpus.field("name", "name", F.upper("name")), corpus.field("title", "other")).alias("fields"))
    out = corpus.compose({"one": part, "two": part.where("record_id = 'c'"), "none": part.limit(0)})
    assert {(r["record_id"], r["channel"], r["field"], r["ord"], r["text"]) for r in out.select("*", F.inline("fields")).collect()} == {
        ("a", "one", "name", 0, "x"), ("a", "one", "name", 1, "X"), ("c", "one", "title", 0, "w"), ("c", "two", "title", 0, "w")
    }
    assert corpus.long_texts(out).count() == 4 and {r["record_id"] for r in search.phrase_matches(corpus.long_texts(out), spark.createDataFrame([("p", "w")], "phrase_id string, phrase string")).collect()} == {"c"}
    touched = spark.createDataFrame([("one", "a", 2, ["k"])], "kind string, id string, n_gaps bigint, gap_kinds array<string>")
    assert {(r["record_id"], r["channel"], r["n_gaps"], tuple(r["gap_kinds"])) for r in corpus.with_gaps(out, "record_id", F.col("channel"), touched).collect()} == {("a", "one", 2, ("k",)), ("c", "one", 0, ()), ("c", "two", 0, ())}


def test_dependency_edges(spark):
    df = spark.createDataFrame([("a", "b"), ("a", "b"), ("", "b"), ("a", None)], "x string, y string")
    out = corpus.dependency_edges([("k", "l", df), ("m", "l", df)]).collect()
    assert {tuple(r)[1:] for r in out} == {("k", "a", "l", "b"), ("m", "a", "l", "b")} and len({r["edge_id"] for r in out}) == 2 == len(out)


def test_bundle_issues(spark):
    blocks = [
        ("a", "p", None, "文[^1]: 注", GOOD), ("a", "p", None, "文[^1]: 注", GOOD), ("b", "p", "a", "x", GOOD), ("c", "p", "gone", "x", (2, 1, [[2, 1]], [1])),
        ("d", "p", "e", "x", (1, 3, [[1, 2]], [1])), ("e", "q", "d", "x", (1, 3, [[1, 3]], [1, 1])), ("f", "q", "e", "x", None), ("g", "q", None, "", GOOD), ("h", "q", None, "1", GOOD), ("h", "q", None, "2", GOOD), (None, "q", None, "x", GOOD),
    ]
    chunks = [
        ("1", "p", ["a", "b"], "见[^1]和[^2]", True), ("2", "p", ["e"], r"$$x$$ $$ \tag{1}", True), ("3", "p", [], None, True), ("4", "p", ["zz", "c"], "水分 ≤ |\n其他", False), ("5", "q", None, "≤ 3 $$a$$", True), ("6", "p", ["d"], r"\tag{2} 式中", True),
    ]
    b = spark.createDataFrame(blocks, BLOCK)
    c = spark.createDataFrame(chunks, "chunk_id string, parse_id string, block_ids array<string>, retrieval_text string, retrieval_enabled boolean")
    got = {(r["code"], r["id"]) for r in integrity.violations(bundle.issues(b, c)).toDF("code", "id").collect()}
    assert got == {
        ("BLOCK_ID_INVALID", "h"), ("BLOCK_ID_INVALID", ""), ("PARENT_MISSING", "c"), ("PARENT_CYCLE", "d"), ("PARENT_CYCLE", "e"), ("PARENT_CYCLE", "f"),
        ("LOCATION_INVALID", "c"), ("LOCATION_INVALID", "d"), ("LOCATION_INVALID", "e"), ("LOCATION_INVALID", "f"),
        ("CHUNK_SOURCE_MISSING", "3"), ("CHUNK_SOURCE_MISSING", "4"), ("CHUNK_SOURCE_MISSING", "5"), ("CROSS_PARSE", "2"), ("FOOTNOTE_MISSING", "1"), ("FORMULA_UNBALANCED", "2"),
        ("FORMULA_VARIABLES_MISSING", "2"), ("COMPARISON_VALUE_MISSING", "4"), ("COVERAGE_MISSING", "c"), ("COVERAGE_MISSING", "f"), ("COVERAGE_MISSING", "h"),
    }
    assert integrity.violations(bundle.issues(b.limit(0), c.limit(0))).count() == 0


def test_text_forms(spark):
    df = spark.createDataFrame([("ｆｓ1000—2018", " Ｘ y ", " 2018 ", "酸 奶"), (None, " ", "20", "鲜土豆")], "d string, r string, y string, q string")
    form = lambda k, c: [r[0] for r in df.select(tx.filter_form(k, c)).collect()]
    assert form("designation", "d") == ["FS1000-2018", None] and form("record_id", "r") == ["X y", None] and form("year", "y") == ["2018", None] and form("lang", "r") == ["Xy", None]
    terms = [list(r[0]) for r in df.select(tx.query_terms("q", {"酸奶": "发酵乳", "土豆": "马铃薯"})).collect()]
    assert terms == [["酸奶", "发酵乳"], ["鲜土豆", "土豆", "马铃薯"]] and list(df.select(tx.query_terms("q", {})).first()[0]) == ["酸奶"]
    flags = spark.createDataFrame([("≤ 3",), ("3 mg/kg",), ("限量mg/kg",), ("10 %",), ("文字",), (None,)], "t string")
    assert [len(r[0]) for r in flags.select(tx.review_flags("t")).collect()] == [1, 1, 0, 1, 0, 0]


def test_filters_in_other_spellings(spark):
    df = spark.createDataFrame([(1, "FS 1000-2018"), (2, "FS1000—2018"), (3, "FS 1000"), (4, None)], "id int, designation string")
    assert {r["id"] for r in search.exact_search_forms(df, {"designation": ["fs1000-2018"]}).collect()} == {1, 2}
    with pytest.raises(search.QueryError):
        search.exact_search_forms(df, {"designation": [" "]})
