import pytest
from pyspark.sql import functions as F

from tarnbeck.functions import geometry as g
from tarnbeck.operators import attach, ingest
from tarnbeck.sources import manual


def rows(df, *cols):
    return {tuple(tuple(v) if isinstance(v, list) else v for v in (r[c] for c in cols or df.columns)) for r in df.collect()}


def test_affected_and_lists(spark):
    gaps = spark.createDataFrame([("1", "a"), ("2", "b")], "gap_id string, gap_kind string")
    links = spark.createDataFrame([("1", "v", "x"), ("1", "v", "x"), ("2", "v", "x"), ("2", "w", "y"), ("9", "v", "z"), ("1", None, "q")], "gap_id string, kind string, id string")
    assert rows(attach.affected(gaps, links)) == {("v", "x", 2, ("a", "b")), ("w", "y", 1, ("b",))}
    d = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a"), ("k", 3, None), ("m", 1, "z")], "k string, o int, v string")
    assert rows(attach.ordered_list(d, ["k"], ["o"], "v", "l")) == {("k", ("a", "b", None), 3), ("m", ("z",), 1)}
    assert rows(attach.ordered_list(d, ["k"], ["o"], "v", "l", limit=2)) == {("k", None, 3), ("m", ("z",), 1)}
    assert rows(attach.ordered_rows(d, ["k"], ["o"]), "k", "v", "position") == {("k", "a", 1), ("k", "b", 2), ("k", None, 3), ("m", "z", 1)}
    r = spark.createDataFrame([("a", None), ("b", "a"), ("c", None)], "id string, prev string")
    assert rows(attach.unsuperseded(r, "id", "prev"), "id") == {("b",), ("c",)}


@pytest.mark.parametrize("bucketed", [False, True])
def test_lists_of_any_size(spark, bucketed):
    bucket = F.floor(F.col("o") / 9000) if bucketed else None
    d = spark.range(120_000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise("warm").alias("k"), (F.col("id") * 7919 % 120_000).alias("o")).withColumn("v", F.col("o").cast("string"))
    out = {r["k"]: (r["l"], r["n"]) for r in attach.ordered_list(d.unionByName(d.selectExpr("k || 2 as k", "o", "v").where("o < 5")).unionByName(spark.range(120_000, 160_000).selectExpr("'hot' k", "id o", "string(id) v")), ["k"], ["o"], "v", "l", bucket=bucket).collect()}
    assert out["hot"][1] == 120_000 == len(out["hot"][0]) and out["warm"][1] == 40_000
    assert all(x == sorted(x, key=int) and len(x) == n for x, n in out.values()) and sum(n for _, n in out.values()) == 160_005


def test_exclusions(spark):
    ex = spark.createDataFrame([("o", "hit", "unknown", ["x"], False), ("o", "miss", "unknown", ["y"], True), ("o", "keep", "applicable", ["y"], False), ("p", "none", "unknown", ["x"], True), ("o", "clash", "conflicting", ["x"], False)], "owner string, exclusion_id string, state string, names array<string>, explicit boolean")
    names = spark.createDataFrame([("o", "x", True), ("p", "x", False)], "owner string, name string, verified boolean")
    out = attach.exclusion_states(ex, names)
    assert rows(out, "exclusion_id", "state") == {("hit", "applicable"), ("miss", "not_applicable"), ("keep", "applicable"), ("none", "unknown"), ("clash", "conflicting")}
    c = spark.createDataFrame([("o", "applicable"), ("p", "applicable"), ("q", "applicable")], "owner string, state string")
    assert rows(attach.applicability(c, out.where("exclusion_id != 'clash'"))) == {("o", "not_applicable"), ("p", "unknown"), ("q", "applicable")}


def test_facts_with_sources(spark):
    f = spark.createDataFrame([("1", "b1", "铅 0.5", "铅"), ("2", "b1", "锡", "铅"), ("3", "b9", "x", "铅"), ("4", "b1", "x", "锡")], "fact_id string, block_id string, quote string, project string")
    b = spark.createDataFrame([("b1", "含铅 0.5 mg"), ("b1", "含铅 0.5 mg")], "block_id string, text string")
    assert rows(attach.facts_with_sources(f, b, project=" 铅 "), "fact_id", "status") == {("1", "ok"), ("2", "QUOTE_MISMATCH"), ("3", "BLOCK_MISSING")}
    with pytest.raises(ValueError):
        attach.facts_with_sources(f, b, project=" ")


def test_outcomes(spark):
    d = spark.createDataFrame([("j", 1), ("j", 2), ("j", None), ("k", 3)], "job string, n int")
    out = ingest.with_outcome(d, [(F.col("n").isNull(), "failed"), (F.col("n") == 2, "duplicate")])
    assert rows(ingest.job_status(out, ["job"]), "job", "n_success", "n_duplicate", "n_failed", "status") == {("j", 1, 1, 1, "completed_with_problems"), ("k", 1, 0, 0, "completed")}
    with pytest.raises(ValueError):
        ingest.with_outcome(d, [(F.lit(True), "nope")])


def test_pages_and_retry(spark):
    b = spark.createDataFrame([(1, "NO_TEXT"), (2, "X"), (2, None), (3, None), (4, "NO_TEXT"), (4, None)], "page int, issue string")
    out = ingest.page_status(b, ["page"], F.col("issue"))
    assert rows(out, "page", "status") == {(1, "needs_ocr"), (2, "quarantined"), (3, "ok"), (4, "ok")}
    again = spark.createDataFrame([(2, 2, 0, "ok"), (3, 9, 9, "bad")], out.schema)
    assert rows(ingest.retry(out, again, ["page"], "status"), "page", "n_blocks", "status") == {(1, 1, "needs_ocr"), (2, 2, "ok"), (3, 1, "ok"), (4, 2, "ok")}


def test_nested_strings(spark):
    d = spark.createDataFrame([(1, '{"a":"x","b":["y",{"c":"z"},3,null],"d":{}}'), (2, "no json"), (3, None), (4, '"s"'), (5, "[]")], "id int, j string")
    assert rows(ingest.nested_strings(d, "id", "j")) == {(1, "/a", "x"), (1, "/b/0", "y"), (1, "/b/1/c", "z"), (4, "", "s")}
    assert rows(ingest.nested_strings(d, "id", "j", 1)) == {(1, "/a", "x"), (4, "", "s")}


def test_boxes(spark):
    d = spark.createDataFrame([(1, [0.0, 5.0, 9.0, 8.0]), (2, [3.0, 1.0, 2.0, 4.0]), (3, [1.0]), (4, None), (5, [-1.0, 0.0, 20.0, 3.0])], "id int, b array<double>")
    assert rows(d.select("id", g.valid_box(F.col("b")).alias("v"))) == {(1, True), (2, False), (3, False), (4, None), (5, True)}
    assert d.where("id = 5").select(g.clip(F.col("b"), F.lit(10.0), F.lit(10.0))).first()[0] == [0.0, 0.0, 10.0, 3.0]
    page = F.array(F.lit(0.0), F.lit(0.0), F.lit(10.0), F.lit(10.0))
    assert rows(d.where("id in (1, 5)").select("id", g.inside(F.col("b"), page).alias("i"))) == {(1, True), (5, False)}
    order = d.where("id in (1, 4, 5)").orderBy(*g.reading_order(F.col("b")))
    assert [r["id"] for r in order.collect()] == [5, 1, 4]


def test_manual_package(spark, tmp_path):
    (tmp_path / "m.md").write_text("﻿a\nb\r\nc\nd\n", encoding="utf-8")
    lines = manual.read_lines(spark, str(tmp_path))
    assert rows(lines, "line", "text") == {(1, "a"), (2, "b"), (3, "c"), (4, "d")}
    path = lines.first()["path"]
    pages = lambda *p: spark.createDataFrame([(path, *x) for x in p], "path string, page int, first_line int, last_line int")
    good = pages((1, 1, 2), (2, 3, 4))
    assert manual.page_map_errors(good, lines).count() == 0
    assert rows(manual.lines_with_pages(lines, good), "line", "page") == {(1, 1), (2, 1), (3, 2), (4, 2)}
    assert rows(manual.page_map_errors(pages((1, 1, 2), (2, 2, 3)), lines), "code", "page") == {("OVERLAP", 2)}
    assert rows(manual.page_map_errors(pages((1, 2, 2), (2, 3, 9)), lines), "code", "page") == {("GAP", 1), ("BEYOND_TEXT", 2)}
    assert rows(manual.page_map_errors(pages((1, 1, 3)), lines), "code", "page") == {("UNMAPPED_END", 1)}
