import datetime as dt

import pytest
from pyspark.sql import functions as F

from tarnbeck.operators import documents, graph, integrity, ranking, registry, taxonomy, versions
from tarnbeck.operators.hierarchy import hierarchy


def rows(df, *cols):
    return {tuple(r[c] for c in cols or df.columns) for r in df.collect()}


# -- graph -----------------------------------------------------------------------------------
def edges(spark, *pairs, verdict="applicable"):
    return spark.createDataFrame([(f"e{i:02}", a, b, verdict) for i, (a, b) in enumerate(pairs)], "edge_id string, src string, dst string, verdict string")


def test_closure(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("b", None), ("a", "c"))
    assert rows(graph.closure(e, spark.createDataFrame([("a",), (None,)], "id string"))) == {("a", 0), ("b", 1), ("c", 1)}
    assert rows(graph.closure(e.limit(0), spark.createDataFrame([("a",)], "id string"))) == {("a", 0)}


def test_closure_of_a_long_chain(spark):
    seed = spark.createDataFrame([(0,)], "id long")
    chain = spark.range(70).selectExpr("id as src", "id + 1 as dst").coalesce(1)
    assert rows(graph.closure(chain, seed)) == {(i, i) for i in range(71)}
    short = chain.where("src < 3")
    assert rows(graph.closure(short, seed, max_depth=3)) == {(i, i) for i in range(4)}
    with pytest.raises(ValueError):
        graph.closure(short, seed, max_depth=2)


def test_expand(spark):
    start = spark.createDataFrame([("A",)], "id string")
    reached, left = graph.expand(edges(spark, ("A", "B"), ("B", "A")), start)
    assert rows(reached, "node", "depth") == {("A", 0), ("B", 1)} and rows(left, "reason") == {("CYCLE",)}
    reached, left = graph.expand(edges(spark, ("A", "B"), ("A", "C"), ("B", "D"), ("C", "D")), start)
    assert rows(reached, "node", "depth") == {("A", 0), ("B", 1), ("C", 1), ("D", 2)} and left.count() == 0
    chain = edges(spark, ("A", "B"), ("B", "C"), ("C", "D"))
    reached, left = graph.expand(chain, start, max_depth=1)
    assert rows(reached, "node") == {("A",), ("B",)} and rows(left, "dst", "reason") == {("C", "DEPTH_BUDGET")}
    reached, left = graph.expand(edges(spark, ("A", "B"), ("A", "C"), ("A", "D")), start, max_nodes=2)
    assert rows(reached, "node") == {("A",), ("B",)} and rows(left, "dst", "reason") == {("C", "NODE_BUDGET"), ("D", "NODE_BUDGET")}
    assert rows(graph.expand(edges(spark, ("A", "B"), verdict="unknown"), start)[1], "reason") == {("UNKNOWN",)}


def test_broken_edges(spark):
    e = edges(spark, ("a", "b"), ("a", "b"), ("a", "a"), ("z", "a"), ("a", "q")).drop("verdict")
    n = spark.createDataFrame([("a",), ("b",)], "id string")
    assert rows(graph.broken_edges(e, n), "code", "edge_id") == {("DUPLICATE_LINK", "e00"), ("SELF_LINK", "e02"), ("MISSING_SOURCE", "e03"), ("MISSING_TARGET", "e04")}


def test_greedy_context(spark):
    b = spark.createDataFrame([("p", f"b{i}", i, n) for i, n in enumerate([5, 9, 3, 1])] + [("q", "c", 0, 99)], "p string, b string, o int, n int")
    out = documents.context(b, "p", "b", "o", "n", 10, 9)
    assert rows(out) == {("p", "b0", True), ("p", "b1", False), ("p", "b2", True), ("p", "b3", True), ("q", "c", False)}
    assert rows(documents.context(b, "p", "b", "o", "n", 2, 99).where("p = 'p'"), "b", "kept") == {("b0", True), ("b1", True), ("b2", False), ("b3", False)}


# -- taxonomy --------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def tree(spark):
    return hierarchy(spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "a")], "child_id string, parent_id string"))


def test_inheritance(spark, tree):
    s = spark.createDataFrame([("a", "applicable"), ("b", "not_applicable"), ("c", "applicable")], "node string, state string")
    assert rows(taxonomy.inherited_states(tree, s)) == {("a", "applicable"), ("b", "not_applicable"), ("c", "not_applicable"), ("d", "unknown")}
    r = spark.createDataFrame([("a", "R1"), ("b", "R2")], "node string, requirement_id string")
    assert rows(taxonomy.inherited_requirements(tree, r).where("node = 'c'")) == {("c", "R1", "a", 2), ("c", "R2", "b", 1)}
    marked = spark.createDataFrame([("a",), ("b",)], "id string")
    assert rows(taxonomy.nearest_ancestor(tree, marked)) == {("a", "a", 0), ("b", "b", 0), ("c", "b", 1), ("d", "a", 1)}


def test_shared(spark):
    m = spark.createDataFrame([("g", "x", 1), ("g", "y", 1), ("g", "x", 2), ("g", "x", 1), ("h", "z", 3), (None, "x", 1)], "g string, b string, i int")
    assert rows(taxonomy.shared_members(m, "g", "b", "i")) == {("g", 1), ("h", 3)}


# -- versions --------------------------------------------------------------------------------
POLICY = "family string, version_id string, lower int, lower_inclusive boolean, upper int, upper_inclusive boolean"


@pytest.mark.parametrize(
    "policies, day, want",
    [
        ([("f", "v1", 0, True, 10, False), ("f", "v2", 10, True, None, None)], 9, ("applicable", "v1")),
        ([("f", "v1", 0, True, 10, False), ("f", "v2", 10, True, None, None)], 10, ("applicable", "v2")),
        ([("f", "v1", 0, True, 10, True), ("f", "v2", 10, True, None, None)], 10, ("conflicting", None)),
        ([("f", "v1", 0, True, 10, None)], 10, ("unknown", None)),
        ([("f", "v1", 9, True, 3, True)], 5, ("unknown", None)),
        ([("f", "v1", 0, True, 3, True)], 5, ("not_applicable", None)),
        ([("f", "v1", 0, True, 3, True)], None, ("unknown", None)),
        ([("g", "v1", 0, True, 3, True)], 1, ("unknown", None)),
    ],
)
def test_resolve(spark, policies, day, want):
    d = spark.createDataFrame([("case", "f", day)], "case_id string, family string, business_date int")
    out = versions.resolve(versions.policy_states(d, spark.createDataFrame(policies, POLICY)), d).first()
    assert (out["state"], out["version_id"]) == want


def test_windows_and_bindings(spark):
    v = spark.createDataFrame([("f", "v1", 1), ("f", "v2", 5), ("f", "v3", 5), ("g", "w", None)], "family string, v string, d int")
    assert rows(versions.windows_from_dates(v, "family", "d", "v"), "version_id", "lower", "upper") == {("v1", 1, 5), ("v2", 5, None), ("v3", 5, None)}
    refs = spark.createDataFrame([("1", "A-2020", "A", True), ("2", "A", "A", False), ("3", "B", "B", False), ("4", "C-1999", "C", True)], "reference_id string, designation string, family string, dated boolean")
    have = spark.createDataFrame([("A1", "A-2020", "A"), ("A2", "A-2021", "A"), ("B1", "B-2000", "B")], "version_id string, designation string, family string")
    assert rows(versions.bind_references(refs, have)) == {("1", "bound", "A1", 1), ("2", "ambiguous", None, 2), ("3", "bound", "B1", 1), ("4", "unbound", None, 0)}
    f = spark.createDataFrame([("a", 1, True), ("a", 1, True), ("b", 1, True), ("b", 2, True), ("c", 1, False), ("d", None, True)], "k string, v int, ok boolean")
    assert rows(versions.fold_dates(f, ["k"], "v", "ok")) == {("a", "applicable", 1), ("b", "conflicting", None), ("c", "unknown", None), ("d", "unknown", None)}


# -- registry --------------------------------------------------------------------------------
def test_registry(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1), ("n", None)], "k string, v int")
    new = spark.createDataFrame([("a", 1), ("b", 2), ("c", 1), ("c", 1), ("d", 1), ("d", 2), ("n", None), (None, 1)], "k string, v int")
    assert rows(registry.compare_incoming(old, new, ["k"], ["v"])) == {("a", "duplicate"), ("b", "conflict"), ("c", "new"), ("d", "conflict"), ("n", "duplicate")}
    assert rows(registry.insert_absent(old, new, ["k"]), "k") == {("c",), ("d",)}
    claims = spark.createDataFrame([(1, "x", "t"), (2, "x", "u"), (3, "x", None), (4, "x", ""), (5, "y", "")], "o int, k string, title string")
    assert rows(registry.first_wins(claims, "k", ["o"], ["title"]), "o", "conflict") == {(1, False), (2, True), (3, False), (4, False), (5, False)}
    log = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("k", 3, "a"), ("m", 1, "a"), ("", 1, "z"), (None, 1, "z")], "k string, t int, v string")
    assert rows(registry.latest(log, "k", ["t"], "v")) == {("k", "a"), ("m", "a")}
    assert rows(registry.transitions(log.where("k != ''"), "k", ["t"], "v")) == {("a", "b", 1), ("b", "a", 1)}
    assert rows(registry.outcome_counts(log, [], "v", ["a", "b"])) == {(3, 1, 2, 0)}
    revisions = spark.createDataFrame([("r1", None), ("r2", "r1"), ("r3", "r1"), ("r4", "gone")], "id string, prev string")
    assert rows(registry.revision_errors(revisions, "id", "prev")) == {("BRANCHED", "r1"), ("PREVIOUS_MISSING", "r4")}


@pytest.mark.parametrize("width", [1, 3, 100])
def test_previous_in_buckets_equals_one_sort(spark, width):
    d = spark.createDataFrame([("hot" if i % 3 else f"k{i % 7}", (i * 37) % 101, str(i)) for i in range(120)] + [(None, 5, "n"), (None, 6, "m")], "k string, t int, v string")
    plain = registry.with_previous(d, "k", ["t", "v"], "v")
    assert rows(registry.with_previous(d, "k", ["t", "v"], "v", F.floor(F.col("t") / width)), "k", "t", "v", "previous") == rows(plain, "k", "t", "v", "previous")
    assert rows(registry.transitions(d, "k", ["t", "v"], "v", F.floor(F.col("t") / width))) == rows(registry.transitions(d, "k", ["t", "v"], "v"))


def test_tiers(spark):
    left = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "k string")
    t = lambda *r: spark.createDataFrame(list(r), "k string, target string")
    out = registry.bind_in_tiers(left, "k", [t(("a", "1"), ("b", "1"), ("b", "2")), t(("a", "9"), ("c", "3"), ("c", "3"))])
    assert rows(out) == {("a", "1", 1), ("b", None, 1), ("c", "3", 2), ("d", None, None)}


# -- integrity -------------------------------------------------------------------------------
def test_integrity(spark):
    m = spark.createDataFrame([("g", "a"), ("g", "b"), ("g", "b"), ("h", None)], "g string, m string")
    again = spark.createDataFrame([("g", "b"), ("g", "a")], "g string, m string")
    one, two = integrity.set_hash(m, ["g"], F.col("m")).collect(), integrity.set_hash(again, ["g"], F.col("m")).collect()
    assert one == two and one[0]["n_members"] == 2
    a = spark.createDataFrame([("x", "1"), ("y", "1"), ("z", "1")], "k string, h string")
    b = spark.createDataFrame([("x", "1"), ("y", "2"), ("w", "1")], "k string, h string")
    assert rows(integrity.verify_manifest(a, b, "k", "h")) == {("x", "verified"), ("y", "mismatch"), ("z", "missing"), ("w", "unlisted")}
    assert rows(integrity.snapshot_diff(a, b, ["k"], ["h"])) == {("y", "changed"), ("z", "removed"), ("w", "added")}
    uses = spark.createDataFrame([("x", True), ("x", False), ("y", False), ("y", None)], "k string, on boolean")
    assert rows(integrity.coverage(a, "k", uses, "on")) == {("x", "retrievable", 2), ("y", "context_only", 2), ("z", "uncovered", None)}
    assert rows(integrity.violations({"A": a.where("k = 'x'").select("k"), "B": b.select("k").where("k = 'q'")})) == {("A", "x")}
    sha = "ab" * 32
    f = spark.createDataFrame([(sha, f"objects/ab/{sha}", "m"), (sha, "objects/xx", "m"), ("short", None, "m"), (None, None, "m")], "asset_id string, storage_key string, media_type string")
    assert [r["status"] for r in integrity.file_check(f).collect()] == ["ok", "misplaced", "malformed_id", "malformed_id"]


# -- ranking ---------------------------------------------------------------------------------
def test_ranking(spark):
    names = spark.createDataFrame([("1", "苹果汁"), ("2", "果汁"), ("3", "果汁糖"), ("4", None)], "name_id string, name string")
    terms = spark.createDataFrame([("果汁",), ("果汁",), ("苹果",), ("汁",), (None,)], "term string")
    s = ranking.name_scores(names, terms)
    assert rows(s) == {("果汁", "2", 100), ("果汁", "1", 83), ("果汁", "3", 76), ("苹果", "1", 76)}
    assert rows(ranking.decide(s, "term")) == {("果汁", "name_match", "2", 3), ("苹果", "name_match", "1", 1)}
    assert rows(ranking.top_k(s, ["term"], [F.desc("score"), F.col("name_id")], 1), "term", "name_id") == {("果汁", "2"), ("苹果", "1")}
    p = spark.createDataFrame([(["1"], False), (["1", "2"], False), (["1", "2", "3"], True), (["1", "4"], True), (["9"], False)], "path array<string>, done boolean")
    assert {("/".join(r["path"]), r["n_resolved"]) for r in ranking.prefix_descendants(p, "done").collect()} == {("1", 2), ("1/2", 1), ("9", 0)}


# -- documents -------------------------------------------------------------------------------
def test_ranges(spark):
    d = spark.createDataFrame([("a", n) for n in (1, 2, 2, 4, 7, 8)] + [("b", None)], "k string, n int")
    assert rows(documents.line_ranges(d, ["k"], "n")) == {("a", 1, 2), ("a", 4, 4), ("a", 7, 8)}
    r = spark.createDataFrame([("a", 1, 9), ("a", 2, 3), ("a", 10, 12), ("a", 14, 14), ("a", 9, 2)], "k string, x int, y int")
    assert rows(documents.merge_ranges(r, ["k"], "x", "y")) == {("a", 1, 12), ("a", 14, 14)}


def test_markdown_tables(spark):
    text = "表 1 限量\n| 项目 | 要求 |\n|---|:-:|\n| 铅（mg/kg） | ≤ 0.5 |\n| a\\|b | `x|y` |\n| 短 |\n\n```\n| no | table |\n|---|---|\n```\n| x |\nend"
    lines = documents.text_lines(spark.createDataFrame([("d", text), ("n", None)], "k string, t string"), "k", "t")
    out = documents.markdown_tables(lines, "k")
    assert rows(out, "row_index", "column", "value", "missing") == {
        (0, 0, "项目", False), (0, 1, "要求", False), (1, 0, "铅（mg/kg）", False), (1, 1, "≤ 0.5", False), (2, 0, "a|b", False), (2, 1, "`x|y`", False), (3, 0, "短", False), (3, 1, None, True),
    }
    req = {r["row_index"]: r for r in documents.requirement_rows(out, "k").collect()}
    assert (req[1]["project"], req[1]["unit"], req[1]["comparator"], req[1]["value"]) == ("铅", "mg/kg", "upper_limit", "0.5")


def test_html_tables(spark):
    html = "<table><tr><th rowspan=2>食品</th><th colspan='2'>指标</th></tr><tr><th>上限</th><th>单位</th></tr><tr><td>汁<br>饮</td><td></td><td>g<table><tr><td>in</td></tr></table></td></tr></table>"
    df = spark.createDataFrame([(1, html), (2, None), (3, "no table"), (4, "<table><tr><td rowspan='x'>a</table>")], "k int, h string")
    out = documents.html_tables(df, "k", "h")
    assert rows(out.where("k = 1"), "row_index", "column", "value", "inherited") == {
        (0, 0, "食品", False), (0, 1, "指标", False), (0, 2, "指标", True), (1, 0, "食品", True), (1, 1, "上限", False), (1, 2, "单位", False), (2, 0, "汁\n饮", False), (2, 1, "", False), (2, 2, "g", False),
    }
    assert rows(out.where("k > 1"), "k", "value") == {(4, "a")}


def test_continuations(spark):
    t = spark.createDataFrame([("d", 1, "表 1 限量", "a|b"), ("d", 2, "表 1（续）", "a|b"), ("d", 3, "表 2（续）", "a"), ("d", 4, "表 1（续）", "x"), ("d", 5, "无", "a")], "k string, table_no int, caption string, header string")
    assert rows(documents.merge_continuations(t, "k")) == {("d", 2, 1), ("d", 3, None), ("d", 4, None)}


def test_sections(spark):
    lines = documents.text_lines(spark.createDataFrame([("d", "前言\n1 范围\n内容\n1.1 细则\nA.1 附录")], "k string, t string"), "k", "t")
    assert rows(documents.sections(lines, "k"), "heading", "first", "last") == {(None, 1, 1), ("1 范围", 2, 3), ("1.1 细则", 4, 4), ("A.1 附录", 5, 5)}


def test_limit_conflicts(spark):
    d = spark.createDataFrame([("a", "铅", "mg", "upper_limit", "1"), ("a", "铅", "mg", "upper_limit", "2"), ("a", "糖", "g", "lower_limit", "5"), ("a", "糖", "g", "upper_limit", "3"), ("a", "盐", "g", "upper_limit", "3.0"), ("a", "盐", "g", "upper_limit", "3"), ("a", "水", "g", "upper_limit", "x")], "k string, p string, unit string, comparator string, value string")
    assert rows(documents.limit_conflicts(d, ["k", "p"])) == {("a", "铅", "mg", "different_values"), ("a", "糖", "g", "crossing")}


def test_fill_down(spark):
    d = spark.createDataFrame([("a", 1, None), ("a", 2, "x"), ("a", 3, None), ("b", 1, None)], "k string, o int, v string")
    assert rows(taxonomy.fill_down(d, "v", ["k"], ["o"], "f"), "k", "o", "f") == {("a", 1, None), ("a", 2, "x"), ("a", 3, "x"), ("b", 1, None)}


def test_dates_are_ntz(spark):
    assert spark.createDataFrame([(dt.datetime(2025, 1, 1),)], "t timestamp_ntz").first()["t"].year == 2025
