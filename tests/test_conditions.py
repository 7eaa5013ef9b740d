import json

import pytest
from pyspark.sql import functions as F

from tarnbeck.operators import conditions as c

EQ = {"op": "eq", "field": "process", "value": "熟制"}
RANGE = {"op": "range", "field": "x", "lower": "1", "upper": "5", "lower_inclusive": True, "upper_inclusive": False}


@pytest.mark.parametrize(
    "tree, codes",
    [
        (None, []),
        (EQ, []),
        (RANGE, []),
        ({"op": "all", "args": [EQ, {"op": "not", "arg": EQ}]}, []),
        ({"op": "xor"}, ["CONDITION_OPERATOR"]),
        ({"op": "all", "args": []}, ["CONDITION_SCHEMA"]),
        ({"op": "eq", "field": "a"}, ["CONDITION_SCHEMA"]),
        ({"op": "gt", "field": "a", "value": "b"}, ["CONDITION_TYPE"]),
        ({"op": "gt", "field": "a", "value": "b", "value_type": "number"}, ["CONDITION_VALUE"]),
        ({"op": "in", "field": "a", "value": []}, ["CONDITION_VALUE"]),
        ({**RANGE, "lower": "9"}, ["CONDITION_RANGE"]),
        ({**RANGE, "lower": "5"}, ["CONDITION_RANGE"]),
        ({**RANGE, "lower_inclusive": 1}, ["CONDITION_SCHEMA"]),
        ({"op": "exists", "field": "a", "more": 1}, ["CONDITION_SCHEMA"]),
        ({"op": "all", "args": [EQ] * 101}, ["CONDITION_BUDGET"]),
        ("text", ["CONDITION_SCHEMA"]),
    ],
)
def test_validate(tree, codes):
    assert c.validate(tree) == codes


def test_depth_and_vocabulary():
    deep = EQ
    for _ in range(40):
        deep = {"op": "not", "arg": deep}
    assert c.validate(deep) == ["CONDITION_DEPTH"]
    assert c.validate(EQ, {"other"}) == ["CONDITION_FACT"]
    assert c.fields({"op": "any", "args": [RANGE, EQ, EQ]}) == ["process", "x"]


def state(spark, tree, facts):
    m = F.create_map(*[x for k, v in facts.items() for x in (F.lit(k), F.struct(F.lit(v[0]).alias("state"), F.lit(v[1]).alias("type"), F.lit(v[2]).alias("value")))]) if facts else F.create_map().cast(f"map<string,{c.FACT}>")
    return spark.range(1).select(c.compile_condition(tree, m)).first()[0]


@pytest.mark.parametrize(
    "tree, facts, want",
    [
        (EQ, {}, "unknown"),
        (EQ, {"process": ("known", "string", "熟制")}, "applicable"),
        (EQ, {"process": ("known", "string", "生鲜")}, "not_applicable"),
        (EQ, {"process": ("conflicting", None, None)}, "conflicting"),
        (EQ, {"process": ("known", "number", "1")}, "unknown"),
        ({"op": "not", "arg": EQ}, {"process": ("known", "string", "熟制")}, "not_applicable"),
        ({"op": "not", "arg": EQ}, {}, "unknown"),
        (RANGE, {"x": ("known", "number", "1")}, "applicable"),
        (RANGE, {"x": ("known", "number", "5.0")}, "not_applicable"),
        (RANGE, {"x": ("known", "number", "nan")}, "unknown"),
        ({"op": "ge", "field": "d", "value": "2025-01-01", "value_type": "date"}, {"d": ("known", "date", "2025-01-01")}, "applicable"),
        ({"op": "in", "field": "x", "value": [1, 2.5]}, {"x": ("known", "number", "2.50")}, "applicable"),
        ({"op": "exists", "field": "x"}, {"x": ("known", "set", "a")}, "applicable"),
        ({"op": "all", "args": [EQ, RANGE]}, {"process": ("known", "string", "x")}, "not_applicable"),
        ({"op": "any", "args": [EQ, RANGE]}, {"process": ("known", "string", "熟制")}, "applicable"),
        ({"op": "any", "args": [EQ, RANGE]}, {"process": ("known", "string", "熟制"), "x": ("conflicting", None, None)}, "conflicting"),
        ({"op": "nope"}, {}, "unknown"),
        (None, {}, "applicable"),
    ],
)
def test_compiled(spark, tree, facts, want):
    assert state(spark, tree, facts) == want


def test_wrapped(spark):
    cond = "struct<state:string,ast_json:string,raw:string,required_facts:array<string>,has_evidence:boolean>"
    tree = json.dumps(EQ, ensure_ascii=False)
    hot = {"process": ("known", "string", "熟制")}
    rows = [
        ("ok", ("structured", tree, "", [], True), hot, "applicable"),
        ("no evidence", ("structured", tree, "", [], False), hot, "unknown"),
        ("unresolved", ("unresolved", tree, "", [], True), hot, "unknown"),
        ("partial", ("partial", tree, "", [], True), hot, "unknown"),
        ("partial excludes", ("partial", tree, "", [], True), {"process": ("known", "string", "生")}, "not_applicable"),
        ("unconditional", ("unconditional", None, "", [], True), {}, "applicable"),
        ("needs", ("unconditional", None, "", ["p"], True), {}, "unknown"),
        ("extra missing", ("structured", tree, "", ["p"], True), hot, "unknown"),
        ("extra clash", ("structured", tree, "", ["p"], True), {**hot, "p": ("conflicting", None, None)}, "conflicting"),
        ("bad json", ("structured", "{", "", [], True), hot, "unknown"),
        ("null", None, hot, "unknown"),
    ]
    df = spark.createDataFrame([(a, b, f) for a, b, f, _ in rows], f"id string, condition {cond}, facts map<string,{c.FACT}>")
    got = {r["id"]: r["state"] for r in c.evaluate_wrapped(df, "condition", "facts").collect()}
    assert got == {r[0]: r[3] for r in rows}


def test_fold(spark):
    rows = [
        ("s", "a", "string", "x", "verified", "sample_fact", "r"), ("s", "a", "string", "x", "verified", "sample_fact", "r2"),
        ("s", "b", "string", "x", "verified", "sample_fact", "r"), ("s", "b", "string", "y", "verified", "sample_fact", "r"),
        ("s", "c", "string", "x", "verified", "sample_fact", "r"), ("s", "c", "string", None, "verified", "sample_fact", "r"),
        ("s", "d", "string", "x", "conflicting", "hint", None), ("s", "e", "string", "x", "verified", "hint", "r"), ("s", "f", "string", "x", "unverified", "sample_fact", "r"),
    ]
    df = spark.createDataFrame(rows, "sample string, field string, type string, value string, verification_state string, role string, source_ref string")
    out = c.fold_facts(df, ["sample"], ["sample_fact"])
    assert {r["field"]: (r["state"], r["value"]) for r in out.collect()} == {"a": ("known", "x"), "b": ("conflicting", None), "c": ("unknown", None), "d": ("conflicting", None), "f": ("unknown", None)}
    assert set(c.fact_map(out, ["sample"]).first()["facts"]) == {"a", "b", "c", "d", "f"}
