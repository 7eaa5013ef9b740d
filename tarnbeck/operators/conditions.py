"""Conditions over facts: checked, compiled to Catalyst expressions, evaluated in four states.

A condition is a small JSON tree: leaves eq, in, gt, ge, lt, le, range and exists over a
fact, combined by all, any and not. Trees that are data are few next to the rows that
hold them: the distinct ones are compiled once each and picked by a CASE, so rows
never leave the JVM.
"""

from __future__ import annotations

import datetime
import json
from decimal import Decimal, InvalidOperation

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnbeck.functions.scalars import decimal, iso_date
from tarnbeck.functions.states import APPLICABLE, CONFLICTING, NOT_APPLICABLE, UNKNOWN, combine_all, combine_any, invert

COMBINE, LEAVES, ORDERED = ("all", "any", "not"), ("eq", "in", "gt", "ge", "lt", "le", "range", "exists"), ("number", "date")
KINDS = ("string", "number", "boolean", "date")
MAX_DEPTH, MAX_NODES, MAX_CHILDREN = 32, 1000, 100
#: Distinct trees that are compiled into one CASE; more are refused.
MAX_TREES = 2000
#: State, type and value (as text) of a fact.
FACT = "struct<state:string,type:string,value:string>"


def _kind(value: object) -> str:
    return "boolean" if isinstance(value, bool) else "number" if isinstance(value, (int, float, Decimal)) else "set" if isinstance(value, list) else "string"


def _fits(value: object, kind: str) -> bool:
    try:
        if kind == "number":
            return not isinstance(value, (bool, list, dict)) and value is not None and Decimal(str(value)).is_finite()
        if kind == "date":
            return isinstance(value, str) and bool(datetime.date.fromisoformat(value))
        return isinstance(value, bool) if kind == "boolean" else isinstance(value, str) if kind == "string" else False
    except (ValueError, InvalidOperation):
        return False


def validate(tree: object, vocabulary: set[str] | None = None) -> list[str]:
    """Codes of what is wrong with a tree, each once; none for a sound one or for None (unconditional)."""
    codes: list[str] = []
    seen = 0

    def note(code: str) -> None:
        if code not in codes:
            codes.append(code)

    def leaf(node: dict, op: str) -> None:
        name = node.get("field")
        if not isinstance(name, str) or vocabulary is not None and name not in vocabulary:
            note("CONDITION_FACT")
        if op == "exists":
            if set(node) != {"op", "field"}:
                note("CONDITION_SCHEMA")
            return
        if op == "range":
            flags = ("lower_inclusive", "upper_inclusive")
            if not {"lower", "upper", *flags} <= set(node):
                note("CONDITION_SCHEMA")
                return
            kind = node.get("value_type", "number")
            if kind not in ORDERED:
                note("CONDITION_TYPE")
            if any(type(node[f]) is not bool for f in flags):
                note("CONDITION_SCHEMA")
            if not (_fits(node["lower"], kind) and _fits(node["upper"], kind)):
                note("CONDITION_VALUE")
            else:
                a, b = ((Decimal(str(v)) if kind == "number" else v) for v in (node["lower"], node["upper"]))
                if a > b or a == b and not all(node[f] for f in flags):
                    note("CONDITION_RANGE")
            extra = {"op", "field", "value_type", "lower", "upper", *flags}
        else:
            if "value" not in node:
                note("CONDITION_SCHEMA")
                return
            many = op == "in"
            values = node["value"] if many else [node["value"]]
            if many and (not isinstance(values, list) or not values):
                note("CONDITION_VALUE")
                return
            kind = node.get("value_type", _kind(values[0]))
            if kind not in KINDS or op in ("gt", "ge", "lt", "le") and kind not in ORDERED:
                note("CONDITION_TYPE")
            elif not all(_fits(v, kind) for v in values):
                note("CONDITION_VALUE")
            extra = {"op", "field", "value_type", "value"}
        if set(node) - extra:
            note("CONDITION_SCHEMA")

    def visit(node: object, depth: int) -> None:
        nonlocal seen
        seen += 1
        if seen > MAX_NODES:
            note("CONDITION_BUDGET")
        elif depth > MAX_DEPTH:
            note("CONDITION_DEPTH")
        elif not isinstance(node, dict):
            note("CONDITION_SCHEMA")
        elif node.get("op") in ("all", "any"):
            args = node.get("args")
            if set(node) != {"op", "args"} or not isinstance(args, list) or not args:
                note("CONDITION_SCHEMA")
            elif len(args) > MAX_CHILDREN:
                note("CONDITION_BUDGET")
            else:
                for a in args:
                    visit(a, depth + 1)
        elif node.get("op") == "not":
            if set(node) != {"op", "arg"}:
                note("CONDITION_SCHEMA")
            else:
                visit(node["arg"], depth + 1)
        elif node.get("op") in LEAVES:
            leaf(node, node["op"])
        else:
            note("CONDITION_OPERATOR")

    if tree is not None:
        visit(tree, 0)
    return codes


def fields(tree: dict | None) -> list[str]:
    """Facts that a sound tree refers to, sorted, each once."""
    if tree is None:
        return []
    if tree["op"] in ("all", "any"):
        return sorted({f for a in tree["args"] for f in fields(a)})
    return fields(tree["arg"]) if tree["op"] == "not" else [tree["field"]]


def _typed(c: Column, kind: str) -> Column:
    return decimal(c) if kind == "number" else iso_date(c) if kind == "date" else c.try_cast("boolean") if kind == "boolean" else c


def _literal(value: object, kind: str) -> Column:
    return F.lit(str(value)).cast("decimal(38,18)") if kind == "number" else F.lit(value).cast("date") if kind == "date" else F.lit(value)


def compile_condition(tree: dict | None, facts: Column) -> Column:
    """State of a tree over ``facts`` (map of field to FACT). An unsound tree is unknown, None is applicable."""
    if validate(tree):
        return F.lit(UNKNOWN)
    if tree is None:
        return F.lit(APPLICABLE)
    op = tree["op"]
    if op in ("all", "any"):
        parts = F.array(*(compile_condition(a, facts) for a in tree["args"]))
        return combine_all(parts) if op == "all" else combine_any(parts)
    if op == "not":
        return invert(compile_condition(tree["arg"], facts))
    fact = F.try_element_at(facts, F.lit(tree["field"]))
    state = F.coalesce(fact["state"], F.lit(UNKNOWN))
    if op == "exists":
        return F.when(state == "known", APPLICABLE).otherwise(state)
    value = tree.get("value")
    kind = tree.get("value_type", "number" if op == "range" else _kind(value[0] if op == "in" else value))
    actual = _typed(fact["value"], kind)
    if op == "range":
        lo, hi = _literal(tree["lower"], kind), _literal(tree["upper"], kind)
        test = (actual >= lo if tree["lower_inclusive"] else actual > lo) & (actual <= hi if tree["upper_inclusive"] else actual < hi)
    elif op == "in":
        test = actual.isin([_literal(v, kind) for v in value])
    else:
        want = _literal(value, kind)
        test = {"eq": actual == want, "gt": actual > want, "ge": actual >= want, "lt": actual < want, "le": actual <= want}[op]
    return F.when(state != "known", state).when((fact["type"] != kind) | actual.isNull(), UNKNOWN).when(test, APPLICABLE).otherwise(NOT_APPLICABLE)


def evaluate_trees(df: DataFrame, tree_column: str, facts_column: str, out: str = "state") -> DataFrame:
    """State of the JSON tree in each row. The distinct trees (at most MAX_TREES, checked) are compiled into one CASE.

    Null trees are unknown: a missing condition is never an unconditional one. Text that
    is no JSON is unknown.
    """
    trees = [r[0] for r in df.select(tree_column).where(F.col(tree_column).isNotNull()).distinct().limit(MAX_TREES + 1).collect()]
    if len(trees) > MAX_TREES:
        raise ValueError(f"more than {MAX_TREES} distinct conditions")
    state = F.when(F.lit(False), UNKNOWN)  # one flat CASE, however many trees
    for text in sorted(trees):
        try:
            state = state.when(F.col(tree_column) == text, compile_condition(json.loads(text), F.col(facts_column)))
        except ValueError:
            continue
    return df.withColumn(out, state.otherwise(UNKNOWN))


def evaluate_wrapped(df: DataFrame, condition: str, facts: str, out: str = "state") -> DataFrame:
    """State of a condition with its source: struct<state, ast_json, raw, required_facts, has_evidence>.

    Only structured, resolved or unconditional ones with evidence decide; a partial
    one may exclude but not confirm; without a tree only an unconditional one that
    needs no facts is applicable. Declared facts that are missing turn applicable into
    unknown; conflicting ones make any of these conflicting.
    """
    c = F.col(condition)
    inner = evaluate_trees(df.withColumn("__tree", c["ast_json"]), "__tree", facts, "__inner")
    needed = F.coalesce(c["required_facts"], F.array().cast("array<string>"))
    states = F.transform(needed, lambda f: F.coalesce(F.try_element_at(F.col(facts), f)["state"], F.lit(UNKNOWN)))
    clash, lacking = F.array_contains(states, CONFLICTING), F.array_contains(states, UNKNOWN)
    evidence = F.coalesce(c["has_evidence"], F.lit(False))
    partial = (c["state"] == "partial") & evidence & c["ast_json"].isNotNull()
    decides = c["state"].isin("structured", "resolved", "unconditional") & evidence
    value = F.col("__inner")
    by_tree = F.when(clash, CONFLICTING).when((value == APPLICABLE) & (lacking | partial), UNKNOWN).otherwise(value)
    bare = F.when((c["state"] == "unconditional") & (F.size(needed) == 0), APPLICABLE).otherwise(UNKNOWN)
    state = F.when(c.isNull() | ~F.coalesce(partial | decides, F.lit(False)), F.when(clash, CONFLICTING).otherwise(UNKNOWN)).when(c["ast_json"].isNull(), bare).otherwise(by_tree)
    return inner.withColumn(out, state).drop("__tree", "__inner")


def fold_facts(facts: DataFrame, keys: list[str], roles: list[str] | None = None) -> DataFrame:
    """(keys, field, state, type, value): one fact for each field from its long rows.

    facts: keys, field, type, value, verification_state, role, source_ref. Any
    conflicting row, or two different verified values, conflict; else known if all are verified
    and equal; else unknown. Rows of other roles are not heard, unless they conflict. Partial aggregation only.
    """
    verified = (F.col("verification_state") == "verified") & F.col("source_ref").isNotNull() & (F.col("source_ref") != "") & F.col("role").isNotNull() & F.col("value").isNotNull()
    clash = F.coalesce(F.col("verification_state") == CONFLICTING, F.lit(False))
    heard = facts.withColumn("__clash", clash).withColumn("__known", F.coalesce(verified, F.lit(False)))
    if roles is not None:
        heard = heard.where(F.col("__clash") | F.col("role").isin(roles))
    value = F.when(F.col("__known"), F.struct("type", "value"))
    out = heard.groupBy(*keys, "field").agg(
        F.bool_or("__clash").alias("__any"), F.min(value).alias("__lo"), F.max(value).alias("__hi"), F.bool_and("__known").alias("__all")
    )
    state = F.when(F.col("__any") | (F.col("__lo") != F.col("__hi")), CONFLICTING).when(F.col("__all"), "known").otherwise(UNKNOWN)
    out = out.withColumn("state", state)
    known = F.col("state") == "known"
    return out.select(*keys, "field", "state", F.when(known, F.col("__lo.type")).alias("type"), F.when(known, F.col("__lo.value")).alias("value"))


def fact_map(folded: DataFrame, keys: list[str], out: str = "facts") -> DataFrame:
    """(keys, out): a map of the folded facts; as many entries as the vocabulary has fields."""
    entry = F.struct("field", F.struct("state", "type", "value").alias("fact"))
    return folded.groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias(out))
