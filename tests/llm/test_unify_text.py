import unicodedata

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnbeck.llm.unify_text import KINDS, unify, unify_values


def kinds_of(s):
    form, bits = unify_values(pa.array([s]))
    return form[0].as_py(), {v for b, v in KINDS.items() if bits[0] & b}


@pytest.mark.parametrize(
    "raw, form, kinds",
    [
        ("квас按", "квас按", set()),
        ("кефир сок с мясом", "кефир сок с мясом", set()),
        ("рН大于4.6", "ph大于4.6", {"lookalike"}),
        ("批号ΑΒ21469", "批号ab21469", {"lookalike"}),
        ("μmоl/g", "μmol/g", {"lookalike"}),
        ("加エ品", "加工品", {"lookalike"}),
        ("手エエ艺", "手工工艺", {"lookalike"}),
        ("カレー咖喱", "カレー咖喱", set()),
        ("ｶﾚｰ", "カレー", {"width"}),
        ("萝ﾄ干", "萝卜干", {"width", "lookalike"}),
        ("⻥及⽔", "鱼及水", {"lookalike"}),
        ("\uf967要", "不要", {"lookalike"}),
        ("cre\u0300me", "cr\u00e8me", {"accent"}),
        ("cr\u00e8me", "cr\u00e8me", set()),
        ("\u1100\u1175\u11b7\u110e\u1175", "\uae40\uce58", {"accent"}),
        ("R²Y Na₂CO₃", "r2y na2co3", set()),
        ("β-胡萝卜素 α µg", "β-胡萝卜素 α μg", set()),
        ("（繁體），。！", "(繁體),。!", set()),
        ("不‌饿", "不饿", {"invisible"}),
        (" a　b\t", "a b", {"space"}),
        ("a\u2028b", "a\nb", {"space"}),
        ("a\u00a0b", "a b", {"space"}),
        ("👨‍👩‍👧吃❤️", "👨👩👧吃❤", set()),
        ("", "", set()),
        ("   ", "", set()),
        ("Straße", "strasse", set()),
    ],
)
def test_forms(raw, form, kinds):
    assert kinds_of(raw) == (form, kinds)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=("Cs",)), max_size=12), min_size=1, max_size=8))
def test_values_do_not_touch_each_other_and_forms_are_stable(values):
    together = unify_values(pa.array(values))[0].to_pylist()
    assert together == [unify_values(pa.array([v]))[0][0].as_py() for v in values]
    assert all(f == unicodedata.normalize("NFKC", f) for f in together)


def test_frame(spark):
    rows = [(1, "ＡＢＣ", "x"), (2, None, "x"), (3, "", "x"), (4, "abc ", "x"), (4, "abc ", "x"), (5, "Abc\r\n def", "x"), (6, "很长" * 50_000, "x")]
    df = spark.createDataFrame(rows, "id int, text string, kinds string")
    out = {r["id"]: r for r in unify(df, "text").collect()}
    assert out[1]["unified"] == out[4]["unified"] == "abc"
    assert out[1]["kinds"] == ["width"] and out[4]["kinds"] == []
    assert out[2]["unified"] is None and out[2]["kinds"] == [] and out[3]["unified"] == ""
    assert out[5]["unified"] == "abc\ndef" and out[6]["unified"] == "很长" * 50_000
    assert unify(df, "text").count() == len(rows)
    assert unify(df.limit(0), "text").count() == 0


def test_plain_values_take_the_same_form_in_both_ways(spark):
    texts = ["Plain Text", "  two  blanks ", "a\n\n b", "中文，标点", "line\r\nend", "x\ty"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = {r["id"]: r["unified"] for r in unify(df, "text").collect()}
    assert [got[i] for i in range(len(texts))] == unify_values(pa.array(texts))[0].to_pylist()
