import unicodedata

import pytest
from pyspark.sql import functions as F

from tarnbeck.functions import scalars as sc
from tarnbeck.functions import states as st
from tarnbeck.functions import text as tx


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in zip(values, ["string"] * len(values)))) if values else spark.range(1)
    return df.select(column).first()[0]


@pytest.mark.parametrize(
    "states, every, some",
    [
        ([], "applicable", "not_applicable"),
        (["applicable"], "applicable", "applicable"),
        (["applicable", "unknown"], "unknown", "applicable"),
        (["not_applicable", "unknown"], "not_applicable", "unknown"),
        (["not_applicable", "applicable", "conflicting"], "conflicting", "conflicting"),
        (["not_applicable"], "not_applicable", "not_applicable"),
    ],
)
def test_states(spark, states, every, some):
    df = spark.createDataFrame([(states,)], "s array<string>")
    assert df.select(st.combine_all("s"), st.combine_any("s")).first()[:] == (every, some)
    rows = df.select(F.explode("s").alias("x"))
    assert rows.agg(st.all_of("x"), st.any_of("x")).first()[:] == (every, some)


def test_invert_and_exclude(spark):
    df = spark.createDataFrame([(["not_applicable", "unknown"],), (["not_applicable", "conflicting"],), (["unknown"],)], "s array<string>")
    assert [r[0] for r in df.select(st.excludes("s")).collect()] == [True, False, False]
    assert [r[0] for r in df.select(st.invert(F.col("s")[0])).collect()] == ["applicable", "applicable", "unknown"]


@pytest.mark.parametrize(
    "raw, form",
    [("Ａ１－Na₂CO₃", "A1-Na2CO3"), ("总 碱　量", "总碱量"), ("a‐b–c", "a-b-c"), ("ABC x", "ABCx"), ("", ""), (None, None)],
)
def test_search_form(spark, raw, form):
    df = spark.createDataFrame([(raw,)], "a string")
    assert df.select(tx.search_form("a")).first()[0] == form


@pytest.mark.parametrize("raw, form", [("gb t 1886.1-2020", "GBT1886.1-2020"), ("gb/t1886.1-2020", "GB/T1886.1-2020"), ("GB／T 1886", "GB/T1886"), ("nyt 5", "NY/T5"), ("其他 文字", "其他文字")])
def test_standard_form(spark, raw, form):
    want = "GB/T1886.1-2020" if form == "GBT1886.1-2020" else form
    assert spark.createDataFrame([(raw,)], "a string").select(tx.standard_form("a")).first()[0] == want


def test_every_substring_is_found_by_its_terms(spark):
    texts = ["苹果汁GB1886.1-2020", "总碱量 Na2CO3/K", "单"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = [(t, t[i : i + n]) for t in (unicodedata.normalize("NFKC", x) for x in texts) for n in (1, 2, 3, 6) for i in range(len(t) - n + 1) if t[i : i + n].strip()]
    pairs = spark.createDataFrame(rows, "t string, q string")
    assert df.count() and pairs.where(F.size(F.array_except(tx.tokens("q", query=True), tx.tokens("t"))) > 0).count() == 0


def test_spans(spark):
    df = spark.createDataFrame([("苹果与苹果汁、苹果", "苹果"), ("aaaa", "aa"), ("", "x"), (None, "x"), ("x" * 50, "x")], "t string, q string")
    got = [r[0] for r in df.select(tx.spans("t", "q")).collect()]
    assert [tuple(s) for s in got[0]] == [(0, 2), (3, 5), (7, 9)] and [tuple(s) for s in got[1]] == [(0, 2), (2, 4)]
    assert got[2] == [] and len(got[4]) == tx.MAX_SPANS
    assert [r[0] for r in df.select(tx.count_of("t", "q")).collect()] == [3, 2, 0, None, 50]


def test_normalised_spans(spark):
    df = spark.createDataFrame([("Ａ Na₂CO₃ 总 碱", "Na2CO3总碱"), ("ﬁsh", "f"), ("ﬁsh", "is"), ("éx", "éx"), (None, "a")], "t string, q string")
    got = [None if r[0] is None else [tuple(s) for s in r[0]] for r in df.select(tx.normalised_spans("t", "q")).collect()]
    assert got == [[(2, 12)], [(0, 1)], [(0, 2)], [(0, 3)], None]


def test_text_helpers(spark):
    df = spark.range(1)
    get = lambda c: df.select(c).first()[0]
    assert get(tx.standards_in(F.lit("按FS/T 2041-2019中6.4和SQ 3017-2021、FS/T  2041-2019"))) == ["FS/T 2041-2019", "SQ 3017-2021"]
    assert get(tx.clauses_in(F.lit("3.1 按A.2规定和6.4的"))) == ["A.2", "6.4"]
    assert get(tx.quality_flags(F.lit("啊" * 30))) == ["repeated"] and get(tx.quality_flags(F.lit(" "))) == ["empty"]
    assert get(tx.quality_flags(F.lit("----=="))) == ["symbols"] and get(tx.quality_flags(F.lit("坏�字"))) == ["garbled"]
    assert get(tx.names_of(F.lit("饮料（茶）"))) == ["饮料（茶）", "饮料", "茶"]
    assert get(tx.food_terms(F.lit("鲜苹果、梨"))) == ["鲜苹果", "梨", "苹果"]
    assert get(tx.without_folios(F.lit("a\n 12 \nb"))) == "a\nb"
    assert get(tx.excerpt(F.lit("a\nb\nc\nd\ne"), "c")) == (3, "b\nc\nd\ne") and get(tx.excerpt(F.lit("a"), "z")) is None
    assert get(tx.family_of(F.lit("GB 1886.1—2020"))) == "GB 1886.1" and get(tx.year_of(F.lit("GB 1886.1—2020"))) == 2020


def test_scalars(spark):
    df = spark.range(1)
    get = lambda c: df.select(c).first()[0]
    assert str(get(sc.iso_date(F.lit("2021-01-31")))) == "2021-01-31"
    assert get(sc.iso_date(F.lit("2021-1-1"))) is None and get(sc.iso_date(F.lit("2021-02-30"))) is None
    assert get(sc.decimal(F.lit("1e3"))) == 1000 and get(sc.decimal(F.lit("nan"))) is None
    assert get(sc.ratio(F.lit(1), F.lit(0))) is None
    t, f, n = F.lit(True), F.lit(False), F.lit(None).cast("boolean")
    five = F.lit(5)
    assert get(sc.within(five, five, t, F.lit(9), f)) is True and get(sc.within(five, five, f, F.lit(9), f)) is False
    assert get(sc.within(five, F.lit(None).cast("int"), n, five, t)) is True and get(sc.within(five, F.lit(1), n, F.lit(9), t)) is None
    assert get(sc.within(five, F.lit(7), t, F.lit(9), n)) is False
    assert get(sc.empty_window(five, t, five, f)) is True and get(sc.empty_window(five, t, five, t)) is False
    assert get(sc.named_id("x", F.lit("a"))) != get(sc.named_id("y", F.lit("a")))
    assert get(sc.media_of(F.lit(b"%PDF-1.7"))) == "application/pdf" and get(sc.media_of(F.lit(b"zzz"))) is None
