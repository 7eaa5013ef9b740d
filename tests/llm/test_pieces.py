import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnbeck.llm.pieces import offsets, oversized, pieces


def check(text, rows, limit, overlap):
    rows = sorted(rows, key=lambda r: r["piece_no"])
    assert [r["piece_no"] for r in rows] == list(range(1, len(rows) + 1))
    end = 0
    for i, r in enumerate(rows):
        assert r["n_pieces"] == len(rows) and 0 < len(r["piece"]) <= limit
        assert text[r["start"] : r["start"] + len(r["piece"])] == r["piece"]
        assert r["start"] == (end - overlap if i else 0)
        end = r["start"] + len(r["piece"])
    assert end == len(text)


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab。\n|，𩽾 1.é", min_size=1, max_size=200), min_size=1, max_size=10), st.sampled_from([(10, 2), (20, 5), (7, 0)]))
def test_pieces_cover_the_text(spark, texts, size):
    limit, overlap = size
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    by = {}
    for r in pieces(df, "text", limit, overlap).collect():
        by.setdefault(r["id"], []).append(r)
    for i, t in enumerate(texts):
        check(t, by[i], limit, overlap)
        assert (len(by[i]) > 1) == (len(t) > limit)


def test_boundaries(spark):
    text = "第一句说明内容。第二句说明内容。\n3.1 第三条要求如下。" + "长" * 30
    df = spark.createDataFrame([(text,)], "text string")
    first = pieces(df, "text", 20, 0).where("piece_no = 1").first()["piece"]
    assert first.endswith("\n")
    assert pieces(df, "text", 16, 0).where("piece_no = 1").first()["piece"].endswith("。")


def test_edges(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "a" * 10, "x"), (4, "a" * 11, "x"), (4, "a" * 11, "x"), (5, "字" * 100_000, "x")], "id int, text string, piece string")
    n = {r["id"]: r["count"] for r in pieces(df, "text", 10, 2).groupBy("id").count().collect()}
    assert 1 not in n and 2 not in n and n[3] == 1 and n[4] == 4 and n[5] == 12_500
    assert {r["id"] for r in oversized(df, "text", 10, 2).collect()} == {4, 5}
    assert pieces(df.limit(0), "text", 10, 2).count() == 0
    with pytest.raises(ValueError):
        pieces(df, "text", 10, 10)


def test_offsets_of_arrays_of_any_length(spark):
    df = spark.createDataFrame([(n,) for n in (0, 1, 63, 64, 65, 5000)], "n int")
    lengths = F.when(F.col("n") == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(1), "n"), lambda i: i % 7))
    for r in df.select(lengths.alias("a"), offsets(lengths).alias("o")).collect():
        assert r["o"] == [sum(r["a"][:i]) for i in range(len(r["a"]))]


def test_one_very_long_text_takes_time_and_memory_in_proportion(spark):
    """Ten million characters, 30 MB: with the text or all its pieces on every piece this would be hundreds of gigabytes."""
    long = spark.range(1).select("id", F.repeat(F.concat(F.lit("第一句说明内容很长。第二句说明内容，\n"), F.col("id").cast("string")), 500_000).alias("text"))
    out = pieces(long, "text", 1200, 120)
    assert out.columns == ["id", "piece_no", "n_pieces", "start", "piece"]
    r = out.agg(F.count("*").alias("n"), F.max("n_pieces").alias("all"), F.sum(F.length("piece")).alias("chars"), F.max(F.length("piece")).alias("longest"), F.max(F.col("start") + F.length("piece")).alias("end")).first()
    assert r["n"] == r["all"] and r["longest"] <= 1200 and r["end"] == 10_000_000 == r["chars"] - 120 * (r["n"] - 1)
