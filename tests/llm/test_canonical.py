import pytest

from tarnbeck.llm.canonical import NameIndex, map_to_canonical, simplified

LIST = [("C1", "低糖苹果发酵饮料", []), ("C2", "苹果汁", ["苹果榨汁"]), ("C3", "马铃薯酱菜", ["土豆酱菜"]), ("C4", "烤鳗鱼松", None), ("C5", "MCT椰油粉", []), ("C6", "苹果罐头", []), ("C7", "低糖苹果罐头", [])]


@pytest.fixture(scope="module")
def index():
    return NameIndex.build(LIST)


@pytest.mark.parametrize(
    "typed, entry",
    [
        ("苹果汁", "C2"), ("苹果榨汁", "C2"), ("散装苹果汁（已开封）", "C2"), ("【某某】苹果汁 250 ml", "C2"), ("苹果汁/袋", "C2"),
        ("苹果发酵饮料（低糖）", "C1"), ("苹果发酵饮料 低糖×2", "C1"), ("低糖苹果发酵欣料", "C1"), ("低唐蘋果發酵飲料", "C1"),
        ("低糖苹果酵发饮料", "C1"), ("低糖糖苹果发酵饮料", "C1"), ("马铃薯酱", "C3"), ("土 豆 酱菜", "C3"), ("烤鰻魚鬆", "C4"), ("mct椰油粉", "C5"),
        ("苹果罐头-低糖", "C7"), ("低苹果罐头", "C7"), ("苹果罐头", "C6"),
        ("苹果汁香精", ""), ("苹果汁生产线", ""), ("苹果发酵饮料种子", ""), ("榴莲千层", ""), ("同上", ""), ("n/a", ""), ("???", ""),
    ],
)
def test_resolve(index, typed, entry):
    assert index.resolve(simplified([typed])[0]) == entry


def test_longest_mention_wins(index):
    assert [f for _, f in index.mentions("低糖苹果罐头苹果汁")] == ["低糖苹果罐头", "苹果汁"]


def test_long_values_take_no_square_of_time(index):
    assert len(index.mentions("苹果汁" * 20_000)) == 20_000
    assert index.resolve("苹果汁" * 20_000) == "C2" and index.resolve("别" * 200_000) == ""


def test_frame(spark):
    canonical = spark.createDataFrame(LIST, "entry_id string, name string, aliases array<string>")
    rows = [(1, "苹果汁"), (2, " 苹果汁"), (3, None), (4, "​ "), (5, "苹果汁、烤鳗鱼松"), (6, "苹果汁\t烤鳗鱼松"), (7, "别的"), (7, "别的"), (8, "苹" * 100_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id int, food string, match string")
    out = {r["id"]: (r["entry_id"], r["match"]) for r in map_to_canonical(df, "food", canonical).collect()}
    assert out[1] == ("C2", "name") and out[2] == ("C2", "mapped") and out[3] == out[4] == (None, "blank")
    assert out[5] == out[6] == (None, "several") and out[7] == out[8] == ("", "none")
    assert map_to_canonical(df, "food", canonical).count() == len(rows)
    assert map_to_canonical(df.limit(0), "food", canonical).count() == 0
    assert {r["match"] for r in map_to_canonical(df.where("id = 1"), "food", canonical.limit(0)).collect()} == {"none"}
