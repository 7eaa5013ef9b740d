import itertools
import random

from tarnbeck.llm.canonical import NameIndex, arrangements, map_to_canonical

FOODS = [("e1", "番茄炒蛋盖饭", ["西红柿鸡蛋饭"]), ("e2", "豆腐", None), ("e3", "绿茶", None)]


def test_mentions_decide_by_what_is_around_them():
    index = NameIndex.build(FOODS)
    for s, e in (("散装豆腐500g", "e2"), ("样品:豆腐(袋装)", "e2"), ("豆腐 豆腐", "e2"), ("豆腐绿茶", None), ("豆腐店", None), ("a豆腐", None)):
        assert index.mentioned(s, index.peeled(s)) == e, s


def test_parts_in_any_order_however_many():
    index = NameIndex.build(FOODS)
    for parts in itertools.permutations(("番茄", "炒", "蛋", "盖饭")):
        assert index.resolve(" ".join(parts)) == "e1", parts
    assert index.resolve("盖饭 蛋 炒 番加") == "e1"  # with a slip
    assert index.resolve("盖饭 蛋 炒 肉丝") == ""


def test_arrangements_and_candidates_equal_brute_force():
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("甲乙丙丁戊") for _ in range(n))
    index = NameIndex.build([(f"e{i}", word(rng.randint(1, 6)), None) for i in range(60)])
    for _ in range(300):
        parts = [word(rng.randint(1, 2)) for _ in range(rng.randint(1, 4))]
        orders = {"".join(p) for p in itertools.permutations(parts)}
        want = {(o, f) for o in orders for f in index.forms if index.slip(o, f) is not None}
        got = {(o, f) for f in index.candidates("".join(parts)) for o in arrangements(parts, f) if index.slip(o, f) is not None}
        assert got == want, parts


def test_mentions_embedded_in_requests_and_quantities():
    index = NameIndex.build([*FOODS, ("e4", "MCT椰油粉", None)])
    for s, e in (("一大包绿茶", "e3"), ("绿茶 整箱", "e3"), ("请检验 mct椰油粉", "e4"), ("两小袋豆腐", "e2"), ("请检验一下:豆腐", "e2"), ("一大包绿茶香精", ""), ("豆腐整箱包装袋", "")):
        assert index.staged(s) == (e, "mention" if e else "none"), s


def test_stages(spark):
    canonical = spark.createDataFrame(FOODS, "entry_id string, name string, aliases array<string>")
    values = ["豆腐", "散装豆腐", "蛋 番茄 盖饭 炒", "番茄炒蛋盖反", "石头", "豆腐、绿茶", None]
    df = spark.createDataFrame([(v,) for v in values], "food string")
    got = {r["food"]: r["stage"] for r in map_to_canonical(df, "food", canonical, stage="stage").collect()}
    assert [got[v] for v in values] == ["name", "mention", "token set", "slip", "none", "several", "blank"]


def test_rows(spark):
    canonical = spark.createDataFrame(FOODS, "entry_id string, name string, aliases array<string>")
    df = spark.createDataFrame([(1, "豆腐"), (2, "蛋 番茄 盖饭 炒"), (3, "石头"), (4, " ")], "id int, food string")
    assert {tuple(r) for r in map_to_canonical(df, "food", canonical).select("id", "entry_id", "match").collect()} == {(1, "e2", "name"), (2, "e1", "mapped"), (3, "", "none"), (4, None, "blank")}
