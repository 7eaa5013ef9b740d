import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnbeck.operators.multivalue import hidden, protections, scan_cuts, split_batch, split_paths, split_values, unquote


def brute(text):
    text = text or ""
    parts, a = [], 0
    for c in [*scan_cuts(text), len(text)]:
        parts.append(unquote(text[a:c]))
        a = c + 1
    return [p for p in parts if "".join(ch for ch in p if not hidden(ch)).strip()]


def split(texts):
    items, owner = split_batch(pa.array(texts, pa.string()))
    out = [[] for _ in texts]
    for i, o in zip(items.to_pylist(), owner.tolist()):
        out[o].append(i)
    return out


@pytest.mark.parametrize(
    "text, items",
    [
        ("苹果、梨", ["苹果", "梨"]),
        (" 苹果 ；；梨,", ["苹果", "梨"]),
        ("苹果\t梨\n桃", ["苹果", "梨", "桃"]),
        ("苹果／梨｜桃", ["苹果", "梨", "桃"]),
        ("坚果与籽类（生干、熟制）/茶", ["坚果与籽类（生干、熟制）", "茶"]),
        ("1,3-二甘油酯油,N,N-二甲基甘氨酸", ["1,3-二甘油酯油", "N,N-二甲基甘氨酸"]),
        ("１，３-二甘油酯", ["１，３-二甘油酯"]),
        ("含量≥0.5 mg/kg类", ["含量≥0.5 mg/kg类"]),
        ("5 g/100 g糖/茶", ["5 g/100 g糖", "茶"]),
        ("w/w 30%糖水", ["w/w 30%糖水"]),
        ("1/2脱脂乳", ["1/2脱脂乳"]),
        ("FS/T型粉/GB/T 1886", ["FS/T型粉", "GB/T 1886"]),
        ("OPO油/MCT粉", ["OPO油", "MCT粉"]),
        ('"苹果、梨"', ["苹果、梨"]),
        ('"苹果/茶""特级""",梨', ['苹果/茶"特级"', "梨"]),
        ("“甜、咸”双味饼干", ["“甜、咸”双味饼干"]),
        ("“甜”、“咸”", ["甜", "咸"]),
        ("'山药/绿豆', 茶", ["山药/绿豆", "茶"]),
        ("Lay's薯片、Oreo's饼干", ["Lay's薯片", "Oreo's饼干"]),
        ("苹果（红、梨", ["苹果（红", "梨"]),
        ("苹果）、梨", ["苹果）", "梨"]),
        ('8"披萨、6"披萨', ['8"披萨', '6"披萨']),
        ("苹果和梨及桃", ["苹果和梨及桃"]),
        ("【罐头（红、黄）、果酱】、茶", ["【罐头（红、黄）、果酱】", "茶"]),
        ("“苹果（红、黄）、梨”/茶", ["苹果（红、黄）、梨", "茶"]),
        ("'苹果(红,黄)/梨' , '茶'", ["苹果(红,黄)/梨", "茶"]),
        ("(苹果[红)、黄]", ["(苹果[红)", "黄]"]),
        ("N,N,N,N-三甲基,α,β-油", ["N,N,N,N-三甲基", "α,β-油"]),
        ("N,N,N", ["N", "N", "N"]),
        ("散装\xad1,​3-油", ["散装\xad1,​3-油"]),
        ("、、", []),
        ("", []),
        (None, []),
    ],
)
def test_items(text, items):
    assert split([text]) == [items] == [brute(text)]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="a1N-苹果、,/;；|\t\n\"'“”「」（）()  \xad​𩽾g", max_size=24)), max_size=8))
def test_vectorised_equals_scanner(texts):
    assert split(texts) == [brute(t) for t in texts]


def test_frame(spark):
    long = "注" * 20_000
    rows = [(1, "a、b、a", 9, None), (2, None, 9, ""), (3, "", 9, "x"), (4, "single", 9, "x"), (5, "、".join(["字"] * 50_000), 9, long), (1, "a、b、a", 9, None)]
    df = spark.createDataFrame(rows, "id int, name string, pos int, note string")
    out = split_values(df, "name", least=2)
    assert out.columns == ["id", "note", "pos", "item"]
    assert [(r["pos"], r["item"]) for r in out.where("id = 1").distinct().orderBy("pos").collect()] == [(1, "a"), (2, "b"), (3, "a")]
    assert out.where("id = 5").count() == 50_000 and out.where("id in (2, 3, 4)").count() == 0
    assert split_values(df, "name").where("id = 4").count() == 1
    assert split_values(df.limit(0), "name").count() == 0


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.text(alphabet="'\"()[]a,、 1", max_size=14), min_size=1, max_size=4))
def test_marks_that_cross_equal_the_scanner(texts):
    assert split(texts) == [brute(t) for t in texts]


@pytest.mark.parametrize("text", ["(" * 200_000, "'a" * 200_000, '"a' * 200_001, "N," * 200_000, "（" * 100_000 + "】" * 100_000, "'，" * 100_000, "a/" * 200_000])
def test_time_is_linear(text):
    import time

    began = time.monotonic()
    scan_cuts(text)
    protections(text, [i for i, c in enumerate(text) if c == ","])
    split([text])
    assert time.monotonic() - began < 12  # the square of these lengths would take hours


def test_paths(spark):
    df = spark.createDataFrame([(1, "a、b"), (1, "'a、b'、c"), (1, "1,3-油、b"), (1, "苹果（红、梨"), (2, None)], "k int, name string")
    assert {tuple(r) for r in split_paths(df, "name", ["k"]).collect()} == {(1, "masks", 3), (1, "scanner", 1), (2, "masks", 1)}
