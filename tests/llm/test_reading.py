import random

import numpy as np
import pytest

from tarnbeck.llm.reading import Boosted, fit_reading_model, isotonic, parse, reading_levels, train

EASY = ["妈妈洗苹果。", "小狗很乖。", "我爱吃梨。", "红的是枣。", "大家去买菜。"]
PLAIN = ["本期登记的产品共有三批，详细情况见附件。", "企业应当保存进货单据，并说明原料来源。", "检查人员建议重新取样，结果另行公布。"]
HARD = ["协方差分析表明，内标校正与体积分数之间的交互作用显著，定量限受基质效应制约。", "采用稳健统计的迭代算法重新估计指定值，并以衍生化反应验证响应的均一性。"]


def corpus(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        level = rng.choice([1, 3, 5])
        pool = {1: EASY, 3: PLAIN, 5: HARD}[level]
        out.append((i, "".join(rng.choice(pool) for _ in range(rng.randint(2, 8))), rng.choice(["a", "b", "c"]), level))
    return out


def test_boosted_learns_steps():
    rng = np.random.default_rng(0)
    x = rng.random((800, 4)).astype(np.float32)
    y = (x[:, 0] > 0.5) * 2.0 + (x[:, 2] > 0.3)
    error = np.abs(Boosted().fit(x[:600], y[:600]).predict(x[600:]) - y[600:])
    # A step within a bin cannot be placed exactly: about 1 row in 48 at each step may be off by its height.
    assert np.median(error) < 0.1 and (error > 0.5).mean() < 3 * 2 / 48


def test_isotonic_is_monotone():
    x, y = isotonic(np.array([1.0, 2, 3, 4]), np.array([1.0, 3, 2, 4]))
    assert (np.diff(y) >= 0).all() and len(x) == 3


def test_held_out_accuracy():
    rows = corpus(300, 1)
    model = train([r[1] for r in rows], np.array([r[3] for r in rows], float), [r[2] for r in rows])
    test = corpus(120, 2)
    score = model.score([r[1] for r in test])
    assert np.abs(score - [r[3] for r in test]).mean() < 0.2
    assert {r["source"] for r in model.report} == {"a", "b", "c"}


def test_parse_edges():
    p = parse(["", "a", "字", "没有句号", "x. y. 1.5 z"])
    assert p.n == 5 and p.chars[0].sum() == 0


@pytest.fixture(scope="module")
def frames(spark):
    rows = corpus(120, 3)
    docs = spark.createDataFrame([(r[0], r[1], r[2]) for r in rows] + [(900, None, "a"), (901, " 　", None), (902, "妈妈" * 40_000, "a")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(r[0], 1, r[3]) for r in rows] + [(0, 2, None), (900, 1, 3), (1, 1, rows[1][3]), (None, 1, 2)], "doc_id long, reader int, reading_level int")
    return docs, labels, rows


def test_frame(frames):
    docs, labels, rows = frames
    model = fit_reading_model(docs, labels)
    out = {r["doc_id"]: r["reading_level"] for r in reading_levels(docs, model).collect()}
    assert out[900] is None and out[901] is None and 1 <= out[902] <= 5
    assert np.mean([out[r[0]] == r[3] for r in rows]) > 0.9
    assert reading_levels(docs.limit(0), model).count() == 0
    assert fit_reading_model(docs, labels.limit(0)) is None
    assert {r["reading_level"] for r in reading_levels(docs, None).collect()} == {None}


@pytest.mark.parametrize("copies", [False, True])
def test_left_out_sources_tell_nothing(copies):
    # The level hangs on a word that only one source has, or only the copies of one text: nothing can predict it.
    rng = np.random.default_rng(4)
    levels, texts, y, sources = rng.permutation(np.arange(60) % 5 + 1), [], [], []
    for i in range(60):
        for j in range(8):
            texts.append(f"zq{'abcdefghij'[i // 10]}{'abcdefghij'[i % 10]} sample text" + ("" if copies else f" {'xyzuvwrs'[j]}"))
            y.append(float(levels[i]))
            sources.append(f"s{j if copies else i}")
    report = train(texts, np.array(y), sources).report
    assert np.average([r["mean_abs_error"] for r in report], weights=[r["n"] for r in report]) > 0.9


def test_the_sample_is_bounded_in_rows_and_characters(frames):
    docs, labels, rows = frames
    from tarnbeck.llm.reading import labelled

    whole = labelled(docs, labels).collect()
    part = labelled(docs, labels, chars=sum(len(r["text"]) for r in whole) // 2).collect()
    assert 0 < len(part) < len(whole) and sum(len(r["text"]) for r in part) <= sum(len(r["text"]) for r in whole) // 2
    assert labelled(docs, labels, limit=5).count() <= 5
