from collections import Counter

import pytest

from tarnbeck.llm.mixing import deviations, frames, mix, pfair, whole_weights

TARGETS = "source string, target_share double, max_repeats int"


SHARES = [
    {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 1.0}, {"a": 0.98, "b": 0.01, "c": 0.01}, {f"s{i}": 1 / 17 for i in range(17)},
    {"a": 0.16, "b": 0.2, "c": 0.61}, {"a": 0.9999, "b": 0.00003, "c": 0.00007}, {f"s{i}": 1 / (i + 2) for i in range(30)},
]


@pytest.mark.parametrize("shares", SHARES)
@pytest.mark.parametrize("frame", [1, 7, 1000])
def test_a_source_is_less_than_two_half_blocks_off_at_every_slot(shares, frame):
    weights = whole_weights(shares)
    whole, slots = sum(weights.values()), 10 * frame if frame > 100 else 3000
    seen, t = Counter(), 0
    for counts in frames(weights, slots, frame):
        assert all(seen[s] == first for s, (first, _) in counts.items())
        order = pfair({s: n for s, (_, n) in counts.items()})
        assert len(order) == frame
        for s in order:
            seen[s] += 1
            t += 1
            assert all(abs(seen[x] * whole - t * n) < 2 * whole for x, n in weights.items())
        assert all(abs(seen[x] * whole - t * n) < whole for x, n in weights.items())
    assert t >= slots


def test_weights_are_exact():
    assert whole_weights({"a": 0.1, "b": 0.2, "c": 0.67}) == {"a": 10, "b": 20, "c": 67}


def test_a_frame_stops_once_it_has_what_is_wanted():
    full = pfair({"a": 600, "b": 400})
    assert pfair({"a": 600, "b": 400}, {"a": 3, "b": 2}) == full[: max(full.index("b", full.index("b") + 1), [i for i, s in enumerate(full) if s == "a"][2]) + 1]
    assert pfair({"a": 600, "b": 0}, {"a": 0, "b": 0}) == []


@pytest.mark.parametrize("frame", [13, 64])
def test_the_deviation_stays_below_one_block_and_a_document_over_many_frames(spark, frame):
    docs = [(i, "abc"[i % 3], 20 + i % 11) for i in range(6000)]
    sized = spark.createDataFrame(docs, "doc_id long, source string, n_tokens int")
    targets = spark.createDataFrame([("a", 0.16, 3), ("b", 0.2, 3), ("c", 0.61, 3), ("gone", 0.03, 1)], TARGETS)
    m = mix(sized, targets, block_tokens=400, slots=frame)
    rows = sorted(m.rows.collect(), key=lambda r: (r["slot"], r["start"], r["doc_id"]))
    assert rows[-1]["slot"] > 10 * frame
    aimed = {r["source"]: r["aimed_share"] for r in m.shares.collect() if r["aimed_share"]}
    total, by, most = 0, Counter(), Counter()
    for i, r in enumerate(rows):
        total += r["n_tokens"]
        by[r["source"]] += r["n_tokens"]
        if i + 1 == len(rows) or rows[i + 1]["slot"] != r["slot"]:
            for s in aimed:
                most[s] = max(most[s], abs(by[s] - total * aimed[s]))
    for r in deviations(m, 400).collect():
        assert r["deviation"] == pytest.approx(most[r["source"]]) and r["deviation"] < r["allowed"] <= 400 + 2 * 30


def test_mixture(spark):
    docs = [(i, "big" if i % 3 else "small", 50 + i % 7) for i in range(600)] + [(600, "big", 0), (601, "other", 9), (602, None, 9), (603, "big", None)]
    sized = spark.createDataFrame(docs, "doc_id long, source string, n_tokens int")
    targets = spark.createDataFrame([("big", 0.4, 2), ("small", 0.5, 3), ("gone", 0.1, 2), (None, 0.2, 1), ("big", 0.1, 1)], TARGETS)
    m = mix(sized, targets, block_tokens=200, slots=90)
    rows = sorted(m.rows.collect(), key=lambda r: (r["slot"], r["start"], r["doc_id"]))
    report = {r["source"]: r for r in m.shares.collect()}
    assert set(report) == {"big", "small", "gone"} and report["gone"]["mixed_tokens"] == 0
    assert report["small"]["most_repeats"] == 3 and report["big"]["most_repeats"] <= 2
    assert max(Counter((r["doc_id"], r["repeat"]) for r in rows).values()) == 1
    total, by = 0, Counter()
    for r in rows:
        total += r["n_tokens"]
        by[r["source"]] += r["n_tokens"]
        for s in ("big", "small"):
            assert abs(by[s] - total * report[s]["aimed_share"]) <= 200 + 2 * 56
    assert abs(report["big"]["actual_share"] - 4 / 9) < 0.01
    assert sum(r["mixed_tokens"] for r in report.values()) == total


def test_empty(spark):
    sized = spark.createDataFrame([], "doc_id long, source string, n_tokens int")
    targets = spark.createDataFrame([("a", 1.0, 2)], TARGETS)
    m = mix(sized, targets)
    assert m.rows.count() == 0 and m.shares.first()["actual_share"] == 0
    assert mix(sized, targets.limit(0)).shares.count() == 0
