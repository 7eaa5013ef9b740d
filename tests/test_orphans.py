import datetime as dt
import random

from pyspark.sql import functions as F

from tarnbeck.operators.orphans import Parent, Reference, broken_counts, broken_references, key_states

P, R = "id string, created_at timestamp_ntz, deleted_at timestamp_ntz, extra int", "id string, parent string, created_at timestamp_ntz, extra int"


def day(n):
    return None if n is None else dt.datetime(2025, 1, 1) + dt.timedelta(days=n)


def frames(spark, parents, refs):
    p = spark.createDataFrame([(i, day(c), day(d), 1) for i, c, d in parents], P)
    r = spark.createDataFrame([(i, k, day(c), 1) for i, k, c in refs], R)
    return [Parent("p", p, "id")], [Reference("r", "parent", r, "id", "p")]


def brute(parents, refs):
    by = {}
    for i, c, d in parents:
        if i:
            by.setdefault(i, []).append((c, d))
    out = set()
    for i, k, c in refs:
        if not i or not k:
            continue
        if k not in by:
            out.add((i, "missing"))
        elif any(d is not None for _, d in by[k]):
            out.add((i, "deleted"))
        else:
            came = [x for x, _ in by[k] if x is not None]
            if came and c is not None and min(came) > c:
                out.add((i, "late"))
    return out


def found(spark, parents, refs):
    return {(r["ref_id"], r["reason"]) for r in broken_references(*frames(spark, parents, refs)).collect()}


def test_reasons(spark):
    parents = [("a", 0, None), ("b", 5, None), ("c", 0, 3), ("c", 0, 3), ("", 0, None), (None, 0, None), ("n", None, None), ("d", 9, 1)]
    refs = [("1", "a", 1), ("2", "b", 4), ("2", "b", 4), ("3", "b", 5), ("4", "c", 1), ("5", "x", 1), ("6", "", 1), ("7", None, 1), ("8", "n", 1), ("9", "a", None), (None, "x", 1), ("10", "d", 1)]
    assert found(spark, parents, refs) == brute(parents, refs) == {("2", "late"), ("4", "deleted"), ("5", "missing"), ("10", "deleted")}


def test_random_with_a_hot_key(spark):
    rng = random.Random(3)
    parents = [(f"k{i}", rng.choice([None, rng.randrange(60)]), rng.choice([None] * 6 + [5])) for i in range(80)]
    refs = [(f"r{i}", "hot" if i % 3 == 0 else f"k{rng.randrange(100)}", rng.randrange(60)) for i in range(2000)]
    assert found(spark, parents, refs) == brute(parents, refs)
    hot = key_states(*frames(spark, parents, refs)).where("key = 'hot'").first()
    assert hot["n_refs"] == 667 and not hot["is_there"]


def test_counts_and_empty(spark):
    parents, refs = [("a", 0, None)], [("1", "x", 1), ("2", "x", 40), ("3", "y", 41)]
    p, r = frames(spark, parents, refs)
    assert {(x["period"], x["n_references"]) for x in broken_counts(p, r).collect()} == {("2025-01", 1), ("2025-02", 2)}
    empty = [Parent("p", p[0].rows.limit(0), "id")]
    assert broken_references(empty, r).count() == 3
    nothing = [Reference("r", "parent", r[0].rows.where(F.lit(False)), "id", "p")]
    assert broken_references(p, nothing).count() == 0


def test_counts_by_month_equal_brute_force(spark):
    rng = random.Random(8)
    parents = [(f"k{i}", rng.choice([None, rng.randrange(90)]), rng.choice([None] * 6 + [5])) for i in range(60)]
    refs = [(f"r{i}", rng.choice(["hot", "k1", f"k{rng.randrange(70)}"]), rng.choice([None, *range(90)])) for i in range(1500)]
    refs += refs[:200]
    at = {i: c for i, _, c in refs}
    want = {}
    for i, reason in brute(parents, refs):
        key = (None if at[i] is None else day(at[i]).strftime("%Y-%m"), reason)
        want[key] = want.get(key, 0) + 1
    assert {(r["period"], r["reason"]): r["n_references"] for r in broken_counts(*frames(spark, parents, refs)).collect()} == want
