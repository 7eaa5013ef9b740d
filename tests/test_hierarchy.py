import random

import pytest

from tarnbeck.operators.hierarchy import all_descendants, all_nodes, cycles, descendants, extra_parents, hierarchy

LINKS = "child_id string, parent_id string"


def walk(pairs):
    up = {}
    for c, p in pairs:
        if c and p:
            up[c] = min(p, up.get(c, p))
    out = {}
    for n in set(up) | set(up.values()):
        path, x = [], n
        while x in up and x not in path:
            path.append(x)
            x = up[x]
        if x in path:
            ring = path[path.index(x) :]
            out[n] = (None, None, min(ring), n in ring, None)
        else:
            path.append(x)
            out[n] = (x, len(path) - 1, None, False, path[::-1])
    return out


def frame(spark, pairs):
    return spark.createDataFrame(pairs, LINKS)


def got(df):
    return {r["node"]: (r["root"], r["depth"], r["cycle_id"], r["on_cycle"], r["path"]) for r in df.collect()}


@pytest.mark.parametrize(
    "pairs",
    [
        [("b", "a"), ("c", "b"), ("d", "c"), ("e", "d")],
        [("a", "a")],
        [("a", "b"), ("b", "a"), ("x", "a"), ("y", "x"), ("z", "y")],
        [("b", "a"), ("b", "a"), ("c", None), ("d", ""), (None, "a"), ("", "a")],
        [(f"n{i:03}", f"n{i + 1:03}") for i in range(70)],
        [(f"c{i}", "hub") for i in range(50)] + [("hub", "top")],
        [("b", "a"), ("b", "c")],
    ],
)
def test_shapes(spark, pairs):
    assert got(hierarchy(frame(spark, pairs))) == walk(pairs)


def test_random_forest_with_cycles(spark):
    rng = random.Random(5)
    pairs = []
    for i in range(400):
        kind = rng.random()
        p = f"n{rng.randrange(i)}" if i and kind < 0.5 else f"n{i - 1}" if i and kind < 0.93 else None
        pairs.append((f"n{i}", p))
    pairs = [(c, p) for c, p in pairs if p] + [("n0", "n37"), ("q1", "q2"), ("q2", "q3"), ("q3", "q1"), ("t", "q2")]
    want = walk(pairs)
    tree = hierarchy(frame(spark, pairs))
    assert got(tree) == want
    pairs_below = {(a, n, len(v[4]) - 1 - i) for n, v in want.items() if v[4] for i, a in enumerate(v[4]) if a != n}
    assert {tuple(r) for r in descendants(tree).collect()} == pairs_below
    assert {tuple(r) for r in cycles(frame(spark, pairs)).collect()} == {(n, v[2]) for n, v in want.items() if v[2]}


def test_empty_and_extra(spark):
    empty = frame(spark, []).withColumnRenamed("child_id", "child_id")
    assert hierarchy(empty).count() == 0 and cycles(empty).count() == 0
    df = spark.createDataFrame([("b", "a", 1), ("b", "c", 2)], LINKS + ", node int")
    assert got(hierarchy(df)) == walk([("b", "a")])
    assert [tuple(r) for r in extra_parents(df).collect()] == [("b", "c", "a")]


def climb(pairs):
    """(ancestor, node, distance) of every node, by walking up until a node comes again."""
    up = {}
    for c, p in pairs:
        if c and p:
            up[c] = min(p, up.get(c, p))
    out = set()
    for n in up:
        seen, x, d = {n}, up[n], 1
        while x is not None and x not in seen:
            out.add((x, n, d))
            seen.add(x)
            x, d = up.get(x), d + 1
    return out


def test_descendants_on_and_below_cycles(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("x", "b"), ("y", "x"), ("z", "y"), ("s", "s"), ("t", "s"), ("u", "t"), ("r1", "r"), ("r2", "r1")]
    rng = random.Random(9)
    pairs += [(f"n{i}", f"n{rng.randrange(120)}") for i in range(120)]
    for links in (pairs, [("b", "a"), ("c", "b")], [("a", "a")], []):
        got_pairs = [tuple(r) for r in all_descendants(frame(spark, links)).select("ancestor", "node", "distance").collect()]
        assert len(got_pairs) == len(set(got_pairs)) and set(got_pairs) == climb(links)


def test_roots_without_links(spark):
    pairs = [("b", "a"), ("c", None), ("d", ""), ("b", None), ("", "a"), (None, None), ("a", "")]
    want = walk(pairs) | {n: (n, 0, None, False, [n]) for n in ("c", "d")}
    assert got(all_nodes(frame(spark, pairs))) == want
