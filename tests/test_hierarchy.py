import random
import time

import pytest

from corrobora.operators import hierarchy

CASE = [("A:1", ["A:2"]), ("A:2", ["A:3", "A:9"]), ("A:3", ["A:1"]), ("A:4", ["a_003 ! name"]), ("A:5", ["A:5"]), ("A:6", ["A:5", "A:7", None, "B:9", "A:77"]), ("A:7", ["A:8"]), ("A:8", None), ("A:9", ["A:10"]), ("A:10", ["A:9"]), ("A:11", ["A:12"]), ("A:12", ["A:11", "A:5"]), ("A:8", None), (None, ["A:1"]), ("A:13", [])]


def brute(rows):
    ids = {i for i, _ in rows if i}
    parents = {i: set() for i in ids}
    for i, ps in rows:
        for p in ps or []:
            key = p and p.split(" !")[0].strip().upper().replace("_", ":")
            key = key and key.split(":")[0] + ":" + (key.split(":")[1].lstrip("0") or "0")
            if i and key in ids:
                parents[i].add(key)
    out = set()
    for i in ids:
        dist, front, own = {i: 0}, [i], False
        while front:
            new = []
            for n in front:
                for p in parents[n]:
                    own |= p == i
                    if p not in dist:
                        dist[p] = dist[n] + 1
                        new.append(p)
            front = new
        roots = [(i, "rooted", p, k) for p, k in dist.items() if not parents[p]]
        out |= {(i, "cycle", "", -1)} if own else set(roots) or {(i, "stray", "", -1)}
    return out


def closure_of(edges, nodes):
    parents, out = {n: set() for n in nodes}, {}
    for c, p in edges:
        parents[c].add(p)
    for n in nodes:
        dist, front = {n: 0}, [n]
        while front:
            new = []
            for x in front:
                for p in parents[x]:
                    if p not in dist:
                        dist[p] = dist[x] + 1
                        new.append(p)
            front = new
        out.update({(p, n): k for p, k in dist.items()})
    return out


def both(spark, nodes, edges):
    return spark.createDataFrame([(n,) for n in nodes], "id string"), spark.createDataFrame(sorted(set(edges)), "child string, parent string")


def test_case(spark):
    df = spark.createDataFrame([(i, p, "x") for i, p in CASE], "id string, parents array<string>, node string")
    got = [tuple(r) for r in hierarchy.standings(df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(CASE)


def shapes():
    rng = random.Random(5)
    name = lambda k: f"n{k:03d}"
    yield "random", 40, [(name(k), name(rng.randrange(40))) for k in range(40) for _ in range(rng.choice([0, 1, 1, 2]))]
    yield "dag", 70, [(name(k), name(rng.randrange(k))) for k in range(1, 70) for _ in range(rng.choice([1, 1, 1, 2]))]
    yield "caterpillar", 60, [(name(k), name(k - 1)) for k in range(1, 30)] + [(name(30 + k), name(k)) for k in range(30)]
    yield "bypass", 40, [(name(k), name(k - 1)) for k in range(1, 40)] + [(name(30), name(3)), (name(39), name(20))]
    yield "ring", 50, [(name(k), name((k + 1) % 20)) for k in range(20)] + [(name(k), name(k - 1)) for k in range(21, 40)] + [(name(40), name(7)), (name(3), name(39)), (name(41), name(41)), (name(42), name(41))]
    yield "closed", 30, [(name(k), name((k + 1) % 17)) for k in range(17)] + [(name(k), name(k - 17)) for k in range(17, 30)]


@pytest.mark.parametrize(("what", "n", "edges"), list(shapes()), ids=[s[0] for s in shapes()])
def test_shapes(spark, what, n, edges):
    nodes = [f"n{k:03d}" for k in range(n)]
    df, links = both(spark, nodes, edges)
    want = closure_of(edges, nodes)
    got = hierarchy.closure(df, links).collect()
    assert {(r.node, r.below): r.steps for r in got} == want and len(got) == len(want)
    tops = set(nodes) - {c for c, _ in edges}
    found, cyclic = hierarchy.roots(df, links)
    rows = found.collect()
    loops = {c for c, p in edges if (c, p) in want}
    assert {(r.node, r.origin): r.steps for r in rows} == {(d, a): k for (a, d), k in want.items() if a in tops} and len(rows) == len({(r.node, r.origin) for r in rows})
    assert {r.node for r in cyclic.collect()} == {c for c, p in edges if (c, p) in {(a, d) for a, d in want}}, loops
    asked = df.limit(3).select(df.id.alias("node"))
    some = {r.node for r in asked.collect()}
    assert {(r.above, r.node) for r in hierarchy.ancestors(asked, links).collect()} == {(a, d) for a, d in want if d in some}
    assert {(r.start, r.node) for r in hierarchy.under(asked, links).collect()} == {(a, d) for a, d in want if a in some}


def test_deep_and_wide(spark):
    """A chain of 10,000 nodes and a root that holds a third of all."""
    began = time.time()
    rows = [(f"T:{k}", [f"T:{k - 1}"] if k > 1 else None) for k in range(1, 10_001)] + [(f"W:{k}", ["W:1"] if k > 1 else None) for k in range(1, 5_001)]
    got = hierarchy.standings(spark.createDataFrame(rows, "id string, parents array<string>")).collect()
    assert {(r.term_id, r.root_id, r.n_steps) for r in got} == {(f"T:{k}", "T:1", k - 1) for k in range(1, 10_001)} | {(f"W:{k}", "W:1", int(k > 1)) for k in range(1, 5_001)}
    assert time.time() - began < 60


def test_profiles(spark):
    rows = [("T:1", None), ("T:2", ["T:1"]), ("T:3", ["T:2", "T:1"]), ("T:4", ["T:3"]), ("T:5", ["T:2", "T:6"]), ("T:6", ["T:1"]), ("T:7", ["T:7"])]
    df = spark.createDataFrame(rows, "id string, parents array<string>")
    want = {("T:1", "T:1", 0, "T:1", 5), ("T:2", "T:1", 1, "T:1>T:2", 3), ("T:3", "T:1", 1, "T:1>T:3", 1), ("T:4", "T:1", 2, "T:1>T:3>T:4", 0), ("T:5", "T:1", 2, "T:1>T:2>T:5", 0), ("T:6", "T:1", 1, "T:1>T:6", 1)}
    assert {tuple(r) for r in hierarchy.profiles(df).collect()} == want


def test_empty(spark):
    df = spark.createDataFrame([], "id string, parents array<string>")
    assert hierarchy.standings(df).count() == 0 and hierarchy.descendants(df).count() == 0 and hierarchy.profiles(df).count() == 0
