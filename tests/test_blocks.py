"""Cut points and impact of graphs with cycles, long chains and several components, against a walk without each node."""

import random

import pytest

from ridgeline.operators import blocks


def _reached(around, start, gone):
    seen, todo = {start}, [start]
    while todo:
        for y in around.get(todo.pop(), ()):
            if y != gone and y not in seen:
                seen.add(y)
                todo.append(y)
    return seen


def _by_hand(nodes, ties):
    """For each node: what the least remaining one no longer reaches without it; and what the least of all reaches."""
    around = {}
    for a, b in ties:
        around.setdefault(a, set()).add(b)
        around.setdefault(b, set()).add(a)
    lost = {g: set(nodes) - {g} - _reached(around, min(x for x in nodes if x != g), g) for g in nodes}
    return lost, _reached(around, min(nodes), None)


def _graphs():
    pick = random.Random(5)
    yield "ring with a tail", range(7), [(0, 1), (1, 2), (2, 3), (3, 0), (2, 4), (4, 5), (6, 4)]
    yield "two components", range(9), [(0, 5), (5, 6), (6, 0), (6, 7), (1, 2), (2, 3), (3, 8)]
    yield "the least alone with one", range(5), [(0, 4), (1, 2), (2, 3)]
    for n, m in ((20, 24), (30, 28)):
        yield f"random {n} {m}", range(n), [(pick.randrange(n), pick.randrange(n)) for _ in range(m)]


@pytest.mark.parametrize(("name", "nodes", "ties"), list(_graphs()), ids=lambda x: x if isinstance(x, str) else "")
def test_cut_points_and_impact(spark, name, nodes, ties):
    edges = spark.createDataFrame([(a, b) for a, b in ties] + [(b, a) for a, b in ties[::2]], "src long, dst long").repartition(3)
    ids = spark.createDataFrame([(n,) for n in nodes], "id long")
    lost, whole = _by_hand(nodes, ties)
    held = blocks.blocks(edges)
    assert {(r.gone, r.node) for r in blocks.impact(ids, edges, ids, held).collect()} == {(g, n) for g in nodes for n in lost[g]}
    assert {r.id: r.cut_off for r in blocks.cut_points(ids, edges, held).collect()} == {g: len(lost[g] & whole) for g in nodes if lost[g] & whole}


def test_a_chain_of_many_hops(spark):
    """Longer than any walk level by level would go, with one ring at its end, and a hub."""
    n = 1200
    edges = spark.range(n).selectExpr("id as src", "id + 1 as dst").union(spark.createDataFrame([(n, n - 9)], "src long, dst long")).union(spark.range(100).selectExpr("100000L + id as src", "5L as dst"))
    ids = spark.range(n + 1).union(spark.range(100_000, 100_100))
    got = {r.id: r.cut_off for r in blocks.cut_points(ids, edges).collect()}
    want = {i: n - i + (100 if i <= 5 else 0) for i in range(1, n - 8)}
    assert got == want


def test_no_edges(spark):
    ids = spark.range(4)
    none = spark.createDataFrame([], "src long, dst long")
    assert blocks.cut_points(ids, none).count() == 0
    assert blocks.impact(ids, none, ids.where("id = 2")).collect()[0].asDict().keys() == {"gone", "node"}
