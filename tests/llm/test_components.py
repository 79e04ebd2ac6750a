"""Components against union-find on the shapes that are hardest for them."""

import random

import pytest

from sluice.llm.components import connected


def joined(edges):
    to = {}

    def root(x):
        to.setdefault(x, x)
        while to[x] != x:
            to[x] = to[to[x]]
            x = to[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        to[b] = a
    return {x: root(x) for x in to}


def shapes():
    draw = random.Random(1)
    ids = list(range(5000))
    draw.shuffle(ids)
    return {
        "random path": list(zip(ids, ids[1:], strict=False)),
        "sorted path": [(i, i + 1) for i in range(4999)],
        "star": [(50_000, i) for i in range(100_001) if i != 50_000],
        "pairs": [(i, i + 10**12) for i in range(300)],
        "random": [(draw.randrange(4000), 4000 + draw.randrange(4000)) for _ in range(3500)],
    }


@pytest.mark.parametrize("name", ["random path", "sorted path", "star", "pairs", "random"])
def test_shape(spark, name):
    edges = shapes()[name]
    got = {r.node: r.component for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == joined(edges)


def test_edges(spark):
    rows = [(1, None), (None, 2), (3, 3), (4, 5), (5, 4), (4, 5)]
    got = {r.node: r.component for r in connected(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {4: 4, 5: 4}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0
    assert {tuple(r) for r in connected(spark.createDataFrame([("b", "a")], "a string, b string")).collect()} == {("a", "a"), ("b", "a")}
