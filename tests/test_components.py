import random

from engramlake.operators.components import connected_components


def test_against_union_find(spark):
    rng = random.Random(3)
    edges = [(f"n{rng.randrange(200):03d}", f"n{rng.randrange(200):03d}") for _ in range(150)]
    edges += [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)] + [("x", "x"), (None, "y"), ("h", "h0")] + [("h", f"h{i}") for i in range(50)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a and b and a != b:
            ra, rb = sorted((find(a), find(b)))
            parent[rb] = ra
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u string, v string")).collect()}
    assert got == {n: find(n) for n in parent}


def test_empty(spark):
    assert connected_components(spark.createDataFrame([], "u string, v string")).count() == 0
