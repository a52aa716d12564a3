import random

from quarry.llm.graph import components


def test_components(spark):
    r = random.Random(9)
    edges = [(i, i + 1) for i in range(100, 160)]                     # a long chain
    edges += [(1000, i) for i in range(200, 260)] + [(7, 7)]          # a star, a loop
    edges += [(r.randrange(300, 400), r.randrange(300, 400)) for _ in range(70)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {x["node"]: x["label"] for x in components(spark.createDataFrame(edges, "a int, b int")).collect()}
    linked = {x for a, b in edges for x in (a, b) if a != b}
    assert got == {x: find(x) for x in linked}
    assert components(spark.createDataFrame([], "a int, b int")).count() == 0
