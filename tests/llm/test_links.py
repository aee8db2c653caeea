import random

from bidloom.llm.links import components


def test_components_equal_union_find(spark):
    draw = random.Random(6)
    edges = [(i, i + 1) for i in range(100, 160)] + [(draw.randrange(300, 420), draw.randrange(300, 420)) for _ in range(70)] + [(500, i) for i in range(501, 560)] + [(7, 7)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
