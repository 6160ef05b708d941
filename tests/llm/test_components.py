import random

from twinplan.llm import components as C


def expected(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent if find(x) != x}


def test_both_ways_find_the_components(spark, monkeypatch):
    rnd = random.Random(1)
    pairs = [(rnd.randrange(120), rnd.randrange(120)) for _ in range(70)] + [(k, k + 1) for k in range(200, 230)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    for most in (500_000, 0):
        monkeypatch.setattr(C, "ONE_TASK", most)
        assert {r["node"]: r["component"] for r in C.components(edges).collect()} == expected(pairs)
