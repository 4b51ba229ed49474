import random

from dunlin.llm.components import components


def test_against_union_find(spark):
    rnd = random.Random(6)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(1000, 1080)] + [(5000, x) for x in range(6000, 6200)] + [(7, 7)]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        up[max(top(a), top(b))] = min(top(a), top(b))
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    df = spark.createDataFrame([*edges, (None, 3), (3, None)], "a long, b long")
    assert {r.node: r.label for r in components(df, "a", "b").collect()} == {x: top(x) for x in nodes}
    assert components(df.limit(0), "a", "b").count() == 0
