import random

import pytest

from stopgrid.operators.components import connected_components


def brute(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("kind", ["random", "path", "star", "empty"])
def test_components(spark, kind):
    r = random.Random(4)
    edges = {
        "random": [(r.randint(-50, 150), r.randint(-50, 150)) for _ in range(120)] + [(None, 3), (7, None), (900, 900)],
        "path": [(i, i + 1) for i in range(60)],
        "star": [(500, i) for i in range(40)],
        "empty": [],
    }[kind]
    out = connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert len(out) == len({x.node for x in out})
    assert {x.node: x.component for x in out} == brute(edges)


def test_the_driver_joins_few_edges_as_the_rounds_do(spark):
    r = random.Random(12)
    edges = [(r.randrange(-400, 400), r.randrange(-400, 400)) for _ in range(330)] + [(k, k + 1) for k in range(1000, 1100)] + [(7000, 7000), (None, 3), (7001, None)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    want = sorted(tuple(x) for x in connected_components(df).collect())
    assert sorted(tuple(x) for x in connected_components(df, local=1000).collect()) == want
    assert sorted(tuple(x) for x in connected_components(df, local=5).collect()) == want
    assert connected_components(df.where("a > 9000"), local=5).count() == 0
