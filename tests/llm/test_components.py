import random

from tribune.llm.components import components


def test_random_graphs_paths_and_stars(spark):
    rng = random.Random(1)
    ids = [rng.randrange(-(2**62), 2**62) for _ in range(400)]
    edges = [(rng.choice(ids[:300]), rng.choice(ids[:300])) for _ in range(250)]
    edges += [(ids[k], ids[k + 1]) for k in range(300, 340)] + [(ids[350], ids[k]) for k in range(351, 400)]
    edges += [(ids[0], ids[0]), edges[0], edges[0][::-1], (None, ids[1])]
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        if a is not None:
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert got == {i: top(i) for i in ids if i in got}
    assert set(got) == {i for e in edges if e[0] is not None and e[0] != e[1] for i in e}
    assert components(spark.createDataFrame([], "x long, y long")).count() == 0
