import random

import pytest

from callweave.operators.graph import preorder


def walked(edges, roots):
    """Depth first, below the parent that is nearest to a root and first by ord."""
    depth, parent, level = dict.fromkeys(roots, 0), {}, list(roots)
    d = 0
    while level:
        d += 1
        found = {}
        for s, t, o in edges:
            if s in level and t not in depth:
                found[t] = min(found.get(t, (o, s)), (o, s))
        for t, p in found.items():
            depth[t], parent[t] = d, p
        level = list(found)
    out = []

    def go(n):
        out.append((n, depth[n], len(out)))
        for _, c in sorted((o, t) for t, (o, s) in parent.items() if s == n):
            go(c)

    for r in sorted(roots):
        go(r)
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_walk_of_graphs(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(25), rng.randrange(25), rng.randrange(9)) for _ in range(40)]
    roots = rng.sample(range(25), 2)
    got = preorder(spark.createDataFrame(edges, "src int, dst int, ord int"), spark.createDataFrame([(r,) for r in roots], "node int"))
    assert sorted(tuple(r) for r in got.collect()) == walked(edges, roots)
