import random

import pytest

from lakewright.operators import identity
from lakewright.plans import tables


def test_every_order_links_over_the_whole_id_range(spark, tmp_path):
    """Ids above 1500, and order keys that 41 does not divide."""
    rng = random.Random(3)
    customers = sorted(rng.sample(range(1, 4000), 1500))
    orders = [(k, rng.choice(customers)) for k in range(1, 900)]
    spark.createDataFrame([(c,) for c in customers], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    near = {c: set() for c in customers}
    for k, a in orders:
        b = (a * 7 + k % 3) % (max(customers) + 1)
        if b in near:
            near[a].add(b)
            near[b].add(a)
    want = {}
    for c in customers:
        todo = [] if c in want else [c]
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = c
                todo += near[x]
    got = {r.id: r.component for r in tables.R.queries["order_components"](spark, str(tmp_path)).collect()}
    assert got == want and any(c != x and c > 1500 for x, c in want.items())


@pytest.mark.parametrize("finish", [0, 30, 1 << 18])
def test_rounds_and_the_last_task_agree(spark, monkeypatch, finish):
    """Chains, stars and rings, with null ends, loops, repeated edges and edges to ids that are no node."""
    monkeypatch.setattr(identity, "FINISH", finish)
    rng = random.Random(5)
    edges = [(k, k + 1) for k in range(300)] + [(1000, 1000 + k) for k in range(1, 200)] + [(2000 + k, 2000 + (k + 1) % 50) for k in range(50)] + [(rng.randint(3000, 3400), rng.randint(3000, 3400)) for _ in range(180)]
    edges += [(5, 5), (None, 4), (7, None), (0, 1), (4000, -9), (-9, 4001)]
    ids = [*range(301), *range(1000, 1200), *range(2000, 2050), *range(3000, 3401), 4000, 4001, 4002]
    root = {i: i for e in edges for i in e if i is not None} | {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    groups = {}
    for i in ids:
        groups.setdefault(find(i), []).append(i)
    got = identity.contraction_components(spark.createDataFrame(edges, "a long, b long"), spark.createDataFrame([(i,) for i in ids], "n long"), "n")
    assert {r.id: r.component for r in got.collect()} == {i: min(g) for g in groups.values() for i in g}
