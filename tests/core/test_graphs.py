import random

from lakewright.operators import graphs


def test_roots_of_long_threads_and_cycles(spark):
    rng = random.Random(4)
    up = {1: None, 500: 777, 900: 900, **{i: i - 1 for i in range(2, 150)}}  # a chain of 149, an unknown parent, an answer to itself
    up |= {600 + i: 600 + (i + 1) % 45 for i in range(45)} | {550: 551, 551: 620, 699: 644}  # a cycle of 45 and tails into it
    up |= {i: rng.choice([*range(1000, i), None]) for i in range(1000, 1060)}
    want = {}
    for i in up:
        seen, at = [i], up[i]
        while at in up and at not in seen:
            seen.append(at)
            at = up[at]
        want[i] = min(seen) if at in up else seen[-1]
    spark.createDataFrame(list(up.items()), "id long, parent long").createOrReplaceTempView("t_long")
    got = graphs.thread_roots(spark, "t_long", "id", "parent").collect()
    assert {r.id: r.root for r in got} == want and len(got) == len(up) and want[149] == 1 and want[550] == 550 and want[699] == 600


def test_paths_below_level_50_and_through_cycles(spark):
    rows = [(1, None), (500, 777), *((i, i - 1) for i in range(2, 121)), (3, 120), (200, 2), (200, 5), (300, 301), (301, 300)]
    want, todo = [], [(i, [i]) for i, p in rows if p is None]
    while todo:
        at, seen = todo.pop()
        want.append((at, len(seen) - 1, "/".join(f"n{x}" for x in seen)))
        todo += [(i, [*seen, i]) for i, p in rows if p == at and i not in seen]
    spark.createDataFrame([(i, p, f"n{i}") for i, p in rows], "id long, parent long, label string").createOrReplaceTempView("t_deep")
    got = [tuple(r) for r in graphs.paths(spark, "t_deep", "id", "parent", "label").collect()]
    assert sorted(got) == sorted(want) and max(d for _, d, _ in got) == 119
