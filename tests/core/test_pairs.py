import numpy as np
from pyspark.sql import functions as F

from lakewright.operators import records, relating


def vectors(spark, n=300):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(n, 8))
    v /= np.linalg.norm(v, axis=1)[:, None]
    rows = [(i * 3, v[i].tolist(), int(i % 5 == 0)) for i in range(n)]
    return rows, spark.createDataFrame([*rows, (None, v[0].tolist(), 1), (1, None, 1), (2, v[0].tolist(), None)], "id long, v array<double>, g int")


def dot(x, y):
    s = 0.0
    for p, q in zip(x, y, strict=True):
        s += p * q
    return s


def test_every_pair_of_a_group_meets(spark, monkeypatch):
    """Ids that differ mod 64 too, and groups of several blocks."""
    monkeypatch.setattr(relating, "BLOCK", 50)
    rows, df = vectors(spark)
    want = {(a, b): dot(x, y) for a, x, g in rows for b, y, h in rows if a < b and g == h}
    got = relating.all_similar_pairs(df, "id", "v", "g", 0.5).collect()
    assert {(r.a, r.b): r.similarity for r in got} == {k: s for k, s in want.items() if s >= 0.5}
    assert len(got) == len({(r.a, r.b) for r in got}) and any(r.a % 64 != r.b % 64 for r in got)
    counts = {}
    for s in want.values():
        counts[int(np.floor(s * 20))] = counts.get(int(np.floor(s * 20)), 0) + 1
    assert {r.bucket: r.n for r in relating.all_similarity_counts(df, "id", "v", "g", 20).collect()} == counts


def test_pair_classes_count_the_pairs_of_the_audit(spark):
    rows = [(i, f"h{i % 3}", [[], [1], [2], [1, 2]][i * 7 % 4]) for i in range(60)] + [(5, "h2", [1]), (6, "h0", [1]), (99, "lone", [])]
    df = spark.createDataFrame(rows, "id long, k string, c array<int>")
    want = {r.k: r.n for r in records.pair_audit(df, "id", "k", "c").groupBy("k").agg(F.count("*").alias("n")).collect()}
    got = {r.k: (r.n, r.silent, r.pairs) for r in records.pair_classes(df, "id", "k", "c").collect()}
    assert {k: p for k, (_, _, p) in got.items()} == want | {"lone": 0}
    assert got["lone"] == (1, 1, 0) and sum(n for n, _, _ in got.values()) == len(rows)


def test_pairs_that_meet_are_dealt_by_their_number(spark, monkeypatch):
    """Tasks grow with the rows, so none holds more of them; the journal names a pair in either order, and nulls meet nothing."""
    monkeypatch.setattr(relating, "ROWS", 100)
    monkeypatch.setattr(relating, "PAIRS", 100)
    rng = np.random.default_rng(3)
    for n in (400, 4000):
        rows = [(int(k), int(v)) for k, v in zip(rng.integers(0, n // 4, n), rng.integers(0, n, n), strict=True)] + [(None, 1), (None, 2), (0, None), (0, 5), (0, 5)]
        df = spark.createDataFrame(rows, "k long, v long")
        want = {(a, b) for k, a in rows for j, b in rows if k is not None and k == j and a is not None and b is not None and a < b}
        pairs, tasks = relating.met_pairs(df, "k", "v")
        held = [len(p) for p in pairs.rdd.glom().collect()]
        got = [(r.a, r.b) for r in pairs.collect()]
        assert set(got) == want and len(got) == len(want)
        assert len(held) == tasks and tasks > n // 100 and max(held) < 200
        journal = spark.createDataFrame([(b, a) if a % 2 else (a, b) for a, b in sorted(want)[::3]] + [(None, 1)], "a long, b long")
        left = relating.undecided_pairs(pairs, journal, tasks).collect()
        assert {(r.a, r.b) for r in left} == want - set(sorted(want)[::3]) and len(left) == len(want) - len(sorted(want)[::3])


def test_pair_queries_keep_many_tasks(spark, sf_dir, monkeypatch):
    """What one task holds is bounded, where both queries took the session's number of tasks for any table."""
    import __spark_entry__ as e

    monkeypatch.setattr(relating, "ROWS", 1000, raising=False)
    monkeypatch.setattr(relating, "PAIRS", 1000, raising=False)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for name in ("unsettled_pairs", "undecided_supplier_pairs"):
            assert e.queries()[name](spark, sf_dir).rdd.getNumPartitions() > 6
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
