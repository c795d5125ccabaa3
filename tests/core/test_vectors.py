"""The vector index against all pairs, on clustered, scattered and equal vectors."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lakewright.operators import vectors as V


def rows_of(seed=3, n=700, dim=24):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, dim))
    out = [centres[i % 9] + rng.normal(size=dim) * (0.02 if i % 3 else 0.6) for i in range(n)]
    return [(i, [float(x) for x in v]) for i, v in enumerate(out)] + [(5000 + i, [float(x) for x in out[7]]) for i in range(60)]


@pytest.fixture(scope="module")
def table(spark):
    odd = [(9001, None), (9002, [0.0] * 24), (9003, [float("nan")] * 24), (9004, [None] * 24), (9005, [float("inf")] * 24)]
    return spark.createDataFrame(rows_of() + odd, "id long, v array<double>").repartition(5)


def products(rows):
    u = np.array([v for _, v in rows])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    return np.array([i for i, _ in rows]), np.rint(u @ u.T * V.PART)


def test_pairs_are_all_found_and_few_examined(spark, table):
    index = V.build(V.unit_rows(table, "id", "v"))
    ids, s = products(rows_of())
    for least in (0.985, 0.9, 0.3):
        found, examined = V.similar_pairs(index, least)
        got = {(r.left_id, r.right_id) for r in found.collect()}
        assert found.count() == len(got)
        i, j = np.nonzero(np.triu(s >= round(least * V.PART), 1))
        assert got == {(int(min(a, b)), int(max(a, b))) for a, b in zip(ids[i], ids[j], strict=True)}
        if least > 0.9:
            assert examined < len(ids) ** 2 / 4


def test_counts_and_nearest_of_distinct_vectors(table):
    reps, members = V.distinct_vectors(table, "id", "v")
    index = V.build(reps)
    assert index.rows.count() == 700 and members.where("stands_for = 7").count() == 61 and members.where("id = 7").first()["second"] == 5000
    ids, s = products(rows_of())
    found, _ = V.link_counts(index, index.rows.select("id", "u"), 0.95)
    got = {r.id: (r.n, r.hit) for r in found.collect()}
    for k in range(700):
        hits = [(-s[k, j], int(ids[j])) for j in range(len(ids)) if ids[j] != k and s[k, j] >= 0.95 * V.PART]
        first = [h for h in hits if h[1] < 5000]
        n = len(hits) - (60 if k == 7 else 0)  # the copies of a row are its class, not its links
        assert (got[k] == (n, min(first)[1])) if first else k not in got


def test_best_accepted_goes_on_until_one_passes(spark, table):
    index = V.build(V.unit_rows(table, "id", "v"))
    searches = index.rows.where("id % 50 = 0").select("id", "u")
    found = V.best_accepted(index, searches, 0.5, lambda c: c.where("hit % 37 = 5"))
    got = {r.id: r.hit for r in found.collect()}
    ids, s = products(rows_of())
    for k in np.flatnonzero(ids % 50 == 0):
        hits = [(-s[k, j], int(ids[j])) for j in range(len(ids)) if j != k and ids[j] % 37 == 5 and s[k, j] >= 0.5 * V.PART]
        assert got.get(int(ids[k])) == (min(hits)[1] if hits else None)


def test_classes_and_reuse(spark, table):
    ids, s = products(rows_of())
    root = {int(i): int(i) for i in ids}
    for _ in range(20):
        for a, b in zip(*np.nonzero(s >= 0.97 * V.PART), strict=True):
            low = min(root[int(ids[a])], root[int(ids[b])])
            root[int(ids[a])] = root[int(ids[b])] = low
    got = {r.id: r.component for r in V.similar_classes(table, "id", "v", 0.97).collect()}
    assert {k: v for k, v in got.items() if k < 9000} == root and all(got[k] == k for k in range(9001, 9006))
    out = V.reused(table, "id", "v", F.size("v"), 0.97, 20).collect()
    assert {r.id: r.representative for r in out} == got
    assert sum(r.reviewed for r in out) == max(20, len({v for v in got.values() if list(got.values()).count(v) > 1}))


def test_a_row_is_sent_for_each_block_and_not_for_each_cell(table):
    index = V.build(V.unit_rows(table, "id", "v"), cells=40)

    def compare(a, b, *_):
        return pd.DataFrame({"n": [len(a) + len(b)]})

    met, examined = V._met(index, index.rows, 0.3, compare, "n long", later=True)
    assert sum(r.n for r in met.collect()) == 2 * index.rows.count() and examined > 20 * index.rows.count()


def test_large_cells_fill_blocks_of_their_own(monkeypatch):
    monkeypatch.setattr(V, "LEAST_BLOCK", 10)
    dealt, blocks = V._dealt(np.array([4, 5, 25, 0, 3, 9]))
    assert dealt == [(0, 0, 1), (1, 0, 1), (2, 1, 3), (3, 4, 1), (4, 4, 1), (5, 5, 1)] and blocks == 6


def test_blocks_that_split_cells_lose_no_pair(monkeypatch, spark, table):
    monkeypatch.setattr(V, "LEAST_BLOCK", 60)
    monkeypatch.setattr(V, "MOST_BLOCK", 60)
    index = V.build(V.unit_rows(table, "id", "v"))
    ids, s = products(rows_of())
    i, j = np.nonzero(np.triu(s >= round(0.6 * V.PART), 1))
    assert {(r.left_id, r.right_id) for r in V.similar_pairs(index, 0.6)[0].collect()} == {(int(min(a, b)), int(max(a, b))) for a, b in zip(ids[i], ids[j], strict=True)}
    got = {r.id: (r.n, r.hit) for r in V.link_counts(index, None, 0.6)[0].collect()}
    assert got == {r.id: (r.n, r.hit) for r in V.link_counts(index, index.rows.select("id", "u"), 0.6)[0].collect()}
    assert sum(n for n, _ in got.values()) == 2 * len(i)


def test_empty_index(spark, table):
    index = V.build(V.unit_rows(table.where("id < 0"), "id", "v"))
    assert V.similar_pairs(index, 0.9)[0].count() == 0
    assert V.similar_classes(table.where("id = 9001"), "id", "v", 0.9).count() == 1


def test_word_vectors_tell_texts_apart(spark):
    df = spark.createDataFrame([(1, "the cat sat on the mat"), (2, "The CAT sat; on the mat!"), (3, "entirely different words here"), (4, None), (5, "")], "id long, t string")
    got = {r.id: np.array(r.v) for r in df.select("id", V.word_vector(F.col("t")).alias("v")).collect()}
    assert (got[1] == got[2]).all() and not (got[1] == got[3]).all() and not got[4].any() and not got[5].any()
