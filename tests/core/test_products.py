import math

import numpy as np
import pandas as pd
import pytest

from lakewright.operators import products, ranking, terms


def cosine(a, b):
    if a is None or b is None or len(a) != len(b):
        return None
    n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b)) / n if n > 0 else None


@pytest.fixture
def vectors():
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 4)], int(rng.integers(0, 3))) for i in range(160)]
    copies = [(200 + i, [1.0, 2.0, 0.0, 1.0], i % 3) for i in range(30)]
    odd = [(250, None, 1), (300, [0.0] * 4, 1), (350, [1.0, 2.0], 2), (351, [2.0, 4.0], 1), (352, [1.0, 1.0, 1.0, 1.0], None)]
    return rows + copies + odd


def small_blocks(monkeypatch):
    for name, n in (("LEFT", 3), ("LEAST_RIGHT", 20), ("MOST_RIGHT", 40), ("TILE", 50)):
        monkeypatch.setattr(products, name, n)


def test_bridges_meet_every_row_whatever_the_blocks(spark, vectors, monkeypatch):
    small_blocks(monkeypatch)
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int")
    want = {}
    for q, v, c in vectors:
        for r, w, d in vectors:
            s = cosine(v, w)
            if q % 50 == 0 and q != r and None not in (c, d, s) and c != d and round(s, 3) >= 0.5:
                want[min(q, r), max(q, r)] = round(s, 3)
    want = sorted((-s, a, b) for (a, b), s in want.items())[:40]
    out = terms.bridges(df.where("vec_id % 50 = 0"), df, "vec_id", "embedding", "label", least=0.5, most=40).collect()
    assert [(-r.similarity, r.left_id, r.right_id) for r in out] == want
    label = {i: c for i, _, c in vectors}
    assert all((r.left_corpus, r.right_corpus) == (label[r.left_id], label[r.right_id]) for r in out)


def test_a_block_sends_only_its_closest_pairs():
    a, b = (pd.DataFrame({"id": range(k, k + 300), "v": [np.array([1.0, 0.5])] * 300, "corpus": [k] * 300}) for k in (0, 1000))
    assert len(products._closest(0.3, 200, 3)(a, b)) == 200


def test_halves_round_up_as_in_spark(spark):
    x = [0.0005, 0.0015, 0.0025, 0.1235, 0.30049999999, -0.0005, -0.1234, 1.0]
    want = [r.x for r in spark.createDataFrame([(v,) for v in x], "v double").selectExpr("round(v, 3) AS x").collect()]
    assert products._rounded(np.array(x), 3).tolist() == want


def test_nearest_of_every_search_whatever_the_blocks(spark, vectors, monkeypatch):
    small_blocks(monkeypatch)
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int")
    got = {}
    for r in ranking.nearest(df.where("vec_id % 50 = 0"), df, "vec_id", "embedding", 5).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append((r.id, r.similarity))
    for q, v, _ in vectors:
        if q % 50 == 0:
            s = [(cosine(v, w), r) for r, w, _ in vectors if r != q]
            want = sorted(s, key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))[:5]
            assert got.pop(q) == [(r, x) for x, r in want]
    assert not got


def test_a_block_sends_only_the_nearest_of_a_search():
    a = pd.DataFrame({"id": range(20), "v": [np.array([1.0, 0.5])] * 20})
    b = pd.DataFrame({"id": range(300), "v": [np.array([1.0, 0.5])] * 300})
    out = products._nearest(5)(a, b)
    assert out.groupby("query")["id"].apply(list).to_dict() == {q: [i for i in range(6) if i != q][:5] for q in range(20)}
