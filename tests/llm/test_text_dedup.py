import random

import pytest

from lakewright.llm import decontaminate, minhash, substring_dedup

from . import brute

SCHEMA = "doc_id long, text string, source string, name string"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    found = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rng = random.Random(5)
    words = ["w%d" % i for i in range(9)]
    long_ = [rng.choice(words) for _ in range(400)]
    more = [None, "", "one", "a b c", " ".join(["same"] * 130), " ".join(["same"] * 95), " ".join(["p", "q"] * 70)]
    more += [" ".join(long_[i : i + 200]) for i in (0, 37, 100, 150)]
    more += [" ".join(long_[10:80] + ["x%d" % k] + long_[10:80]) for k in range(3)]
    more += [found[3][1], found[3][1] + " tail", "\t".join(long_[:60]), "A b C d E", "a B c D e"]
    return found + [(10_000 + i, t) for i, t in enumerate(more)]


@pytest.fixture(scope="module")
def frame(spark, documents):
    return spark.createDataFrame([(d, t, "s", "n") for d, t in documents], SCHEMA).repartition(3)


def test_repeats_match_brute_force(frame, documents):
    got = rows_of(substring_dedup.digest(substring_dedup.remove_repeats(frame)))
    assert got == sorted(brute.repeats(documents), key=repr)


def test_repeats_small_windows(frame, documents):
    got = rows_of(substring_dedup.digest(substring_dedup.remove_repeats(frame, window=7)))
    assert got == sorted(brute.repeats(documents, 7), key=repr)


def test_repeats_edge_rows(spark):
    t = " ".join(f"k{i}" for i in range(60))
    df = spark.createDataFrame([(None, t, "", ""), (3, t, "", ""), (3, t, "", ""), (5, t, "", ""), (5, "other", "", "")], SCHEMA)
    got = sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(df).collect())
    assert got == [(-1, 60, 0), (3, 60, 0), (3, 60, 0), (5, 1, 0), (5, 60, 60)]
    assert substring_dedup.remove_repeats(df.limit(0)).count() == 0


def test_near_duplicates_match_brute_force(frame, documents):
    want = {d: (n, c) for d, (n, c) in brute.near(documents).items()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame, 4, 80).collect()}
    assert got == want


def test_near_duplicates_edge_rows(spark):
    t = " ".join(f"k{i}" for i in range(60))
    df = spark.createDataFrame([(None, t, "", ""), (3, t, "", ""), (3, t, "", ""), (1, None, "", ""), (2, " ", "", "")], SCHEMA)
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, 4).collect())
    assert got == [(-1, 57, 3, False), (1, 0, 1, True), (2, 0, 2, True), (3, 57, 3, True), (3, 57, 3, True)]
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_signature_estimates_similarity():
    import numpy as np

    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 62, 900).astype(np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 1 << 62, 100).astype(np.uint64)])
    sig = minhash.super_minhash(np.repeat([0, 1], 900), np.concatenate([a, b]), 2)
    assert abs((sig[0] == sig[1]).mean() - 0.8) < 0.12


def test_contamination_matches_brute_force(spark, sf_dir, frame, documents):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    items += [(900, documents[7][1]), (901, "the"), (902, "of the"), (903, None), (904, " -- "), (900, documents[7][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = rows_of(decontaminate.digest(decontaminate.contamination(frame, bench)))
    assert got == sorted(brute.contamination(documents, items), key=repr)


def test_contamination_in_blocks(spark, sf_dir, frame, documents):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    items += [(900, documents[7][1]), (905, documents[11][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    index = decontaminate.build_index(frame, most=700).cache()
    assert index.count() > 10
    got = rows_of(decontaminate.digest(decontaminate.search(index, bench, block_bytes=60_000)))
    assert got == sorted(brute.contamination(documents, items), key=repr)
    none = decontaminate.digest(decontaminate.contamination(frame, bench.limit(0)))
    assert none.where("n_hit > 0 or n_items > 0").count() == 0


def test_contamination_of_rows_with_one_id_in_blocks(spark):
    """Rows of one doc_id with as many words keep their own hits; extra columns clash with inner names."""
    a, b = " ".join(f"a{i}" for i in range(20)), " ".join(f"b{i}" for i in range(20))
    docs = spark.createDataFrame([(1, a, 5), (1, b, 6), (None, a, 7)], "doc_id long, text string, shard long")
    bench = spark.createDataFrame([(1, a, "x"), (2, " ".join(f"c{i}" for i in range(20)), "y")], "item_id long, text string, words string")
    index = decontaminate.build_index(docs).cache()
    for size in (1 << 20, 50):
        got = sorted((r.doc_id or -1, r.n_hit) for r in decontaminate.digest(decontaminate.search(index, bench, block_bytes=size)).collect())
        assert got == [(-1, 20), (1, 0), (1, 20)]


def test_suffix_order_of_copies():
    import numpy as np

    rng = np.random.default_rng(6)
    part = rng.integers(10, 14, 50)
    text = np.concatenate([np.concatenate([part, [k]]) for k in range(8)] + [np.full(70, 12), [9]])
    want = sorted(range(len(text)), key=lambda i: text[i:].tolist())
    assert decontaminate.suffix_order(text).tolist() == want


def test_fm_index_counts_all_substrings():
    import numpy as np

    rng = np.random.default_rng(3)
    text = rng.integers(0, 4, 300)
    text[-1] = 0
    made = decontaminate.FMIndex.of(text, 3)
    index = decontaminate.FMIndex.unpacked(*made.packed())
    for size in (1, 2, 3):
        for pattern in np.ndindex(*[3] * size):
            p = np.array([pattern]) + 1
            low, high = index.ranges(p, np.array([size]))
            want = [i for i in range(300 - size + 1) if (text[i : i + size] == p[0]).all()]
            assert sorted(index.locate(np.arange(low[0], max(low[0], high[0]))).tolist()) == want


def test_components_of_paths_and_stars(spark):
    from lakewright.llm.components import components

    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 540)] + [(7, 3), (3, 7), (9, 9)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 500 for i in range(500, 540)}, 3: 3, 7: 3}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_byte_shards(frame, documents):
    import zlib

    from lakewright.llm import sharding

    got = sharding.shard(frame).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in got} == {d: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in documents}
    for k in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
    sizes = [sum(r.size for r in got if r.shard == k) for k in range(8)]
    assert max(sizes) - min(sizes) <= 2 * max(r.size for r in got)
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.doc_id for r in order] == sorted(r.doc_id for r in got)
    assert sharding.shard(frame.limit(0)).count() == 0


def test_near_duplicates_of_a_chain(spark):
    """Neighbours are near, the ends are not, and a boilerplate keeps all in one family."""
    base = [f"w{i}" for i in range(300)]
    docs = []
    for i in range(40):
        own = list(base)
        for k in range(i):
            own[k * 7 % 300] = f"y{k}"
        docs.append((i, " ".join(own)))
    docs += [(100 + i, " ".join(base[:230] + [f"z{i}_{k}" for k in range(70)])) for i in range(6)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, 4).collect()}
    assert got == brute.near(docs)


def test_near_duplicates_in_pieces(spark, monkeypatch):
    rng = random.Random(8)
    base = [f"w{rng.randint(0, 400)}" for _ in range(150)]
    docs = []
    for i in range(120):
        own = list(base)
        for _ in range(rng.randint(0, 9)):
            own[rng.randrange(150)] = f"x{rng.randint(0, 10**6)}"
        docs.append((i, " ".join(own)))
    monkeypatch.setattr(minhash, "PIECE", 24)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, 4).collect()}
    assert got == brute.near(docs)


def test_contraction_of_random_edges(spark):
    from lakewright.llm import components

    rng = random.Random(4)
    pairs = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)]
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    got = {r.node: r.component for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in linked}


def unlike_words():
    """Two words of 1024 bytes that a polynomial hash modulo a power of two cannot tell apart."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_long_words_that_differ(spark):
    one, two = unlike_words()
    tail = " ".join(f"k{i}" for i in range(60))
    df = spark.createDataFrame([(1, one, "", ""), (2, two, "", ""), (3, f"{one} {tail[:180]}", "", ""), (4, f"{two} {tail[:180]}", "", "")], SCHEMA)
    docs = [(r.doc_id, r.text) for r in df.collect()]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, 4).collect()} == brute.near(docs)
    assert rows_of(substring_dedup.digest(substring_dedup.remove_repeats(df, 20))) == sorted(brute.repeats(docs, 20), key=repr)
    bench = spark.createDataFrame([(7, one)], "item_id long, text string")
    assert rows_of(decontaminate.digest(decontaminate.contamination(df, bench))) == sorted(brute.contamination(docs, [(7, one)]), key=repr)
