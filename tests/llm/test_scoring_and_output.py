import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakewright.llm import embedding_dedup, mixing, quality, secret_scan, token_output, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, label string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, "x") for i, t, s in rows], DOCS)


# secrets

BASE = [
    ("assign", re.compile("(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), 2, 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile("[0-9a-f]+"), 0, 24),
]


def spans_of(text):
    out = []
    for k, (kind, pattern, group, least) in enumerate(BASE):
        out += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in pattern.finditer(text or "") if len(m.group(group)) >= least]
    return ",".join(x[2] for x in sorted(out))


def test_secrets_match_plain_search(spark):
    texts = [
        None, "", "token=token:abcdefgh", "PASSWORD : 'abc' passwd=abcdef", "é😀 api_key=\"abc123==\" Apikey=x1234567", "AKIA" + "A1" * 8 + " AKIA123", "x" * 5 + "ab" * 12 + "g" + "f" * 30,
        "secret=" + "0123456789abcdef" * 2, "tokens token", "password==abcdef password= :abcdef", "ghp_" + "Z" * 36, "-----BEGIN RSA PRIVATE KEY-----", "token=ab\ntoken=abcdef " * 200,
    ]
    df = docs_of(spark, [(i, t, "s") for i, t in enumerate(texts)] + [(3, texts[3], "s"), (None, texts[2], "s")])
    found = secret_scan.scan(df, secret_scan.BASE_RULES)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.spans) for r in secret_scan.digest(found).collect())
    want = sorted([(False, i, spans_of(t)) for i, t in enumerate(texts)] + [(False, 3, spans_of(texts[3])), (True, 0, spans_of(texts[2]))])
    assert got == want
    more = {r.doc_id: r.spans for r in secret_scan.digest(secret_scan.scan(df)).collect()}
    assert more[10] == "github:0:40" and more[11].startswith("pem:0:")
    assert secret_scan.scan(df.limit(0)).count() == 0


def test_trigram_queries():
    assert secret_scan.trigram_query("[0-9a-f]{24,}") == []
    assert secret_scan.trigram_query("ab?cde") == [[["abc", "bcd", "cde"], ["acd", "cde"]]]


# mixing


def test_mix_targets_and_shards(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randint(1, 60)), ["a", "b", "c", "d", None][min(4, int(rng.random() ** 2 * 5))]) for i in range(900)] + [(9000, None, "a"), (9001, None, "empty")]
    df = docs_of(spark, rows)
    out = mixing.mix(df, shards=8, block_words=64).join(df.select("doc_id", "source"), "doc_id").collect()
    again = mixing.mix(df, shards=8, block_words=64).collect()
    assert {(r.doc_id, r.taken, tuple(r.draws)) for r in out} == {(r.doc_id, r.taken, tuple(r.draws)) for r in again}
    size = {s: sum(r.size for r in out if r.source == s) for s in {r.source for r in out}}
    order = sorted(s for s in size if s is not None) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    want, open_ = {}, set(size)
    left = 1.5 * sum(size.values())
    while True:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * size[s]}
        if not over:
            want |= {s: level * weight[s] for s in open_}
            break
        want |= {s: 2.0 * size[s] for s in over}
        left -= sum(2.0 * size[s] for s in over)
        open_ -= over
        if not open_:
            break
    for s in size:
        mine = [r for r in out if r.source == s]
        assert all(r.source_size == size[s] and r.target == pytest.approx(want[s]) and r.taken <= 2 * r.size for r in mine)
        assert abs(sum(r.taken for r in mine) - want[s]) <= 30  # half of the longest document
        assert all(len(r.draws) * r.size == r.taken for r in mine if r.size)
    words = [sum(r.size * sum(d.shard == k for d in r.draws) for r in out) for k in range(8)]
    places = sorted((d.shard, d.block, d.place) for r in out for d in r.draws)
    for k in range(8):  # a shard's blocks are numbered without gaps, and so are a block's places
        blocks = {b for s, b, _ in places if s == k}
        assert blocks == set(range(len(blocks)))
        for b in blocks:
            own = [p for s, c, p in places if (s, c) == (k, b)]
            assert own == list(range(len(own)))
    assert max(words) - min(words) <= 4 * 64 * len(size)
    assert mixing.mix(df.limit(0)).count() == 0


def test_split_quotas_are_exact(spark):
    quotas = {1: 0, 2: 7, 3: 1000, 4: 55, 5: 1, 6: 333}
    ends = {r.sid: list(r.ends) for r in mixing.split_quotas(spark.createDataFrame(list(quotas.items()), "sid int, blocks long"), 8).collect()}
    assert all(e == sorted(e) and e[-1] == quotas[s] and len(e) == 8 for s, e in ends.items())
    share = np.array([np.diff([0, *ends[s]]) for s in sorted(ends)])
    assert set(share.sum(axis=0).tolist()) <= {174, 175} and abs(share[2] - 125).max() < 40


def test_hypergeometric_draws(spark):
    u = (F.col("id") + 0.5) / 4000
    k = mixing.hypergeometric(u, F.lit(50).cast("long"), F.lit(20).cast("long"), F.lit(10).cast("long"))
    got = np.array([r[0] for r in spark.range(4000).select(k).collect()])
    assert got.min() >= 0 and got.max() <= 10 and abs(got.mean() - 4) < 0.01 and abs(got.var() - 10 * 0.4 * 0.6 * 40 / 49) < 0.05


# vectors


def brute_links(rows, cosine=0.93):
    good = [(i, np.array(v, dtype=float), label) for i, v, label in rows if v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: 0 for i, _, _ in rows}
    root = {i: i for i, _, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x, lx) in enumerate(good):
        for j, y, ly in good[a + 1 :]:
            if lx == ly and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine:
                links[i] += 1
                links[j] += 1
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: (links[i], find(i)) for i in links}


def test_vectors_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "PIECE", 16)
    rng = np.random.default_rng(4)
    rows = []
    for c in range(12):
        base = rng.standard_normal(24)
        rows += [(base + rng.standard_normal(24) * s).tolist() for s in rng.choice([0.0, 0.1, 0.2, 0.3], 12)]
    rows += [rng.standard_normal(24).tolist() for _ in range(80)]
    rows = [(i, v, i % 2) for i, v in enumerate(rows)]
    rows += [(900, None, 1), (901, [0.0] * 24, 1), (902, [float("nan")] + [1.0] * 23, 1), (903, rows[5][1], None), (904, [None] + [1.0] * 23, 1), (905, rows[5][1], 1), (906, [1.0, 0.0], 1), (907, [2.0, 0.0], 1), (908, [], 0)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, text string")
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    want = brute_links(rows)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(df).collect()}
    assert got == want
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


# tokens


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 17, 1000):
        assert sorted(token_output.feistel(np.arange(n), n, 7).tolist()) == list(range(n))
    assert token_output.feistel(np.arange(1000), 1000, 7).tolist() != token_output.feistel(np.arange(1000), 1000, 8).tolist()


def test_tokens_round_trip(spark, tmp_path):
    tiktoken = pytest.importorskip("tiktoken")
    import base64

    with open(token_output.TOKENIZER, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    bpe = tiktoken.Encoding("t", pat_str=token_output.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["plain words here", "  lead and  double ", "a\n\nb \n c", "é ü it's don't", "", None, "<|endoftext|> x", " ", "tab\tend ", "word " * 300]
    encode = token_output.encoder()
    for t in texts:
        assert np.frombuffer(encode(t or ""), dtype="<u2").tolist() == bpe.encode_ordinary(t or "")
    df = docs_of(spark, [(i, t, "s") for i, t in enumerate(texts * 3)]).repartition(3)
    out = token_output.sequences(df, length=16, stride=8).cache()
    rows = out.collect()
    n = len(rows)
    assert sorted(r.slot for r in rows) == list(range(n)) and all(r.shard == r.slot // 8 and r.place == r.slot % 8 and len(r.tokens) == 32 for r in rows)
    ids = sum((np.frombuffer(r.tokens, dtype="<u2")[: r.n_tokens].tolist() for r in rows), [])
    want = sum((bpe.encode_ordinary(t or "") + [token_output.END] for t in texts * 3), [])
    assert sorted(ids) == sorted(want)
    sure = [r for r in rows if len(set(r.doc_ids)) == 1]
    for r in sure:
        t = (texts * 3)[r.doc_ids[0]] or ""
        got = np.frombuffer(r.tokens, dtype="<u2")[: r.n_tokens].tolist()
        assert bpe.decode([x for x in got if x != token_output.END]) in t or got == [token_output.END]
    token_output.write_shards(out, str(tmp_path / "shards"))
    later = token_output.read_from(spark, str(tmp_path / "shards"), n // 2, stride=8).collect()
    assert [r.slot for r in later] == list(range(n // 2, n))
    made = {r.shard: r.bytes for r in token_output.write_binary(out, str(tmp_path / "bin")).collect()}
    by_slot = {r.slot: bytes(r.tokens) for r in rows}
    for s, size in made.items():
        raw = (tmp_path / "bin" / f"shard-{s:05d}.bin").read_bytes()
        assert len(raw) == size and raw == b"".join(by_slot[k] for k in range(8 * s, min(n, 8 * s + 8)))
    assert token_output.sequences(df.limit(0)).count() == 0


# classifiers


def labelled(spark, make, n=500):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        y = int(rng.random() < 0.35)
        rows.append((i, make(rng, y), "s"))
        labels.append((i, y, y, "x"))
    return docs_of(spark, [*rows, (9000, None, "s"), (9001, "", "s"), (3, rows[3][1], "s")]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string"), dict(enumerate(y for _, y, _, _ in labels))


def plain_words(rng, n=40):
    return " ".join(rng.choice(["on", "the", "river", "stone", "walking", "evening", "light", "small"]) for _ in range(n))


@pytest.mark.parametrize("which", ["quality", "toxic"])
def test_classifiers(spark, which):
    if which == "quality":
        df, labels, truth = labelled(spark, lambda r, y: plain_words(r) if y else " ".join(w + "%%%" for w in plain_words(r).split()))
        out, folds, held, cut = quality.scores(df, labels), 5, 0, 0.3
    else:
        df, labels, truth = labelled(spark, lambda r, y: plain_words(r) + (" " + r.choice(["zorgon", "zorgish", "idiot"]) if y else ""))
        out, folds, held, cut = toxicity.scores(df, labels), 3, 1, 0.7
    rows = out.collect()
    assert len(rows) == df.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= cut)
    mine = [(truth[r.doc_id], r.predicted) for r in rows if r.doc_id in truth and r.held_out]
    assert sum(a == b for a, b in mine) / len(mine) > 0.95
    none = (quality if which == "quality" else toxicity).scores(df, labels.limit(0))
    assert none.count() == df.count()
    assert (quality if which == "quality" else toxicity).scores(df.limit(0), labels).count() == 0


def test_statistics_of_plain_texts():
    texts = ["The cat sat.", "", "A A A\nA A A", "x%% y%% !!"]
    raw = [t.encode() for t in texts]
    x = quality.statistics(np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0] + [len(r) for r in raw]))
    f = {n: x[:, k] for k, n in enumerate(quality.FEATURES)}
    assert f["word_bytes"].tolist() == pytest.approx([10 / 3, 0, 1, 8 / 3])
    assert f["distinct"][2] == pytest.approx(1 / 6) and f["repeated_lines"][2] == pytest.approx(0.5) and f["top_word"][2] == 1
    assert f["symbol_end"][3] == pytest.approx(2 / 3) and f["upper"][2] == pytest.approx(6 / 11)
    assert not np.isnan(x).any()


def test_tree_rules():
    text = "Tree 0\n If (feature 1 <= 0.5)\n  If (feature 0 > 2.0)\n   Predict: 1.0\n  Else (feature 0 <= 2.0)\n   Predict: 0.0\n Else (feature 1 > 0.5)\n  Predict: 0.0\n"
    assert quality.tree_rules(text) == {((1, "<=", 0.5),), ((0, ">", 2.0), (1, "<=", 0.5)), ((0, "<=", 2.0), (1, "<=", 0.5)), ((1, ">", 0.5),)}
