from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from lakewright.llm import decontaminate, mixing, quality

from . import brute


def test_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = docs.where("doc_id = 7").select((F.col("doc_id") + 50_000).alias("doc_id"), *docs.columns[1:])
    docs = docs.union(extra).union(docs.where("doc_id = 3"))
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in now.select("doc_id", "text").collect()] if name != "tokens" else []
        out = stage(spark, now, sf_dir).cache()
        rows = out.collect()
        if name == "quality":
            good = {r.doc_id for r in quality.scores(now, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("predicted = 1").collect()}
            assert sorted(r.doc_id for r in rows) == sorted(d for d, _ in before if d in good)
        elif name == "near_dedup":
            ids = {d: t for d, t in before}
            groups = brute.near(list(ids.items()), 5)
            assert sorted(r.doc_id for r in rows) == sorted(d for d, (_, c) in groups.items() if c == d)
        elif name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            assert sorted(r.doc_id for r in rows) == sorted(x[0] for x in brute.contamination(before, items) if not x[5])
        elif name == "mix":
            taken = {r.doc_id: len(r.draws) for r in mixing.mix(now).collect()}
            got = {}
            for r in rows:
                got[r.doc_id] = got.get(r.doc_id, 0) + 1
            assert got == {d: n for d, n in taken.items() if n}
        else:
            assert sorted(r.slot for r in rows) == list(range(len(rows)))
            assert {d for r in rows for d in r.doc_ids} == {r.doc_id for r in now.collect()}
        if name != "tokens":
            assert out.columns == docs.columns
        now = out


def test_decontamination_keeps_clean_documents(spark):
    words = " ".join(f"w{i}" for i in range(400))
    bench = " ".join(f"b{i}" for i in range(15))
    docs = spark.createDataFrame([(1, words), (2, f"{words} {bench}"), (3, bench), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r.contaminated for r in decontaminate.digest(decontaminate.contamination(docs, spark.createDataFrame([(1, bench)], "item_id long, text string"))).collect()}
    assert got == {1: False, 2: False, 3: True, 4: False}


def test_mix_keeps_rows_without_id(spark):
    """A lone source is taken 1.5 times, so each row appears once or twice, with or without doc_id."""
    rows = [(None if i % 3 == 0 else i, f"text{i} " + "w " * (20 + i), "en", "s", 1) for i in range(60)]
    rows += [(None, "same words twice", "en", "s", 1)] * 2 + [(None, None, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    out = corpus_pipeline.source_mix(spark, docs, None)
    got = Counter((r.doc_id, r.text) for r in out.collect())
    times = Counter((r[0], r[1]) for r in rows if r[1])
    assert out.columns == docs.columns and all(n <= got[k] <= 2 * n for k, n in times.items())
    words = lambda c: sum(n * len((t or "").split()) for (_, t), n in c.items())
    assert abs(words(got) - 1.5 * words(times)) <= 40
    found = corpus_pipeline.tokens(spark, out, None).collect()
    assert {d for r in found for d in r.doc_ids} >= {None}
