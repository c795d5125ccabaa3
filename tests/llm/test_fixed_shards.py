"""Shards in files of whole shards, and raw records at multiplied places."""

import os

from pyspark.sql import functions as F

from lakewright.llm import token_output


def test_files_hold_whole_shards_and_resume(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_output, "FILE_SHARDS", 3)
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("words é of "), F.col("id"), F.repeat(F.lit(" and more"), F.col("id").cast("int") % 9)).alias("text")).repartition(3)
    out = token_output.sequences(df, length=16, stride=8).cache()
    rows = {r.slot: bytes(r.tokens) for r in out.collect()}
    path = str(tmp_path / "shards")
    token_output.write_shards(out, path, stride=8)
    files = [f for f in os.listdir(path) if f.endswith(".parquet")]
    assert len(files) >= len(rows) // 24 and not [f for f in os.listdir(path) if "=" in f]
    seen = spark.read.parquet(path).groupBy(F.input_file_name().alias("f")).agg(F.min("slot").alias("a"), F.max("slot").alias("b"), F.count("*").alias("n")).collect()
    assert all(r.a % 8 == 0 and r.b - r.a + 1 == r.n <= 24 for r in seen)
    for at in (0, 5, len(rows) // 2, len(rows) - 1):
        assert [r.slot for r in token_output.read_from(spark, path, at, stride=8).collect()] == list(range(at, len(rows)))


def test_raw_records(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_output, "FILE_SHARDS", 2)
    df = spark.range(150).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.array_repeat(F.concat(F.lit("naïve text "), F.col("id")), 7)).alias("text")).repartition(2)
    out = token_output.sequences(df, length=32, stride=4).cache()
    rows = {r.slot: bytes(r.tokens) for r in out.collect()}
    token_output.write_fixed(out, str(tmp_path / "raw"), stride=4)
    files = token_output.fixed_files(spark, str(tmp_path / "raw"), length=32).collect()
    assert sum(f.slots for f in files) == len(rows) and len(files) > 2
    for slot, tokens in rows.items():
        f = next(f for f in files if f.first_slot <= slot < f.first_slot + f.slots)
        with open(f.path.removeprefix("file:"), "rb") as raw:
            raw.seek((slot - f.first_slot) * f.record_bytes)
            assert raw.read(64) == tokens
