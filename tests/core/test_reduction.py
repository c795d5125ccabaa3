"""Packets against a plain loop, however rows are dealt; levels end."""

import random

import pytest
from pyspark.sql import functions as F

from lakewright.operators import reduction


def plain(tokens, target):
    out, packet, size = [], -1, None
    for n in tokens:
        if size is None or size + n > target:
            packet, size = packet + 1, 0
        size += n
        out.append(packet)
    return out


@pytest.mark.parametrize(("seed", "target", "parts"), [(1, 100, 1), (2, 100, 7), (3, 17, 40), (4, 100000, 9), (5, 1, 5)])
def test_packets(spark, seed, target, parts):
    rng = random.Random(seed)
    tokens = [rng.choice([0, 0, 1, 3, rng.randint(0, 40), rng.randint(0, 300) if rng.random() < 0.1 else 5]) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(tokens)), "k long, n long").repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.k: r.packet for r in reduction.packed(df, ["k"], F.col("n"), target).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [got[k] for k in range(len(tokens))] == plain(tokens, target)


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, None)], "k long, n long")
    assert {r.k: r.packet for r in reduction.packed(df, ["k"], F.col("n"), 3).collect()} == {1: 0, 2: 1, 3: 2}
    assert reduction.packed(df.limit(0), ["k"], F.col("n"), 3).count() == 0


def test_levels_until_they_fit_or_stop_shrinking(spark):
    df = spark.range(500).withColumn("n", F.lit(10))
    out = reduction.reduced(df, "id", F.col("n"), 100, 60, lambda tokens, items: tokens / 5).orderBy("level", "packet").collect()
    assert [sum(r.level == k for r in out) for k in (1, 2, 3)] == [50, 10, 2] and max(r.level for r in out) == 3
    stuck = reduction.reduced(df, "id", F.col("n"), 100, 60, lambda tokens, items: tokens)
    assert stuck.agg(F.max("level")).first()[0] == 2
