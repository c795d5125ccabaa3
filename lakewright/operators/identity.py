"""Exact and near duplicates, clusters and merged records."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_body
from .stored import drop_stored, stored


def exact_groups(df: DataFrame, id_: str, key: Column) -> DataFrame:
    """(id, winner, n): rows of equal keys; the smallest id wins. Null keys have no group."""
    rows = df.select(F.col(id_).alias("id"), key.alias("_k")).where("_k is not null")
    groups = rows.groupBy("_k").agg(F.min("id").alias("winner"), F.count("*").alias("n")).where("n > 1")
    return rows.join(groups, "_k").select("id", "winner", "n")


def two_stage_groups(df: DataFrame, id_: str, size: Column, text: Column) -> DataFrame:
    """Exact duplicates with a hash only where sizes collide."""
    rows = df.select(F.col(id_).alias("id"), size.alias("size"), text.alias("text"))
    shared = rows.groupBy("size").count().where("count > 1").select("size")
    return exact_groups(rows.join(shared, "size").select("id", F.sha2("text", 256).alias("h")), "id", F.col("h"))


def body_hash(c: Column) -> Column:
    return F.sha2(normalize_body(c), 256)


def blocked_pairs(df: DataFrame, id_: str, keys: list[Column], most: int = 50) -> DataFrame:
    """(a, b): pairs that share a key. A key of more than `most` rows is too common to be evidence and is listed by common_keys."""
    flat = df.select(F.col(id_).alias("id"), F.explode(F.array_distinct(F.array_compact(F.array(*keys)))).alias("k")).where("k <> ''").distinct()
    sizes = flat.groupBy("k").count().where((F.col("count") > 1) & (F.col("count") <= most)).select("k")
    flat = flat.join(sizes, "k")
    return flat.withColumnRenamed("id", "a").join(flat.withColumnRenamed("id", "b"), "k").where("a < b").select("a", "b").distinct()


def common_keys(df: DataFrame, keys: list[Column], most: int = 50) -> DataFrame:
    flat = df.select(F.explode(F.array_distinct(F.array_compact(F.array(*keys)))).alias("k")).where("k <> ''")
    return flat.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > most)


def _contained(trim: bool):
    @F.pandas_udf("double")
    def share(short: pd.Series, long_: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(short, long_, strict=True):
            lines, other = ([(x.strip(" ") if trim else x) for x in (t or "").split("\n") if x.strip(" " if trim else None)] for t in (a, b))
            out.append((Counter(lines) & Counter(other)).total() / len(lines) if lines else 0.0)
        return pd.Series(out, dtype="float64")

    return share


def line_containment(short: Column, long_: Column, trim: bool = True) -> Column:
    """Share of the shorter text's lines, blank ones aside, that the longer one holds, as multisets; trim: spaces round a line do not count."""
    return _contained(trim)(short, long_)


def keep_rounds(spark: SparkSession) -> None:
    """Checkpoints need a folder; a local one is set only where none is configured."""
    if not (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()):
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.conf.set("spark.checkpoint.dir", "/tmp/checkpoints")
        spark.sparkContext.setCheckpointDir("/tmp/checkpoints")


#: Edges that one task finishes (a few MB); more are contracted round by round until no more are left.
FINISH = 1 << 18


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) of one task -> (a, p): for each label the smallest one that it reaches."""
    found = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not found:
        return
    left, right = (np.concatenate(x) for x in zip(*found, strict=True))
    names, at = np.unique(np.concatenate([left, right]), return_inverse=True)
    i, j, root = at[: len(left)], at[len(left) :], np.arange(len(names))
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new[new]]
        if (new == root).all():
            break
        root = new
    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[root])], ["a", "p"])


def contraction_components(edges: DataFrame, nodes: DataFrame, id_: str) -> DataFrame:
    """(id, component): the smallest id reachable over edges (a, b); lone nodes are their own. Ids are whole numbers.

    Labels are random names of ids (a bijection of 64 bits). In each round every label hooks to the smallest one next to it, edges are renamed to
    their ends' hooks, and equal ones and loops go, so a round leaves at most half of the labels that still have edges, and later rounds read
    less and less. Nothing but edges and labels is moved, and no task sees a component of more than FINISH edges. Rounds are stored tables.
    """
    name = lambda c: F.xxhash64(F.col(c).cast("long"))
    both = lambda d: d.select("a", "b").union(d.select(F.col("b").alias("a"), F.col("a").alias("b")))
    ends = edges.where("a is not null and b is not null and a <> b")
    open_ = stored(ends.select(F.least(name("a"), name("b")).alias("a"), F.greatest(name("a"), name("b")).alias("b")).distinct(), "cc-edges")
    labels = nodes.select(F.col(id_).alias("id")).distinct().withColumn("label", name("id"))
    up = lambda hook, c, to: hook.select(F.col("a").alias(c), F.col("p").alias(to))
    while (left := open_.count()) > FINISH:
        hook = stored(both(open_).groupBy("a").agg(F.min("b").alias("p")).select("a", F.least("a", "p").alias("p")), "cc-hooks")
        moved = open_.join(up(hook, "a", "x"), "a").join(up(hook, "b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        chain = hook.join(up(hook, "p", "pp"), "p").select(F.col("p").alias("a"), F.col("pp").alias("b"))  # a hook's own hook
        moved = moved.union(chain).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        labels = stored(labels.join(up(hook, "label", "p"), "label", "left").select("id", F.coalesce("p", "label").alias("label")), "cc-labels")
        old, open_ = (open_, hook), stored(moved, "cc-edges")
        drop_stored(*old)
    if left:
        last = stored(open_.coalesce(1).mapInArrow(_roots, "a long, p long"), "cc-hooks")
        labels = labels.join(up(last, "label", "p"), "label", "left").select("id", F.coalesce("p", "label").alias("label"))
    labels = stored(labels, "cc-labels")
    return labels.join(labels.groupBy("label").agg(F.min("id").alias("component")), "label").select("id", "component")


def cluster_table(components: DataFrame) -> DataFrame:
    """(id, component, size, representative) for clusters of two or more."""
    sizes = components.groupBy("component").agg(F.count("*").alias("size")).where("size > 1")
    return components.join(sizes, "component").select("id", "component", "size", (F.col("id") == F.col("component")).alias("representative"))


def preferred(df: DataFrame, key: str, priority: Column, value: str) -> DataFrame:
    """(key, value): the first non-null value by priority."""
    known = df.where(F.col(value).isNotNull())
    return known.groupBy(key).agg(F.min_by(value, priority).alias(value))


def merged_lists(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, values): distinct values of an array column over a key's rows, sorted."""
    return df.groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(column)))).alias("values"))


def first_provider(df: DataFrame, url: Column, provider: Column, rank: Column) -> DataFrame:
    """Rows whose provider is the first with their URL; a provider's own repeats stay. Adds order: provider, then rank."""
    rows = df.withColumn("_u", url).withColumn("_p", provider)
    first = rows.groupBy("_u").agg(F.min("_p").alias("_f"))
    from .sequences import numbered  # which imports this module

    rows = rows.join(first, "_u").where("_p = _f").withColumn("_r", rank)
    return numbered(rows, ["_p", "_r", "_u"], "order").drop("_u", "_p", "_f", "_r")
