"""Joins, set operations and manifest comparisons."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


#: Rows of a block that meets another in one task, and rows of it that are multiplied at a time (fixed values).
BLOCK, TILE = 1024, 64
#: Rows, and pairs that they are expected to make, of a task that makes or tells apart pairs (fixed values).
ROWS, PAIRS = 1 << 18, 1 << 20


def manifest_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change): added, removed or changed. A change needs a value on both sides."""
    a, b = old.select(key, F.col(value).alias("old")), new.select(key, F.col(value).alias("new"))
    both = a.withColumn("in_old", F.lit(True)).join(b.withColumn("in_new", F.lit(True)), key, "full")
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return both.select(key, change.alias("change")).where("change is not null")


def pending(eligible: DataFrame, recorded: DataFrame, key: str) -> DataFrame:
    return eligible.join(recorded, key, "left_anti")


def unknown_references(rows: DataFrame, key: str, references: str, known: DataFrame, known_key: str) -> DataFrame:
    """(key, reference): entries of an array column that name no known row."""
    flat = rows.select(key, F.explode(references).alias("reference")).distinct()
    return flat.join(known.select(F.col(known_key).alias("reference")).distinct(), "reference", "left_anti").select(key, "reference")


def unique_on_both(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str) -> DataFrame:
    """Pairs whose key occurs once on each side."""
    once = lambda d, i: d.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("c"), F.min(i).alias(i)).where("c = 1").drop("c")
    return once(left, left_id).join(once(right, right_id), key)


def nearest_before(events: DataFrame, facts: DataFrame, by: str, at: str, value: str, event_id: str) -> DataFrame:
    """As-of: for each event the latest fact at or before it. One sort of both sides together, no range join."""
    e = events.select(by, F.col(at).alias("t"), F.col(event_id), F.lit(None).cast(facts.schema[value].dataType).alias("v"), F.lit(1).alias("kind"))
    f = facts.select(by, F.col(at).alias("t"), F.lit(None).cast(events.schema[event_id].dataType).alias(event_id), F.col(value).alias("v"), F.lit(0).alias("kind"))
    w = Window.partitionBy(by).orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return e.union(f).withColumn("latest", F.last("v", ignorenulls=True).over(w)).where("kind = 1").select(event_id, by, F.col("latest").alias(value))


def nearest_value(left: DataFrame, right: DataFrame, by: str, left_at: Column, right_at: Column, left_id: str) -> DataFrame:
    """(id, distance): least absolute distance to a value of the same group on the other side."""
    a = left.select(by, left_at.cast("double").alias("t"), F.col(left_id), F.lit(1).alias("kind"))
    b = right.select(by, right_at.cast("double").alias("t"), F.lit(None).cast(left.schema[left_id].dataType).alias(left_id), F.lit(0).alias("kind"))
    rows = a.union(b)
    known = F.when(F.col("kind") == 0, F.col("t"))
    w = Window.partitionBy(by).orderBy("t", "kind")
    down = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    up = F.first(known, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("down", down).withColumn("up", up).where("kind = 1")
    return rows.select(left_id, F.least(F.abs(F.col("t") - F.col("down")), F.abs(F.col("up") - F.col("t"))).alias("distance"))


def met_pairs(rows: DataFrame, key: str, value: str) -> tuple[DataFrame, int]:
    """(a, b) with a < b: the distinct pairs of values that share a key, dealt by pair over tasks, and how many tasks that are.

    Tasks are as many as the rows ask for, so that one holds no more of them when there are more. Rows are brought
    together before they are grouped: grouped first, a task holds all that differs in its part of the file.
    """
    rows = rows.select(F.col(key).alias("k"), F.col(value).alias("v")).where("k is not null and v is not null")
    n, keys = rows.agg(F.count("*"), F.approx_count_distinct("k")).first()
    parts = max(1, -(-n // ROWS))
    tasks = max(1, -(-max(n, int(n * (n / max(keys, 1) - 1) / 2)) // PAIRS))
    sets = rows.repartition(parts, "k").groupBy("k").agg(F.collect_set("v").alias("vs")).where(F.size("vs") > 1)
    pairs = sets.select(F.explode("vs").alias("a"), "vs").select("a", F.explode(F.filter("vs", lambda x: x > F.col("a"))).alias("b"))
    return pairs.repartition(tasks, "a", "b").distinct(), tasks


def undecided_pairs(pairs: DataFrame, journal: DataFrame, tasks: int) -> DataFrame:
    """The pairs (a, b), a < b, that no row of the journal (a, b) names in either order; both are dealt by pair over so many tasks."""
    named = journal.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return pairs.join(named.repartition(tasks, "a", "b"), ["a", "b"], "left_anti")


def _tiles(ids: np.ndarray, own: np.ndarray, vectors: np.ndarray, i: int, j: int):
    """(ids of a tile's rows, ids of its columns, which cells are pairs, dot products). Products are summed in order, as a plain loop does."""
    ids_b, b = ids[own == j], vectors[own == j].T.copy()
    ids_a, a = ids[own == i], vectors[own == i]
    for at in range(0, len(a), TILE):
        rows, x = ids_a[at : at + TILE], a[at : at + TILE]
        sums, part = np.zeros((len(x), b.shape[1])), np.empty((len(x), b.shape[1]))
        for d in range(len(b)):
            sums += np.multiply(x[:, d, None], b[d], out=part)
        yield rows, ids_b, (rows[:, None] < ids_b if i == j else rows[:, None] != ids_b), sums


def _met(rows: DataFrame, id_: str, vector: str, by: str, tile: Callable, schema: StructType | str) -> DataFrame:
    """tile(ids of rows, ids of columns, is a pair, dot product) -> columns of schema, over every pair of rows that are equal in `by`.

    A group is cut into blocks by a hash of the id, and any two of its blocks meet in a task of their own.
    """
    rows = rows.select(F.col(by).alias("g"), F.col(id_).alias("id"), F.col(vector).cast("array<double>").alias("v")).dropna()
    blocks = rows.groupBy("g").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = rows.join(blocks, "g").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rows = rows.select("g", "id", "v", "own", other).select("g", "id", "v", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        ids, own = (table.column(c).to_numpy() for c in ("id", "own"))
        flat = table.column("v").combine_chunks()
        vectors = flat.flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
        found = [tile(*x) for x in _tiles(ids, own, vectors, key[1].as_py(), key[2].as_py())]
        return pa.concat_tables(found) if found else empty

    empty = pa.table({f.name: pa.array([], _ARROW[f.dataType.simpleString()]) for f in schema})
    return rows.groupBy("g", "i", "j").applyInArrow(run, schema)


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}


def all_similar_pairs(rows: DataFrame, id_: str, vector: str, by: str, least: float) -> DataFrame:
    """(a, b, similarity): every pair a < b of vectors that are equal in `by`, with a dot product of at least `least`. Rows with nulls have no pair."""
    kind = rows.schema[id_].dataType

    def tile(a, b, pair, s):
        x, y = np.nonzero(pair & (s >= least))
        low, high = np.minimum(a[x], b[y]), np.maximum(a[x], b[y])
        return pa.table({"a": pa.array(low, arrow), "b": pa.array(high, arrow), "similarity": s[x, y]})

    arrow = _ARROW[kind.simpleString()]
    return _met(rows, id_, vector, by, tile, StructType().add("a", kind).add("b", kind).add("similarity", "double"))


def all_similarity_counts(rows: DataFrame, id_: str, vector: str, by: str, steps: int) -> DataFrame:
    """(bucket, n): how many of those pairs have a dot product in each bucket of 1 / steps. Pairs are counted where they meet."""

    def tile(a, b, pair, s):
        at, n = np.unique(np.floor(s[pair] * steps).astype(np.int64), return_counts=True)
        return pa.table({"bucket": at, "n": n.astype(np.int64)})

    return _met(rows, id_, vector, by, tile, StructType().add("bucket", "long").add("n", "long")).groupBy("bucket").agg(F.sum("n").alias("n"))


def overlapping(ranges: DataFrame, marks: DataFrame, by: str, width: int) -> DataFrame:
    """(range_id, mark_id): ranges [start, stop) and marks of one group that overlap; meets on buckets of `width`, no cross join."""
    r = ranges.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("stop") - 1) / width))))
    m = marks.select(by, "mark_id", F.col("start").alias("ms"), F.col("stop").alias("me"))
    m = m.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("ms") / width), F.floor((F.col("me") - 1) / width))))
    hit = r.join(m, [by, "bucket"]).where((F.col("start") < F.col("me")) & (F.col("ms") < F.col("stop")))
    # a pair meets in each bucket that both cover; it counts in the first one
    first = F.floor(F.greatest("start", "ms") / width)
    return hit.where(F.col("bucket") == first).select("range_id", "mark_id")


def union_by_name(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def multiset_extra(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of b beyond their number in a."""
    return b.exceptAll(a)
