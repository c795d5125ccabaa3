"""Texts that hold an earlier text whole, found by an index of shingles instead of a join of a group with itself.

Every run of WINDOW shingles of SHINGLE characters has a least one by hash; the index has these, some three in a hundred characters.
A text that holds another holds the other's runs too, and so all of its shingles of the index. So a text is looked up by that
one of its shingles that the fewest texts have, which passages that many texts share are not, and candidates are verified by their characters. Equal texts of a group are one text.
What is looked up are numbers of texts; the texts themselves meet only as candidates. A text that some row of one
group holds counts for that group alone.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stored import stored

#: Characters of a shingle and shingles of a window: powers of two.
SHINGLE, WINDOW = 16, 64
#: Least characters of a text that counts as pasted, and characters of an error that are looked for (fixed values).
LEAST, PROBE = 80, 120


def plain(c: Column) -> Column:
    """White space as one space, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "(?U)\\s+", " ")))


def _shingles(text: str) -> np.ndarray:
    """A 64-bit hash of each run of SHINGLE characters."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    if len(codes) < SHINGLE:
        return np.zeros(0, dtype=np.uint64)
    # runs of one, two, four, eight and sixteen characters: each is two of the ones before, the first times the base to the power of its length
    out, size, base = codes + np.uint64(1), 1, np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        while size < SHINGLE:
            out, size, base = out[:-size] * base + out[size:], 2 * size, base * base
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return out


def _least(own: np.ndarray) -> np.ndarray:
    """The least of each run of WINDOW values, without repeats."""
    if len(own) < WINDOW:
        return own[:0]
    size = 1
    while size < WINDOW:
        own, size = np.minimum(own[:-size], own[size:]), 2 * size
    return np.unique(own[np.flatnonzero(np.append(True, own[1:] != own[:-1]))])  # neighbours mostly share theirs


def _least_of_windows():
    @F.pandas_udf("array<long>")
    def windows(texts: pd.Series) -> pd.Series:
        return pd.Series([_least(_shingles(t)).view(np.int64) for t in texts])

    return windows


def pasted(rows: DataFrame, by: str, order: str, text: Column, probes: DataFrame | None = None, least: int = LEAST) -> DataFrame:
    """(by, order, earlier, kind): rows that hold the whole of an earlier text of their group, of `least` characters or more, and the earliest such one.

    probes: (by, order, text) of errors; of each the first PROBE characters are looked for. kind is "text" or "error"; a row may have both. The
    least length is at least WINDOW + SHINGLE - 1, below which a text has no run of shingles.
    """
    if least < WINDOW + SHINGLE - 1:
        raise ValueError(f"texts of fewer than {WINDOW + SHINGLE - 1} characters have no anchor")
    kept = rows.select(F.col(by).alias("_g"), F.col(order).alias("_n"), plain(text).alias("t")).where(F.length("t") >= least).withColumn("sha", F.sha2("t", 256))
    parts = [kept.select("_g", "_n", "sha", F.lit("text").alias("kind"), "t")]
    if probes is not None:
        cut = probes.select(F.col(by).alias("_g"), F.col(order).alias("_n"), F.substring(plain(F.col("text")), 1, PROBE).alias("t")).where(F.length("t") >= least)
        parts.append(cut.select("_g", "_n", F.sha2("t", 256).alias("sha"), F.lit("error").alias("kind"), "t"))
    every = reduce(DataFrame.union, parts)
    # texts travel once, as distinct ones with a number, and once more as candidates; all else are numbers
    texts = stored(every.select("sha", "t").dropDuplicates(["sha"]).withColumn("key", F.monotonically_increasing_id()), "pasted-texts")
    new = stored(every.drop("t").join(texts.select("sha", "key"), "sha").select("_g", "_n", "key", "kind"), "pasted-rows")
    heads = new.groupBy("_g", F.col("key").alias("old"), "kind").agg(F.min("_n").alias("first"))  # a paste that is repeated is one text
    index = stored(texts.select("key", F.explode(_least_of_windows()("t")).alias("h")), "pasted-index")
    # a text that holds another holds all its shingles of the index: it is looked up by the one that the fewest texts have
    counts = index.groupBy("h").agg(F.count("*").alias("n"))
    rarest = index.join(counts.where("n > 1"), "h", "left").groupBy("key").agg(F.min(F.struct(F.coalesce("n", F.lit(1)).alias("n"), "h")).alias("x"))
    rarest = rarest.where("x.n > 1").select(F.col("key").alias("old"), "x.h")
    met = stored(index.join(rarest, "h").where("key <> old").select("key", "old"), "pasted-met")
    short = texts.join(met.select(F.col("old").alias("key")).distinct(), "key", "left_semi").select(F.col("key").alias("old"), F.col("t").alias("_t"))
    held = texts.join(met.join(short, "old"), "key").where(F.contains("t", "_t")).select("key", "old")
    held = stored(held.union(texts.select("key", F.col("key").alias("old"))), "pasted-held")  # a text holds itself
    # of a group's texts, those that hold one that stood in the group before
    here = new.where("kind = 'text'").select("_g", "key").distinct().join(held, "key")
    there = heads.select(F.col("_g").alias("_h"), F.col("old").alias("_old"), "first", "kind")
    found = here.join(there, (F.col("old") == F.col("_old")) & F.col("_g").eqNullSafe(F.col("_h"))).groupBy("_g", "key", "kind").agg(F.min("first").alias("earlier"))
    found = found.select(F.col("_g").alias("_h"), F.col("key").alias("_key"), "kind", "earlier")
    out = new.where("kind = 'text'").select("_g", "_n", "key").join(found, F.col("_g").eqNullSafe(F.col("_h")) & (F.col("key") == F.col("_key"))).where(F.col("earlier") < F.col("_n"))
    return out.select(F.col("_g").alias(by), F.col("_n").alias(order), "earlier", "kind")
