"""Connected components by repeated contraction: no task gathers a component, whatever the number of edges.

Every node hooks to the smallest node next to it, by a random order, and edges are renamed to their
ends' parents until none is left. Labels are 64-bit hashes of ids; xxhash64 of one long is a
bijection, so they never collide. Each round is a written table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of 0 .. n - 1 the smallest one that links i - j lead to, by repeated minimum and jumping."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new[root]]
        if (new == root).all():
            break
        root = new
    return root


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of longs -> (node, component): the smallest id that each node reaches, for nodes with edges.

    The edges are read more than once: pass a written table.
    """
    x, y = F.xxhash64("a"), F.xxhash64("b")
    now = edges.where("a <> b")
    nodes = written(now.select("a").union(now.select("b")).distinct().select(F.col("a").alias("node"), F.xxhash64("a").alias("label")), "cc-nodes")
    now = written(now.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct(), "cc-edges")
    while not now.isEmpty():
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = written(both.groupBy("a").agg(F.min("b").alias("p")).select("a", F.least("a", "p").alias("p")), "cc-parents")
        pa = parent.select("a", F.col("p").alias("pa"))
        pb = parent.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        moved = now.join(pa, "a").join(pb, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b"))
        chain = parent.join(parent.select(F.col("a").alias("p"), F.col("p").alias("pp")), "p").select(F.col("p").alias("a"), F.col("pp").alias("b"))
        moved = moved.union(chain).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        old = [now, nodes, parent]
        nodes = written(nodes.join(parent.select(F.col("a").alias("label"), "p"), "label", "left").select("node", F.coalesce("p", "label").alias("label")), "cc-nodes")
        now = written(moved.distinct(), "cc-edges")
        drop_written(*old)
    smallest = nodes.groupBy("label").agg(F.min("node").alias("component"))
    return nodes.join(smallest, "label").select("node", "component")
