"""An index of vectors in cells, and exact searches on it.

Rows go to the nearest of at most MOST_CELLS centroids, which spherical k-means finds on a bounded sample. For a
least cosine t two unit vectors are at most r = sqrt(2 - 2t) apart, so a search leaves out a cell when the triangle
inequality puts its ring (least and most distance of its rows from its centroid) further than r away, or when the plane
between the two centroids is. What is left out cannot hold a hit: results are exact, whatever the sample was.

Blocks hold whole cells, or parts of a large one, and a task compares one block with another: a row is sent once for each block that
some row of the other side has to meet, not once for each cell. Within a task, rows meet the cells that they have to by
products of single precision on few leading directions of the sample. With the lengths of what is left out, these are never
below the cosine (but for a slack), so they only propose pairs; proposed ones are multiplied in double precision. Rows with a null,
zero or non-finite vector are in no index. Of equal vectors one row, the smallest id, stands for all (`distinct_vectors`), so copies are not paired with each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from .identity import contraction_components
from .sequences import numbered
from .stored import stored

MOST_CELLS, SAMPLE_PER_CELL = 1024, 16
#: Rows of a block, at least and at most, and blocks of a table between these; products of a tile.
LEAST_BLOCK, MOST_BLOCK, BLOCKS, TILE = 2048, 196608, 10, 1 << 20
#: Candidates that a search looks at in one round, and by what part of one similarities are ordered.
AT_ONCE, PART = 8, 10**9
DIMENSIONS, MOST_KNOWN = 64, 1 << 20
_SLACK = 1e-9
#: What a product of single precision may be off by, and the share of the sample's pairs that may pass as proposals.
_SINGLE, _PASSING = 2e-5, 2e-5


class _Places(dict):
    """Of each word twice its place, and one more for a minus; at most MOST_KNOWN words are kept."""

    def __missing__(self, w: str) -> int:
        h = hashlib.md5(w.encode()).hexdigest()
        at = 2 * (int(h[:2], 16) % DIMENSIONS) + (int(h[2], 16) >= 8)
        if len(self) < MOST_KNOWN:
            self[w] = at
        return at


def _hashed_words():
    known = _Places()  # of a task

    @F.pandas_udf("array<double>")
    def vectors(words: pd.Series) -> pd.Series:
        signed = (np.bincount([known[w] for w in row], minlength=2 * DIMENSIONS) if len(row) else np.zeros(2 * DIMENSIONS) for row in words)
        return pd.Series([(n[::2] - n[1::2]).astype("float64") for n in signed])

    return vectors


def word_vector(c: Column) -> Column:
    """The distinct words of a text, hashed with a sign into 64 places: a deterministic stand-in for an embedding."""
    return _hashed_words()(F.array_distinct(tokens(c)))


def _unit(c: Column) -> Column:
    as_doubles = F.transform(c, lambda x: x.cast("double"))
    length = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    sound = lambda v: F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # the vector and its length are bound as arguments, so each is computed once
    scaled = lambda v: F.get(F.transform(F.array(length(v)), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n))), F.lit(0))
    return F.get(F.transform(F.array(as_doubles), lambda v: F.when(sound(v), scaled(v))), F.lit(0))


def _units():
    @F.pandas_udf("array<double>")
    def units(vectors: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(vectors), dtype=object)
        by_length: dict[int, list[int]] = {}
        for i, v in enumerate(vectors):
            if v is not None and len(v):
                by_length.setdefault(len(v), []).append(i)
        for n, at in by_length.items():
            rows = np.array([np.asarray(vectors.iloc[i], dtype="float64") for i in at])
            squares = np.zeros(len(rows))
            for d in range(n):  # place by place, as a sum of doubles is
                squares += rows[:, d] * rows[:, d]
            sound = np.isfinite(rows).all(axis=1) & (squares > 0)
            with np.errstate(invalid="ignore", divide="ignore"):
                scaled = rows / np.sqrt(squares)[:, None]
            for i, v, ok in zip(at, scaled, sound, strict=True):
                if ok:
                    out.iat[i] = v
        return out

    return units.asNondeterministic()  # so a filter on the result does not compute it once more


def unit_rows(df: DataFrame, id_: str, vector: str) -> DataFrame:
    """(id, u) of rows with a usable vector, scaled to length one."""
    return df.select(F.col(id_).alias("id"), _units()(F.col(vector)).alias("u")).where("u is not null")


def distinct_vectors(df: DataFrame, id_: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """(id, u, weight) of one row for each distinct vector, and (id, stands_for, weight, second) of all rows.

    second: the next id of the class. Ids are distinct.
    """
    key = F.sha2(F.array_join(F.transform("u", lambda x: x.cast("string")), ",").cast("binary"), 256)
    rows = stored(unit_rows(df, id_, vector).withColumn("key", key), "vec-rows")
    first = rows.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("weight"))
    first = stored(first, "vec-first")
    second = rows.join(first, "key").where("weight > 1 and id <> first").groupBy("key").agg(F.min("id").alias("second"))
    classes = stored(first.join(second, "key", "left"), "vec-classes")
    members = rows.select("id", "key").join(classes, "key").select("id", F.col("first").alias("stands_for"), "weight", "second")
    return rows.join(first.select(F.col("first").alias("id"), "weight"), "id").select("id", "u", "weight"), members


@dataclass
class Index:
    """rows: id, u, weight, cell, a stored table. One number for each cell: rows in it, least and most distance from its centroid.

    basis: orthonormal directions, those of most of the sample first.
    """

    rows: DataFrame
    centroids: np.ndarray
    sizes: np.ndarray
    least: np.ndarray
    most: np.ndarray
    basis: np.ndarray
    sample: np.ndarray

    def visited(self, u: np.ndarray, own: np.ndarray, cells: np.ndarray, reach: float) -> np.ndarray:
        """rows x cells: which of these cells may hold a row within reach of rows u, whose nearest centroids are `own`."""
        to = self.centroids[cells]
        far = np.sqrt(np.maximum(2 - 2 * u @ to.T, 0))
        nearest = 2 - 2 * np.einsum("ij,ij->i", u, self.centroids[own])
        between = np.sqrt(np.maximum(2 - 2 * self.centroids @ to.T, 0))[own]
        plane = np.divide(far**2 - nearest[:, None], 2 * between, out=np.zeros_like(far), where=between > _SLACK)
        inside = (far >= self.least[cells] - reach - _SLACK) & (far <= self.most[cells] + reach + _SLACK) & (plane <= reach + _SLACK)
        return inside & (self.sizes[cells] > 0)

    def leading(self, least: float) -> int:
        """How many leading directions let few pairs of the sample pass; all where that is not so before."""
        x = self.sample[:2048] @ self.basis
        for d in (8, 12, 16, 20, 24, 32):
            if d < x.shape[1]:
                rest = np.sqrt(np.maximum(0, 1 - (x[:, :d] ** 2).sum(axis=1)))
                if (x[:512, :d] @ x[:, :d].T + rest[:512, None] * rest >= least).mean() - 1 / len(x) <= _PASSING:
                    return d
        return x.shape[1]


def _means(sample: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    centroids = sample[np.linspace(0, len(sample) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = (sample @ centroids.T).argmax(axis=1)
        for j in range(k):
            mean = sample[own == j].sum(axis=0)
            if np.linalg.norm(mean) > 0:
                centroids[j] = mean / np.linalg.norm(mean)
    return centroids


def build(rows: DataFrame, cells: int | None = None) -> Index:
    """rows: (id, u) of unit vectors of one length, and weight, the rows that one stands for. The centroids come from at most SAMPLE_PER_CELL * MOST_CELLS rows, by hash of the id."""
    weight = F.col("weight") if "weight" in rows.columns else F.lit(1)
    rows = stored(rows.select("id", "u", weight.cast("long").alias("weight")), "vec-units")
    n = rows.count()
    k = min(cells or int(np.ceil(np.sqrt(n) / 2)), MOST_CELLS, max(n, 1))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_PER_CELL * k).collect()
    if not sample:
        return Index(rows.withColumn("cell", F.lit(0)), np.zeros((1, 1)), np.zeros(1), np.zeros(1), np.zeros(1), np.eye(1), np.zeros((0, 1)))
    known = np.array([r["u"] for r in sample])
    centroids = _means(known, k)
    centroids = centroids[np.argsort(centroids @ np.linalg.svd(centroids, full_matrices=False)[2][0], kind="stable")]  # near ones often share a block
    basis = np.linalg.eigh(known.T @ known)[1][:, ::-1].copy()

    @F.pandas_udf("cell int, far double")
    def assign(u: pd.Series) -> pd.DataFrame:
        near = np.stack(u.to_numpy()) @ centroids.T
        own = near.argmax(axis=1)
        return pd.DataFrame({"cell": own.astype("int32"), "far": np.sqrt(np.maximum(2 - 2 * near[np.arange(len(own)), own], 0))})

    placed = stored(rows.withColumn("x", assign("u")).select("id", "u", "weight", "x.cell", "x.far"), "vec-index")
    sizes, least, most = np.zeros(k), np.zeros(k), np.zeros(k)
    for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("far").alias("a"), F.max("far").alias("b")).collect():  # a row for each cell
        sizes[r["cell"]], least[r["cell"]], most[r["cell"]] = r["n"], r["a"], r["b"]
    return Index(placed.drop("far"), centroids, sizes, least, most, basis, known)


def _dealt(sizes: np.ndarray) -> tuple[list[tuple[int, int, int]], int]:
    """(cell, first block, blocks) of each cell, in their order, and how many blocks there are. Only a cell that is larger than a block has several."""
    room = int(np.clip(-(-sizes.sum() // BLOCKS), LEAST_BLOCK, MOST_BLOCK))
    out, at, used = [], 0, 0
    for c, n in enumerate(sizes):
        parts = max(1, -(-int(n) // room))
        if used and used + n > room:
            at, used = at + 1, 0
        out.append((c, at, parts))
        at, used = (at + parts, 0) if parts > 1 else (at, used + n)
    return out, at + 1


class _Close:
    """The pairs of two blocks that may reach `least`, cell by cell and tile by tile."""

    def __init__(self, index: Index, least: float, later: bool):
        self.index, self.least, self.later, self.leading = replace(index, rows=None, sample=None), least, later, index.leading(least)
        self.reach = float(np.sqrt(max(0.0, 2 - 2 * least)))

    def _sides(self, u: np.ndarray) -> np.ndarray:
        d = self.leading
        x = u @ self.index.basis
        rest = np.sqrt(np.maximum(0, 1 - (x[:, :d] ** 2).sum(axis=1)))
        return np.column_stack([x[:, :d], rest] if d < x.shape[1] else [x]).astype("float32")

    def meets(self, u: np.ndarray, own: np.ndarray, cells: np.ndarray) -> np.ndarray:
        open_ = self.index.visited(u, own, cells, self.reach)
        return open_ & (cells >= own[:, None]) if self.later else open_

    def pairs(self, a: pd.DataFrame, b: pd.DataFrame, bar: np.ndarray | None = None, wanted: Callable | None = None):
        """Yields (i, j, cosine) with places in a and b. bar: for each row of a what a cosine must reach by now; wanted(i, j): which proposals to look at."""
        if not len(a) or not len(b):
            return
        ua, ub = np.stack(a["u"].to_numpy()), np.stack(b["u"].to_numpy())
        own, of = a["cell"].to_numpy(), b["cell"].to_numpy()
        cells = np.unique(of)
        step = max(1, TILE // len(cells))
        open_ = np.concatenate([self.meets(ua[k : k + step], own[k : k + step], cells) for k in range(0, len(ua), step)])
        pa, pb = self._sides(ua), self._sides(ub)
        products, passed = np.empty(TILE, dtype="float32"), np.zeros(TILE + 8, dtype=bool)
        for at, c in enumerate(cells):
            mine, theirs = np.flatnonzero(open_[:, at]), np.flatnonzero(of == c)
            for k in range(0, len(theirs), 1024):
                js = theirs[k : k + 1024]
                right = np.ascontiguousarray(pb[js].T)
                for m in range(0, len(mine), TILE // len(js)):
                    rows = mine[m : m + TILE // len(js)]
                    size = len(rows) * len(js)
                    near = products[:size].reshape(len(rows), len(js))
                    np.matmul(pa[rows], right, out=near)
                    np.greater_equal(near, np.float32(self.least - _SINGLE) if bar is None else (bar[rows, None] - _SINGLE).astype("float32"), out=passed[:size].reshape(near.shape))
                    passed[size : size + 8] = False
                    words = np.flatnonzero(passed[: -(-size // 8) * 8].view("uint64"))  # eight at a time, as few pass
                    if not len(words):
                        continue
                    flat = (words[:, None] * 8 + np.arange(8)).ravel()
                    flat = flat[passed[flat]]
                    i, j = rows[flat // len(js)], js[flat % len(js)]
                    if wanted is not None and len(i) > 512:
                        keep = wanted(i, j)
                        i, j, flat = i[keep], j[keep], flat[keep]
                    if len(i) * 16 > size:
                        x = (ua[rows] @ ub[js].T).ravel()[flat]
                    else:
                        x = np.concatenate([np.einsum("ij,ij->i", ua[i[n : n + 65536]], ub[j[n : n + 65536]]) for n in range(0, max(1, len(i)), 65536)])
                    yield i, j, x


def _met(index: Index, searches: DataFrame, least: float, compare: Callable, schema: str, later: bool = False) -> tuple[DataFrame, int]:
    """compare(searches, rows, close) for every pair of blocks that have to meet, and how many pairs share a cell to meet.

    searches: id, u and what compare needs. later: they are the index's rows, and meet only cells from their own on.
    """
    spark, close = index.rows.sparkSession, _Close(index, least, later)
    dealt, rights = _dealt(index.sizes)
    plan = spark.createDataFrame(dealt, "cell int, first int, parts int")  # a row for each cell
    rows = index.rows.join(F.broadcast(plan), "cell").withColumn("r", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int")).drop("first", "parts")
    if later:
        probes = rows.withColumnRenamed("r", "l")
    else:

        @F.pandas_udf("int")
        def own(u: pd.Series) -> pd.Series:
            return pd.Series((np.stack(u.to_numpy()) @ close.index.centroids.T).argmax(axis=1).astype("int32"))

        lefts = max(1, -(-searches.count() // int(np.clip(index.sizes.sum() // BLOCKS, LEAST_BLOCK, MOST_BLOCK))))
        probes = searches.drop("cell").withColumn("cell", own("u")).withColumn("l", F.pmod(F.xxhash64("id"), F.lit(lefts)).cast("int"))
    every = np.arange(len(index.sizes))

    def visits(batches):
        for batch in batches:
            for k in range(0, len(batch), 2048):
                part = batch.iloc[k : k + 2048]
                open_ = close.meets(np.stack(part["u"].to_numpy()), part["cell"].to_numpy(), every)
                for block in np.unique(part["l"]):
                    n = open_[part["l"].to_numpy() == block].sum(axis=0)
                    yield pd.DataFrame({"l": block, "to": np.flatnonzero(n), "n": n[n > 0]})

    counts = probes.select("u", "cell", "l").mapInPandas(visits, "l int, to int, n long").groupBy("l", "to").agg(F.sum("n").alias("n")).collect()  # blocks x cells at most
    pairs = sorted({(r["l"], k) for r in counts for k in range(dealt[r["to"]][1], sum(dealt[r["to"]][1:]))}) or [(-1, -1)]
    meet = F.broadcast(spark.createDataFrame(pairs, "l int, r int"))
    left, right = probes.join(meet, "l"), rows.join(meet, "r")
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # both sides can be of one table
    left, right = (d.repartition(min(len(pairs), 2000), "l", "r") for d in (left, right))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return compare(a, b, close)

    met = left.groupBy("l", "r").cogroup(right.groupBy("l", "r")).applyInPandas(run, schema)
    return met, int(sum(r["n"] * index.sizes[r["to"]] for r in counts))


def similar_pairs(index: Index, least: float) -> tuple[DataFrame, int]:
    """(left_id, right_id, similarity) of all pairs of indexed rows with a cosine of `least` or more, and how many pairs were examined."""

    def compare(a: pd.DataFrame, b: pd.DataFrame, close: _Close) -> pd.DataFrame:
        out = [pd.DataFrame({"left_id": pd.Series(dtype="int64"), "right_id": pd.Series(dtype="int64"), "similarity": pd.Series(dtype="float64")})]
        for i, j, x in close.pairs(a, b):
            left, right, same = a["id"].to_numpy()[i], b["id"].to_numpy()[j], a["cell"].to_numpy()[i] == b["cell"].to_numpy()[j]
            keep = (x >= least - _SLACK) & (~same | (left < right))  # rows of one cell meet both ways
            left, right = left[keep], right[keep]
            out.append(pd.DataFrame({"left_id": np.minimum(left, right), "right_id": np.maximum(left, right), "similarity": x[keep]}))
        return pd.concat(out)

    found, examined = _met(index, index.rows, least, compare, "left_id long, right_id long, similarity double", later=True)
    return found.where(F.round("similarity", 9) >= least), examined


def link_counts(index: Index, searches: DataFrame | None, least: float) -> tuple[DataFrame, int]:
    """(id, n, hit, similarity): for each search (id, u) the weight of all indexed rows, other than itself, with a cosine of `least`
    or more, and the most similar of them, the smallest id first; and how many pairs were examined. No pairs are listed.

    Without searches, all indexed rows are; then a pair of two cells is looked at once, for both.
    """
    floor, both = round(least * PART), searches is None

    def compare(a: pd.DataFrame, b: pd.DataFrame, close: _Close) -> pd.DataFrame:
        sides = [(a, b), (b, a)]
        n = [np.zeros(len(d), dtype="int64") for d, _ in sides]
        place = [np.full(len(d), -2 * PART, dtype="int64") for d, _ in sides]
        hit = [np.zeros(len(d), dtype="int64") for d, _ in sides]

        def count(side: int, i: np.ndarray, j: np.ndarray, p: np.ndarray) -> None:
            other = sides[side][1]
            np.add.at(n[side], i, other["weight"].to_numpy()[j] if "weight" in other.columns else 1)
            to = other["id"].to_numpy()[j]
            order = np.lexsort((to, -p, i))
            i, p, to = i[order], p[order], to[order]
            first = np.r_[True, i[1:] != i[:-1]][: len(i)]
            i, p, to = i[first], p[first], to[first]
            better = (p > place[side][i]) | ((p == place[side][i]) & (to < hit[side][i]))
            place[side][i[better]], hit[side][i[better]] = p[better], to[better]

        for i, j, x in close.pairs(a, b):
            p = np.rint(x * PART).astype("int64")
            keep = (p >= floor) & (a["id"].to_numpy()[i] != b["id"].to_numpy()[j])
            i, j, p = i[keep], j[keep], p[keep]
            count(0, i, j, p)
            if both:
                apart = a["cell"].to_numpy()[i] != b["cell"].to_numpy()[j]  # rows of one cell meet both ways
                count(1, j[apart], i[apart], p[apart])
        out = [pd.DataFrame({"id": d["id"].to_numpy(), "n": n[k], "place": place[k], "hit": hit[k]})[n[k] > 0] for k, (d, _) in enumerate(sides)]
        return pd.concat(out).astype("int64")

    met, examined = _met(index, index.rows if both else searches, least, compare, "id long, n long, place long, hit long", later=both)
    best = F.min(F.struct((-F.col("place")).alias("p"), "hit"))
    return met.groupBy("id").agg(F.sum("n").alias("n"), best.alias("x")).select("id", "n", "x.hit", (-F.col("x.p") / PART).alias("similarity")), examined


def neighbours(index: Index, searches: DataFrame, least: float, k: int) -> DataFrame:
    """(id, hit, similarity, rank): the k most similar indexed rows with a cosine of `least` or more, other than itself; the smaller id first."""
    met, _ = _met(index, searches.select("id", "u", F.lit(2 * PART).cast("long").alias("after"), F.lit(-1).cast("long").alias("after_id")), least, _best(least, k), "id long, hit long, place long")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("place"), "hit"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("id", "hit", (F.col("place") / PART).alias("similarity"), "rank")


def _best(least: float, k: int = AT_ONCE):
    floor = round(least * PART)

    def compare(a: pd.DataFrame, b: pd.DataFrame, close: _Close) -> pd.DataFrame:
        own, ids = a["id"].to_numpy(), b["id"].to_numpy()
        after, after_id = a["after"].to_numpy(), a["after_id"].to_numpy()
        bar = np.full(len(a), least)
        pool, new, waiting = [np.zeros(0, dtype="int64")] * 3, [], 0  # places in a, hits, similarities

        def merged() -> list[np.ndarray]:
            at, hit, place = (np.concatenate(c) for c in zip(pool, *new, strict=True))
            order = np.lexsort((hit, -place, at))
            at, hit, place = at[order], hit[order], place[order]
            first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]][: len(at)])
            nth = np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)]))
            full = nth == k - 1
            bar[at[full]] = np.maximum(least, place[full] / PART)
            return [at[nth < k], hit[nth < k], place[nth < k]]

        for i, j, x in close.pairs(a, b, bar):
            place, hit = np.rint(x * PART).astype("int64"), ids[j]
            ok = (place >= floor) & (hit != own[i]) & ((place < after[i]) | ((place == after[i]) & (hit > after_id[i])))
            new.append([i[ok], hit[ok], place[ok]])
            waiting += int(ok.sum())
            if waiting > 2 * len(a):
                pool, new, waiting = merged(), [], 0
        at, hit, place = merged()
        return pd.DataFrame({"id": own[at], "hit": hit, "place": place}, dtype="int64")

    return compare


def best_accepted(index: Index, searches: DataFrame, least: float, accepted: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(id, hit, similarity): for each search (id, u) the most similar indexed row, other than itself, that is accepted.

    accepted: (id, hit, place) -> those of its rows that pass. Candidates come in the order of similarity, then hit, AT_ONCE of a
    search in the first round and four times as many in each further one; a search of which none passes goes on after the last one, so
    nothing is given up.
    """
    k = AT_ONCE
    open_ = searches.select("id", "u", F.lit(2 * PART).cast("long").alias("after"), F.lit(-1).cast("long").alias("after_id"))
    done = []
    while True:
        met, _ = _met(index, open_, least, _best(least, k), "id long, hit long, place long")
        rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("place"), "hit"))
        best = met.withColumn("rank", rank).where(F.col("rank") <= k)
        ranked = best.groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-F.col("place")).alias("p"), "hit"))).alias("c"))
        ranked = stored(ranked, "vec-candidates")
        flat = ranked.select("id", F.explode("c").alias("c")).select("id", "c.hit", (-F.col("c.p")).alias("place"))
        passed = accepted(flat).groupBy("id").agg(F.min(F.struct((-F.col("place")).alias("p"), "hit")).alias("x"))
        passed = stored(passed.select("id", "x.hit", (-F.col("x.p") / PART).alias("similarity")), "vec-passed")
        done.append(passed)
        last = F.element_at("c", -1)
        rest = ranked.where(F.size("c") == k).join(passed, "id", "left_anti").select("id", (-last["p"]).alias("after"), last["hit"].alias("after_id"))
        open_ = stored(rest.join(searches.select("id", "u"), "id").select("id", "u", "after", "after_id"), "vec-open")
        if open_.isEmpty():
            break
        k *= 4
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out


def connections(df: DataFrame, id_: str, vector: str, per_row: int, least: float, most: float, domain: Column, folder: Column, two_domains: float, one_folder: float, subdomain: Column | None = None, two_subdomains: float = 0.0) -> DataFrame:
    """(left_id, right_id, similarity, near_duplicate, priority): the nearest rows of each row, as undirected pairs.

    Pairs of `most` or more are near duplicates and have no priority; the others gain by differing domains (or subdomains) and lose in one folder.
    """
    index = build(unit_rows(df, id_, vector))
    near = neighbours(index, index.rows.select("id", "u"), least, per_row)
    pairs = near.groupBy(F.least("id", "hit").alias("left_id"), F.greatest("id", "hit").alias("right_id")).agg(F.max("similarity").alias("similarity"))
    about = df.select(F.col(id_).alias("id"), domain.alias("domain"), (subdomain if subdomain is not None else F.lit(None).cast("string")).alias("sub"), folder.alias("folder"))
    side = lambda k: about.select(*[F.col(c).alias(f"{k}_{c}") for c in about.columns])
    rows = pairs.join(side("l"), F.col("left_id") == F.col("l_id")).join(side("r"), F.col("right_id") == F.col("r_id"))
    gain = F.when(F.col("l_domain") != F.col("r_domain"), two_domains).when(~F.col("l_sub").eqNullSafe(F.col("r_sub")) & F.col("l_sub").isNotNull(), two_subdomains).otherwise(0.0)
    loss = F.when(F.col("l_folder") == F.col("r_folder"), one_folder).otherwise(0.0)
    near_duplicate = F.col("similarity") >= most
    return rows.select("left_id", "right_id", F.round("similarity", 6).alias("similarity"), near_duplicate.alias("near_duplicate"), F.when(~near_duplicate, F.round(F.col("similarity") + gain - loss, 6)).alias("priority"))


def similar_classes(df: DataFrame, id_: str, vector: str, least: float) -> DataFrame:
    """(id, component): the smallest id that a row reaches over cosines of `least` or more; rows without a usable vector are alone.

    A task sends on the spanning links of its two blocks, not its pairs.
    """
    reps, members = distinct_vectors(df, id_, vector)
    index = build(reps)

    def compare(a: pd.DataFrame, b: pd.DataFrame, close: _Close) -> pd.DataFrame:
        links: list[tuple[int, int]] = []
        ids = np.unique(np.concatenate([a["id"].to_numpy(), b["id"].to_numpy()])) if len(a) and len(b) else np.zeros(0, dtype="int64")
        root = np.arange(len(ids))
        here, there = np.searchsorted(ids, a["id"].to_numpy()), np.searchsorted(ids, b["id"].to_numpy())

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        def apart(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            while (root[root] != root).any():
                root[:] = root[root]
            return root[here[i]] != root[there[j]]

        for i, j, x in close.pairs(a, b, wanted=apart):
            linked = np.rint(x * PART) >= round(least * PART)
            i, j = i[linked], j[linked]
            while len(i):  # a few at a time, as these often settle the others
                for one, two in zip(here[i[:512]], there[j[:512]], strict=True):
                    p, q = find(one), find(two)
                    if p != q:
                        root[max(p, q)] = min(p, q)
                        links.append((int(ids[one]), int(ids[two])))
                i, j = i[512:], j[512:]
                keep = apart(i, j)
                i, j = i[keep], j[keep]
        return pd.DataFrame({"a": pd.Series([x for x, _ in links], dtype="int64"), "b": pd.Series([y for _, y in links], dtype="int64")})

    links, _ = _met(index, index.rows, least, compare, "a long, b long", later=True)
    links = links.union(members.where("id <> stands_for").select("id", "stands_for"))
    return contraction_components(stored(links, "vec-links"), df, id_)


def reused(df: DataFrame, id_: str, vector: str, answer: Column, least: float, review: int) -> DataFrame:
    """(id, representative, members, answer, reused, reviewed): one row of each class is answered and its answer serves the class.

    Reviewed are the representatives of classes of several rows, and an even spread of the lone rows for what is left of `review`.
    """
    classes = stored(similar_classes(df, id_, vector, least).withColumnRenamed("component", "representative"), "reuse-classes")
    sizes = stored(classes.groupBy("representative").agg(F.count("*").alias("members")), "reuse-sizes")
    shared = sizes.where("members > 1").count()
    alone = numbered(sizes.where("members = 1").select(F.col("representative").alias("id")), ["id"], "at")
    room, n = max(0, review - shared), sizes.where("members = 1").count()
    step = max(1, n // room) if room else 1
    spread = alone.where(F.lit(room > 0) & ((F.col("at") - 1) % step == 0) & (F.floor((F.col("at") - 1) / step) < room)).select("id", F.lit(True).alias("spread"))
    answers = df.select(F.col(id_).alias("representative"), answer.alias("answer"))
    rows = classes.join(sizes, "representative").join(answers, "representative").join(spread, "id", "left")
    own = F.col("id") == F.col("representative")
    return rows.select("id", "representative", "members", "answer", (~own).alias("reused"), ((own & (F.col("members") > 1)) | F.coalesce("spread", F.lit(False))).alias("reviewed"))


def cluster_members(df: DataFrame, id_: str, vector: str, least: float) -> DataFrame:
    """(id, cluster, size, representative, similarity): classes of `least` or more, numbered g1, g2 and on by their smallest ids, which represent them.

    similarity: to the representative, to three places; 1 for itself and for rows without a usable vector, which are alone.
    """
    df = stored(df.select(id_, vector), "cluster-vectors")
    classes = stored(similar_classes(df, id_, vector, least).withColumnRenamed("component", "representative"), "cluster-classes")
    sizes = classes.groupBy("representative").agg(F.count("*").alias("size"))
    order = numbered(sizes.select("representative"), ["representative"], "place").select("representative", F.concat(F.lit("g"), F.col("place").cast("string")).alias("cluster"))
    units = unit_rows(df, id_, vector)
    own, first = units.withColumnRenamed("u", "a"), units.select(F.col("id").alias("representative"), F.col("u").alias("b"))
    rows = classes.join(sizes, "representative").join(order, "representative").join(own, "id", "left").join(first, "representative", "left")
    product = F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda s, z: s + z)
    return rows.select("id", "cluster", "size", "representative", F.round(F.coalesce(product, F.lit(1.0)), 3).alias("similarity"))


def hybrid_ranking(chunks: DataFrame, by: str, id_: str, vector: str, question: list[float], overlap: Column, each: int, meaning: float = 0.75) -> DataFrame:
    """(by, id, score, best): the `each` best chunks of each group by cosine with a question and share of its words, and the group's best score.

    A chunk without a usable vector has the cosine 0.
    """
    q = np.array(question, dtype=float)
    u = F.array(*[F.lit(float(x)) for x in q / np.linalg.norm(q)])
    product = F.aggregate(F.zip_with(_unit(F.col(vector)), u, lambda x, y: x * y), F.lit(0.0), lambda s, z: s + z)
    rows = chunks.select(by, F.col(id_).alias("id"), (F.lit(meaning) * F.coalesce(product, F.lit(0.0)) + F.lit(1 - meaning) * overlap).alias("score"))
    best = rows.groupBy(by).agg(F.max("score").alias("best")).withColumnRenamed(by, "_by")
    # Spark keeps `each` rows of a group in each task before it shuffles
    top = rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "id"))).where(F.col("place") <= each)
    return top.join(best, F.col(by).eqNullSafe(F.col("_by"))).select(by, "id", F.round("score", 6).alias("score"), F.round("best", 6).alias("best"))
