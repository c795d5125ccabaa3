"""Stated searches against all rows, exactly: a task multiplies a block of searches with a block of rows.

Products of whole tiles only propose pairs, with a slack beyond their rounding; a proposed pair's cosine is then summed place by
place in double precision, as `functions.values.cosine` does, so results do not hang on how rows fall into blocks. Rows are
sent once for each LEFT searches, searches at most SPREAD times (more often only beyond SPREAD * MOST_RIGHT rows), and a task
sends its best on. Pairs of a null, zero or non-finite vector, or of two lengths, have no cosine.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEFT, LEAST_RIGHT, MOST_RIGHT, SPREAD, TILE = 32768, 2048, 65536, 64, 1 << 21
_SLACK = 1e-12


def _usable(vectors: pd.Series) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length the places of its usable vectors, these as doubles, and their norms."""
    by_length: dict[int, list[int]] = {}
    for i, v in enumerate(vectors):
        if v is not None and len(v):
            by_length.setdefault(len(v), []).append(i)
    out = {}
    for n, at in by_length.items():
        rows = np.array([np.asarray(vectors.iloc[i], dtype="float64") for i in at])
        norms = np.zeros(len(rows))
        for d in range(n):
            norms += rows[:, d] * rows[:, d]
        norms = np.sqrt(norms)
        sound = np.isfinite(norms) & (norms > 0)
        if sound.any():
            out[n] = np.array(at)[sound], rows[sound], norms[sound]
    return out


def _cosines(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    total = np.zeros(len(i))
    for d in range(a.shape[1]):
        total += a[i, d] * b[j, d]
    return total / (na[i] * nb[j])


def _tiles(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    step = max(1, TILE // max(1, len(b)))
    for at in range(0, len(a), step):
        yield at, (a[at : at + step] @ b.T) / (na[at : at + step, None] * nb)


def _first_of_each(rows: np.ndarray, most: int) -> np.ndarray:
    """Places of the first `most` copies of each distinct row."""
    group = pd.factorize(np.array([r.tobytes() for r in rows], dtype=object))[0]
    order = np.argsort(group, kind="stable")
    start = np.flatnonzero(np.r_[True, group[order][1:] != group[order][:-1]][: len(order)])
    nth = np.arange(len(order)) - np.repeat(start, np.diff(np.r_[start, len(order)]))
    return np.sort(order[nth < most])


def _nearest(k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64"), "similarity": pd.Series(dtype="float64")})
        b = b.sort_values("id", ignore_index=True)
        own, ids = a["id"].to_numpy(), b["id"].to_numpy()
        found = [(np.zeros(0, dtype="int64"), np.zeros(0, dtype="int64"), np.zeros(0))]
        rights, length = _usable(b["v"]), np.zeros(len(a), dtype="int64")
        for n, (at, x, nx) in _usable(a["v"]).items():
            length[at] = n
            if n not in rights:
                continue
            to, y, ny = rights[n]
            few = _first_of_each(y, k + 1)  # of equal vectors only the smallest ids can be among the nearest
            to, y, ny = to[few], y[few], ny[few]
            for start, near in _tiles(x, nx, y, ny):
                near[own[at[start : start + len(near)], None] == ids[to]] = -np.inf
                bar = np.partition(near, -k, axis=1)[:, -k] if near.shape[1] > k else np.full(len(near), -np.inf)
                i, j = np.nonzero((near >= bar[:, None] - _SLACK) & (near > -np.inf))
                exact = _cosines(x, nx, y, ny, i + start, j)
                order = np.lexsort((ids[to[j]], -exact, i))
                i, j, exact = i[order], j[order], exact[order]
                first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]][: len(i)])
                keep = np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)])) < k
                found.append((at[i[keep] + start], ids[to[j[keep]]], exact[keep]))
        place, hit, similarity = (np.concatenate(c) for c in zip(*found, strict=True))
        query, missing = own[place], k - np.bincount(place, minlength=len(a))
        rest_q, rest_id = [], []
        others: dict[int, np.ndarray] = {}
        for i in np.flatnonzero(missing > 0):  # rows without a cosine come last, by id
            n = int(length[i])
            if n not in others:
                others[n] = np.setdiff1d(np.arange(len(b)), rights[n][0] if n in rights else [])[: k + len(b) - len(set(ids)) + 1]
            rest = [x for x in ids[others[n]].tolist() if x != own[i]][: missing[i]]
            rest_q += [own[i]] * len(rest)
            rest_id += rest
        none = np.full(len(rest_q), np.nan)
        return pd.DataFrame({"query": np.r_[query, np.array(rest_q, dtype="int64")], "id": np.r_[hit, np.array(rest_id, dtype="int64")], "similarity": np.r_[similarity, none]})

    return compare


def _rounded(x: np.ndarray, places: int) -> np.ndarray:
    """As Spark's round does: half up, by the shortest decimal form of the number."""
    scaled = np.abs(x) * 10**places
    out = np.sign(x) * np.floor(scaled + 0.5) / 10**places
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-places), rounding=ROUND_HALF_UP))
    return out


def _closest(least: float, most: int, places: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    unit = 10.0**-places

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        pool = pd.DataFrame({c: pd.Series(dtype=t) for c, t in (("left_id", "int64"), ("right_id", "int64"), ("q", "int64"), ("r", "int64"), ("similarity", "float64"))})
        parts, waiting, floor = [pool], 0, least
        best = lambda ps: pd.concat(ps).drop_duplicates(["left_id", "right_id"]).sort_values(["similarity", "left_id", "right_id"], ascending=[False, True, True]).head(most)
        if len(a) and len(b):
            own, ids = a["id"].to_numpy(), b["id"].to_numpy()
            mine, theirs = (pd.factorize(pd.concat([a["corpus"], b["corpus"]]))[0][s] for s in (slice(0, len(a)), slice(len(a), None)))
            rights = _usable(b["v"])
            for n, (at, x, nx) in _usable(a["v"]).items():
                if n not in rights:
                    continue
                to, y, ny = rights[n]
                for start, near in _tiles(x, nx, y, ny):
                    i, j = np.nonzero(near >= floor - unit)
                    other = mine[at[i + start]] != theirs[to[j]]
                    i, j = i[other] + start, j[other]
                    exact = _rounded(_cosines(x, nx, y, ny, i, j), places)
                    keep = exact >= floor
                    i, j, exact = at[i[keep]], to[j[keep]], exact[keep]
                    parts.append(pd.DataFrame({"left_id": np.minimum(own[i], ids[j]), "right_id": np.maximum(own[i], ids[j]), "q": i, "r": j, "similarity": exact}))
                    waiting += len(i)
                    if waiting > 20 * most:
                        parts, waiting = [best(parts)], 0
                        floor = parts[0]["similarity"].iloc[-1] if len(parts[0]) == most else floor
            pool = best(parts)
        q, r = pool["q"].to_numpy(), pool["r"].to_numpy()
        first = a["id"].to_numpy()[q] < b["id"].to_numpy()[r]
        left, right = a["corpus"].to_numpy()[q], b["corpus"].to_numpy()[r]
        return pd.DataFrame({"left_id": pool["left_id"].to_numpy(), "left_corpus": np.where(first, left, right), "right_id": pool["right_id"].to_numpy(), "right_corpus": np.where(first, right, left), "similarity": pool["similarity"].to_numpy()})

    return compare


def _met(searches: DataFrame, rows: DataFrame, compare: Callable, schema: str) -> DataFrame:
    """compare(searches, rows) for every pair of blocks. Both have an id, and columns v and what compare needs."""
    n, lefts = rows.count(), max(1, -(-searches.count() // LEFT))
    rights = max(1, -(-n // min(MOST_RIGHT, max(LEAST_RIGHT, -(-n // SPREAD)))))
    own = lambda k: F.pmod(F.xxhash64("id"), F.lit(k)).cast("int")
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    a = searches.withColumn("l", own(lefts)).withColumn("r", each(rights))
    b = rows.withColumn("r", own(rights)).withColumn("l", each(lefts))
    # one task for each pair of blocks: their number is known here, so it is not left to the default
    a, b = (d.repartition(min(lefts * rights, 2000), "l", "r") for d in (a, b))
    return a.groupBy("l", "r").cogroup(b.groupBy("l", "r")).applyInPandas(compare, schema)


def nearest(queries: DataFrame, vectors: DataFrame, id_: str, vector: str, k: int) -> DataFrame:
    """(query, id, similarity, rank): the k nearest of all other rows for a stated query set; rows without a cosine come last. Ids are whole numbers."""
    pick = lambda d: d.select(F.col(id_).cast("long").alias("id"), F.col(vector).alias("v"))
    best = _met(pick(queries), pick(vectors), _nearest(k), "query long, id long, similarity double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "id", "similarity", "rank")


def bridges(queries: DataFrame, vectors: DataFrame, id_: str, vector: str, corpus: str, least: float = 0.78, most: int = 200) -> DataFrame:
    """(left_id, left_corpus, right_id, right_corpus, similarity): the `most` closest pairs of different corpora, to three places.

    One side is of the stated query set, the other any row; a pair is listed once, the smaller id on the left. Rows without a corpus
    link with nothing. Ids are whole numbers.
    """
    pick = lambda d: d.where(F.col(corpus).isNotNull()).select(F.col(id_).cast("long").alias("id"), F.col(vector).alias("v"), F.col(corpus).alias("corpus"))
    kind = vectors.schema[corpus].dataType.simpleString()
    pairs = _met(pick(queries), pick(vectors), _closest(least, most, 3), f"left_id long, left_corpus {kind}, right_id long, right_corpus {kind}, similarity double")
    return pairs.dropDuplicates(["left_id", "right_id"]).orderBy(F.desc("similarity"), "left_id", "right_id").limit(most)
