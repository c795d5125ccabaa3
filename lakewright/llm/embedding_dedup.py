"""Embedding near-duplicates by collision counting over sorted one-dimensional projections.

A table has a random projection and coarse cells of further projections that keep unlike vectors
apart: in 64 dimensions a one-dimensional window alone holds most of a label. Within each cell vectors are
sorted by the table's projection, and each vector's window on it gives the candidates: those that collide
with it in this table. A pair that collides in at least COUNT tables is verified by cosine in double
precision. The number of tables is the least at which a pair at the threshold reaches COUNT with probability
RECALL, from the normal law of projected differences; the number of cell projections grows with the
logarithm of the largest label.

Only cells with two or more vectors get vectors sent. A large cell is cut by a hash into pieces of
about PIECE rows, and every pair of pieces is a task, so no cell is one task's work. A pair counts in
the first table in which it collides, so no list of pairs is gathered to make it unique. Tasks return
for each vector how many links they found, and edges that span their linked groups.

Equal vectors of a label form a class and travel once; links of a class count its copies. Null, zero
and non-finite vectors, null labels and null ids link with nothing; nor do vectors of other lengths. An
empty table gives no row; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import components, local_roots
from .textscan import U, mix

COSINE = 0.93
COUNT, RECALL = 2, 0.9998
CELL, WINDOW = 2.0, 0.8  # in standard deviations of one coordinate of a random unit vector
PIECE = 512
#: Pairs that a task holds at once, and about how many rows it gets.
PAIRS, TASK_ROWS = 8192, 4096
SEED = 5


def _normal(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def _inside(width: float, spread: float) -> float:
    """Probability that two numbers with a normal difference fall in one cell of a randomly shifted grid."""
    z = width / spread
    return 2 * _normal(z) - 1 - 2 / (math.sqrt(2 * math.pi) * z) * (1 - math.exp(-z * z / 2))


def plan(rows: int, cosine: float = COSINE) -> tuple[int, int]:
    """(cell projections, tables) for labels of up to `rows` vectors; lengths in standard deviations."""
    near = math.sqrt(2 - 2 * cosine)
    far = math.sqrt(2)
    k = 3 + math.ceil(math.log(max(rows, 2)) / -math.log(_inside(CELL, far)))  # a twentieth of a row shares its cell by chance
    p = _inside(CELL, near) ** k * (2 * _normal(WINDOW / near) - 1)
    tables = COUNT
    while sum(math.comb(tables, i) * p**i * (1 - p) ** (tables - i) for i in range(COUNT)) > 1 - RECALL:
        tables += 1
    return k, tables


class Tables:
    """Cells and sorted projections of vectors, in units of one coordinate's standard deviation."""

    def __init__(self, dims: int, k: int, tables: int):
        rng = np.random.default_rng(SEED)
        self.k, self.tables = k, tables
        self.axes = rng.standard_normal((dims, tables * (k + 1)))
        self.axes *= math.sqrt(dims) / np.linalg.norm(self.axes, axis=0)
        self.shift = rng.uniform(0, CELL, tables * k)
        self.keys = rng.integers(1, 1 << 62, tables * k).astype(U) | U(1)

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows x tables) cell names and places on the sorted projection."""
        y = x @ self.axes
        cut = self.tables * self.k
        cells = np.floor((y[:, :cut] + self.shift) / CELL).astype(np.int64).view(U)
        names = (mix(cells + self.keys) * self.keys).reshape(len(x), self.tables, self.k).sum(axis=2, dtype=U)
        return mix(names), y[:, cut:]


def _unit(column: pa.Array, dims: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)  # no overflow in the squares
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def _cells(dims: int, k: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Tables(dims, k, tables)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                names, _ = made(_unit(part.column(2), dims))
                label = mix(part.column(1).to_numpy().view(U))
                key = mix(names ^ label[:, None] ^ mix(np.arange(tables, dtype=U) + U(99)))
                ids = part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), tables)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(key.reshape(-1).view(np.int64)), pa.array(np.tile(np.arange(tables, dtype=np.int32), part.num_rows))], ["rep", "cell", "t"])

    return run


def _windows(group: np.ndarray, place: np.ndarray, first: np.ndarray, both: np.ndarray, span: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows of one group that lie in each other's window on the sorted projection, some at a time.

    A group within one piece (not both) pairs all its rows; one of two pieces pairs the first piece's rows (first) with the other's.
    Groups stand one after the other on a line, so one sort and one search serve all of them.
    """
    line = group * (4.0 * span) + place  # |place| < span
    reach = WINDOW + 1e-9  # rounding on the line; callers compare places
    order = np.argsort(line, kind="stable")
    target = order[~(both & first)[order]]  # rows that are looked for
    query = order[(~both | first)[order]]
    low = np.searchsorted(line[target], line[query] - reach, side="left")
    high = np.searchsorted(line[target], line[query] + reach, side="right")
    after = np.searchsorted(line[target], line[query], side="left")  # within a piece, each pair once: those behind in the order
    at = np.empty(len(group), dtype=np.int64)
    at[target] = np.arange(len(target))
    low = np.where(both[query], low, np.maximum(after, at[query] + 1) if len(query) else low)
    count = np.maximum(high - low, 0)
    ends = np.cumsum(count)
    i = 0
    while i < len(query):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PAIRS, side="right")))
        n = count[i:j]
        k = np.repeat(low[i:j] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        yield np.repeat(query[i:j], n), target[k]
        i = j


def _links(dims: int, k: int, tables: int, cosine: float):
    def run(table: pa.Table) -> pa.Table:
        made = Tables(dims, k, tables)
        column = lambda c: table.column(c).to_numpy()
        rep, copies, label, t = (column(c) for c in ("rep", "copies", "label", "t"))
        x = _unit(table.column("v").combine_chunks(), dims)
        names, place = made(x)
        group = np.unique(mix(column("cell").view(U) + mix(t.astype(U) + mix(column("p").astype(U) * U(65536) + column("q").astype(U)))), return_inverse=True)[1]
        both = column("p") != column("q")
        out_i, out_j = [], []
        for i, j in _windows(group, place[np.arange(len(t)), t], column("piece") == column("p"), both, math.sqrt(dims) + 1):
            hit = (names[i] == names[j]) & (np.abs(place[i] - place[j]) <= WINDOW)
            ok = (hit.sum(axis=1) >= COUNT) & (hit.argmax(axis=1) == t[i]) & hit[np.arange(len(i)), t[i]] & (label[i] == label[j])
            i, j = i[ok], j[ok]
            near = np.einsum("ij,ij->i", x[i], x[j]) >= cosine
            out_i.append(i[near])
            out_j.append(j[near])
        i, j = (np.concatenate(o) if o else np.zeros(0, dtype=np.int64) for o in (out_i, out_j))
        ids, row = np.unique(rep, return_inverse=True)
        links = np.zeros(len(ids), dtype=np.int64)
        np.add.at(links, row[i], copies[j])
        np.add.at(links, row[j], copies[i])
        root = local_roots(len(ids), row[i], row[j])
        keep = links > 0
        return pa.table({"rep": ids[keep], "links": links[keep], "other": ids[root][keep]})

    return run


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vectors (vec_id long, embedding array, label) -> vec_id, n_links, component_id, kept; one row for each row."""
    kind = vectors.schema["embedding"].dataType.elementType
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda x: x != 0)
    v = F.transform("embedding", lambda x: F.when(x == 0, F.lit(0).cast(kind)).otherwise(x))  # -0.0 equals 0.0 in a cosine
    rows = vectors.select(F.col("vec_id").cast("long"), F.xxhash64(F.col("label").cast("string")).alias("label"), F.when(F.coalesce(good, F.lit(False)), v).alias("v"))
    rows = written(rows.withColumn("h", F.when(F.col("v").isNotNull(), F.sha2(F.concat_ws("|", F.col("label").cast("string"), F.to_json(F.struct("v"))), 256))), "ed-rows")
    classes = rows.where("h is not null").groupBy("h").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("v").alias("v"))
    classes = written(classes, "ed-classes")
    edges, counts = None, None
    for dims in sorted(r[0] for r in classes.select(F.size("v")).distinct().collect()):  # one for each vector length
        own = classes.where(F.size("v") == dims)
        most = own.groupBy("label").count().agg(F.max("count")).first()[0]
        k, tables = plan(most, cosine)
        cells = written(own.select("rep", "label", "v").mapInArrow(_cells(dims, k, tables), "rep long, cell long, t int"), "ed-cells")
        full = cells.groupBy("cell", "t").agg(F.count("*").alias("n")).where("n > 1").select("cell", "t", F.ceil(F.col("n") / PIECE).cast("int").alias("pieces"))
        members = cells.join(full, ["cell", "t"])
        piece = F.pmod(F.xxhash64("rep", F.lit(7)), F.col("pieces")).cast("int")
        members = members.withColumn("piece", piece).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        members = written(members.select("rep", "cell", "t", "piece", F.least("piece", "with").alias("p"), F.greatest("piece", "with").alias("q")), "ed-members")
        buckets = max(1, -(-members.count() // TASK_ROWS))
        members = members.withColumn("bucket", F.pmod(F.xxhash64("cell", "t", "p", "q"), F.lit(buckets))).join(own.select("rep", "label", "copies", "v"), "rep")
        found = members.groupBy("bucket").applyInArrow(_links(dims, k, tables, cosine), "rep long, links long, other long")
        found = written(found, "ed-links")
        edges = found.select("rep", "other") if edges is None else edges.union(found.select("rep", "other"))
        n = found.groupBy("rep").agg(F.sum("links").alias("links"))
        counts = n if counts is None else counts.union(n)
    if edges is None:
        edges = rows.sparkSession.createDataFrame([], "rep long, other long")
        counts = rows.sparkSession.createDataFrame([], "rep long, links long")
    groups = components(written(edges.toDF("a", "b").distinct(), "ed-edges")).withColumnRenamed("node", "rep")
    known = classes.select("h", "rep", "copies").join(counts, "rep", "left").join(groups, "rep", "left")
    known = known.select("h", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("c"))
    out = rows.select("vec_id", "h").join(known, "h", "left")
    component = F.coalesce("c", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
