"""A manifest of a dataset: a tree of digests over its rows, with a proof for every row.

Leaves are digests of rows, sequences (one for each source) order them by doc_id, and every 3
consecutive nodes become their digest until a sequence has one node, its subroot. The subroots, in
the order of their sources (null first, bytewise), are a sequence of their own, whose last node is the root.

Nodes live in Parquet folders, one for each level. A node's coordinate is (sequence, level, place), so its
parent and the others of its run follow from numbers alone. Leaves get their places from sorted runs: range
partitions, the rows of each sequence in them, and sums of these. A chunk is 3^STEPS consecutive nodes and never
spans two tasks: one scan of sorted chunks writes STEPS levels, sorted by place, and the next scan
reads the uppermost of them. Proofs go the other way: a scan merges a chunk's nodes, level by level, with its
leaves and with the path from the chunk's top to the root. So a task holds one chunk, however large a source
is, and only digests are shuffled, never texts.

A null doc_id stands first in its sequence; rows of one doc_id are ordered by their digests, so the tree does
not depend on how rows are dealt, and repeated rows are leaves of their own. Null values count as such; long
texts are hashed whole within one task. Columns that are no part of a leaf are ignored, whatever their names.
An empty table has no root and gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir, written

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY, STEPS = 3, 6
CHUNK = ARITY**STEPS
DIGEST = 32
NODES = "seq binary, at long, count long, hash binary, level int"


def hashed(digests: bytes) -> bytes:
    """The digest of some digests, one after the other, each as lowercase hex text."""
    return hashlib.sha256(digests.hex().encode()).digest()


def encoded(column: Column) -> Column:
    """`-` if null, else the bytes of its UTF-8 form, a colon, and that."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: dict[str, Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[encoded(c) for c in columns.values()]).cast("binary"), 256))


def levels_above(count: int) -> int:
    """How many levels a stage adds above `count` nodes of a sequence."""
    n = 0
    while count > 1 and n < STEPS:
        count, n = -(-count // ARITY), n + 1
    return n


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (seq, ..., a written table) -> with at, the place in their sequence, and count, the rows of it."""
    keys = ["seq", *order]
    runs = written(rows.repartitionByRange(*keys).withColumn("run", F.spark_partition_id()), "mk-runs")
    totals = runs.groupBy("run", "seq").agg(F.count("*").alias("n"))
    by_run = Window.partitionBy("seq").orderBy("run")  # a row for each run that a sequence meets
    before = F.coalesce(F.sum("n").over(by_run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = written(totals.select("run", "seq", before.alias("before"), F.sum("n").over(Window.partitionBy("seq")).alias("count")), "mk-totals")
    rank = F.row_number().over(Window.partitionBy("run", "seq").orderBy(*order))
    return written(runs.withColumn("rank", rank).join(totals, ["run", "seq"]).withColumn("at", F.col("before") + F.col("rank") - 1).drop("run", "rank", "before"), "mk-leaves")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list]]:
    """Consecutive rows of one (seq, chunk), the first two columns."""
    rows = (r for b in batches for a in range(0, b.num_rows, 4096) for r in zip(*[c.to_pylist() for c in b.slice(a, 4096).columns], strict=True))
    for key, group in itertools.groupby(rows, key=lambda r: r[:2]):
        yield key, list(group)


def _grow(base: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (seq, chunk), rows in _chunks(batches):
            nodes, count, at, made = [r[4] for r in rows], rows[0][3], chunk * CHUNK, []
            for level in range(1, levels_above(count) + 1):
                nodes = [hashed(b"".join(nodes[k : k + ARITY])) for k in range(0, len(nodes), ARITY)]
                count, at = -(-count // ARITY), at // ARITY
                made += [(seq, at + k, count, h, base + level) for k, h in enumerate(nodes)]
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], type=t) for k, t in enumerate(kinds)], ["seq", "at", "count", "hash", "level"])

    return run


@dataclass
class Tree:
    """Placed leaves (seq, at, count, hash, ...), the folder of the levels above them, and the level at which each stage starts."""

    leaves: DataFrame
    path: str
    bases: list[int]

    def nodes(self) -> DataFrame:
        return self.leaves.sparkSession.read.schema(NODES).parquet(self.path)

    def tops(self) -> DataFrame:
        """seq, hash, length (of the sequence): the last node of each sequence."""
        one = self.leaves.where("count = 1").select("seq", "hash", F.lit(1).cast("long").alias("length"))
        lengths = self.leaves.where("at = 0 and count > 1").select("seq", F.col("count").alias("length"))
        return one.union(self.nodes().where("count = 1").select("seq", "hash").join(lengths, "seq"))


def build(leaves: DataFrame) -> Tree:
    """leaves: what placed gave, with hash. Writes the levels above them."""
    spark = leaves.sparkSession
    tree = Tree(leaves, f"{shared_dir(spark)}/mk-levels-{uuid.uuid4().hex[:12]}", [])
    now = leaves.where("count > 1")
    while not tree.bases or not now.isEmpty():
        base = STEPS * len(tree.bases)
        tree.bases.append(base)
        rows = now.select("seq", F.floor(F.col("at") / CHUNK).alias("chunk"), "at", "count", "hash")
        rows = rows.repartitionByRange("seq", "chunk").sortWithinPartitions("seq", "chunk", "at")
        grown = rows.mapInArrow(_grow(base), NODES)
        grown.sortWithinPartitions("level", "seq", "at").write.mode("append").partitionBy("level").option("compression", "zstd").parquet(tree.path)
        now = tree.nodes().where((F.col("level") == base + STEPS) & (F.col("count") > 1))
    return tree


def entry(run: list[bytes], place: int) -> bytes:
    """One level of a path: a byte with the run's size and the place in it, then the others of the run."""
    return bytes([len(run) * 4 + place]) + b"".join(run[:place] + run[place + 1 :])


def others(path: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Level by level, the digests before and after one's own."""
    at = 0
    while at < len(path):
        size, place = divmod(path[at], 4)
        stop = at + 1 + DIGEST * (size - 1)
        middle = at + 1 + DIGEST * place
        yield path[at + 1 : middle], path[middle:stop]
        at = stop


def folded(own: bytes, path: bytes) -> bytes:
    """The root that a leaf and its path lead to."""
    for before, after in others(path):
        own = hashed(before + own + after)
    return own


def _descend(final: bool, keep_path: bool):
    """Rows seq, chunk, kind (0: the path above, 1: inner nodes, 2: base nodes), level, count, hash, path, top, doc_id, tampered."""
    if final:
        names = ["doc_id", "leaf", "subroot", "proof_sha256", "folded_root", "path"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary()]
    else:
        names, kinds = ["seq", "chunk", "path", "top"], [pa.binary(), pa.int64(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (seq, chunk), rows in _chunks(batches):
            above, top, floors = b"", b"", {}
            for r in rows:
                if r[2] == 0:
                    above, top = r[6], r[7]
                elif r[2] == 1:
                    floors.setdefault(r[3], []).append(r[5])
            base = [r for r in rows if r[2] == 2]
            levels = [[r[5] for r in base], *[floors[k] for k in sorted(floors)]][: levels_above(base[0][4])]
            paths = [above]
            for nodes in reversed(levels):
                paths = [entry(nodes[p - p % ARITY : p - p % ARITY + ARITY], p % ARITY) + paths[p // ARITY] for p in range(len(nodes))]
            if final:
                out = []
                for r, path in zip(base, paths, strict=True):
                    siblings = b"".join(x + y for x, y in others(path))
                    out.append((r[8], r[5].hex(), top.hex(), hashed(siblings).hex(), folded(r[9] or r[5], path).hex(), path if keep_path else None))
            else:
                out = [(seq, chunk * CHUNK + k, path, top) for k, path in enumerate(paths)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], type=t) for k, t in enumerate(kinds)], names)

    return run


def paths(tree: Tree, ends: DataFrame, keep_path: bool) -> DataFrame:
    """Proofs of a tree's leaves. ends: seq, length, path (from the sequence's top to the root), top; a written table."""
    none, long_none = F.lit(None).cast("binary"), F.lit(None).cast("long")
    above = None
    for base in reversed(tree.bases):
        whole, inner = CHUNK ** (base // STEPS + 1), tree.nodes()
        here = ends.where((F.col("length") <= whole) & (F.col("length") > (whole // CHUNK if base else 0)))
        here = here.select("seq", F.lit(0).cast("long").alias("chunk"), "path", "top")
        above = here if above is None else here.union(above)
        nodes = tree.leaves if base == 0 else inner.where((F.col("level") == base) & (F.col("count") > 1)).withColumn("doc_id", long_none).withColumn("tampered", none)
        inner = inner.where(F.col("level").between(base + 1, base + STEPS - 1))
        width = F.pow(F.lit(float(ARITY)), F.lit(base + STEPS) - F.col("level")).cast("long")
        rows = above.select("seq", "chunk", F.lit(0).alias("kind"), F.lit(0).alias("level"), long_none.alias("count"), none.alias("hash"), "path", "top", long_none.alias("doc_id"), none.alias("tampered"), long_none.alias("at"))
        rows = rows.union(inner.select("seq", F.floor(F.col("at") / width), F.lit(1), "level", "count", "hash", none, none, long_none, none, "at"))
        rows = rows.union(nodes.select("seq", F.floor(F.col("at") / CHUNK), F.lit(2), F.lit(0), "count", "hash", none, none, "doc_id", "tampered", "at"))
        rows = rows.repartitionByRange("seq", "chunk").sortWithinPartitions("seq", "chunk", "kind", "level", "at").drop("at")
        if base:
            above = written(rows.mapInArrow(_descend(False, True), "seq binary, chunk long, path binary, top binary"), "mk-paths")
        else:
            return rows.mapInArrow(_descend(True, keep_path), "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string, path binary")


@dataclass
class Manifest:
    """The tree of the rows, the tree of the subroots (its seq is empty), and the root (hex; None for an empty table)."""

    rows: Tree
    sources: Tree
    root: str | None

    def proofs(self, keep_path: bool = True) -> DataFrame:
        """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified and path: one row for each row of the table."""
        # the path of a subroot in the upper tree, found as those of leaves are
        tops = written(self.rows.tops().select("seq", F.col("hash").alias("top"), "length"), "mk-tops")
        ends = self.sources.tops().select("seq", "length", F.lit(b"").alias("path"), F.col("hash").alias("top"))
        upper = paths(self.sources, written(ends, "mk-ends"), True)  # its doc_id is the place among the sources
        places = self.sources.leaves.select(F.col("at").alias("doc_id"), F.col("own").alias("seq"))
        ends = upper.select("doc_id", "path").join(places, "doc_id").drop("doc_id").join(tops, "seq")
        found = paths(self.rows, written(ends.select("seq", "length", "path", "top"), "mk-ends"), keep_path)
        root = F.lit(self.root)
        out = found.select("doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"), "path")
        return out if keep_path else out.drop("path")


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, tampered: DataFrame | None = None) -> Manifest:
    """docs (doc_id long, source, ...) -> its manifest.

    tampered: docs with a further column `_tampered`, the leaf that a row has after tampering (null: its own); proofs fold that one.
    """
    docs = tampered if tampered is not None else docs.withColumn("_tampered", F.lit(None).cast("binary"))
    source = F.coalesce(F.concat(F.lit(b"\x01"), F.col("source").cast("string").cast("binary")), F.lit(b""))  # null first
    leaves = docs.select(source.alias("seq"), F.col("doc_id").cast("long").alias("doc_id"), leaf({c: F.col(c) for c in columns}).alias("hash"), F.col("_tampered").alias("tampered"))
    rows = build(placed(written(leaves, "mk-digests"), ["doc_id", "hash", "tampered"]))
    subroots = written(rows.tops().select(F.lit(b"").alias("seq"), F.col("seq").alias("own"), "hash"), "mk-subroots")
    top = placed(subroots, ["own"]).withColumn("doc_id", F.col("at")).withColumn("tampered", F.lit(None).cast("binary"))
    sources = build(top)
    root = sources.tops().first()
    return Manifest(rows, sources, root and bytes(root["hash"]).hex())


def without_newlines(docs: DataFrame, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """docs with `_tampered`: where 2 divides the checksum of doc_id, the leaf of the row without the newlines of its text."""
    changed = {c: F.translate(c, "\n", "") if c == "text" else F.col(c) for c in columns}
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return docs.withColumn("_tampered", F.when(even & F.col("text").contains("\n"), leaf(changed)))
