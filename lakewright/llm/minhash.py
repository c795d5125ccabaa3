"""MinHash near-duplicates: SuperMinHash signatures, banding, verification, components.

A document's set holds its distinct shingles of `words` words (a shorter text is one shingle; no
words: an empty set, linked with nothing). For each element SuperMinHash walks a random permutation
of the slots: at step j it offers slot p(j) the value j + r. Ranks within an element are distinct,
which lowers the variance of plain MinHash, and a document stops once no slot holds a rank above j.
The permutation is affine, which keeps each slot's rank uniform.

Texts of equal words (by a 128-bit hash of their spelling) form a class, represented by its smallest
doc_id; only representatives go on. They meet in buckets of bands: 32 of 4 rows, so that a pair at 0.8
misses all of them once in 2e7. Pairs of a bucket with 80 of 128 equal slots (a pair at 0.8 has
102 +- 4.5) join families; tasks send on spanning edges only, never the pairs of a bucket.

Verification is on full sets, with words told apart by their bytes: 100 * |A & B| >= 80 * |A | B|.
  1. Each spanning edge of a family is verified: a hub's text goes once to each piece of its members.
  2. A family that this joins to one component is done. In the others all pairs of members of
     different components are compared, piece by piece.

Repeated rows are copies of each other. Null and empty texts have n_shingles 0 and stay alone, as a row
without doc_id does in its class only if no other row has its words. A long text is whole within one
task. An empty table gives none; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import components, local_roots
from .textscan import NOT_SPACE, Spelled, U, mix, names_of, numbered, row_words, seeded, slices, word_spans

SLOTS, BANDS, ROWS = 128, 32, 4
LEAST_EQUAL_SLOTS = 80
#: Rows of a bucket in one piece; a family's pieces, which carry texts, are half as large.
PIECE = 512

_BAND = seeded(22, ROWS) | U(1)


class Shingles:
    """The distinct shingles of each row of a slice: their rows, and numbers that are equal only for equal words."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, words: int):
        rows = len(off) - 1
        self.starts, self.ends, wrow = word_spans(buf, off, NOT_SPACE)
        self.word, self.vocabulary = numbered(buf, self.starts, self.ends, NOT_SPACE, lower=True)
        self.first = row_words(wrow, rows)
        count = np.diff(self.first)
        n = len(self.word)
        begin = np.zeros(0, dtype=np.int64)
        if n >= words:
            begin = np.flatnonzero(wrow[: n - words + 1] == wrow[words - 1 :])
        few = np.flatnonzero((count > 0) & (count < words))
        begin = np.concatenate([begin, self.first[few]])
        size = np.concatenate([np.full(len(begin) - len(few), words), count[few]])
        row = wrow[begin]
        self.spelt = np.full((len(begin), words), -1, dtype=np.int32)  # -1 after the end of a short text
        for k in range(words):
            has = np.flatnonzero(size > k)
            self.spelt[has, k] = self.word[begin[has] + k]
        raw = pa.Array.from_buffers(pa.binary(4 * words), len(begin), [None, pa.py_buffer(self.spelt)])
        number = raw.dictionary_encode().indices.to_numpy().astype(np.int64)
        key = row * (len(begin) + 1) + number
        order = np.argsort(key)
        new = np.ones(len(key), dtype=bool)
        new[1:] = np.diff(key[order]) != 0
        keep = order[new]  # by row
        self.row, self.number, self.spelt = row[keep], number[keep], self.spelt[keep]

    def names(self) -> np.ndarray:
        """A 64-bit name of each shingle, the same in every task."""
        words = np.append(names_of(self.vocabulary), U(0))  # the last one for -1
        place = seeded(21, self.spelt.shape[1]) | U(1)
        return mix((words[self.spelt] * place).sum(axis=1, dtype=U))


def super_minhash(row: np.ndarray, value: np.ndarray, rows: int, slots: int = SLOTS) -> np.ndarray:
    """rows x slots: the rank of the smallest offer in the top 8 bits, its fraction in the others."""
    sig = np.full((rows, slots), ~U(0), dtype=U)
    flat = sig.reshape(-1)
    at = mix(value + U(0x1234567)) & U(slots - 1)
    stride = (mix(value + U(0x89ABCDE)) & U(slots - 1)) | U(1)
    base = row.astype(U) * U(slots)
    turn = seeded(23, slots)
    for j in range(slots):
        if not len(value):
            break
        offer = (mix(value ^ turn[j]) >> U(8)) | (U(j) << U(56))
        np.minimum.at(flat, (base + at).astype(np.int64), offer)
        going = ~(sig < (U(j + 1) << U(56))).all(axis=1)
        on = going[row]
        if not on.all():
            row, value, at, stride, base = row[on], value[on], at[on], stride[on], base[on]
        at = (at + stride) & U(slots - 1)
    return sig


def _sign(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, off in slices(batch, "text"):
                rows = part.num_rows
                own = Shingles(buf, off, words)
                n = np.bincount(own.row, minlength=rows).astype(np.int64)
                f1, f2 = Spelled(buf, own.starts, own.ends, NOT_SPACE, lower=True).digests(own.first[:-1], own.first[1:])
                sig = super_minhash(own.row, own.names(), rows)
                grouped = sig.reshape(rows, BANDS, ROWS)
                bands = np.zeros((rows, BANDS), dtype=U)
                for k in range(ROWS):
                    bands += mix(grouped[:, :, k]) * _BAND[k]
                bands = mix(bands + np.arange(BANDS, dtype=U) * U(0x9E3779B97F4A7C15))
                small = np.ascontiguousarray((mix(sig) & U(255)).astype(np.uint8))
                at = pa.array(np.arange(rows + 1, dtype=np.int32) * BANDS)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n), pa.array(f1), pa.array(f2), pa.ListArray.from_arrays(at, pa.array(bands.view(np.int64).reshape(-1))), pa.array([x.tobytes() for x in small], type=pa.binary())],
                    ["doc_id", "n_shingles", "f1", "f2", "bands", "sig"],
                )

    return run


def pieced(members: DataFrame, group: str, member: str, piece: int, task_rows: int) -> DataFrame:
    """members (group, member) with columns piece, p, q and task: every pair of a group's members meets in one (p, q).

    A group is cut by a hash into pieces of about `piece` rows, every pair of pieces is met once, and
    pairs of pieces are dealt to tasks of about `task_rows` rows.
    """
    sizes = members.groupBy(group).agg(F.ceil(F.count("*") / piece).cast("int").alias("pieces"))
    rows = members.join(sizes, group).withColumn("piece", F.pmod(F.xxhash64(member, F.lit(7)), F.col("pieces")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    rows = written(rows.select(group, member, "piece", F.least("piece", "with").alias("p"), F.greatest("piece", "with").alias("q")), "mh-pieces")
    tasks = max(1, -(-rows.count() // task_rows))
    return rows.withColumn("task", F.pmod(F.xxhash64(group, "p", "q"), F.lit(tasks)))


def _groups(table: pa.Table, group: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row numbers of each (group, p, q), those of piece p and of piece q."""
    c = lambda n: table.column(n).to_numpy()
    piece, p, q = c("piece"), c("p"), c("q")
    key = mix(c(group).view(U) + mix(p.astype(U) * U(1 << 32) + q.astype(U)))
    order = np.argsort(key, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
        first = own[0]
        if p[first] == q[first]:
            yield own, own, own
        else:
            yield own, own[piece[own] == p[first]], own[piece[own] == q[first]]


def _spanning(rep: np.ndarray, i: list, j: list) -> pa.Table:
    """Edges that join the same members as rows i - j do."""
    i, j = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (i, j))
    ids, at = np.unique(np.concatenate([rep[i], rep[j]]), return_inverse=True)
    root = local_roots(len(ids), at[: len(i)], at[len(i) :])
    own = root != np.arange(len(ids))
    return pa.table({"a": ids[root[own]], "b": ids[own]})


def _maybe(table: pa.Table) -> pa.Table:
    """Of members of buckets with their slots: edges over all pairs with enough equal slots."""
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), dtype=np.uint8).reshape(table.num_rows, -1)
    rep = table.column("rep").to_numpy()
    left, right = [], []
    for _, a, b in _groups(table, "bucket"):
        for x in a.tolist():
            rest = b[b > x] if a is b else b
            near = rest[(sig[rest] == sig[x]).sum(axis=1) >= LEAST_EQUAL_SLOTS]
            left.append(np.full(len(near), x))
            right.append(near)
    return _spanning(rep, left, right)


def _sets_of(texts: pa.ChunkedArray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle numbers of a column of texts, and where each text's begin."""
    batch = pa.RecordBatch.from_arrays([texts.cast(pa.large_string()).combine_chunks()], ["text"])
    (_, buf, off), *_ = slices(batch, "text", 1 << 62)  # one slice: numbers hold within it
    own = Shingles(buf, off, words)
    return own.number, np.searchsorted(own.row, np.arange(len(texts) + 1))


def _star_links(words: int, percent: int):
    """Of hubs and pieces of their members, with texts: the edges whose full sets are similar enough."""

    def run(table: pa.Table) -> pa.Table:
        number, start = _sets_of(table.column("text"), words)
        size = np.diff(start)
        hub, rep, piece = (table.column(c).to_numpy() for c in ("hub", "rep", "piece"))
        order = np.lexsort((rep != hub, piece, hub))
        there = np.zeros(int(number.max(initial=-1)) + 1, dtype=bool)
        found = []
        for own in np.split(order, np.flatnonzero((np.diff(hub[order]) != 0) | (np.diff(piece[order]) != 0)) + 1):
            x, rest = own[0], own[1:]
            there[number[start[x] : start[x + 1]]] = True
            shared = np.array([there[number[start[y] : start[y + 1]]].sum() for y in rest.tolist()], dtype=np.int64)
            there[number[start[x] : start[x + 1]]] = False
            found.append(rest[(shared > 0) & (100 * shared >= percent * (size[x] + size[rest] - shared))])
        good = np.concatenate(found)
        return pa.table({"a": hub[good], "b": rep[good]})

    return run


def _verified(words: int, percent: int):
    """Of families with their texts: edges over all pairs of different parts whose full sets are similar enough."""

    def run(table: pa.Table) -> pa.Table:
        rep, part = table.column("rep").to_numpy(), table.column("part").to_numpy()
        number, start = _sets_of(table.column("text"), words)
        size = np.diff(start)
        left, right = [], []
        for own, a, b in _groups(table, "family"):
            # who holds each shingle of the group
            places = np.concatenate([np.arange(start[x], start[x + 1]) for x in own.tolist()])
            mine_of = np.unique(number[places], return_inverse=True)[1]
            holder = np.repeat(np.arange(len(own)), size[own])
            order = np.argsort(mine_of, kind="stable")
            holders, first = holder[order], np.concatenate([[0], np.cumsum(np.bincount(mine_of))])
            bounds = np.concatenate([[0], np.cumsum(size[own])])
            local = {x: k for k, x in enumerate(own.tolist())}
            in_b = np.isin(own, b)
            for x in a.tolist():
                k = local[x]
                mine = mine_of[bounds[k] : bounds[k + 1]]
                count = first[mine + 1] - first[mine]
                at = np.repeat(first[mine] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
                shared = np.bincount(holders[at], minlength=len(own))
                ok = in_b & (part[own] != part[x]) & (100 * shared >= percent * (size[x] + size[own] - shared)) & (shared > 0)
                other = own[ok]
                other = other[other > x] if a is b else other
                left.append(np.full(len(other), x))
                right.append(other)
        return _spanning(rep, left, right)

    return run


def _stars(edges: DataFrame, piece: int) -> DataFrame:
    """edges (a, b) -> hub, rep, piece: members b dealt to pieces of about `piece` rows, and the hub a in each piece."""
    sizes = written(edges.groupBy("a").agg(F.ceil(F.count("*") / piece).cast("int").alias("pieces")), "mh-stars")
    members = edges.join(sizes, "a").select(F.col("a").alias("hub"), F.col("b").alias("rep"), F.pmod(F.xxhash64("b", F.lit(7)), F.col("pieces")).cast("int").alias("piece"))
    # a piece that the hash leaves empty holds its hub alone, which links with nothing
    hubs = sizes.select(F.col("a").alias("hub"), F.col("a").alias("rep"), F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    return members.union(hubs)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs (doc_id long, text) -> doc_id, n_shingles, component_id, kept; one row for each row of docs."""
    rows = written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_sign(words), "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>, sig binary"), "mh-signed")
    key = ["f1", "f2", "n_shingles"]
    reps = rows.where("n_shingles > 0").groupBy(*key).agg(F.min("doc_id").alias("rep"), F.first(F.struct("bands", "sig")).alias("x"))
    reps = written(reps.select(*key, "rep", "x.*"), "mh-reps")
    banded = reps.where("rep is not null").select("rep", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("n"), F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select("bucket", "n")
    members = pieced(banded.join(shared.select("bucket"), "bucket"), "bucket", "rep", PIECE, 8192)
    maybe = members.join(reps.select("rep", "sig"), "rep").groupBy("task").applyInArrow(_maybe, "a long, b long")
    maybe = written(maybe.distinct(), "mh-maybe")
    families = written(components(maybe).toDF("rep", "family"), "mh-families")
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(families.select("rep"), "rep", "left_semi")
    texts = written(texts.groupBy("rep").agg(F.min("text").alias("text")), "mh-texts")
    stars = _stars(maybe, PIECE // 2).join(texts, "rep")
    tasks = max(1, -(-maybe.count() // 512))
    stars = stars.groupBy(F.pmod(F.xxhash64("hub", "piece"), F.lit(tasks)).alias("task"))
    linked = written(stars.applyInArrow(_star_links(words, percent), "a long, b long"), "mh-linked")
    parts = components(linked).withColumnRenamed("node", "rep")
    parts = written(families.join(parts, "rep", "left").select("rep", "family", F.coalesce("component", "rep").alias("part")), "mh-parts")
    open_ = parts.groupBy("family").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x < y").select("family")
    rest = written(parts.join(open_, "family").select("rep", "family", "part"), "mh-open")
    compared = pieced(rest.select("rep", "family"), "family", "rep", PIECE // 2, 512).join(rest.select("rep", "part"), "rep").join(texts, "rep")
    links = written(compared.groupBy("task").applyInArrow(_verified(words, percent), "a long, b long").union(linked), "mh-links")
    found = written(components(links).withColumnRenamed("node", "rep"), "mh-found")
    classes = reps.select(*key, "rep").join(found, "rep", "left").select(*key, F.coalesce("component", "rep").alias("component_id"))
    out = rows.select("doc_id", *key).join(classes, key, "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
