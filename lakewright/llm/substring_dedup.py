"""Removal of long repeats by recompression.

Words get 64-bit names, then rounds replace runs and pairs of symbols by new names: first runs of one
word, then in each round every pair of a left and a right symbol, the side being a bit of the name
and the round. A name is a keyed hash of its parts, so it is the same in every document and on every
executor, without a shuffled dictionary in each round. A symbol also carries the stretch of words
that its making depended on. Wherever that stretch recurs, so does the symbol.

Names only propose; what is removed is compared by 128-bit hashes of the words' spelling (BLAKE2b).

Each window of `window` words is represented by an anchor: the first symbol of the highest round
whose stretch lies within the window. Equal windows have equal anchors. Neighbouring windows with one
anchor form a block (name, hash of its spelling, document, first and last window):
  1. Names found in one document only are dropped: their windows have no equal elsewhere.
  2. A block whose words recur as a block of a smaller document is removed as a whole.
  3. Blocks with a shared name but other words (at the ends of repeats) are compared window by
     window, on the hashes of the windows, one block for each distinct text.
  4. Each document loses the words of its removed windows.

Windows never cross documents and are judged on the input. Copies in the same doc_id, or in rows
with a null doc_id, remove nothing. Null texts have no words; a long text is whole within one task. An
empty table gives none; other columns are ignored, whatever their names. A name or window that many documents share
is summed up before the shuffle and then joined to its short rows, a join whose hot keys Spark splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written
from .textscan import NOT_SPACE, Spelled, U, mix, row_words, seeded, slices, word_names, word_spans

WINDOW = 50
ROUNDS = 10
_K = seeded(31, 8) | U(1)
_SIDE = seeded(32, 64)


def rounds_of(names: np.ndarray, row: np.ndarray, window: int) -> list[tuple[np.ndarray, ...]]:
    """For each round: where each symbol's stretch begins and ends, and its name.

    Places are word numbers plus `gap` for each row, so stretches beyond a row's ends (which no window
    holds) keep their order.
    """
    gap = 2 * window + 28
    out = window + 14
    place = np.arange(len(names)) + gap * row
    first, last, left, right = place, place + 1, place, place + 1
    levels = [(left, right, names)]
    # runs of one word; a lone word is known as such once both its neighbours are
    same = (names[1:] == names[:-1]) & (row[1:] == row[:-1])
    head = np.flatnonzero(np.concatenate([[True], ~same]))
    tail = np.append(head[1:], len(names)) - 1
    size = tail - head + 1
    before = np.maximum(head - 1, 0)
    after = np.minimum(tail + 1, len(names) - 1)
    has_before = (head > 0) & (row[before] == row[head])
    has_after = (tail < len(names) - 1) & (row[after] == row[tail])
    left = np.where(has_before, left[before], first[head] - out)
    right = np.where(has_after, right[after], last[tail] + out)
    names = np.where(size > 1, mix(names[head] * _K[0] + size.astype(U) * _K[1]), names[head])
    first, last, row = first[head], last[tail], row[head]
    levels.append((left, right, names))
    for k in range(ROUNDS):
        n = len(names)
        if n < 2:
            break
        side = (mix(names ^ _SIDE[k]) & U(1)).astype(bool)  # true: right
        near = row[1:] == row[:-1]
        joins = ~side[:-1] & side[1:] & near
        opens = np.append(joins, False)
        closes = np.concatenate([[False], joins])
        # a lone left symbol depends on what follows, a lone right one on what precedes
        nxt = np.append(np.where(near, right[1:], last[:-1] + out), last[-1] + out)
        prv = np.concatenate([[first[0] - out], np.where(near, left[:-1], first[1:] - out)])
        new_left = np.where(side & ~closes, prv, left)
        new_right = np.where(~side & ~opens, nxt, right)
        at = np.flatnonzero(opens)
        new_right[at] = right[at + 1]
        last = last.copy()
        last[at] = last[at + 1]
        names = names.copy()
        names[at] = mix(names[at] * _K[2] + names[at + 1] * _K[3] + U(k))
        keep = ~closes
        first, last, left, right, names, row = (x[keep] for x in (first, last, new_left, new_right, names, row))
        levels.append((left, right, names))
    return levels


def blocks(names: np.ndarray, row: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word of the first window, of the last one, name) of each block of windows with one anchor."""
    n = len(names)
    z = np.zeros(0, dtype=np.int64)
    if n < window:
        return z, z, z.astype(U)
    start = np.flatnonzero(row[: n - window + 1] == row[window - 1 :])
    if not len(start):
        return z, z, z.astype(U)
    place = start + (2 * window + 28) * row[start]
    name = np.zeros(len(start), dtype=U)
    which = np.zeros(len(start), dtype=np.int64)
    open_ = np.arange(len(start))
    for level, (left, right, symbols) in reversed(list(enumerate(rounds_of(names, row, window)))):
        p = place[open_]
        k = np.searchsorted(left, p)
        fits = k < len(left)
        fits[fits] = right[k[fits]] <= p[fits] + window
        done = open_[fits]
        name[done] = symbols[k[fits]]
        which[done] = k[fits] * 64 + level
        open_ = open_[~fits]
        if not len(open_):
            break
    head = np.ones(len(start), dtype=bool)
    head[1:] = (which[1:] != which[:-1]) | (start[1:] != start[:-1] + 1) | (row[start[1:]] != row[start[:-1]])
    heads = np.flatnonzero(head)
    tails = np.append(heads[1:], len(start)) - 1
    return start[heads], start[tails], name[heads]


def _block_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, off in slices(batch, "text"):
                s, e, row = word_spans(buf, off, NOT_SPACE)
                lo, hi, name = blocks(word_names(buf, s, e, NOT_SPACE), row, window)
                k1, k2 = Spelled(buf, s, e, NOT_SPACE).digests(lo, hi + window)
                own = row[lo]
                first = row_words(row, part.num_rows)[own]
                ids = part.column(0).take(pa.array(own))
                yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(k1), pa.array(k2), ids, pa.array((lo - first).astype(np.int32)), pa.array((hi - first).astype(np.int32))], ["name", "k1", "k2", "doc_id", "lo", "hi"])

    return run


def _listed(part: pa.RecordBatch, column: str):
    """A list<struct> column of a batch, flat: its fields, and the row of each entry."""
    lists = part.column(part.schema.get_field_index(column))
    flat = lists.flatten()
    lens = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return flat, np.repeat(np.arange(part.num_rows), lens)


def _own(flat: pa.Array, own: np.ndarray, first: np.ndarray, spelled: Spelled, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words and last windows of listed blocks, and which blocks are of this text (a doc_id may have several)."""
    lo, hi = (flat.field(x).to_numpy().astype(np.int64) + first[own] for x in ("lo", "hi"))
    good = np.flatnonzero(hi + window <= first[own + 1])
    k1, k2 = spelled.digests(lo[good], hi[good] + window)
    return lo, hi, good[(k1 == flat.field("k1").to_numpy()[good]) & (k2 == flat.field("k2").to_numpy()[good])]


def _window_rows(window: int):
    """Of documents with their listed blocks: a row for each window of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, off in slices(batch, "text"):
                s, e, row = word_spans(buf, off, NOT_SPACE)
                first = row_words(row, part.num_rows + 1)
                spelled = Spelled(buf, s, e, NOT_SPACE)
                flat, own = _listed(part, "blocks")
                lo, hi, good = _own(flat, own, first, spelled, window)
                size = hi[good] - lo[good] + 1
                at = np.repeat(np.arange(len(good)), size)
                offset = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
                start = lo[good][at] + offset
                w1, w2 = spelled.digests(start, start + window)
                source = pa.array(good[at])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(w1), pa.array(w2), part.column(0).take(pa.array(own[good][at])), flat.field("name").take(source), flat.field("k1").take(source), flat.field("k2").take(source), pa.array(offset.astype(np.int32))],
                    ["w1", "w2", "doc_id", "name", "k1", "k2", "offset"],
                )

    return run


def _cut(window: int):
    """Documents with their removed blocks -> words, words removed, text of the words kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, off in slices(batch, "text"):
                rows = part.num_rows
                s, e, row = word_spans(buf, off, NOT_SPACE)
                first = row_words(row, rows + 1)
                flat, own = _listed(part, "gone")
                change = np.zeros(len(s) + 1, dtype=np.int64)
                if len(flat):
                    lo, hi, good = _own(flat, own, first, Spelled(buf, s, e, NOT_SPACE), window)
                    some = flat.field("offsets")
                    whole = good[some.is_null().to_numpy(zero_copy_only=False)[good]]
                    np.add.at(change, lo[whole], 1)
                    np.add.at(change, hi[whole] + window, -1)
                    offsets = some.flatten().to_numpy().astype(np.int64)
                    at = np.repeat(np.arange(len(flat)), some.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                    ok = np.isin(at, good)
                    a = lo[at][ok] + offsets[ok]
                    np.add.at(change, a, 1)
                    np.add.at(change, a + window, -1)
                kept = np.cumsum(change[:-1]) == 0
                ks, krow = s[kept], row[kept]
                size = e[kept] - ks + 1
                ends = np.cumsum(size)
                total = int(ends[-1]) if len(ends) else 0
                place = np.arange(total) - np.repeat(ends - size - ks, size)
                text = buf[np.minimum(place, len(buf) - 1)] if total else np.zeros(0, dtype=np.uint8)
                if total:
                    text[ends - 1] = 0x20
                bound = np.concatenate([[0], ends])[np.searchsorted(krow, np.arange(rows + 1))]
                raw = text.tobytes()
                out = [raw[a : max(a, b - 1)].decode() for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True)]
                words = np.diff(first[: rows + 1])
                left = np.bincount(krow, minlength=rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words.astype(np.int64)), pa.array((words - left).astype(np.int64)), pa.array(out, type=pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs (doc_id long, text) -> doc_id, n_words, n_removed, kept_text; one row for each row of docs."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    found = docs.where("doc_id is not null").mapInArrow(_block_rows(window), "name long, k1 long, k2 long, doc_id long, lo int, hi int")
    found = written(found, "sd-blocks")
    ends = lambda c, a, b: (F.min(c).alias(a), F.max(c).alias(b))
    names = found.groupBy("name").agg(*ends("doc_id", "d0", "d1"), *ends("k1", "a0", "a1"), *ends("k2", "b0", "b1")).where("d0 < d1")
    names = written(names.select("name", F.expr("a0 < a1 or b0 < b1").alias("mixed")), "sd-names")
    shared = written(found.join(names, "name"), "sd-shared")
    drop_written(found, names)
    block = ["name", "k1", "k2"]
    groups = shared.groupBy(*block).agg(F.min(F.struct("doc_id", "lo", "hi")).alias("x"), F.max("mixed").alias("mixed"))
    groups = written(groups.select(*block, "x.*", "mixed"), "sd-groups")
    doubtful = groups.where("mixed").groupBy("doc_id").agg(F.collect_list(F.struct(*block, "lo", "hi")).alias("blocks"))
    windows = docs.join(doubtful, "doc_id").mapInArrow(_window_rows(window), "w1 long, w2 long, doc_id long, name long, k1 long, k2 long, offset int")
    windows = written(windows, "sd-windows")
    # of a group's windows, those that a smaller document than its own first one holds
    first = windows.groupBy("w1", "w2").agg(*ends("doc_id", "m", "d1")).where("m < d1").select("w1", "w2", "m")
    first = written(first, "sd-first")
    earlier = windows.join(first, ["w1", "w2"]).where("m < doc_id")
    matched = written(earlier.groupBy(*block).agg(F.collect_set("offset").alias("offsets")), "sd-matched")
    drop_written(windows, first)
    known = groups.select(*block, F.col("doc_id").alias("m0")).join(matched, block, "left")
    known = written(known, "sd-known")  # Spark splits hot keys of a join of two tables, not of three
    gone = shared.join(known, block)
    gone = gone.select("doc_id", "lo", "hi", "k1", "k2", "m0", F.when(F.col("m0") >= F.col("doc_id"), F.col("offsets")).alias("offsets")).where("m0 < doc_id or size(offsets) > 0")
    gone = gone.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi", "k1", "k2", "offsets")).alias("gone"))
    gone = written(gone, "sd-gone")
    drop_written(shared, groups, matched, known)
    return docs.join(gone, "doc_id", "left").mapInArrow(_cut(window), "doc_id long, n_words long, n_removed long, kept_text string")


def digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
