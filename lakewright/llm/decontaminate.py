"""Benchmark decontamination with an FM-index for each training shard.

Words are runs of letters and digits (all that is not ASCII counts), A-Z lower-cased. A window is
`window` consecutive words of an item; a shorter item is one window.

Index. Each shard (documents of about SHARD_WORDS words, or one longer document) has its words numbered
by their spelling, is suffix-sorted, and gets the wavelet matrix of its Burrows-Wheeler transform and
every SAMPLE-th suffix position. Nothing is left out of it, and it does not depend on the benchmark:
`build_index` gives a table that serves any benchmark.

Search. Distinct windows of up to BLOCK_BYTES together are broadcast to all shards. More of them are routed: a window
goes to the shards that hold its rarest word, in blocks of about BLOCK_BYTES, all in one plan; only windows whose
every word some shard holds are sent. In a shard they are found by backward search over wavelet ranks, located
by walking to a sampled suffix position, and merged to spans of words in each document.

Null or empty texts have no words, items without words no windows; an empty benchmark hits nothing, an
empty table gives none. Rows are told apart by their place in a shard, so each repeated row or doc_id
has its own result; repeated items count once. A long text is one shard, whole within one task. Other
columns of both tables are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written
from .textscan import ALNUM, numbered, row_words, slices, word_spans

WINDOW = 13
SHARD_WORDS, BLOCK_BYTES = 1 << 19, 4 << 20
SAMPLE = 8
_WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_SPANS = "array<struct<start: long, stop: long>>"


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix array of symbols, the last of which occurs nowhere else: some symbols at once, then by doubling what is still equal."""
    n = len(symbols)
    bits = max(1, int(symbols.max()).bit_length())
    k = max(1, min(8, 62 // bits))
    key = np.zeros(n, dtype=np.int64)
    for d in range(k):
        key <<= bits
        key[: max(0, n - d)] |= symbols[d:]
    order = np.argsort(key)
    rank = np.zeros(n, dtype=np.int64)
    base = np.zeros(n, dtype=np.int64)
    open_, key = order, key[order]
    while len(open_):
        at = np.arange(len(open_))
        head = np.concatenate([[True], key[1:] != key[:-1]])
        old = np.concatenate([[True], base[1:] != base[:-1]])
        new = base + np.maximum.accumulate(np.where(head, at, 0)) - np.maximum.accumulate(np.where(old, at, 0))
        rank[open_] = new
        rest = ~(head & np.append(head[1:], True))
        open_ = open_[rest]
        key = rank[open_] * (n + 1) + rank[np.minimum(open_ + k, n - 1)]
        order = np.argsort(key)
        open_, key = open_[order], key[order]
        base = rank[open_]
        k *= 2
    out = np.empty(n, dtype=np.int64)
    out[rank] = np.arange(n)
    return out


class WaveletMatrix:
    """Ranks of symbols in a sequence; one cumulative bit count for each bit of a symbol."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ones = []
        for bit in levels:
            count = np.zeros(len(bit) + 1, dtype=np.int32)
            np.cumsum(bit, out=count[1:])
            self.ones.append(count)
        self.zeros = [len(c) - 1 - int(c[-1]) for c in self.ones]

    @classmethod
    def of(cls, seq: np.ndarray, bits: int) -> WaveletMatrix:
        levels = []
        for b in range(bits - 1, -1, -1):
            bit = ((seq >> b) & 1).astype(bool)
            levels.append(bit)
            seq = np.concatenate([seq[~bit], seq[bit]])
        return cls(levels)

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each end."""
        start = np.zeros_like(end)
        top = len(self.ones) - 1
        for k, (count, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            one = ((symbol >> (top - k)) & 1).astype(bool)
            r, s = count[end], count[start]
            end = np.where(one, zeros + r, end - r)
            start = np.where(one, zeros + s, start - s)
        return end - start

    def symbols(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), dtype=np.int64)
        for bit, count, zeros in zip(self.levels, self.ones, self.zeros, strict=True):
            one = bit[at]
            out = out * 2 + one
            at = np.where(one, zeros + count[at], at - count[at])
        return out


class FMIndex:
    """Of a text of symbols 1.. in which 0 ends each document; no pattern holds a 0."""

    def __init__(self, tree: WaveletMatrix, below: np.ndarray, kept: np.ndarray, samples: np.ndarray):
        self.tree, self.below, self.kept, self.samples = tree, below, kept, samples
        self.n, self.kept_before = len(kept), np.cumsum(kept) - kept

    @classmethod
    def of(cls, text: np.ndarray, symbols: int) -> FMIndex:
        n = len(text)
        cut = text == 0
        sa = suffix_order(np.where(cut, np.cumsum(cut) - 1, text + int(cut.sum())))  # ends of documents all differ
        place = np.arange(n) - np.maximum.accumulate(np.where(cut, np.arange(n), -1)) - 1
        kept = ((place % SAMPLE == 0) | cut)[sa]
        bwt = np.where(sa > 0, text[sa - 1], 0)
        below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols + 1))])
        return cls(WaveletMatrix.of(bwt, max(1, int(symbols).bit_length())), below, kept, sa[kept])

    def packed(self) -> list[bytes]:
        bits = np.packbits(np.stack([*self.tree.levels, self.kept]), axis=1)
        return [bits.tobytes(), np.diff(self.below).astype(np.int32).tobytes(), self.samples.astype(np.int32).tobytes()]

    @classmethod
    def unpacked(cls, bits: bytes, counts: bytes, samples: bytes) -> FMIndex:
        below = np.concatenate([[0], np.cumsum(np.frombuffer(counts, dtype=np.int32), dtype=np.int64)])
        n = int(below[-1])
        rows = np.unpackbits(np.frombuffer(bits, dtype=np.uint8).reshape(-1, -(-n // 8)), axis=1, count=n).astype(bool)
        return cls(WaveletMatrix(list(rows[:-1])), below, rows[-1], np.frombuffer(samples, dtype=np.int32).astype(np.int64))

    def ranges(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of patterns, one in a row, aligned left."""
        low, high = np.zeros(len(patterns), dtype=np.int64), np.full(len(patterns), self.n, dtype=np.int64)
        for t in range(patterns.shape[1]):
            on = np.flatnonzero((lengths > t) & (low < high))
            if not len(on):
                break
            c = patterns[on, lengths[on] - 1 - t]
            low[on] = self.below[c] + self.tree.rank(c, low[on])
            high[on] = self.below[c] + self.tree.rank(c, high[on])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows."""
        out, steps = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
        open_ = np.arange(len(rows))
        rows = rows.copy()
        while len(open_):
            known = self.kept[rows[open_]]
            done = open_[known]
            out[done] = self.samples[self.kept_before[rows[done]]] + steps[done]
            open_ = open_[~known]
            c = self.tree.symbols(rows[open_])
            rows[open_] = self.below[c] + self.tree.rank(c, rows[open_])
            steps[open_] += 1
        return out


def _index(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents -> shards: doc_ids, words of each, vocabulary, index."""
        part, made = TaskContext.get().partitionId(), 0
        ids, counts, bufs, words, held = [], [], [], [], 0

        def shard() -> pa.RecordBatch:
            nonlocal ids, counts, bufs, words, held, made
            data, sizes = np.concatenate(bufs), np.concatenate(words)
            ends = np.cumsum(sizes)
            number, vocabulary = numbered(data, ends - sizes, ends, np.ones(256, dtype=bool))
            count = np.concatenate(counts)
            text = np.insert(number + 1, np.cumsum(count), 0)
            bits, freq, samples = FMIndex.of(text, len(vocabulary)).packed()
            doc_ids = pa.concat_arrays(ids)
            one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], type=pa.int32()), a)
            out = pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + made]), one(doc_ids), one(pa.array(count.astype(np.int64))), one(vocabulary.cast(pa.binary())), *[pa.array([b], type=pa.binary()) for b in (bits, freq, samples)]],
                ["shard", "doc_ids", "counts", "vocabulary", "bits", "freq", "samples"],
            )
            ids, counts, bufs, words, held = [], [], [], [], 0
            made += 1
            return out

        for batch in batches:
            for rows, buf, off in slices(batch, "text", min(1 << 19, 8 * most)):
                s, e, row = word_spans(buf, off, ALNUM)
                n = np.diff(row_words(row, rows.num_rows))
                if held and held + len(s) + len(n) > most:
                    yield shard()
                low = buf[ALNUM[buf]].copy()
                low[(low >= 0x41) & (low <= 0x5A)] += 32
                ids.append(rows.column(0))
                counts.append(n)
                bufs.append(low)
                words.append(e - s)
                held += len(s) + len(n)
        if held:
            yield shard()

    return run


def build_index(docs: DataFrame, most: int = SHARD_WORDS) -> DataFrame:
    """docs (doc_id, text) -> a row for each shard; write it before it is searched, as shards are numbered by task."""
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(_index(most), f"shard long, doc_ids array<{kind}>, counts array<long>, vocabulary array<binary>, bits binary, freq binary, samples binary")


def windows_of(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(words, items): the distinct windows of the items and, sorted, which items have them."""
    low = F.translate(F.coalesce(F.col("text"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.regexp_extract_all(low, F.lit(_WORD), F.lit(0)).alias("w")).where("item is not null and size(w) > 0")
    begin = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (window - 1)))
    cut = items.select("item", F.explode(F.transform(begin, lambda i: F.slice("w", i, window))).alias("words"))
    return cut.groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards, each with a block of windows -> the documents with hits: shard, row, items, spans."""
    for batch in batches:
        col = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
        for k in range(batch.num_rows):
            words, items = col["words"][k].values, col["items"][k].values
            size = words.value_lengths().to_numpy().astype(np.int64)
            number = pc.index_in(words.flatten().cast(pa.binary()), value_set=col["vocabulary"][k].values).fill_null(-1).to_numpy().astype(np.int64) + 1
            first = np.cumsum(size) - size
            known = np.flatnonzero(np.minimum.reduceat(number, first) > 0) if len(size) else first
            if not len(known):
                continue
            length = size[known]
            patterns = np.zeros((len(known), int(length.max())), dtype=np.int64)
            for t in range(patterns.shape[1]):
                on = np.flatnonzero(length > t)
                patterns[on, t] = number[first[known[on]] + t]
            index = FMIndex.unpacked(*[col[c][k].as_py() for c in ("bits", "freq", "samples")])
            low, high = index.ranges(patterns, length)
            times = np.maximum(high - low, 0)
            which = np.repeat(np.arange(len(times)), times)
            suffix = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times) + low[which]
            start = index.locate(suffix)
            order = np.argsort(start, kind="stable")
            start, which = start[order], which[order]
            if not len(start):
                continue
            begin = np.concatenate([[0], np.cumsum(col["counts"][k].values.to_numpy() + 1)])  # each document and its end
            row = np.searchsorted(begin, start, side="right") - 1
            stop = np.maximum.accumulate(start + length[which])
            head = np.concatenate([[True], (start[1:] >= stop[:-1]) | (row[1:] != row[:-1])])
            at = np.flatnonzero(head)
            ends = stop[np.append(at[1:], len(start)) - 1]
            spans: dict[int, list[dict]] = {}
            for r, a, b in zip(row[at].tolist(), (start[at] - begin[row[at]]).tolist(), (ends - begin[row[at]]).tolist(), strict=True):
                spans.setdefault(r, []).append({"start": a, "stop": b})
            width = len(known)
            both = np.unique(row * width + which)
            named: dict[int, set[str]] = {}
            for r, w in zip((both // width).tolist(), known[both % width].tolist(), strict=True):
                named.setdefault(r, set()).update(items[w].as_py())
            rows = sorted(spans)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([col["shard"][k].as_py()] * len(rows), type=pa.int64()), pa.array(rows, type=pa.int64()), pa.array([sorted(named[r]) for r in rows], type=pa.list_(pa.string())), pa.array([spans[r] for r in rows], type=kind)],
                ["shard", "row", "items", "spans"],
            )


def _routed(index: DataFrame, windows: DataFrame, block_bytes: int) -> DataFrame:
    """Shards, each with a block of the windows whose rarest word it holds; a window with a word that no shard holds goes nowhere."""
    words = windows.select("w", F.explode(F.array_distinct(F.transform("words", lambda x: x.cast("binary")))).alias("word"))
    held = index.select("shard", F.explode("vocabulary").alias("word")).join(words.select("word").distinct(), "word", "left_semi")
    held = written(held, "dc-held")
    counts = held.groupBy("word").agg(F.count("*").alias("n"))
    need = words.groupBy("w").agg(F.count("*").alias("need"))
    rarest = words.join(counts, "word").groupBy("w").agg(F.count("*").alias("found"), F.min(F.struct("n", "word")).alias("x"))
    rarest = rarest.join(need, "w").where("found = need").select("w", "x.word")
    length = F.octet_length(F.array_join("words", " ")) + F.octet_length(F.array_join("items", " "))
    met = written(rarest.join(held, "word").select("shard", "w").join(windows.withColumn("bytes", length), "w"), "dc-routed")
    parts = met.groupBy("shard").agg(F.ceil(F.sum("bytes") / block_bytes).cast("int").alias("parts"))
    dealt = met.join(parts, "shard").groupBy("shard", F.pmod(F.xxhash64("w"), F.col("parts")).alias("part")).agg(F.collect_list(F.struct("words", "items")).alias("x"))
    return index.drop("doc_ids").join(dealt.select("shard", "x.words", "x.items"), "shard")


def search(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, items (sorted), spans (of words, disjoint and sorted within a block); one row for each document of the index."""
    windows = written(windows_of(benchmark, window).withColumn("w", F.monotonically_increasing_id()), "dc-windows")
    size = windows.agg(F.sum(F.octet_length(F.array_join("words", " ")) + F.octet_length(F.array_join("items", " ")))).first()[0] or 0
    rows = index.select("shard", F.posexplode(F.arrays_zip(F.col("doc_ids").alias("doc_id"), F.col("counts").alias("n_words"))).alias("row", "x"))
    rows = rows.select("shard", F.col("row").cast("long"), "x.doc_id", "x.n_words")
    none = F.array().cast("array<string>"), F.array().cast(_SPANS)
    if not size:
        return rows.select("doc_id", "n_words", none[0].alias("items"), none[1].alias("spans"))
    if size <= block_bytes:
        whole = windows.agg(F.collect_list(F.struct("words", "items")).alias("x")).select(F.lit(0).alias("block"), "x.words", "x.items")
        met = index.drop("doc_ids").withColumn("block", F.explode(F.array(F.lit(0)))).join(F.broadcast(written(whole, "dc-blocks")), "block").drop("block")
    else:
        met = _routed(index, windows, block_bytes)
    columns = ("shard", "counts", "vocabulary", "bits", "freq", "samples", "words", "items")
    hits = written(met.select(*columns).mapInArrow(_found, f"shard long, row long, items array<string>, spans {_SPANS}"), "dc-hits")
    all_ = hits.groupBy("shard", "row").agg(*[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("items", "spans")])
    out = rows.join(all_, ["shard", "row"], "left")
    return out.select("doc_id", "n_words", F.coalesce("items", none[0]).alias("items"), F.coalesce("spans", none[1]).alias("spans"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs (doc_id, text), benchmark (item_id, text) -> doc_id, n_words, items, spans; one row for each row of docs."""
    index = written(build_index(docs), "dc-index")
    found = written(search(index, benchmark, window), "dc-found")
    drop_written(index)
    return found


def digest(found: DataFrame) -> DataFrame:
    """Words hit, items and the contamination rule: at least a twentieth of the words is hit."""
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))

    def step(acc, x):
        more = F.greatest(F.lit(0).cast("long"), x["stop"] - F.greatest(x["start"], acc["end"]))
        return F.struct(F.greatest(acc["end"], x["stop"]).alias("end"), (acc["n"] + more).alias("n"))

    out = found.select("doc_id", "n_words", F.aggregate("spans", start, step)["n"].alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
