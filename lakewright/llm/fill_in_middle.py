"""Fill-in-the-middle rows from an index of distinct texts.

The index groups documents by their whole texts, which Spark compares byte by byte, and writes one row
for each distinct text: its SHA-256 name, its size in bytes, how many rows hold it, whether a sentinel
occurs in it, and an Elias-Fano list of the byte offsets at which its code points begin. Documents are
joined back to it by name and size; a document's two seeded cuts are two selects on the list, which
give byte offsets without decoding the text.

A name is hot if more than 256 rows, and more than one in 2^14 of all, share it. There are at most 2^14 such names, whatever the
input, so they are broadcast; their documents are dealt over parts and their index row is repeated for each.

Null texts are empty and stay plain. A null doc_id is hashed as an empty one. Repeated rows each give a row,
cut alike. Long texts are whole within one task. Other columns are ignored, whatever their names. An
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Sentinels before prefix, suffix and middle (fixed values).
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SENTINELS = (PREFIX, SUFFIX, MIDDLE)
SEED = 1
PLAIN_FROM, SPM_BELOW = 90, 20
#: Every so many entries of a list have their position stored.
SAMPLED = 256
HOT_NAMES, HOT_ROWS = 1 << 14, 256


class Boundaries:
    """An Elias-Fano list of rising numbers below 4 times their count (starts of UTF-8 code points, then the size)."""

    def __init__(self, count: int, shift: int, high: bytes, low: bytes, samples: bytes):
        self.count, self.shift = count, shift
        self.high, self.low, self.samples = np.frombuffer(high, np.uint8), np.frombuffer(low, np.uint8), np.frombuffer(samples, "<u4")

    @staticmethod
    def encode(text: bytes) -> tuple[int, int, bytes, bytes, bytes]:
        data = np.frombuffer(text, np.uint8)
        at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        shift = max(0, int(len(data) // len(at)).bit_length() - 1)
        ones = (at >> shift) + np.arange(len(at))
        bits = np.zeros(int(ones[-1]) + 1, np.uint8)
        bits[ones] = 1
        low = ((at[:, None] >> np.arange(shift)) & 1).astype(np.uint8)
        return len(at), shift, np.packbits(bits).tobytes(), np.packbits(low).tobytes(), ones[::SAMPLED].astype("<u4").tobytes()

    def __getitem__(self, k: int) -> int:
        """The k-th number: a select of the k-th one among the high bits, and its low bits."""
        start = int(self.samples[k // SAMPLED])
        span = np.unpackbits(self.high[start // 8 : start // 8 + SAMPLED])  # 256 ones are within 5 * 256 bits
        one = start // 8 * 8 + int(np.flatnonzero(span[start % 8 :])[k % SAMPLED]) + start % 8
        value = (one - k) << self.shift
        if self.shift:
            first = k * self.shift
            bits = np.unpackbits(self.low[first // 8 : (first + self.shift + 7) // 8])[first % 8 :]
            value |= sum(int(b) << j for j, b in enumerate(bits[: self.shift]))
        return value


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            part, rows = batch.slice(a, 256), []
            for text, copies in zip(part.column(0).cast(pa.large_binary()).to_pylist(), part.column(1).to_pylist(), strict=True):
                rows.append((hashlib.sha256(text).digest(), len(text), copies, any(s in text for s in SENTINELS), *Boundaries.encode(text)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=t) for k, t in enumerate(kinds)], [f"c{k}" for k in range(len(kinds))])


def build_index(docs: DataFrame) -> DataFrame:
    """docs (text) -> a written table with one row for each distinct text."""
    texts = docs.groupBy(F.coalesce("text", F.lit("")).alias("text")).agg(F.count("*").alias("copies"))
    made = texts.mapInArrow(_index, "c0 binary, c1 long, c2 long, c3 boolean, c4 long, c5 int, c6 binary, c7 binary, c8 binary")
    return written(made.toDF("name", "size", "copies", "marked", "count", "shift", "high", "low", "samples"), "fim-index")


def cuts(doc_id: int | None, n: int, seed: int = SEED) -> tuple[str, int, int]:
    """Form of a document with n code points and no sentinel, and the code points before its two cuts."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    return ("plain" if h[2] % 100 >= PLAIN_FROM else "spm" if h[3] % 100 < SPM_BELOW else "psm"), a, b


def restored(output: bytes, form: str) -> bytes:
    """The text that an output was made of."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    head, middle = output.removeprefix(first).split(MIDDLE)
    one, two = head.split(second)
    prefix, suffix = (one, two) if form == "psm" else (two, one)
    return prefix + middle + suffix


def _transform(keep_output: bool, seed: int):
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.large_binary()] * keep_output

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                rows = []
                for doc_id, text, marked, count, *entry in zip(*[c.to_pylist() for c in batch.slice(a, 256).columns], strict=True):
                    text, n = text.encode(), count - 1
                    form, start, stop = cuts(doc_id, n, seed)
                    if marked or not n or form == "plain":
                        form, output, sizes = "plain", text, (None, None)
                    else:
                        at, sizes = Boundaries(count, *entry), (start, stop - start)
                        x, y = at[start], at[stop]
                        prefix, middle, suffix = text[:x], text[x:y], text[y:]
                        pieces = (PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle) if form == "psm" else (SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)
                        output = b"".join(pieces)
                    back = restored(output, form)
                    rows.append((doc_id, n, form, *sizes, hashlib.sha256(output).hexdigest(), hashlib.sha256(back).hexdigest(), output))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=t) for k, t in enumerate(kinds)], [f"c{k}" for k in range(len(kinds))])

    return run


def transform(docs: DataFrame, index: DataFrame | None = None, seed: int = SEED, keep_output: bool = True) -> DataFrame:
    """docs (doc_id long, text) -> doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 and, if kept, output (UTF-8).

    index: what build_index gave for docs, or for a table that holds all their texts.
    """
    index = index if index is not None else build_index(docs)
    rows = index.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    hot = max(HOT_ROWS, rows // HOT_NAMES)
    parts = F.broadcast(index.where(F.col("copies") > hot).select("name", F.ceil(F.col("copies") / hot).cast("int").alias("parts")))
    text = F.coalesce("text", F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("name"), F.octet_length(text).cast("long").alias("size"))
    own = own.join(parts, "name", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.col("parts")), F.lit(0)).cast("int")).drop("parts")
    each = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("copies") / hot), F.lit(1)).cast("int") - 1))
    met = own.join(index.select("*", each.alias("part")), ["name", "size", "part"])
    found = met.select("doc_id", "text", "marked", "count", "shift", "high", "low", "samples").mapInArrow(
        _transform(keep_output, seed), "c0 long, c1 long, c2 string, c3 long, c4 long, c5 string, c6 string" + ", c7 binary" * keep_output
    )
    return found.toDF("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", *["output"] * keep_output)
