"""Token-ID output in training order: fixed-length sequences at globally permuted slots.

Texts are tokenised (a null text is empty), an end token follows each document, and each input
partition's stream is cut into sequences of `length` ids; its last one is filled up with end tokens.
A keyed Feistel network with cycle-walking permutes 0 .. n - 1: it runs over the least square of a
power of two that holds n, and repeats where it leaves the range. Sequence i goes to slot p(i), a
shard holds `stride` slots, and range partitions hold whole shards in slot order. Files hold whole
shards too, FILE_SHARDS of them (some 256 MB) where a partition has so many, so the number of files
grows with the bytes and not with the shards, and a reader that resumes at a slot skips what lies before it by
the slots that Parquet notes of each file (`write_shards`, `read_from`). The raw form (`write_fixed`) has one record for each slot,
all of one length, so the bytes of a slot are found by a multiplication (`fixed_files`); Spark's own text sink writes it
to any store.

Repeated rows are tokenised as often as they occur, rows without doc_id too; a long text is whole within one
task; other columns are ignored, whatever their names; an empty table gives no sequence. The tokenised sequences are a written table, so a lost executor repeats no tokenising.
"""

from __future__ import annotations

import functools
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir, written
from .textscan import U, mix

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split pattern that goes with that vocabulary (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END = 50256
LENGTH, STRIDE, KEY = 1024, 2048, 20240601
#: Shards in a file at most.
FILE_SHARDS = 64
#: Bytes of a Parquet row group.
GROUP_BYTES = 16 << 20
#: Ends a record of the raw form.
RECORD_END = "\n\n"


@functools.cache
def encoder(path: str = TOKENIZER, width: int = 2) -> Callable[[str], bytes]:
    """Text -> ids as little-endian bytes. A Python worker keeps its encoder for all its tasks."""
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    bpe = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    kind = f"<u{width}"

    def encode(text: str) -> bytes:
        return np.array(bpe.encode_ordinary(text), dtype=kind).tobytes()

    return encode


def _pack(path: str, length: int, end: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, width)
        stop = np.array([end], dtype=f"<u{width}").tobytes()
        size = length * width
        part, made = TaskContext.get().partitionId(), 0
        stream, docs = bytearray(), []  # docs: (first byte after the document, its id)

        def cut(last: bool) -> pa.RecordBatch | None:
            nonlocal stream, docs, made
            n = len(stream) // size
            if last and len(stream) % size:
                real = len(stream)
                stream += stop * ((size - len(stream) % size) // width)
                n += 1
            else:
                real = n * size
            if not n:
                return None
            ends = np.array([x for x, _ in docs], dtype=np.int64)
            starts = np.concatenate([[0], ends])[:-1]
            at = np.arange(n) * size
            a, b = np.searchsorted(ends, at, side="right"), np.searchsorted(starts, at + size, side="left")
            ids = [[docs[k][1] for k in range(x, y)] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
            tokens = [bytes(stream[x : x + size]) for x in at.tolist()]
            used = np.minimum(real - at, size) // width
            out = pa.RecordBatch.from_arrays([pa.array(np.full(n, part, dtype=np.int32)), pa.array(np.arange(made, made + n)), pa.array(used.astype(np.int32)), pa.array(ids, type=pa.list_(pa.int64())), pa.array(tokens, type=pa.binary())], ["part", "at", "n_tokens", "doc_ids", "tokens"])
            made += n
            stream = stream[n * size :]
            docs = [(x - n * size, d) for x, d in docs if x > n * size]
            return out

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for k in range(0, batch.num_rows, 256):
                for d, t in zip(ids[k : k + 256], batch.column(1).slice(k, 256).to_pylist(), strict=True):
                    stream += encode(t or "") + stop
                    docs.append((len(stream), d))
                if (out := cut(False)) is not None:
                    yield out
        if (out := cut(True)) is not None:
            yield out

    return run


def feistel(i: np.ndarray, n: int, key: int, rounds: int = 4) -> np.ndarray:
    """A keyed permutation of 0 .. n - 1."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = U((1 << half) - 1)
    out = np.asarray(i).astype(U)
    open_ = np.arange(len(out))
    while len(open_):
        left, right = out[open_] >> U(half), out[open_] & mask
        for r in range(rounds):
            left, right = right, left ^ (mix(right + mix(np.array([key * 16 + r], dtype=U))) & mask)
        out[open_] = (left << U(half)) | right
        open_ = open_[out[open_] >= U(n)]
    return out.astype(np.int64)


def sequences(docs: DataFrame, path: str = TOKENIZER, length: int = LENGTH, stride: int = STRIDE, key: int = KEY, end: int = END, width: int = 2) -> DataFrame:
    """docs (doc_id long, text) -> slot, shard, place, n_tokens, doc_ids, tokens; whole shards in each partition, by slot."""
    made = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_pack(path, length, end, width), "part int, at long, n_tokens int, doc_ids array<long>, tokens binary")
    made = written(made, "to-sequences")
    ahead = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = written(made.groupBy("part").agg(F.count("*").alias("n")).select("part", "n", ahead.alias("ahead")), "to-parts")  # a row for each partition
    n = parts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    slot_of = F.pandas_udf(lambda i: pd.Series(feistel(i.to_numpy(), n, key)), "long")
    shards = max(1, -(-n // stride))
    tasks = max(1, min(shards, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    rows = made.join(parts.select("part", "ahead"), "part").withColumn("slot", slot_of(F.col("ahead") + F.col("at")))
    rows = rows.withColumn("shard", F.floor(F.col("slot") / stride).cast("int"))
    rows = rows.repartitionById(tasks, F.floor(F.col("shard").cast("long") * tasks / shards).cast("int")).sortWithinPartitions("shard", "slot")
    return rows.select("slot", "shard", (F.col("slot") % stride).cast("int").alias("place"), "n_tokens", "doc_ids", "tokens")


def write_shards(seqs: DataFrame, path: str, stride: int = STRIDE) -> None:
    """Parquet files of whole shards, rows by slot; any store that Spark writes to. Row groups are of some shards, which is what a writer holds and a reader skips."""
    seqs.write.option("compression", "zstd").option("maxRecordsPerFile", stride * FILE_SHARDS).option("parquet.block.size", GROUP_BYTES).parquet(path)


def write_fixed(seqs: DataFrame, path: str, stride: int = STRIDE) -> None:
    """Files of whole shards in slot order by name; a record is the tokens of a slot and RECORD_END."""
    lines = seqs.select(F.col("tokens").cast("string").alias("value"))
    lines.write.option("lineSep", RECORD_END).option("maxRecordsPerFile", stride * FILE_SHARDS).text(path)


def fixed_files(spark, path: str, length: int = LENGTH, width: int = 2) -> DataFrame:
    """(path, first_slot, slots, record_bytes) of write_fixed's files: a slot's record begins (slot - first_slot) * record_bytes into its file."""
    size = length * width + len(RECORD_END)
    files = spark.read.format("binaryFile").load(path).select("path", (F.col("length") / size).cast("long").alias("slots"))
    ahead = F.coalesce(F.sum("slots").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each file
    return files.select("path", ahead.alias("first_slot"), "slots", F.lit(size).alias("record_bytes"))


def materialised(docs: DataFrame, path: str | None = None, **how) -> DataFrame:
    """Writes the shards of docs to path (a new folder of the shared one if not given); their rows, read from there."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/shards-{uuid.uuid4().hex[:12]}"
    seqs = sequences(docs, **how)
    write_shards(seqs, path, how.get("stride", STRIDE))
    return spark.read.schema(seqs.schema).parquet(path).select(*seqs.columns)


def read_from(spark, path: str, slot: int, stride: int = STRIDE) -> DataFrame:
    """What follows from a slot on, in order; files and row groups of earlier slots are skipped by their statistics."""
    return spark.read.parquet(path).where((F.col("shard") >= slot // stride) & (F.col("slot") >= slot)).orderBy("slot")


def write_binary(seqs: DataFrame, path: str) -> DataFrame:
    """Raw files shard-00000.bin under a folder that all executors mount; gives (shard, sequences, bytes).

    A file is written under another name and then renamed, so a repeated task does no harm.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(path, exist_ok=True)
        attempt = TaskContext.get().taskAttemptId()
        shard, out, n, size, done = None, None, 0, 0, []

        def close() -> None:
            if out is not None:
                out.close()
                os.replace(out.name, f"{path}/shard-{shard:05d}.bin")
                done.append((shard, n, size))

        for batch in batches:
            for s, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if s != shard:
                    close()
                    shard, n, size = s, 0, 0
                    out = open(f"{path}/.shard-{s:05d}.{attempt}", "wb")  # noqa: SIM115
                out.write(tokens)
                n, size = n + 1, size + len(tokens)
        close()
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], type=t) for k, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], ["shard", "sequences", "bytes"])

    return seqs.select("shard", "tokens").mapInArrow(run, "shard int, sequences long, bytes long")
