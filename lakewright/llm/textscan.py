"""Words of Arrow text columns as numpy arrays, without a Python object for each word.

Texts are taken as UTF-8 bytes in slices of a few MB, so memory is bounded by the longest text.
Within a task words are numbered by their bytes. Between tasks they have 64-bit names, which only
propose candidates: what is decided is decided on words, or on 128-bit hashes of their spelling.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def seeded(seed: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U) + U(seed) * U(1 << 32)) * U(0x9E3779B97F4A7C15))


def byte_set(pairs: list[tuple[int, int]]) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    for a, b in pairs:
        out[a : b + 1] = True
    return out


#: Everything but ASCII white space.
NOT_SPACE = ~byte_set([(0x20, 0x20), (0x09, 0x0D)])
#: ASCII letters and digits, and all that is not ASCII.
ALNUM = byte_set([(0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch with about `most` bytes of text: rows, their bytes, offsets of each row and the end."""
    texts = batch.column(batch.schema.get_field_index(column))
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    i, n = 0, len(texts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        j = min(j, n)
        yield batch.slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def word_spans(buf: np.ndarray, off: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of maximal runs of allowed bytes in each row, and the row of each."""
    n = len(buf)
    if n == 0:
        z = np.zeros(0, dtype=np.int64)
        return z, z, z
    inside = allowed[buf]
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    first = off[:-1]
    before[first[first < n]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    last = off[1:] - 1
    after[last[last >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(off, starts, side="right") - 1


def numbered(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, allowed: np.ndarray, lower: bool = False) -> tuple[np.ndarray, pa.Array]:
    """Numbers of the words that word_spans found, and the distinct words (large binary) in the order of these numbers.

    Words are told apart by their bytes, so equal numbers mean equal words.
    """
    data = buf[allowed[buf]]
    data = np.ascontiguousarray(LOWER[data] if lower else data)
    offsets = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    return words.indices.to_numpy().astype(np.int64), words.dictionary


def names_of(words: pa.Array) -> np.ndarray:
    """A 64-bit name of each of some byte strings, cut from a cryptographic hash."""
    raw = b"".join(blake2b(w, digest_size=8).digest() for w in words.to_pylist())
    return np.frombuffer(raw, dtype=U)


def word_names(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, allowed: np.ndarray, lower: bool = False) -> np.ndarray:
    """The 64-bit name of each word."""
    if len(starts) == 0:
        return np.zeros(0, dtype=U)
    number, words = numbered(buf, starts, ends, allowed, lower)
    return names_of(words)[number]


class Spelled:
    """Words of a slice spelled with one space after each; gives 128-bit hashes of stretches of them."""

    def __init__(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, allowed: np.ndarray, lower: bool = False):
        data = buf[allowed[buf]]
        stops = np.cumsum(ends - starts)
        self.text = memoryview(np.insert(LOWER[data] if lower else data, stops, 0x20).tobytes())
        self.at = np.concatenate([[0], stops + np.arange(1, len(stops) + 1)])

    def digests(self, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the words start .. stop - 1 of each stretch: two longs."""
        text = self.text
        raw = b"".join([blake2b(text[a:b], digest_size=16).digest() for a, b in zip(self.at[start].tolist(), self.at[stop].tolist(), strict=True)])
        both = np.frombuffer(raw, dtype=np.int64).reshape(-1, 2)
        return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])


def row_words(words_row: np.ndarray, rows: int) -> np.ndarray:
    """Offsets of each row's words."""
    return np.searchsorted(words_row, np.arange(rows + 1), side="left")
