"""Helpers over Arrow text columns: raw buffers, bounded slices, token hashes."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of text whose temporaries are alive at once.
SLICE_BYTES = 1 << 18

# Character classes of a byte: 0 white space and controls, 1 word, 2 punctuation.
# Bytes from 0x80 belong to words, so UTF-8 letters are never cut.
CLASS = np.full(256, 2, np.uint8)
CLASS[:33] = 0
CLASS[127] = 0
CLASS[128:] = 1
for _span in (b"09", b"AZ", b"az"):
    CLASS[_span[0]:_span[1] + 1] = 1
LOWER = np.arange(256, dtype=np.uint64)
LOWER[65:91] += np.uint64(32)
LOWER[CLASS == 0] = 0

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def mixed(h: np.ndarray) -> np.ndarray:
    """A multiply-xorshift finaliser, so that high and low bits are both usable."""
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for a task, whose freed memory then returns to the system: workers live on and serve later stages."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return wrapped


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, width)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def row_slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of about ``limit`` bytes; a longer text is a range of its own."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def _piece_hashes(data: np.ndarray, breaks: np.ndarray, prefixes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (whole and prefixes) and start of each token; a token is a run of one class and never crosses a break."""
    kind = CLASS[data]
    new = np.empty(len(data), bool)
    new[0] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:])
    new[breaks] = True
    starts = np.flatnonzero(new)
    lengths = np.diff(starts, append=len(data))
    place = np.arange(len(data)) - np.repeat(starts, lengths)
    powers = np.full(int(lengths.max()), _BASE)
    powers[0] = np.uint64(1)
    np.multiply.accumulate(powers, out=powers)
    values = LOWER[data] * powers[place]
    word = kind[starts] > 0
    hashes = [mixed(np.add.reduceat(values, starts)[word])]
    for n in prefixes:
        # The length is part of the hash, so a prefix is no word.
        own = mixed(np.add.reduceat(np.where(place < n, values, np.uint64(0)), starts)[word] + np.uint64(n * int(_MIX) % (1 << 64)))
        hashes.append(np.where(lengths[word] > n, own, np.uint64(0)))
    return np.stack(hashes), starts[word]


def token_hashes(data: np.ndarray, offsets: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each token, index of the first token of each row and the end).

    With ``prefixes`` there are as many rows of hashes more: of the first n bytes
    of each longer token, 0 for a shorter one. ``offsets`` delimit the rows inside
    ``data``. Long rows are read in pieces cut at white space (or after
    ``SLICE_BYTES`` where there is none), so only the hashes of a row, never its
    temporaries, grow with its length.
    """
    hashes, starts = [], []
    begin, end = int(offsets[0]), int(offsets[-1])
    while begin < end:
        stop = min(begin + 2 * SLICE_BYTES, end)
        if stop < end:
            blank = np.flatnonzero(CLASS[data[begin + SLICE_BYTES:stop]] == 0)
            stop = begin + SLICE_BYTES + int(blank[-1]) + 1 if len(blank) else stop
        inside = offsets[(offsets >= begin) & (offsets < stop)] - begin
        h, s = _piece_hashes(data[begin:stop], inside, prefixes)
        hashes.append(h)
        starts.append(s + begin)
        begin = stop
    h = np.concatenate(hashes, axis=1) if hashes else np.zeros((1 + len(prefixes), 0), np.uint64)
    s = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return h if prefixes else h[0], np.searchsorted(s, offsets)


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values`` per row; ``first`` holds each row's first index and the end."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]


def text_key() -> Column:
    """Tells texts apart where ids are null or repeat."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as decimal text, modulo ``modulus``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus
