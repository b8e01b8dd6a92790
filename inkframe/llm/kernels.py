"""Vectorised byte kernels shared by the corpus operators.

Everything here works on one flat ``uint8`` buffer holding many texts back to back, with
``off`` (n + 1 offsets) marking where each text starts; nothing loops over characters.
Hashes are 64-bit chains of a bit mixer; polynomials modulo 2**64 are avoided, as they
have known collisions for every base.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled by one vectorised step; a longer text is a step of its own.
STEP_BYTES = 256 << 10

#: Spans of more bytes are hashed one by one by XXH3.
_LONG = 64
_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)
_LOW_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)


def _mix_int(x: int) -> int:
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % (1 << 64)
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB % (1 << 64)
    return x ^ (x >> 31)


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that every output bit depends on every input bit."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def eights(buf: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one integer, without a copy; zeros follow the last byte."""
    return np.ndarray((len(buf) + 1,), "<u8", np.concatenate([buf, np.zeros(8, np.uint8)]), 0, (1,))


def span_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte span [start, end), wherever it stands: a chain of mixed 8-byte words, XXH3 for long spans.

    Each step of the chain mixes before the next word enters, so no two words of a span cancel out as in a polynomial.
    """
    size = np.minimum(end - start, _LONG)
    out = mix(size.astype(np.uint64) * _ODD)
    words, at, now = eights(buf), start, np.arange(len(start))
    for j in range(0, int(size.max(initial=0)), 8):
        if j:
            now = now[size[now] > j]
            at = start[now] + j
        out[now] = mix((out[now] ^ (words[at] & _LOW_BYTES[np.minimum(size[now] - j, 8)])) * _ODD)
    long = np.flatnonzero(end - start > _LONG)
    if len(long):
        import xxhash

        data = memoryview(np.ascontiguousarray(buf))
        out[long] = [xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(start[long].tolist(), end[long].tolist())]
    return out


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place where each distinct hash first stands, number of each hash among the distinct), in order of first place and without a sort."""
    number = pa.array(hashes).dictionary_encode().indices.to_numpy()
    one = np.zeros(int(number.max(initial=-1)) + 1, np.int64)
    one[number[::-1]] = np.arange(len(hashes) - 1, -1, -1)
    return one, number


def pair_name(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Identifier of what ``x`` names followed by what ``y`` names."""
    return mix((mix(x) + y) * _ODD)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary()
    column = column.cast(pa.large_string()).cast(kind) if pa.types.is_string(column.type) else column.cast(kind)
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def release() -> None:
    """Give freed memory back to the system: a Python worker outlives its task, and other stages share its executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def steps(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut Arrow batches into (rows, bytes, offsets) of about ``most`` bytes of text each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        buf, off = flat(batch.column(batch.schema.get_field_index(text)))
        i, n = 0, batch.num_rows
        while i < n:
            j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
            yield batch.slice(i, j - i), buf[off[i] : off[j]], off[i : j + 1] - off[i]
            i = j
        buf = off = None
    batch = None
    release()


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


LOWER = lower_table()
#: True for the bytes of words `[^\x20\x09-\x0D]+`; bytes of longer code points are all word bytes.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: True for the bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def word_spans(buf: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and how many words each text has."""
    inside = table[buf]
    edge = np.zeros(len(buf) + 1, dtype=bool)
    edge[off] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.diff(np.searchsorted(starts, off))


def within(counts: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... restarting in each text."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def shingles(hashes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every k-word shingle and each text's number of them; a text of fewer words, but not none, has one over all its words."""
    at, size = within(counts), np.repeat(counts, counts)
    keep = (at + k <= size) | ((at == 0) & (size < k))
    where = np.flatnonzero(keep)
    out = np.zeros(len(where), dtype=np.uint64)
    padded = np.concatenate([hashes, np.zeros(k, np.uint64)])
    left = size[where]
    for j in range(k):
        out += np.where(j < left, padded[where + j] * _U(_mix_int(j + 1) | 1), _U(0))
    return mix(out), np.where(counts >= k, counts - k + 1, (counts > 0).astype(counts.dtype))


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices starts[0], ..., starts[0] + sizes[0] - 1, starts[1], ..."""
    return np.repeat(starts, sizes) + within(sizes)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
