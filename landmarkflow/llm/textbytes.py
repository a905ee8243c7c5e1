"""Vectorised byte-level text work on Arrow batches.

Every function takes the texts of some rows as one byte array with row offsets,
so numpy works on a few megabytes at a time however short or long the rows are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 21

_RNG = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ROOT = np.uint64(0x9E3779B97F4A7C15)
ROOT_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
LEVEL_FACTORS = _RNG.integers(1, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
GRAM_FACTORS = _RNG.integers(1, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: Word separators of the quality statistics: space and the ASCII controls 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


class _Cache(dict):
    """A cache that stays where it is: functions sent to tasks carry an empty one."""

    def __reduce__(self):
        return _Cache, ()


_POWERS = _Cache()


def powers(root: np.uint64, n: int) -> np.ndarray:
    """``root ** 0 .. root ** (n - 1)`` modulo 2^64, kept between calls."""
    have = _POWERS.get(int(root))
    if have is None or len(have) < n:
        base = np.full(max(1 << n.bit_length(), 1 << 16), root, np.uint64)
        base[0] = 1
        have = _POWERS[int(root)] = np.multiply.accumulate(base)
        if n > 8 * CHUNK_BYTES:  # a very long row does not hold memory for ever
            del _POWERS[int(root)]
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows and the rows' offsets in them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0]:at[-1]], at - at[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES):
    """Runs of rows with about ``limit`` bytes: (first row, last row + 1, bytes, offsets)."""
    data, at = texts_of(column)
    first, n = 0, len(at) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        last = min(last, n)
        yield first, last, data[at[first]:at[last]], at[first:last + 1] - at[first]
        first = last


def runs(flag: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of set bytes that do not cross rows: start, end, row."""
    n = len(flag)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    begins, ends = flag.copy(), flag.copy()
    begins[1:] &= ~flag[:-1]
    ends[:-1] &= ~flag[1:]
    inner = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < n)]
    begins[inner] = flag[inner]
    ends[inner - 1] = flag[inner - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(at, start, "right") - 1


def prefix_codes(data: np.ndarray) -> np.ndarray:
    """Running sums from which :func:`span_hashes` reads the hash of any span."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODES[data] * powers(ROOT, len(data)), out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span; equal bytes give equal hashes wherever they stand."""
    inverse = powers(ROOT_INVERSE, len(prefix))
    return mix((prefix[end] - prefix[start]) * inverse[start]
               + (end - start).astype(np.uint64) * LEVEL_FACTORS[0])


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted values, each once. ``np.unique`` hashes them, which takes ten times as long on
    keys that share their high bits."""
    ordered = np.sort(values)
    return ordered[np.r_[True, ordered[1:] != ordered[:-1]]] if len(ordered) else ordered


def repeated(values: np.ndarray) -> np.ndarray:
    """True where a value occurs more than once."""
    ordered = np.sort(values)
    twice = distinct(ordered[1:][ordered[1:] == ordered[:-1]])
    return member(values, twice)


def member(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """True where a value is in ``wanted`` (sorted, distinct)."""
    out = np.zeros(len(values), bool)
    if len(wanted) and len(values):
        some = np.zeros(1 << 16, bool)
        some[(wanted & np.uint64(0xFFFF)).astype(np.int64)] = True
        maybe = np.flatnonzero(some[(values & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(wanted, values[maybe]), len(wanted) - 1)
        out[maybe] = wanted[at] == values[maybe]
    return out


def gram_hashes(words: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every ``n`` consecutive words of one row, and the place of the first."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.flatnonzero(row[:count] == row[n - 1:])
    total = words[first] * GRAM_FACTORS[0]
    for k in range(1, n):
        total += words[first + k] * GRAM_FACTORS[k]
    return mix(total), first


def whole_groups(batches):
    """Batches of a stream sorted by its first column, cut between groups."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = batch if rest is None else pa.Table.from_batches(
            [rest, batch]).combine_chunks().to_batches()[0]
        key = table.column(0).to_numpy()
        last = int(np.searchsorted(key, key[-1])) if len(key) else 0
        if last:
            yield table.slice(0, last)
        rest = table.slice(last)
    if rest is not None:
        yield rest
