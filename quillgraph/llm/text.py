"""Vectorised text primitives over Arrow string batches (UTF-8 bytes, never per-row Python)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_TABLES: dict[str, np.ndarray] = {}


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls are empty.  offsets[0] is 0."""
    column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(column) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def doc_slices(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` bytes together, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words_at(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without ASCII white space) of all rows, in order."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~IS_SPACE[data]
    before = np.empty_like(solid)
    before[0], before[1:] = False, solid[:-1]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    before[inner] = False
    after = np.empty_like(solid)
    after[-1], after[:-1] = False, solid[1:]
    after[inner - 1] = False
    return np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1


def rows_of(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The row of each position in ``starts``."""
    return np.searchsorted(offsets, starts, "right") - 1


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes (all input bits reach all output bits)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _TABLES or len(_TABLES["up"]) < n:
        n = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                a = np.full(n, np.uint64(base), np.uint64)
                a[0] = 1
                _TABLES[name] = np.multiply.accumulate(a)
    return _TABLES["up"], _TABLES["down"]


def byte_values() -> np.ndarray:
    """A fixed random 64-bit value for each byte."""
    if "values" not in _TABLES:
        _TABLES["values"] = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return _TABLES["values"]


#: Spans up to this long are hashed eight bytes a round, all together; longer ones by XXH64, one by one.
_ROUNDS = 64


def word_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span: its bytes, eight at a time, and its length, mixed in turn (no linear structure)."""
    size = ends - starts
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    short = np.minimum(size, 8)
    keep = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
    h = mix((eight[starts] & keep[short]) * np.uint64(0x9E3779B97F4A7C15) + size.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    open_ = np.flatnonzero((size > 8) & (size <= 8 * _ROUNDS))
    k = 8
    while len(open_):
        part = eight[starts[open_] + k] & keep[np.minimum(size[open_] - k, 8)]
        h[open_] = mix(h[open_] * np.uint64(0x9FB21C651E98DF25) + part)
        k += 8
        open_ = open_[size[open_] > k]
    long = np.flatnonzero(size > 8 * _ROUNDS)
    if len(long):
        import xxhash

        raw = data.tobytes()
        h[long] = [xxhash.xxh64_intdigest(raw[a:b]) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
    return h


class SpanHash:
    """Hashes of any spans of a byte array in constant time each, from one prefix sum.

    Sums are modulo 2**64, which is sound for spans of some hundred bytes; words, which can be
    of any length, have ``word_hash``.
    """

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(len(data) + 1)
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(byte_values()[data] * up[: len(data)], out=self.prefix[1:])

    def raw(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.prefix[ends] - self.prefix[starts]) * self.down[starts]

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Equal for equal bytes; the length takes part."""
        return mix(self.raw(starts, ends) + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def shingle_hash(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` word hashes (len(words) - size + 1 of them)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(size):
        h = (h + words[i : i + n]) * np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(29)
    return mix(h)
