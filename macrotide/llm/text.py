"""Whole texts of an Arrow column as numpy arrays: words, their hashes and hashes of word runs."""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are taken up to so many bytes at a time (at least one whole text).
CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Keeps the first 0 .. 8 bytes of a little-endian word.
_LOW = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
#: Spans of more bytes than this are hashed by BLAKE2b, one by one.
_LONG = 64


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of pairs; for a given member, one to one in the other."""
    return mixed(((a ^ (a >> np.uint64(29))) * _ODD) + b)


def drawn_key() -> int:
    """A secret for the hashes of one run: no text can be made to collide with another under a key that nobody knew."""
    return secrets.randbits(64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, family: int = 0, key: int = 0) -> np.ndarray:
    """Hashes of the bytes data[start:end]: eight at a time, mixed with the key after each step; long spans by keyed BLAKE2b.

    Without a key the hashes are the same in every run, and texts with equal ones can be made.
    """
    secret, raw = np.uint64(key), key.to_bytes(8, "little") if key else b""
    size = ends - starts
    room = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", room, 0, (1,))
    out = mixed(size.astype(np.uint64) * _ODD + np.uint64(family) ^ secret)
    out = joined(out, eight[starts] & _LOW[np.minimum(size, 8)])
    rest = np.flatnonzero((size > 8) & (size <= _LONG))
    for at in range(8, _LONG, 8):
        if not len(rest):
            break
        out[rest] = joined(out[rest] ^ secret, eight[starts[rest] + at] & _LOW[np.minimum(size[rest] - at, 8)])
        rest = rest[size[rest] > at + 8]
    for i in np.flatnonzero(size > _LONG):
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, salt=bytes([family]), key=raw).digest(), "little")
    return out


def gram_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive values, put together from runs of powers of two."""
    if len(values) < k:
        return np.zeros(0, np.uint64)
    out, have, power, width = values, 0, values, 1
    while True:
        if k & width:
            n = len(values) - have - width + 1
            out = joined(power[:n], out[width : width + n]) if have else power
            have += width
        if have == k:
            return out
        power = joined(power[:-width], power[width:])
        width *= 2


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the runs values[start:end], of one value at least: two runs of a power of two cover each."""
    size = ends - starts
    out = np.zeros(len(starts), np.uint64)
    power, width = values, 1
    while len(starts) and width <= size.max():
        own = np.flatnonzero((size >= width) & (size < 2 * width))
        out[own] = joined(joined(power[starts[own]], power[ends[own] - width]), size[own].astype(np.uint64))
        power = joined(power[:-width], power[width:])
        width *= 2
    return out


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of some texts: bytes starts[i]:ends[i] of data, in text doc[i]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data, self.offsets = (_LOWER[data] if lower else data), offsets
        n = len(data)
        word = ~_SPACE[data]
        begins, stops = word.copy(), word.copy()
        begins[1:] &= ~word[:-1]
        stops[:-1] &= ~word[1:]
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < n)]
        begins[inner] = word[inner]
        stops[inner - 1] = word[inner - 1]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        #: Words of text i: first[i] to first[i + 1].
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self, family: int = 0, key: int = 0) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends, family, key)

    def normalized(self) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) of the texts with their words joined by one space."""
        size = self.ends - self.starts + 1
        last = self.first[1:][self.counts > 0] - 1
        size[last] -= 1
        at = np.concatenate([[0], np.cumsum(size)])
        out = self.data[np.minimum(np.repeat(self.starts - at[:-1], size) + np.arange(at[-1]), max(0, len(self.data) - 1))]
        gaps = np.setdiff1d(np.arange(len(size)), last, assume_unique=True)
        out[at[gaps + 1] - 1] = 32
        return out, at[self.first]


def texts(column: pa.Array | pa.ChunkedArray, most_rows: int = 1 << 30) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of runs of whole texts of about CHUNK_BYTES and ``most_rows`` at most; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1)
        to = min(to, at + most_rows)
        yield slice(at, to), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to
