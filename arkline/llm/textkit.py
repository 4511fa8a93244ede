"""Vectorised word scanning of Arrow text batches.

Words are found and hashed with numpy over the UTF-8 bytes of many texts at once: a byte
table maps upper-case ASCII to lower case and separators to a space, a prefix sum of
per-byte values times powers of an odd constant gives every word's hash by subtraction.
Hashes have 64 bits and end in a mixing step; memory is bounded by SEGMENT bytes of text
(or one word, if a word is longer than that).
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SEGMENT = 1 << 17
LONG = 64  # bytes of a word that scan_spaced hashes with numpy
_STEP = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_UNSTEP = pow(_STEP, -1, 1 << 64)
_U = np.uint64


def byte_table(separators) -> np.ndarray:
    """256 bytes: A-Z in lower case, separators (a predicate on byte values) as a space."""
    return np.array([32 if separators(b) else b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


#: Words are runs of anything but ASCII white space.
SPACED = byte_table(lambda b: b == 32 or 9 <= b <= 13)
#: Words are runs of ASCII digits and letters and of anything that isn't ASCII.
ALNUM = byte_table(lambda b: b < 48 or 58 <= b <= 64 or 91 <= b <= 96 or 123 <= b <= 127)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _U(_STEP))
_powers = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, SEGMENT + 1)
        for key, base in (("up", _STEP), ("down", _UNSTEP)):
            table = np.full(size, _U(base))
            table[0] = 1
            _powers[key] = np.cumprod(table)
    return _powers["up"], _powers["down"]


def utf8_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary Arrow column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """The words of some texts: text i has words first[i]:first[i + 1]."""

    __slots__ = ("starts", "ends", "hashes", "first")

    def __init__(self, starts, ends, hashes, first):
        self.starts, self.ends, self.hashes, self.first = starts, ends, hashes, first


def scan_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, scan=None) -> Words:
    """Words of the texts data[offsets[i]:offsets[i + 1]]; no word spans two texts. scan: _scan or
    another function of its kind, for the same table."""
    scan = scan or _scan
    found = []
    at, n = 0, len(data)
    while at < n:
        stop = min(n, at + SEGMENT)
        if stop < n:
            cut = _last_break(data, offsets, at, stop, table)
            while cut is None:  # one word fills the segment
                stop = min(n, stop + SEGMENT)
                cut = n if stop == n else _last_break(data, offsets, at, stop, table)
            stop = cut
        found.append(scan(data[at:stop], at, offsets, table))
        at = stop
    starts, ends, hashes = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
    return Words(starts, ends, hashes, np.searchsorted(starts, offsets))


def _last_break(data, offsets, at, stop, table):
    """The last place in (at, stop] where a text starts or a separator stands."""
    k = np.searchsorted(offsets, stop, side="right") - 1
    best = int(offsets[k]) if k >= 0 and offsets[k] > at else None
    for reach in (256, 65536, stop - at if best is None else 0):
        low = max(at, stop - reach)
        blanks = np.flatnonzero(table[data[low:stop]] == 32)
        if len(blanks):
            break
    if len(blanks):
        best = max(best or 0, low + int(blanks[-1]) + 1)
    return best


def _scan(part, base, offsets, table):
    mapped = table[part]
    inside = mapped != 32
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    own = offsets[(offsets > base) & (offsets < base + len(part))] - base
    opens = inside & ~before
    closes = before & ~inside
    opens[own] = inside[own]
    closes[own] = before[own]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes)
    if len(part) and inside[-1]:
        ends = np.append(ends, len(part))
    return starts + base, ends + base, span_hashes(mapped, starts, ends)


#: What is kept of 8 bytes of which a word has 0 to 8.
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def scan_spaced(part, base, offsets, table=SPACED):
    """As _scan with SPACED, in less time and with other hashes: a word's bytes are taken by eights,
    words of more than LONG bytes go through xxhash."""
    n = len(part)
    low = np.zeros(n + 8, np.uint8)
    np.bitwise_or(part, ((part - np.uint8(65)) < 26).view(np.uint8) << np.uint8(5), out=low[:n])
    inside = np.zeros(n + 2, bool)
    np.logical_not((part == 32) | ((part - np.uint8(9)) < 5), out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    own = np.unique(offsets[(offsets > base) & (offsets < base + n)]) - base
    own = own[inside[own] & inside[own + 1]]  # a text ends in a word and the next begins with one
    edges = np.insert(edges, np.repeat(np.searchsorted(edges, own), 2), np.repeat(own, 2))
    starts, ends = np.ascontiguousarray(edges[::2]), np.ascontiguousarray(edges[1::2])
    size = ends - starts
    eights = np.ndarray((n + 1,), "<u8", low, strides=(1,))
    hashes = eights[starts] & _KEEP[np.minimum(size, 8)]
    more, at = np.flatnonzero(size > 8), 8
    while len(more) and at < LONG:
        left = size[more] - at
        hashes[more] = mix(hashes[more]) ^ (eights[starts[more] + at] & _KEEP[np.minimum(left, 8)])
        more, at = more[left > 8], at + 8
    for k in more.tolist():
        hashes[k] = xxhash.xxh3_64_intdigest(low[starts[k] : ends[k]])
    return starts + base, ends + base, mix(hashes + size.view(np.uint64) * _U(_STEP))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span data[starts[i]:ends[i]]."""
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def chunks(offsets: np.ndarray, size: int = 2 * SEGMENT) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about size bytes together, one text at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        yield i, min(j, n)
        i = j


def scanned(column: pa.Array, table: np.ndarray, scan=None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, Words]]:
    """(first text, past the last, their bytes, their offsets, their words), by chunks."""
    data, offsets = utf8_column(column)
    for i, j in chunks(offsets):
        part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        yield i, j, part, own, scan_words(part, own, table, scan)


def give_back() -> None:
    """Freed memory goes back to the system; glibc and Arrow otherwise keep what arrays have left."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
