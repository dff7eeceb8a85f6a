"""Numpy views of Arrow text columns: word boundaries and hashes without a Python object for each word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_MIX1, _MIX2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
#: Longest word whose byte positions all count apart; a longer word's positions repeat with this period.
MAX_WORD = 1 << 16


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64 (shift, multiply, twice)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * _MIX1
        x = (x ^ (x >> U64(27))) * _MIX2
        return x ^ (x >> U64(31))


_POWER = np.full(MAX_WORD, 0x9E3779B97F4A7C15 | 1, dtype=U64)
_POWER[0] = 1
with np.errstate(over="ignore"):
    _POWER = np.cumprod(_POWER, dtype=U64)
_BYTE_CODES = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
#: The same codes, with A-Z given those of a-z.
FOLDED_CODES = _BYTE_CODES.copy()
FOLDED_CODES[65:91] = _BYTE_CODES[97:123]
BYTE_CODES = _BYTE_CODES

#: Bytes that are not ASCII white space.
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: ASCII letters and digits, and every byte of a longer UTF-8 sequence.
WORD_BYTES = np.zeros(256, dtype=bool)
WORD_BYTES[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its n + 1 offsets; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def from_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The same pair for a list of byte strings."""
    offs = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offs[1:])
    return np.frombuffer(b"".join(texts), dtype=np.uint8), offs


def row_chunks(offs: np.ndarray, most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes each; one long row is a range of its own."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


class Words:
    """Words of a chunk of rows: ``hashes`` (uint64), ``starts`` and ``ends`` in bytes, ``bounds`` (words of row i are bounds[i]:bounds[i+1])."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, is_word: np.ndarray = WORD_BYTES, codes: np.ndarray = FOLDED_CODES):
        self.buf, self.offs = buf, offs
        n = len(buf)
        inside = np.zeros(n + 2, dtype=bool)
        inside[1:-1] = is_word[buf]
        starts = inside[1:] & ~inside[:-1]
        ends = inside[:-1] & ~inside[1:]
        edges = offs[1:-1]
        edges = edges[(edges > 0) & (edges < n)]
        cut = edges[inside[edges] & inside[edges + 1]]
        starts[cut] = True
        ends[cut] = True
        self.starts, self.ends = np.flatnonzero(starts), np.flatnonzero(ends)
        self.lens = self.ends - self.starts
        body = inside[1:-1]
        self.first = np.zeros(len(self.lens) + 1, np.int64)
        np.cumsum(self.lens, out=self.first[1:])
        place = np.arange(self.first[-1]) - np.repeat(self.first[:-1], self.lens)
        with np.errstate(over="ignore"):
            sums = np.zeros(self.first[-1] + 1, U64)
            np.cumsum(codes[buf[body]] * _POWER[place & (MAX_WORD - 1)], out=sums[1:])
            self.sums = sums
            self.hashes = mix64(sums[self.first[1:]] - sums[self.first[:-1]])
        self.bounds = np.searchsorted(self.starts, offs)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def affix(self, length: int, at_end: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the first (or last) ``length`` bytes of each longer word, and which words those are."""
        which = np.flatnonzero(self.lens > length)
        lo = self.first[which + 1] - length if at_end else self.first[which]
        with np.errstate(over="ignore"):
            raw = self.sums[lo + length] - self.sums[lo]
            if at_end:  # positions count from the word's start
                raw = raw * _INVERSE[(self.lens[which] - length) & (MAX_WORD - 1)]
            return mix64(raw ^ U64(0xA5A5A5A5 + length + (1 << 20) * at_end)), which


_INVERSE = np.full(MAX_WORD, pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64), dtype=U64)
_INVERSE[0] = 1
with np.errstate(over="ignore"):
    _INVERSE = np.cumprod(_INVERSE, dtype=U64)


class IdTable:
    """uint64 keys to small integers: open slots, looked up for a whole array at once."""

    def __init__(self, bits: int = 16):
        self._reset(bits)

    def _reset(self, bits: int) -> None:
        self.bits, self.n = bits, 0
        self.keys = np.zeros(1 << bits, U64)
        self.vals = np.full(1 << bits, -1, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 where there is none."""
        mask = (1 << self.bits) - 1
        slots = self._slots(keys)
        vals = self.vals[slots]
        hit = (vals >= 0) & (self.keys[slots] == keys)
        out = np.where(hit, vals, np.int32(-1))
        todo = np.flatnonzero((vals >= 0) & ~hit)
        slots = slots[todo]
        while len(todo):
            slots = (slots + 1) & mask
            vals = self.vals[slots]
            hit = (vals >= 0) & (self.keys[slots] == keys[todo])
            out[todo[hit]] = vals[hit]
            more = (vals >= 0) & ~hit
            todo, slots = todo[more], slots[more]
        return out

    def put(self, keys: np.ndarray, vals: np.ndarray) -> None:
        """Adds keys that are not there yet and that differ from each other."""
        if (self.n + len(keys)) * 2 > 1 << self.bits:
            old = self.vals >= 0
            keys, vals = np.concatenate([self.keys[old], keys]), np.concatenate([self.vals[old], vals])
            bits = self.bits
            while len(keys) * 2 > 1 << bits:
                bits += 1
            self._reset(bits)
        self.n += len(keys)
        slots = self._slots(keys)
        while len(keys):
            free = self.vals[slots] < 0
            self.keys[slots[free]] = keys[free]
            self.vals[slots[free]] = vals[free]
            lost = self.keys[slots] != keys
            keys, vals, slots = keys[lost], vals[lost], (slots[lost] + 1) & ((1 << self.bits) - 1)
