"""Text pieces and a cache of their token ids, for tokenizers that treat pieces one by one.

A worker keeps each distinct piece's ids once; a chunk of texts is then encoded by looking up the hashes of all its pieces.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from functools import cache

import numpy as np

from specgraph.llm.arrays import IdTable, mix64

U64 = np.uint64
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
#: The White_Space code points of Unicode.
WHITE_SPACE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

#: Ranges of letters and numbers that Python's Unicode tables have and those of the tokenizers library do not; it takes them for other signs.
NEWER = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D40, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x113B7), (0x113D1, 0x113D3), (0x116D0, 0x116E3), (0x11BC0, 0x11BE0), (0x11BF0, 0x11BF9), (0x13460, 0x143FA), (0x16100, 0x1611D),
    (0x16130, 0x16139), (0x16D40, 0x16D6C), (0x16D70, 0x16D79), (0x18CFF, 0x18CFF), (0x1CCF0, 0x1CCF9), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5FA),
]


@cache
def classes() -> np.ndarray:
    """LETTER, NUMBER, SPACE or OTHER for each code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), dtype=np.uint8, count=sys.maxunicode + 1)
    out[WHITE_SPACE] = SPACE
    for lo, hi in NEWER:
        out[lo : hi + 1] = OTHER
    return out


def code_points(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """All texts as one string, its code points and the n + 1 offsets."""
    offs = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offs[1:])
    whole = "".join(texts)
    return whole, np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype="<u4"), offs


def byte_level_starts(cps: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where the pieces of the byte-level pattern begin.

    Pieces are runs of letters, of numbers and of other signs, each with one space (U+0020) before it if there is one; the contractions
    's 't 're 've 'm 'll 'd; and white space, whose last sign before a text goes to the next piece or stands alone.
    """
    n = len(cps)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[cps]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offs] = True
    first, last = edge[:-1], edge[1:]
    space, blank = kind == SPACE, cps == 32
    after = np.zeros(n, dtype=bool)  # the sign before is in the same text and ...
    start = first.copy()
    same = np.zeros(n, dtype=bool)
    same[1:] = (kind[1:] == kind[:-1]) & ~first[1:]
    after[1:] = blank[:-1] & ~first[1:]
    start |= ~space & ~same & ~after
    before_text = np.zeros(n, dtype=bool)  # white space right before a text
    before_text[:-1] = space[:-1] & ~space[1:] & ~last[:-1]
    start |= space & (~same | before_text)
    at = np.flatnonzero((cps == 39) & start)
    if len(at):
        pad = np.zeros(n + 3, dtype=cps.dtype)
        pad[:n] = cps
        room = offs[np.searchsorted(offs, at, "right")] - at
        one, two = pad[at + 1], pad[at + 2]
        short = (room > 1) & np.isin(one, [ord(c) for c in "stmd"])
        long = (room > 2) & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
        start[at[short | long] + 1] = False
        for hit, size in ((short, 2), (long & ~short, 3)):
            to = at[hit] + size
            start[to[to < n]] = True
    return np.flatnonzero(start)


class Pieces:
    """Where the pieces of a chunk of code points begin and end; ``bounds`` gives the pieces of each text."""

    def __init__(self, offs: np.ndarray, starts: np.ndarray):
        self.starts, self.ends = starts, np.append(starts[1:], offs[-1])
        self.bounds = np.searchsorted(starts, offs)


class PieceHashes(Pieces):
    """Pieces with their hashes."""

    _powers = np.ones(1, U64)

    def __init__(self, cps: np.ndarray, offs: np.ndarray, starts: np.ndarray):
        super().__init__(offs, starts)
        lens = self.ends - starts
        longest = int(lens.max(initial=1))
        if longest > len(PieceHashes._powers):
            powers = np.full(1 << longest.bit_length(), 0x9E3779B97F4A7C15, dtype=U64)
            powers[0] = 1
            with np.errstate(over="ignore"):
                PieceHashes._powers = np.cumprod(powers, dtype=U64)
        place = np.arange(len(cps)) - np.repeat(starts, lens)
        with np.errstate(over="ignore"):
            coded = mix64(cps.astype(U64) + U64(1)) * PieceHashes._powers[place]
            self.hashes = mix64(np.add.reduceat(coded, starts)) if len(starts) else np.zeros(0, U64)


class IdCache:
    """Token ids of pieces by hash; it starts anew once it holds ``most`` pieces or eight times as many ids, so its bytes are bounded (about 80 for each of ``most``)."""

    def __init__(self, most: int = 500_000):
        self.most = most
        self._clear()

    def _clear(self) -> None:
        self.table = IdTable(16)
        self.n = self.used = 0
        self.starts, self.lens, self.pool = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), np.zeros(1 << 18, np.int32)

    @staticmethod
    def _room(values: np.ndarray, n: int) -> np.ndarray:
        if n <= len(values):
            return values
        grown = np.zeros(max(n, 2 * len(values)), values.dtype)
        grown[: len(values)] = values
        return grown

    def encode(self, hashes: np.ndarray, make: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces on end, and the number of each piece's ids. ``make`` gets places in ``hashes`` of pieces that are new, and gives the same two arrays for them."""
        if self.n > self.most or self.used > 8 * self.most:
            self._clear()
        at = self.table.get(hashes)
        new = np.flatnonzero(at < 0)
        if len(new):
            keys, once = np.unique(hashes[new], return_index=True)
            ids, lens = make(new[once])
            self.pool = self._room(self.pool, self.used + len(ids))
            self.starts, self.lens = self._room(self.starts, self.n + len(keys)), self._room(self.lens, self.n + len(keys))
            self.pool[self.used : self.used + len(ids)] = ids
            self.starts[self.n : self.n + len(keys)] = self.used + np.cumsum(lens) - lens
            self.lens[self.n : self.n + len(keys)] = lens
            self.table.put(keys, np.arange(self.n, self.n + len(keys), dtype=np.int32))
            self.used, self.n = self.used + len(ids), self.n + len(keys)
            at[new] = self.table.get(hashes[new])
        lens = self.lens[at].astype(np.int64)
        begin = np.cumsum(lens) - lens
        return self.pool[np.arange(int(lens.sum())) + np.repeat(self.starts[at] - begin, lens)], lens


def row_bounds(bounds: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Offsets of each text's ids, from the pieces of each text and the ids of each piece."""
    total = np.zeros(len(lens) + 1, np.int64)
    np.cumsum(lens, out=total[1:])
    return total[bounds]
