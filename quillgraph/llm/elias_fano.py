"""Elias-Fano sequences over flat arrays that can be memory-mapped, queried many keys at a time."""

from __future__ import annotations

import numpy as np

U = np.uint64
_ONE, _HIGH = U(0x0101010101010101), U(0x8080808080808080)
_HALF, _PAIR, _NIBBLE = U(0x5555555555555555), U(0x3333333333333333), U(0x0F0F0F0F0F0F0F0F)
#: Place of the k-th set bit of each byte, at 8 * byte + k.
_IN_BYTE = np.array([([i for i in range(8) if byte >> i & 1] + [0] * 8)[:8] for byte in range(256)], np.uint8).reshape(-1)


#: Keys or places looked up at a time: their intermediate arrays stay in the processor's cache.
_AT_ONCE = 1 << 14


def _in_pieces(look_up, x: np.ndarray) -> np.ndarray:
    return look_up(x) if len(x) <= _AT_ONCE else np.concatenate([look_up(x[i : i + _AT_ONCE]) for i in range(0, len(x), _AT_ONCE)])


def dump(*arrays: np.ndarray) -> bytes:
    """Arrays one after the other, each with a header and on an 8-byte boundary."""
    out = [len(arrays).to_bytes(8, "little")]
    for a in arrays:
        a = np.ascontiguousarray(a)
        body = a.tobytes()
        out += [a.dtype.str.encode().ljust(8), len(a).to_bytes(8, "little"), body, b"\0" * (-len(body) % 8)]
    return b"".join(out)


def load(buffer: np.ndarray) -> list[np.ndarray]:
    """Views of the arrays of dump(); nothing is copied."""
    out, at = [], 8
    for _ in range(int.from_bytes(buffer[:8].tobytes(), "little")):
        kind = np.dtype(buffer[at : at + 8].tobytes().decode().strip())
        n = int.from_bytes(buffer[at + 8 : at + 16].tobytes(), "little")
        size = n * kind.itemsize
        out.append(buffer[at + 16 : at + 16 + size].view(kind))
        at += 16 + size + -size % 8
    return out


def _select_in_word(word: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Where in each word its rank-th set bit (from 0) is: the byte by its running count of bits, then a table."""
    k = rank.astype(U)
    sums = word - ((word >> U(1)) & _HALF)
    sums = (sums & _PAIR) + ((sums >> U(2)) & _PAIR)
    sums = ((sums + (sums >> U(4))) & _NIBBLE) * _ONE  # bits up to and with each byte
    place = np.bitwise_count((((k * _ONE) | _HIGH) - sums) & _HIGH).astype(U) << U(3)  # bytes whose count is not above k
    k -= ((sums << U(8)) >> place) & U(255)
    at = (((word >> place) & U(255)) << U(3)) + k
    return place.astype(np.int64) + _IN_BYTE[at.astype(np.int64)]


class EliasFano:
    """A monotone sequence: low bits packed, high bits in unary, one running count for each 64-bit word of the latter."""

    ARRAYS = 4

    def __init__(self, meta: np.ndarray, low: np.ndarray, high: np.ndarray, ones: np.ndarray) -> None:
        self.n, self.l, self.top = int(meta[0]), int(meta[1]), int(meta[2])
        self.arrays = [meta, low, high, ones]
        self.low, self.high, self.ones = low, high, ones
        self._zeros: np.ndarray | None = None

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        """values: not decreasing, 64-bit."""
        values = values.astype(U)
        n, last = len(values), int(values[-1]) if len(values) else 0
        l = max(0, (last // max(1, n)).bit_length() - 1)
        top = last >> l
        high = np.zeros((n + top + 1 + 63) // 64 + 1, U)
        if n:
            at = (values >> U(l)) + np.arange(n, dtype=U)
            np.bitwise_or.at(high, (at >> U(6)).astype(np.int64), U(1) << (at & U(63)))
        low = np.zeros(n * l // 64 + 2, U)
        if n and l:
            rest = values & U((1 << l) - 1)
            bit = np.arange(n, dtype=U) * U(l)
            word, shift = (bit >> U(6)).astype(np.int64), bit & U(63)
            np.bitwise_or.at(low, word, rest << shift)
            np.bitwise_or.at(low, word + 1, (rest >> U(1)) >> (U(63) - shift))
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high).astype(np.int64))]).astype(np.uint32)
        return cls(np.array([n, l, top], U), low, high, ones)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.l:
            return np.zeros(len(i), U)
        bit = i.astype(U) * U(self.l)
        word, shift = (bit >> U(6)).astype(np.int64), bit & U(63)
        return ((self.low[word] >> shift) | ((self.low[word + 1] << U(1)) << (U(63) - shift))) & U((1 << self.l) - 1)

    def _select1(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, i.astype(np.uint32), side="right") - 1
        return word * 64 + _select_in_word(self.high[word], i - self.ones[word])

    def _select0(self, h: np.ndarray) -> np.ndarray:
        if self._zeros is None:
            self._zeros = (np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones).astype(np.uint32)
        word = np.searchsorted(self._zeros, h.astype(np.uint32), side="right") - 1
        return word * 64 + _select_in_word(~self.high[word], h - self._zeros[word])

    def _ones_from(self, bit: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Length of the run of ones that starts at each bit, before the h-th zero."""
        word, off = bit >> 6, bit & 63
        x = ~(self.high[word] >> off.astype(U))
        n = np.bitwise_count((x & (~x + U(1))) - U(1)).astype(np.int64)
        far = np.flatnonzero(n >= 64 - off)  # up to the word's end: the zero is in a later one
        if len(far):
            n[far] = self._select0(h[far]) - bit[far]
        return n

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at the places i."""
        return _in_pieces(self._get, i)

    def _get(self, i: np.ndarray) -> np.ndarray:
        i = i.astype(np.int64)
        return ((self._select1(i) - i).astype(U) << U(self.l)) | self._low(i)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Where each key is, by search for its successor among the values with its high bits; -1 if it is not there."""
        if not self.n or not len(keys):
            return np.full(len(keys), -1, np.int64)
        return _in_pieces(self._find, keys)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.astype(U)
        h = keys >> U(self.l)
        inside = h <= U(self.top)
        h = np.where(inside, h, U(0)).astype(np.int64)
        bit = np.where(h > 0, self._select0(np.maximum(h - 1, 0)) + 1, 0)
        lo = bit - h
        end = lo + self._ones_from(bit, h)
        want = keys & U((1 << self.l) - 1)
        hi = end.copy()
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low(mid) < want[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
            open_ = open_[lo[open_] < hi[open_]]
        ok = inside & (lo < end)
        ok[ok] = self._low(lo[ok]) == want[ok]
        return np.where(ok, lo, -1)


class Level:
    """One level of a trie's shard: which parents have children here, where each parent's run of children starts, and the children.

    A run is kept above the last value of the run before it, so that all children form one monotone
    sequence whose universe is the sum of the runs' largest children; a child is found by one search
    for its successor, within the run that the pointers give.
    """

    ARRAYS = 3 * EliasFano.ARRAYS

    def __init__(self, arrays: list[np.ndarray]) -> None:
        k = EliasFano.ARRAYS
        self.parents, self.pointers, self.children = (EliasFano(*arrays[j * k : j * k + k]) for j in range(3))

    @classmethod
    def of(cls, parent: np.ndarray, child: np.ndarray) -> list[np.ndarray]:
        """Arrays of a level; pairs sorted and distinct."""
        n = len(parent)
        first = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]])) if n else np.empty(0, np.int64)
        pointers = np.concatenate([first, [n]])
        width = child[pointers[1:] - 1].astype(U) + U(1) if n else np.empty(0, U)
        base = np.cumsum(width, dtype=U) - width
        if n and float(width.astype(np.float64).sum()) >= 2.0**63:
            raise ValueError("a shard of this size needs more shards")
        values = child.astype(U) + np.repeat(base, np.diff(pointers))
        return [a for s in (EliasFano.of(parent[first]), EliasFano.of(pointers), EliasFano.of(values)) for a in s.arrays]

    def _runs(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first place, place after the last, base) of the parents' runs."""
        start, end = self.pointers.get(at).astype(np.int64), self.pointers.get(at + 1).astype(np.int64)
        base = np.zeros(len(at), U)
        later = start > 0
        base[later] = self.children.get(start[later] - 1) + U(1)
        return start, end, base

    def find(self, at: np.ndarray, child: np.ndarray) -> np.ndarray:
        """Place of the child of the parent of that rank; -1 if there is none or the rank is -1. Fastest where equal ranks are neighbours."""
        out = np.full(len(at), -1, np.int64)
        ok = np.flatnonzero(at >= 0)
        if not len(ok):
            return out
        rank = at[ok]
        new = np.concatenate([[True], rank[1:] != rank[:-1]])
        start, end, base = (x[np.cumsum(new) - 1] for x in self._runs(rank[new]))
        place = self.children.find(base + child[ok].astype(U))
        out[ok] = np.where((place >= start) & (place < end), place, -1)
        return out

    def relative(self, at: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Place within the parent's run."""
        return place - self.pointers.get(at).astype(np.int64)

    def unrolled(self) -> tuple[np.ndarray, np.ndarray]:
        """All (parent, child) in order."""
        parents = self.parents.get(np.arange(self.parents.n)).astype(np.int64)
        start, end, base = self._runs(np.arange(self.parents.n)) if self.parents.n else (np.empty(0, np.int64),) * 3
        return np.repeat(parents, end - start), (self.children.get(np.arange(self.children.n)) - np.repeat(base, end - start).astype(U)).astype(np.int64)
