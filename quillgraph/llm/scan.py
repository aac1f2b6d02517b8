"""Words of many texts at once: 64-bit hashes of byte runs by prefix sums, without an object per word.

A run's hash is a polynomial of its bytes modulo 2**64 taken from two prefix sums, then mixed; a word
of LONG bytes or more is hashed by BLAKE2b instead, since polynomials modulo a power of two agree on
some regular strings of 512 bytes or more, whatever the base. Two different words then share a hash by
accident only, with a chance of about 2**-64 a pair; it is no defence against someone who
solves for a collision. Operators whose contract is exact on words either recheck on the bytes or
state this bound.
"""

from __future__ import annotations

import hashlib

import numpy as np

from quillgraph.llm.common import CHUNK

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: Bytes from which a word is hashed by BLAKE2b.
LONG = 256
#: A-Z to a-z, all else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: All bytes as they are.
PLAIN = np.arange(256, dtype=np.uint8)
#: Bytes that separate words of [^\x20\x09-\x0D]+.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse for i below n at least, kept at the largest length asked for so far."""
    if not _tables or n > len(_tables[0][0]):
        size = max(n, CHUNK + 4096)
        up, down = np.full(size, _BASE, U), np.full(size, _BACK, U)
        up[0] = down[0] = 1
        _tables[0] = (np.cumprod(up, dtype=U), np.cumprod(down, dtype=U))
    return _tables[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def prefix(b: np.ndarray) -> np.ndarray:
    """Sums of (byte + 1) * BASE**i before each position."""
    up, _ = powers(len(b) + 1)
    out = np.empty(len(b) + 1, U)
    out[0] = 0
    np.cumsum((b.astype(U) + U(1)) * up[: len(b)], dtype=U, out=out[1:])
    return out


def run_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte runs start:end."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U))


def edges(b: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end."""
    word = np.zeros(len(b) + 2, np.int8)
    word[1:-1] = ~space[b]
    step = np.diff(word)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def pieces(text: bytes, space: np.ndarray, limit: int = CHUNK) -> list[bytes]:
    """A long text in pieces cut at separators; a word is never cut, however long."""
    if len(text) <= limit:
        return [text]
    out, at, b = [], 0, np.frombuffer(text, np.uint8)
    while len(text) - at > limit:
        cut = np.flatnonzero(space[b[at : at + limit]])
        if len(cut):
            to = at + int(cut[-1]) + 1
        else:
            to = at + limit
            while to < len(text):
                later = np.flatnonzero(space[b[to : to + limit]])
                if len(later):
                    to += int(later[0]) + 1
                    break
                to = min(len(text), to + limit)
        out.append(text[at:to])
        at = to
    return [*out, text[at:]]


def words(texts: list[bytes], space: np.ndarray = SPACE, fold: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and how many each text has."""
    queue = [(i, p) for i, t in enumerate(texts) for p in pieces(t, space)]
    counts, hashes, k = np.zeros(len(texts), np.int64), [], 0
    while k < len(queue):
        a, size = k, 0
        while k < len(queue) and (k == a or size + len(queue[k][1]) < CHUNK):
            size += len(queue[k][1]) + 1
            k += 1
        own = queue[a:k]
        b = fold[np.frombuffer(b" ".join(p for _, p in own), np.uint8)]
        start, end = edges(b, space)
        if len(start):
            offset = np.cumsum([0, *(len(p) + 1 for _, p in own)])
            np.add.at(counts, [i for i, _ in own], np.diff(np.searchsorted(start, offset)))
            found = run_hash(prefix(b), start, end)
            for i in np.flatnonzero(end - start >= LONG).tolist():
                found[i] = int.from_bytes(hashlib.blake2b(b[start[i] : end[i]], digest_size=8).digest(), "little")
            hashes.append(found)
    return (np.concatenate(hashes) if hashes else np.empty(0, U)), counts


def windows(hashes: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words that stay within a text, and how many each text has."""
    each = np.maximum(counts - (n - 1), 0)
    if not each.sum():
        return np.empty(0, U), each
    total = len(hashes) - (n - 1)
    out = np.zeros(total, U)
    for j in range(n):
        out = out * U(_BASE) + hashes[j : j + total]
        out ^= out >> U(29)
    firsts = np.cumsum(counts) - counts
    ok = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(ok, firsts[each > 0], 1)
    np.add.at(ok, (firsts + each)[each > 0], -1)
    return mix(out[np.cumsum(ok[:-1])[:total] > 0]), each
