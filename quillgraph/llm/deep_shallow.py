"""Deep-shallow string sorting: multikey quicksort over the first bytes, blind tries for what still ties.

The shallow part partitions all groups at once by eight bytes at a time (a multikey quicksort whose
symbols are 64-bit words). Groups that agree on `SHALLOW` bytes go to the deep part: a blind trie
branches on single bytes without looking at what lies between, so each string is compared in full
with one other only. Besides the order, both parts give the longest common prefix of neighbours.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 32


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


class BlindTrie:
    """A trie of strings that keeps only branching depths; leaves hold equal strings together."""

    def __init__(self, strings: list[bytes]) -> None:
        self.strings = strings
        self.root: list | None = None  # inner: [depth, {byte or -1: node}]; leaf: (index, ...) as a list of ints after None

    def insert(self, i: int) -> None:
        s = self.strings[i]
        if self.root is None:
            self.root = [None, [i]]
            return
        node = self.root
        while node[0] is not None:
            d, kids = node
            nxt = kids.get(s[d] if d < len(s) else -1)
            node = nxt if nxt is not None else next(iter(kids.values()))
        other = self.strings[node[1][0]]
        lcp = common_prefix(s, other)
        if lcp == len(s) == len(other):
            node[1].append(i)
            return
        parent, key, node = None, None, self.root
        while node[0] is not None and node[0] < lcp:
            parent, key = node, s[node[0]]
            node = node[1][key]
        own = s[lcp] if lcp < len(s) else -1
        if node[0] == lcp:
            node[1][own] = [None, [i]]
            return
        made = [lcp, {own: [None, [i]], (other[lcp] if lcp < len(other) else -1): node}]
        if parent is None:
            self.root = made
        else:
            parent[1][key] = made

    def ordered(self) -> tuple[list[int], list[int]]:
        """Indices in order, and each one's common prefix with the one before (the first: -1)."""
        order: list[int] = []
        lcps: list[int] = []
        stack: list[tuple[list, int]] = [(self.root, -1)]
        while stack:
            node, lcp = stack.pop()
            if node[0] is None:
                own = node[1]
                order += own
                lcps.append(lcp)
                lcps += [len(self.strings[own[0]])] * (len(own) - 1)
            else:
                keys = sorted(node[1], reverse=True)
                for k in keys[:-1]:
                    stack.append((node[1][k], node[0]))
                stack.append((node[1][keys[-1]], lcp))
        return order, lcps


def sort(strings: list[bytes], group: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings by (group, string), and each one's common prefix with the one before it; -1 where a group starts."""
    n = len(strings)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    size = np.fromiter(map(len, strings), np.int64, n)
    order = np.argsort(group, kind="stable")
    g = group[order]
    label = np.cumsum(np.concatenate([[0], g[1:] != g[:-1]]))
    lcp = np.where(np.concatenate([[True], label[1:] != label[:-1]]), -1, 0)
    head = np.frombuffer(b"".join(s[:shallow].ljust(shallow, b"\0") for s in strings), np.uint8).reshape(n, shallow)
    words = head.view(">u8").astype(np.uint64).reshape(n, shallow // 8)
    for k in range(shallow // 8):
        starts = np.concatenate([[True], label[1:] != label[:-1], [True]])
        at = np.flatnonzero(~(starts[:-1] & starts[1:]))  # in groups of two or more
        if k:
            at = at[size[order[at]] >= 8 * k]  # strings that ended are equal in their group
        if not len(at):
            break
        own = order[at]
        word, left = words[own, k], np.minimum(size[own] - 8 * k, 8)
        p = np.lexsort((left, word, label[at]))
        order[at], word, left = own[p], word[p], left[p]
        lab = label[at]
        new = np.zeros(n, np.int64)
        differs = (lab[1:] == lab[:-1]) & ((word[1:] != word[:-1]) | (left[1:] != left[:-1]))
        if differs.any():
            x = word[1:] ^ word[:-1]
            zero = np.zeros(len(x), np.int64)
            for s in (56, 48, 40, 32, 24, 16, 8, 0):  # equal leading bytes
                zero += (x >> np.uint64(s)) == 0
            depth = 8 * k + np.minimum(np.minimum(zero, left[1:]), left[:-1])
            j = at[1:][differs]
            lcp[j] = depth[differs]
            new[j] = 1
        label = label + np.cumsum(new)
    starts = np.flatnonzero(np.concatenate([[True], label[1:] != label[:-1]]))
    for a, b in zip(starts, np.concatenate([starts[1:], [n]]), strict=True):
        if b - a > 1:
            own = order[a:b].tolist()
            if len(own) == 2:
                x, y = own
                both = common_prefix(strings[x], strings[y])
                if strings[x] > strings[y]:
                    order[a], order[a + 1] = y, x
                lcp[a + 1] = both
            else:
                trie = BlindTrie(strings)
                for i in own:
                    trie.insert(i)
                ranked, depth = trie.ordered()
                order[a:b], lcp[a + 1 : b] = ranked, depth[1:]
    return order, lcp
