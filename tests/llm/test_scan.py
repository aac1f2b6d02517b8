"""Word scanning, Elias-Fano sequences and string sorting against plain Python."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quillgraph.llm import deep_shallow, scan
from quillgraph.llm.common import pack, unpack
from quillgraph.llm.elias_fano import EliasFano, Level, dump, load

texts = st.lists(st.text(alphabet="aB é\n\t\x0b\x1c ", max_size=40), max_size=8)


@given(texts)
@settings(max_examples=200, deadline=None)
def test_words(xs):
    raw = [x.encode() for x in xs]
    h, n = scan.words(raw)
    want = [t.lower().split() for t in raw]
    assert n.tolist() == [len(w) for w in want]
    flat = [w for ws in want for w in ws]
    assert len(set(flat)) == len(set(h.tolist())) and len(set(zip(flat, h.tolist(), strict=True))) == len(set(flat))
    g, each = scan.windows(h, n, 3)
    shingles = [tuple(w[i : i + 3]) for w in want for i in range(len(w) - 2)]
    assert each.sum() == len(shingles) and len(set(zip(shingles, g.tolist(), strict=True))) == len(set(shingles)) == len(set(g.tolist()))


def test_long_text_is_cut_between_words(monkeypatch):
    rng = random.Random(1)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 30))) for _ in range(2000)] + ["x" * 5000] + ["tail"]
    text = " ".join(words).encode()
    want, n = scan.words([text, b"end"])
    monkeypatch.setattr(scan, "CHUNK", 700)
    parts = scan.pieces(text, scan.SPACE, 700)
    assert b"".join(parts) == text and len(parts) > 10
    got = [scan.words([p])[0] for p in parts]
    assert np.array_equal(np.concatenate(got), want[:-1]) and n.tolist() == [len(words), 1]


@given(st.lists(st.integers(0, 2**40), max_size=60))
@settings(max_examples=150, deadline=None)
def test_elias_fano(xs):
    v = np.unique(np.array(xs, np.uint64))
    e = EliasFano(*load(np.frombuffer(dump(*EliasFano.of(v).arrays), np.uint8)))
    assert np.array_equal(e.get(np.arange(len(v))), v)
    keys = np.concatenate([v, v + np.uint64(1), np.array([0, 2**41, 2**50], np.uint64)])
    at = {int(x): i for i, x in enumerate(v)}
    assert e.find(keys).tolist() == [at.get(int(k), -1) for k in keys]


def test_elias_fano_dense_and_clustered():
    for v in (np.arange(5000), np.concatenate([np.arange(3000), [10**15, 10**15 + 1]]), np.arange(0, 10**12, 10**9)):
        e = EliasFano.of(v)
        assert np.array_equal(e.get(np.arange(len(v))), v.astype(np.uint64)) and np.array_equal(e.find(v), np.arange(len(v)))


@given(st.sets(st.tuples(st.integers(0, 9), st.integers(0, 50)), max_size=40))
@settings(max_examples=100, deadline=None)
def test_level(pairs):
    pairs = sorted(pairs)
    p, c = np.array([x[0] for x in pairs], np.int64), np.array([x[1] for x in pairs], np.int64)
    level = Level(Level.of(p, c))
    if pairs:
        assert [tuple(x) for x in zip(*(y.tolist() for y in level.unrolled()), strict=True)] == pairs
    rank = level.parents.find(np.repeat(np.arange(12), 53))
    child = np.tile(np.arange(53), 12)
    place = level.find(rank, child)
    at = {x: i for i, x in enumerate(pairs)}
    assert place.tolist() == [at.get((a, b), -1) for a in range(12) for b in range(53)]
    hit = place >= 0
    first = {a: min(i for (x, _), i in at.items() if x == a) for a, _ in pairs}
    assert level.relative(rank[hit], place[hit]).tolist() == [at[x] - first[x[0]] for x in pairs]


strings = st.lists(st.binary(max_size=12) | st.text(alphabet="ab\0", max_size=60).map(str.encode), max_size=25)


@given(strings, st.integers(1, 3))
@settings(max_examples=250, deadline=None)
def test_deep_shallow(xs, n_groups):
    group = np.arange(len(xs)) % n_groups
    order, lcp = deep_shallow.sort(xs, group, 8)
    got = [(int(group[i]), xs[i]) for i in order.tolist()]
    assert got == sorted((int(g), x) for g, x in zip(group, xs, strict=True))
    for k in range(1, len(got)):
        same = got[k][0] == got[k - 1][0]
        assert lcp[k] == (deep_shallow.common_prefix(got[k][1], got[k - 1][1]) if same else -1)


def test_blind_trie_alone():
    rng = random.Random(5)
    xs = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 9))).encode() for _ in range(300)]
    t = deep_shallow.BlindTrie(xs)
    for i in range(len(xs)):
        t.insert(i)
    order, lcps = t.ordered()
    assert [xs[i] for i in order] == sorted(xs)
    assert lcps[1:] == [deep_shallow.common_prefix(xs[a], xs[b]) for a, b in zip(order, order[1:], strict=False)]


def test_packing():
    arrays = [np.arange(5, dtype=np.uint64), np.empty(0, np.uint16), np.array([1, 2**40], np.int64)]
    assert all(np.array_equal(a, b) and a.dtype == b.dtype for a, b in zip(arrays, unpack(pack(*arrays)), strict=True))
