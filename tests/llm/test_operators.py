"""The ten operators against brute force, round trips and held-out accuracy, and on odd tables."""

import gzip
import hashlib
import io
import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import bpe, decontamination, elias_fano, language, language_model, lines, near_dedup, quality, queries, scan, sharding, substrings, warc
from quillgraph.llm.common import table

SMALL = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")

ODD = [(1, "same text here and there", "en", "s", 1), (1, "same text here and there", "en", "s", 1), (2, None, None, None, None), (3, "", "en", "s", 0), (None, "one two three four five six seven eight nine ten eleven", "de", "t", 9), (4, "é ü\n\nö " * 400, "de", None, 5), (5, "x" * 3000, "en", "s", 3000)]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, COLUMNS).withColumn("n_words", F.lit("clash")).withColumn("score", F.lit("clash"))


@pytest.fixture(scope="module")
def empty(odd):
    return odd.filter("false")


def copies(seed=0, n=60):
    """Texts with near copies of one base at many distances, chains of edits, and unrelated ones."""
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 999)}" for _ in range(120)]
    out = []
    for i in range(n):
        w = base[:]
        for _ in range(rng.randint(0, 8)):
            w[rng.randrange(len(w))] = f"n{rng.randint(0, 9999)}"
        out.append(" ".join(w))
    chain = [f"c{rng.randint(0, 999)}" for _ in range(150)]
    for _ in range(20):
        chain = chain[:]
        chain[rng.randrange(len(chain))] = f"z{rng.randint(0, 9999)}"
        out.append(" ".join(chain))
    out += [" ".join(f"r{rng.randint(0, 99999)}" for _ in range(rng.randint(1, 60))) for _ in range(30)]
    return out


def brute_components(texts, n, percent):
    sets = [near_dedup.shingles_of(t.encode(), n) for t in texts]
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return [root(i) for i in range(len(texts))]


@pytest.mark.parametrize(("n", "percent", "chunk"), [(3, 85, 1000), (5, 80, 1000), (3, 85, 20)])
def test_near_dedup(spark, monkeypatch, n, percent, chunk):
    monkeypatch.setattr(near_dedup, "CLUSTER_ROWS", chunk)
    monkeypatch.setattr(near_dedup, "BUCKET_ROWS", chunk)
    texts = copies()
    texts += texts[3:6]
    got = near_dedup.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), n, percent).collect()
    want = brute_components(texts, n, percent)
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(want))
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(near_dedup.shingles_of(t.encode(), n)) for i, t in enumerate(texts)}


def test_near_dedup_at_the_threshold_and_long(spark):
    """Pairs exactly at 85 % link, those just below do not; sets are of whole texts."""
    base = [f"w{i}" for i in range(102)]  # 100 shingles of 3
    cut_ = lambda k: " ".join(base[: 102 - k])  # noqa: E731  keeps 100 - k shingles, all of them the base's
    long = [f"l{i}" for i in range(250_000)]
    texts = [cut_(0), cut_(15), cut_(16) + "x", " ".join(long), " ".join([*long[:-5], "a", "b"]), " ".join(long[:120_000])]
    got = {r.doc_id: r for r in near_dedup.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 3, 85).collect()}
    assert got[1].n_shingles == 85 and got[1].component_id == 0
    assert got[2].component_id == brute_components(texts[:3], 3, 85)[2]
    assert got[3].n_shingles == 249_998 and got[4].component_id == 3 and got[5].component_id == 5


def test_near_dedup_finds_all_links_of_the_tables(spark):
    """Recall against brute force, by shared shingles, over a whole table: every link."""
    if not os.path.isdir(SMALL):
        pytest.skip("no test data")
    rows = [(r.doc_id, r.text or "") for r in table(spark, SMALL, "documents", "doc_id", "text").collect()]
    got = {r.doc_id: r.component_id for r in near_dedup.groups(table(spark, SMALL, "documents", "doc_id", "text"), 3, 85).collect()}
    want = brute_components([t for _, t in rows], 3, 85)
    first = {}
    for (i, _), c in zip(rows, want, strict=True):
        first[c] = min(first.get(c, i), i)
    assert got == {i: first[c] for (i, _), c in zip(rows, want, strict=True)}


def test_spanning_links_join_what_is_alike():
    import numpy as np

    rng = random.Random(5)
    for _ in range(30):
        n = rng.randint(1, 30)
        comp = np.array([rng.randint(0, 8) for _ in range(n)]) * 7
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(0, 25))]

        def hits(label, pairs=pairs):
            for k in range(0, len(pairs), 4):
                own = [(x, y) for x, y in pairs[k : k + 4] if label[x] != label[y]]
                if own:
                    yield tuple(np.array(c) for c in zip(*own, strict=True))

        links = near_dedup._spanning(np.arange(n), comp, hits).to_pydict()
        up = {int(c): int(c) for c in comp}

        def root(x, up=up):
            while up[x] != x:
                x = up[x]
            return x

        joined = lambda ps: [up.update({max(a, b): min(a, b)}) for x, y in ps for a, b in [(root(int(comp[x])), root(int(comp[y])))] if a != b]
        made = joined(zip(links["u"], links["v"], strict=True))
        assert len(made) == len(links["u"])  # no link is spare
        assert not joined(pairs)  # and none is missing


def test_near_dedup_odd(odd, empty):
    got = near_dedup.groups(odd, 3, 85).collect()
    assert len(got) == len(ODD) and {r.component_id for r in got if r.doc_id == 1} == {1} and all(r.n_shingles == 0 and r.kept for r in got if r.doc_id in (2, 3))
    assert near_dedup.groups(empty).count() == 0


def test_near_dedup_repeated_ids_join_their_groups(spark):
    a, b = "alpha beta gamma delta epsilon zeta eta theta", "one two three four five six seven eight"
    got = near_dedup.groups(spark.createDataFrame([(9, a), (9, b), (2, a), (5, b)], "doc_id long, text string"), 3, 85).collect()
    assert {r.component_id for r in got} == {2}


def brute_removed(texts, size=200):
    seen = Counter(t[i : i + size] for t in texts for i in range(len(t) - size + 1))
    out = []
    for t in texts:
        gone, e = [False] * len(t), 0
        for s in range(len(t) - size + 1):
            if seen[t[s : s + size]] > 1:
                for j in range(max(s, e), s + size):
                    gone[j] = True
                e = s + size
        out.append(gone)
    return out


def spans(gone):
    return sum(1 for j, g in enumerate(gone) if g and (not j or not gone[j - 1]))


def test_substrings(spark):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    p, q = word(260), word(210)
    texts = [word(300) + p + word(50), word(20) + p, q, q + word(5), word(400), p[:199], p[30:235] + q[3:205], "ab" * 400, "é" * 230, word(100) + "x" * 201, "x" * 199, q, p[:150] + word(60) + p[150:]]
    got = {r.doc_id: r for r in substrings.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    raw = [t.encode() for t in texts]
    for i, gone in enumerate(brute_removed(raw)):
        kept = bytes(b for b, g in zip(raw[i], gone, strict=True) if not g)
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(raw[i]), sum(gone), spans(gone), hashlib.sha256(kept).hexdigest())
        assert sum(s.end - s.start for s in r.spans) == r.n_removed


def test_substrings_long_text(spark, monkeypatch):
    rng = random.Random(8)
    t = "".join(rng.choice("abcdefgh ") for _ in range(30_000))
    texts = [t, t[7_000:7_500], t[14_900:15_200] + "zz"]
    monkeypatch.setattr(substrings, "CHUNK", 5_000)
    whole, _ = substrings.anchors([t.encode()])
    assert sum((whole.high - whole.low + 1).tolist()) == len(t) - 199
    got = {r.doc_id: r for r in substrings.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i].n_removed for i in range(3)] == [800, 500, 300]


def test_substrings_odd(odd, empty):
    clash = odd.withColumn("n_bytes", F.lit("x")).withColumn("spans", F.lit("x")).withColumn("kept_sha256", F.lit("x"))
    assert substrings.remove_repeats(clash).filter("n_removed = 3000").count() == 1
    got = substrings.remove_repeats(odd).collect()
    assert len(got) == len(ODD) and {r.n_removed for r in got if r.doc_id == 5} == {3000} and {r.n_bytes for r in got if r.doc_id in (2, 3)} == {0}
    assert substrings.remove_repeats(empty).count() == 0


def brute_model(train):
    tok = [t.encode().lower().split() + [None] for t in train]
    c1, c2, c3 = (Counter(x for t in tok for x in zip(*(t[i:] for i in range(k)), strict=False)) for k in (1, 2, 3))
    n, v = sum(c1.values()), len(c1)
    p1 = lambda w: (c1[w,] + 1) / (n + v + 1)
    p2 = lambda a, w: (c2[a, w] + language_model.MU2 * p1(w)) / (c1[a,] + language_model.MU2)
    p3 = lambda a, b, w: (c3[a, b, w] + language_model.MU3 * p2(b, w)) / (c2[a, b] + language_model.MU3)
    return c1, n, v, p1, p2, p3


def model_score(text, p1, p2, p3):
    w = text.encode().lower().split() + [None]
    return math.log10(p1(w[0])) + (math.log10(p2(w[0], w[1])) if len(w) > 1 else 0) + sum(math.log10(p3(*x)) for x in zip(w, w[1:], w[2:], strict=False))


@pytest.mark.parametrize("share", [language_model.SHARE, 60])  # a small share: hot contexts are spread, questions come in chunks
def test_language_model(spark, share):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(30)] + ["z" * 300]
    make = lambda: " ".join(rng.choice(vocab[: rng.randint(2, 31)]) for _ in range(rng.randint(0, 40)))
    train = [make() for _ in range(80)] + [None, "w0 w1 " * 200]
    tests = [make() for _ in range(20)] + ["unseen words w1 w2 w3", "", "w1", "w1 " * 3000 + "w2 unseen " * 500, train[-1]]
    model = language_model.train_model(spark.createDataFrame([(t,) for t in train], "text string").repartition(3), share)
    c1, n, v, p1, p2, p3 = brute_model([t or "" for t in train])
    assert (model.total, model.size) == (n, v)
    assert any(int(f.split("-")[1]) >= model.parts for f in model.files) == (share == 60)
    got = {r.i: r for r in language_model.score(spark.createDataFrame(list(enumerate(tests)), "i int, text string").repartition(4), model).collect()}
    for i, t in enumerate(tests):
        w = t.encode().lower().split() + [None]
        assert got[i].n_tokens == len(w) and got[i].n_known == sum(c1[x,] > 0 for x in w)
        assert got[i].base_score == pytest.approx(sum(math.log10((c1[x,] + 1) / (n + v + 1)) for x in w))
        assert abs(got[i].score - model_score(t, p1, p2, p3)) <= 0.05 * len(w)
    # probabilities of all words after a context add up to one
    for a, b in (("w1", "w2"), ("w3", "w0")):
        assert sum(p3(a.encode(), b.encode(), x[0]) for x in c1) + p3(a.encode(), b.encode(), b"never") == pytest.approx(1)


@pytest.mark.parametrize("tops", [(3, 5), (1 << 20, 1 << 21), (40, 1 << 40, 1 << 35), (1 << 63, 4), (0, 0)])  # one word of 64 bits, two rounds, too wide
@pytest.mark.parametrize("n", [0, 1, 2, 5000])
def test_order_of_keys_and_places(tops, n):
    rng = np.random.default_rng(n)
    keys = [rng.integers(0, top, n, np.uint64, endpoint=True) for top in tops]
    assert language_model.order_of(*keys).tolist() == np.lexsort(keys[::-1]).tolist()
    first, number = language_model.distinct(keys[0], keys[1])
    pairs = list(zip(keys[0].tolist(), keys[1].tolist(), strict=True))
    assert [pairs[i] for i in first] == sorted(set(pairs)) and [pairs[first[i]] for i in number] == pairs


def test_sequence_longer_than_a_piece():
    values = np.cumsum(np.random.default_rng(1).integers(1, 1000, 40_000)).astype(np.uint64)
    held = elias_fano.EliasFano.of(values)
    assert (held.get(np.arange(len(values))) == values).all()
    asked = np.concatenate([values, values + np.uint64(1)])
    at = dict(zip(values.tolist(), range(len(values)), strict=True))
    assert held.find(asked).tolist() == [at.get(x, -1) for x in asked.tolist()]


def test_language_model_lost_file(spark):
    model = language_model.train_model(spark.createDataFrame([("one two three four",), ("two three four five",)], "text string"))
    docs = spark.createDataFrame([(1, "one two three four")], "doc_id long, text string")
    assert language_model.score(docs, model).count() == 1
    for kind in ("words", "pairs", "triples"):
        lost = sorted(f for f in model.files if f.startswith(kind))
        broken = [model.folder.removeprefix("file://") + "/" + f for f in lost]
        held = [open(f, "rb").read() for f in broken]
        for f in broken:
            os.remove(f)
        with pytest.raises(Exception, match="FileNotFoundError|No such file"):
            language_model.score(docs, model).collect()
        for f, data in zip(broken, held, strict=True):
            with open(f, "wb") as out:
                out.write(data[:-8])
        with pytest.raises(Exception, match="of the model has"):
            language_model.score(docs, model).collect()
        for f, data in zip(broken, held, strict=True):
            with open(f, "wb") as out:
                out.write(data)


def test_op1_against_counts(spark, tmp_path):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(12)]
    docs = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 30)))) for i in range(60)] + [(None, "w1 w2"), (7, None), (7, "w3 w4"), (7, "w3 w4")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op1_lm"](spark, str(tmp_path)).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c1, n, v, p1, p2, p3 = brute_model([t or "" for i, t in docs if not held(i)])
    want = sorted((str(i), held(i), len((t or "").split()) + 1, round(sum(math.log10((c1[x,] + 1) / (n + v + 1)) for x in [*(t or "").encode().split(), None]), 6)) for i, t in docs)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, round(r.base_score, 6)) for r in got) == want and {r.train_tokens for r in got} == {n}
    texts = dict(docs[:60])
    assert all(abs(r.score - model_score(texts[r.doc_id], p1, p2, p3)) <= 0.05 * r.n_tokens for r in got if r.doc_id in texts and r.doc_id != 7)


@needs_data
def test_op1_counts_of_a_whole_table(spark):
    docs = [(r.doc_id, (r.text or "").encode().lower().split()) for r in table(spark, SMALL, "documents", "doc_id", "text").collect()]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(x for i, w in docs if not held(i) for x in [*w, None])
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in queries.QUERIES["op1_lm"](spark, SMALL).collect()}
    assert len(got) == len(docs)
    for i, w in docs:
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(w) + 1, sum(c[x] > 0 for x in [*w, None]), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in [*w, None]))


def test_language_model_odd(odd, empty):
    model = language_model.train_model(odd)
    got = language_model.score(odd, model).collect()
    assert len(got) == len(ODD) and {r.n_tokens for r in got if r.doc_id in (2, 3)} == {1}
    nothing = language_model.train_model(empty)
    assert nothing.total == 0 and all(r.n_known == 0 for r in language_model.score(odd, nothing).collect())
    assert language_model.score(empty, model).count() == 0


@needs_data
def test_language_model_beats_unigrams(spark):
    held = [r for r in queries.QUERIES["op1_lm"](spark, SMALL).collect() if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lines(spark, odd, empty):
    rows = [(i, f"menu\nline {i}\n\n menu ", "h" if i < 30 else None) for i in range(40)] + [(99, "menu\nx", "small"), (100, None, "h")]
    got = {r.doc_id: r for r in lines.drop_lines(spark.createDataFrame(rows, "doc_id long, text string, source string"), min_pages=10).collect()}
    assert got[0].text == "line 0\n" and (got[0].n_lines, got[0].n_dropped) == (4, 2) and got[35].n_dropped == 2
    assert got[99].n_dropped == 0 and got[100].text is None and got[100].n_lines == 0
    assert lines.drop_lines(odd).count() == len(ODD) and lines.drop_lines(empty).count() == 0


def test_lines_of_small_hosts(spark):
    sizes = {"one": 1, "two": 2, "ten": 10, "nineteen": 19, "twenty": 20}
    rows = [(f"{h}{i}", "\n".join(["menu", f"own {h} {i}", *(["some"] if i < 2 else [])]), h) for h, n in sizes.items() for i in range(n)]
    got = {r.doc_id: r.text.split("\n") for r in lines.drop_lines(spark.createDataFrame(rows, "doc_id string, text string, source string")).collect()}
    for h, n in sizes.items():
        on = Counter(x for d, t, s in rows if s == h for x in t.split("\n"))
        assert all(got[d] == [x for x in t.split("\n") if on[x] < 2 or on[x] <= 0.1 * n] for d, t, s in rows if s == h)
    assert got["nineteen0"] == ["own nineteen 0"] and got["twenty0"] == ["own twenty 0", "some"] and got["one0"][0] == "menu"


def test_lines_salted_join_is_the_same(spark, monkeypatch):
    from quillgraph.llm import common

    docs = spark.createDataFrame([(i, f"menu\nline {i}", f"h{i % 3}" if i % 4 else None) for i in range(200)], "doc_id long, text string, source string")
    want = sorted(map(tuple, lines.drop_lines(docs).collect()), key=repr)
    monkeypatch.setattr(common, "BROADCAST_ENTRIES", 0)  # hot hosts are salted
    assert sorted(map(tuple, lines.drop_lines(docs).collect()), key=repr) == want
    monkeypatch.setattr(common, "BROADCAST_ENTRIES", 3)  # hot hosts are broadcast, the null host among them
    monkeypatch.setattr(common, "HOT_SHARE", 0.24)
    assert sorted(map(tuple, lines.drop_lines(docs).collect()), key=repr) == want
    monkeypatch.setattr(common, "HOT_SHARE", 2)  # no host is hot
    assert sorted(map(tuple, lines.drop_lines(docs).collect()), key=repr) == want


def test_lines_at_the_ratio_tabs_and_clashes(spark):
    rows = [(i, "\n".join(["ten", *(["eleven"] if i < 11 else []), "\tpad" if i % 2 else "pad"])[(4 if i >= 10 else 0) :], "h") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("boiler", F.lit(1)).withColumn("n_lines", F.lit("x")).withColumn("n_dropped", F.lit("x")).withColumn("h", F.lit(2))
    got = {r.doc_id: r for r in lines.drop_lines(docs).collect()}
    assert got[0].text == "ten" and got[0].n_dropped == 2 and got[50].text == "" and got[0].boiler == 1 and got[0].h == 2
    long = "\n".join(f"own {i}" for i in range(200_000)) + "\nmenu"
    got = lines.drop_lines(spark.createDataFrame([(1, long, "s"), (2, "menu\nx", "s")], "doc_id long, text string, source string")).collect()
    assert {r.doc_id: (r.n_lines, r.n_dropped) for r in got} == {1: (200_001, 1), 2: (2, 1)}


def brute_hits(text, items, n=10):
    w = decontamination.normal_words(text.encode())
    hit, found = set(), set()
    for key, item in items:
        x = decontamination.normal_words(item.encode())
        for i in range(max(0, len(x) - n) + 1 if x else 0):
            s = x[i : i + n]
            for j in range(len(w) - len(s) + 1):
                if w[j : j + len(s)] == s:
                    hit.update(range(j, j + len(s)))
                    found.add(str(key))
    found.discard("None")
    return len(w), len(hit), sorted(found)


def test_decontamination(spark, odd, empty):
    rng = random.Random(4)
    items = [(i, " ".join(f"k{rng.randint(0, 4)}" for _ in range(rng.randint(0, 14)))) for i in range(12)] + [(50, "Quite, a-SHORT é"), (51, None), (52, "!!"), (53, "quite a short É"), (None, "nameless item"), (50, "k1 k1")]
    docs = [(i, " ".join(f"K{rng.randint(0, 4)}," for _ in range(200))) for i in range(5)] + [(7, "x " + (items[0][1] or "") + " y quite a short É quite-a.short.é"), (8, None), (9, ""), (10, "a Nameless, item"), (11, ("k1 " * 900 + "other ") * 50)]
    b = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit("clash"))
    got = {r.doc_id: r for r in decontamination.hits(d, b).collect()}
    for i, t in docs[:9]:
        want = brute_hits(t or "", [(k, x or "") for k, x in items])
        assert (got[i].n_words, got[i].n_hit, got[i].items) == want
        raw = (t or "").encode()
        assert sum(len(decontamination.normal_words(raw[s.start : s.end])) for s in got[i].spans) == got[i].n_hit
    assert (got[10].n_hit, got[10].items) == (2, []) and (got[11].n_words, got[11].n_hit) == (45_050, 45_000) and "50" in got[11].items
    clean = {r.doc_id for r in decontamination.clean(d, b).collect()}
    assert clean == {i for i in got if got[i].n_hit == 0}
    assert decontamination.hits(odd, b).count() == len(ODD) and decontamination.hits(empty, b).count() == 0
    assert decontamination.hits(d, b.filter("false")).filter("n_hit > 0").count() == 0
    with pytest.raises(Exception, match="more than 9 bytes of items"):
        decontamination.build(b, most=9)


@pytest.mark.parametrize("stretch", [1, 7, 64])
def test_automaton(monkeypatch, stretch):
    monkeypatch.setattr(decontamination, "STRETCH", stretch)
    rng = random.Random(stretch)
    make = lambda n, k: " ".join(f"k{rng.randint(0, k)}" for _ in range(n))
    items = [(str(i), make(rng.randint(0, 9), 2)) for i in range(15)]
    machine = decontamination.Automaton(decontamination.load(__import__("numpy").frombuffer(decontamination.dump(*decontamination.Automaton.build(((i, t.encode()) for i, t in items), 4)), "u1")))
    texts = [make(rng.randint(0, 300), 3) for _ in range(12)]
    counts, found = decontamination.scanned([t.encode() for t in texts], machine)
    names = machine.item_names()
    for i, t in enumerate(texts):
        runs, which = found.get(i, ([], []))
        items_met = sorted({names[k] for e in which for k in machine.items[machine.first[e] : machine.first[e + 1]]})
        assert (int(counts[i]), sum(b - a for a, b in runs), items_met) == brute_hits(t, items, 4)


def test_automaton_of_a_large_collection():
    """Items above any block of texts still make one automaton, of 13 bytes a state."""
    rng = random.Random(1)
    items = [(str(i), " ".join(f"w{rng.randint(0, 5000)}" for _ in range(400)).encode()) for i in range(500)]
    arrays = decontamination.Automaton.build(iter(items))
    machine = decontamination.Automaton(arrays)
    assert sum(a.nbytes for a in (machine.keys, machine.fail, machine.marked)) <= 13 * (len(machine.keys) + 1)
    _, found = decontamination.scanned([b" ".join(t.split()[50:80]) for _, t in items[::50]], machine)
    assert all(found[i][0] == [(0, 30)] for i in range(10))


def test_words_of_regular_patterns(spark):
    """Two words whose letters follow the Thue-Morse pattern and its complement are told apart at any length."""
    for size in (128, 256, 512, 1024, 2048, 4096):
        one = "".join("ab"[bin(i).count("1") & 1] for i in range(size))
        other = one.translate(str.maketrans("ab", "ba"))
        h, _ = scan.words([one.encode(), other.encode()])
        assert h[0] != h[1]
        assert int(quality.features([f"{one} {other} p q r {other} {one} p q r".encode()])[4][0]) == 0
        assert len(near_dedup.shingle_sets([f"x y {one} z x y {other} z".encode()], 3)[0]) == 6
    train, docs = spark.createDataFrame([(one,)], "text string"), spark.createDataFrame([(other,)], "text string")
    assert language_model.score(docs, language_model.train_model(train)).first().n_known == 1


def test_warc_reader():
    a, b = warc.page_record(1, "http://x/ y", b"hello" * 100, warc.sha1_base32(b"hello" * 100), None, True), warc.page_record(2, None, b"", warc.sha1_base32(b""), 3, False)
    got = list(warc.read_records(io.BytesIO(a + b)))
    assert [h["warc-type"] for h, _ in got] == ["response", "revisit"] and warc.payload_of(got[0][1]) == b"hello" * 100 and got[1][0]["x-refers-to-page"] == "3"
    for bad in (a[:-9], a[:50] + b"zz" + a[52:], gzip.compress(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n"), gzip.compress(b"hello"), gzip.compress(gzip.decompress(a).replace(b"hellohello", b"hellohellO", 1)), zlib.compress(b"x")):
        with pytest.raises(warc.WarcError):
            list(warc.read_records(io.BytesIO(bad)))


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "u1", "same"), (2, "u2", "same"), (5, "u5", "same"), (3, None, None), (4, "u4", ""), (6, "u6", "ünique " * 50_000), (7, "u7", "b")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))
    folder = f"file://{tmp_path}/w"
    found = warc.write_archives(pages, folder, roll=2000)
    archives = spark.createDataFrame(found.collect(), found.schema)
    got = {r.page_id: r for r in warc.read_archives(archives, folder).collect()}
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {1: ("revisit", 5), 2: ("revisit", 5), 5: ("response", None), 3: ("revisit", 4), 4: ("response", None), 6: ("response", None), 7: ("response", None)}
    for i, _, html in rows:
        raw = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), warc.sha1_base32(raw)) and (got[i].payload is None or bytes(got[i].payload) == raw)
    clash = pages.withColumn("refers_to", F.lit(1)).withColumn("n_same", F.lit(1)).withColumn("_digest", F.lit("x")).withColumn("_salt", F.lit(1))
    again = warc.write_archives(clash.union(clash.filter("page_id = 5")), f"{folder}2")
    done = [(r.page_id, r.record_type, r.refers_to) for r in warc.read_archives(spark.createDataFrame(again.collect(), again.schema), f"{folder}2").collect()]
    assert Counter(done)[(5, "response", None)] == 2 and len(done) == len(rows) + 1 and (1, "revisit", 5) in done
    none = warc.write_archives(pages.filter("false"), folder)
    assert none.count() == 0


def test_bpe(spark, odd, empty):
    enc = bpe.encoding(*bpe.default_ranks())
    rng = random.Random(6)
    long = "".join(rng.choice(["word ", "don't", "  ", "\n\n", "12345", "é!", " ", "¿"]) for _ in range(4000))
    unspaced = "".join(rng.choice(["字", "。", "か", "é", ",", "'s", "'", "d", "ll", "한", "!", "7", "\n", "١", "ж", "\u3000", "\x1c"]) for _ in range(6000))
    for text in (long, unspaced):
        for size in (1, 50, 333, 1000):
            assert [i for p in bpe.pieces(text, size) for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text) == bpe.encode(enc, text, size)
    assert max(map(len, bpe.pieces("字。" * 50_000, 1000))) < 1100 and max(map(len, bpe.pieces("字。\n" * 50_000, 1000))) < 1100
    whole = bpe.encoding(bpe.default_ranks()[0], r"[\s\S]")
    assert bpe.encode(whole, "字。" * 300, 10) == whole.encode_ordinary("字。" * 300)
    clash = bpe.tokens(odd.withColumn("token_ids", F.lit(1)).withColumn("decoded", F.lit(1))).collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in clash)
    texts = [t or "" for _, t, *_ in ODD]
    got = bpe.digests(odd).collect()
    assert Counter(r.decoded_sha256 for r in got) == Counter(hashlib.sha256(t.encode()).hexdigest() for t in texts)
    assert Counter(r.n_tokens for r in got) == Counter(len(enc.encode_ordinary(t)) for t in texts)
    whole = bpe.tokens(odd).collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() and "n_words" in r.asDict() for r in whole)
    assert bpe.digests(empty).count() == 0 and bpe.tokens(empty).count() == 0


@needs_data
def test_op5_against_the_library(spark):
    enc = bpe.encoding(*bpe.default_ranks())
    texts = {r.doc_id: r.text or "" for r in table(spark, SMALL, "documents", "doc_id", "text").collect()}
    for r in queries.QUERIES["op5_bpe"](spark, SMALL).collect():
        ids = enc.encode_ordinary(texts[r.doc_id])
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


@needs_data
def test_language(spark, odd, empty):
    got = {r.doc_id: r for r in queries.QUERIES["op6_language"](spark, SMALL).collect()}
    lang = {r.doc_id: r.lang for r in table(spark, SMALL, "documents").collect()}
    held = [i for i in got if got[i].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= got[i].score <= 1 for i in got)
    assert sum(got[i].lang_pred == lang[i] for i in held) >= 0.9 * len(held)
    langs, matrix = language.profiles(odd)
    out = {r.doc_id: r for r in language.identify(odd, langs, matrix).collect()}
    assert out[2].lang_pred == out[3].lang_pred == "und" and out[4].lang_pred == "de"
    nothing = language.profiles(empty)
    assert nothing[0] == [] and language.identify(odd, *nothing).filter("lang_pred <> 'und'").count() == 0 and language.identify(empty, langs, matrix).count() == 0


def test_language_vectors():
    keys, n = language.grams("aba b")
    v = language.Vectors(256)
    plain = sum(c * v._make(k) for k, c in zip(keys.tolist(), n.tolist(), strict=True))
    assert abs(v.bundle(keys, n) - plain).max() == 0
    a, b = language.grams("x y! Zé" * 100_000), language.grams(("x y! Zé" * 100_000).lower())
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all()
    assert len(language.grams("123 !!")[0]) == 0


def brute_grams(text):
    s = [0]
    for c in [ord(c.lower()) if c.isalpha() and len(c.lower()) == 1 else ord(c) if c.isalpha() else 0 for c in text] + [0]:
        if c or s[-1]:
            s.append(c)
    return Counter((a << 42) | (b << 21) | c for a, b, c in zip(s, s[1:], s[2:], strict=False) if a or b or c)


@pytest.mark.parametrize("step", [1, 2, 5, 1 << 18])
def test_grams_of_long_texts(monkeypatch, step):
    monkeypatch.setattr(language, "STEP", step)
    rng = random.Random(step)
    for text in ["", "a", "!", "a!b", "x" * 40, *("".join(rng.choice("aBé 1!Ω") for _ in range(rng.randint(1, 60))) for _ in range(40))]:
        keys, n = language.grams(text)
        assert dict(zip(keys.tolist(), n.tolist(), strict=True)) == dict(brute_grams(text))


def test_identify_against_plain_sums(spark):
    """Predictions by the operator's vectors, but with plain sums over every gram of every text."""
    import numpy as np

    rng = random.Random(12)
    words = {"aa": ["kala", "mato", "susi"], "bb": ["brzt", "ghul", "yyx"], "cc": ["lorem", "ipsu", "amet"]}
    rows = [(i, " ".join(rng.choice(words[k] + ["common"]) for _ in range(rng.randint(1, 12))), k) for i, k in enumerate(rng.choice(list(words)) for _ in range(60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang_pred", F.lit("clash"))
    got = {r.doc_id: r for r in language.identify(docs, *language.profiles(docs.repartition(3))).collect()}
    vectors = language.Vectors()
    plain = lambda t: sum(c * vectors._make(k).astype(float) for k, c in brute_grams(t).items())
    sums = {k: sum(plain(t) for _, t, own in rows if own == k) for k in words}
    for i, t, _ in rows:
        v = plain(t)
        cosine = {k: float(v @ s / np.linalg.norm(v) / np.linalg.norm(s)) for k, s in sums.items()}
        assert got[i].lang_pred == max(sorted(cosine), key=cosine.get) and abs(got[i].score - min(1, max(0, cosine[got[i].lang_pred]))) < 1e-6
    same = spark.createDataFrame([(1, "kala", "bb"), (2, "kala", "aa")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language.identify(same, *language.profiles(same)).collect()} == {"aa"}  # ties: first in order


def brute_quality(t):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    rep = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    ls = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(ls) - len(set(ls)), len(rep)


def test_quality(spark, odd, empty):
    rng = random.Random(9)
    texts = ["".join(rng.choice(["a ", "b ", "A ", "é\n", "#", "<x> ", "\n", "a b c d e ", "\x1c "]) for _ in range(rng.randint(0, 60))) for _ in range(80)]
    docs = spark.createDataFrame([(i, t, f"s{i % 3}") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    for r in quality.judge(docs).collect():
        want = brute_quality(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
    assert sorted(r.doc_id for r in quality.keep(docs).collect()) == sorted(r.doc_id for r in quality.judge(docs).filter("kept").collect())
    clash = docs.withColumn("n_words", F.lit("x")).withColumn("host_kept", F.lit("x")).withColumn("_source", F.lit("x")).withColumn("base_failed", F.lit("x"))
    assert quality.keep(clash).columns == clash.columns and quality.keep(clash).count() == quality.keep(docs).count()
    even = spark.createDataFrame([(i, "one two three four five six seven eight nine ten" if i % 2 else "", f"s{i // 20}") for i in range(40)], "doc_id long, text string, source string")
    assert quality.judge(even, bad_host=0.5).filter("kept").count() == 20 and quality.judge(even, bad_host=0.49).filter("kept").count() == 0
    far = " ".join(f"w{i}" for i in range(300_000)) + " w0 w1 w2 w3 w4"
    assert [r.n_repeat_words for r in quality.judge(spark.createDataFrame([(1, far, "s")], "doc_id long, text string, source string")).collect()] == [10]
    assert quality.judge(odd).count() == len(ODD) and quality.judge(empty).count() == 0 and quality.keep(empty).count() == 0


def test_host_verdicts(spark):
    rows = [("bad", i < 95) for i in range(100)] + [("tiny", True)] + [(f"good{i % 20}", i % 17 == 0) for i in range(2000)] + [(None, False)] * 5
    got = {r.source: r for r in quality.host_verdicts(spark.createDataFrame(rows, "source string, base_failed boolean")).collect()}
    assert not got["bad"].host_kept and got["tiny"].host_kept and got[None].host_kept and all(got[f"good{i}"].host_kept for i in range(20))
    assert got["tiny"].shrunk_rate < 1 and got["bad"].shrunk_rate > 0.8


def test_sharding(spark, odd, empty):
    def plain(p, side, keys, total):
        while True:
            left, right = divmod(p, side)
            for k in keys:
                t = (right + k) % sharding.PRIME
                left, right = right, (left + t * t % sharding.PRIME * t % sharding.PRIME) % side
            p = left * side + right
            if p < total:
                return p

    for n in (1, 2, 3, 10, 97, 1000):
        side = math.isqrt(n - 1) + 1
        df = spark.range(n).select(sharding.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(side).cast("long")).alias("p"), "id")
        got = {r.id: r.p for r in df.collect()}
        assert sorted(got.values()) == list(range(n)) and got == {i: plain(i, side, sharding.round_keys(20240229, 6), n) for i in range(n)}
    docs = spark.createDataFrame([(i % 50, "t" * (i % 7)) for i in range(700)], "doc_id long, text string")
    one, two = (sharding.shard(d, 24).collect() for d in (docs, docs.repartition(7)))
    assert sorted(map(repr, one)) == sorted(map(repr, two))
    sizes = Counter(r.shard for r in one)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r.slot for r in one if r.shard == s) == list(range(sizes[s]))
    got = sharding.shard(odd).collect()
    assert len(got) == len(ODD) and {r.size for r in got if r.doc_id in (2, 3)} == {8} and {r.text_crc32 for r in got if r.doc_id == 1} == {zlib.crc32(b"same text here and there")}
    assert sharding.shard(empty).count() == 0
