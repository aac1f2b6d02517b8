"""Near-duplicate groups: many universal hash minima, banding, verification, star components.

Documents with equal shingle sets become one representative first, so exact copies cost one row
each and no pair. Representatives that share a band are candidates. A bucket is not expanded into
pairs: its members are first compared with the bucket's smallest only (signature estimate, then the
words' full sets); a large bucket is dealt to groups with centres of their own first. Where members are then still in different components, alike ones are gathered in
clusters, and a cluster's components are compared on full sets, in blocks of bounded size. All that
these steps return is links that join components, fewer than there are members.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import arrow_batches, discard, fresh_dir, kept_in, slices, table, text_bytes
from quillgraph.operators.components import components
from quillgraph.llm.scan import mix, windows, words

BANDS = 32
ROWS = 5
#: A pair goes on to the exact comparison if its signatures agree in (threshold - MARGIN) of all places: five standard deviations.
MARGIN = 0.16
#: Members of a bucket, and of a cluster, that one chunk holds; a task compares two chunks.
BUCKET_ROWS, CLUSTER_ROWS = 4_000, 1_000
#: Groups that the members of one bucket, cluster or shingle set are dealt to.
SALTS = 64
#: Pairs of texts that a worker gets at a time.
PAIR_ROWS = 256

_U = np.uint64
_rng = np.random.default_rng(20240229)
_A = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * _U(2) + _U(1)
_B = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the n-word shingles of each text; of the whole sequence if it has fewer words, but some."""
    hashes, counts = words(texts)
    grams, each = windows(hashes, counts, n)
    at, first = np.cumsum(each) - each, np.cumsum(counts) - counts
    out = []
    for i in range(len(texts)):
        if each[i]:
            out.append(np.unique(grams[at[i] : at[i] + each[i]]))
        elif counts[i]:
            whole = _U(int(counts[i]))
            for h in hashes[first[i] : first[i] + counts[i]]:
                whole = mix(np.array([whole ^ h], _U))[0]
            out.append(np.array([whole], _U))
        else:
            out.append(np.empty(0, _U))
    return out


def minima(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each of the hash functions a x + b modulo 2**64 over the set."""
    out = np.full(len(_A), np.iinfo(np.uint64).max, _U)
    for k in range(0, len(shingles), 256):
        np.minimum(out, (shingles[k : k + 256, None] * _A + _B).min(axis=0), out=out)
    return out


def band_keys(low: np.ndarray) -> np.ndarray:
    """A key for each band: the band's number mixed with its minima."""
    key = np.arange(BANDS, dtype=_U)
    for j in range(ROWS):
        key = mix(key ^ (low[j::ROWS] >> _U(32)) * _U(0x9E3779B97F4A7C15))
    return key


SETS = "doc_id long, n_shingles long, set_key binary, bands array<long>, signature binary"


def signed_sets(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, bands, signature) of every row; no key where there is no shingle or no doc_id."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, tuple[np.ndarray, bytes]] = {}
        for batch in it:
            ids, texts = batch.column(0).to_pylist(), text_bytes(batch.column(1))
            rows: list[tuple] = []
            for a, b in slices(len(texts), lambda i: len(texts[i])):
                for i, own in zip(range(a, b), shingle_sets(texts[a:b], n), strict=True):
                    if not len(own) or ids[i] is None:
                        rows.append((len(own), None, None, None))
                        continue
                    key = hashlib.md5(own.tobytes()).digest()
                    if key not in seen:
                        if len(seen) >= 20_000:
                            seen.clear()
                        low = minima(own)
                        seen[key] = (band_keys(low).view(np.int64), (low >> _U(32) & _U(255)).astype(np.uint8).tobytes())
                    rows.append((len(own), key, *seen[key]))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.list_(pa.int64())), pa.array(cols[3], pa.binary())],
                names=["doc_id", "n_shingles", "set_key", "bands", "signature"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SETS)


def _alike(pairs: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """Pairs (u, v) whose signatures agree in `least` of all places or more."""
    left = reps.select(F.col("doc_id").alias("u"), F.col("signature").alias("su"))
    right = reps.select(F.col("doc_id").alias("v"), F.col("signature").alias("sv"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows:
                a = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                b = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                ok = pa.array((a == b).mean(axis=1) >= least)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["u", "v"])

    return pairs.join(left, "u").join(right, "v").select("u", "v", "su", "sv").mapInArrow(run, "u long, v long")


def shingles_of(text: bytes, n: int) -> set[tuple[bytes, ...]]:
    w = text.lower().split()  # bytes: folds A-Z only, splits at \x20 and \x09-\x0D only
    if len(w) < n:
        return {tuple(w)} if w else set()
    return set(zip(*(w[j:] for j in range(n)), strict=False))


def _linked(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Pairs (u, v) whose full shingle sets, taken from the words themselves, are alike enough."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            us, vs, held = [], [], {}
            for u, v, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = held.get(a)
                if x is None:
                    held = {a: shingles_of(a, n)}
                    x = held[a]
                y = shingles_of(b, n)
                both = len(x & y)
                if both and 100 * both >= percent * (len(x) + len(y) - both):
                    us.append(u)
                    vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    left = texts.select(F.col("doc_id").alias("u"), F.col("bytes").alias("tu"))
    right = texts.select(F.col("doc_id").alias("v"), F.col("bytes").alias("tv"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "tu", "tv").mapInArrow(run, "u long, v long").distinct()


def _salt(column: str = "doc_id"):
    return F.pmod(F.xxhash64(column), F.lit(SALTS)).cast("int")


def _attached(rows: DataFrame, key: str, values: DataFrame, how: str = "inner") -> DataFrame:
    """rows (doc_id, key, ...) joined with one row a key, by (key, salt): a key on any share of the rows meets its value in SALTS places."""
    dealt = rows.withColumn("_s", _salt())
    return dealt.join(dealt.select(key, "_s").distinct().join(values, key), [key, "_s"], how).drop("_s")


def _blocked(rows: DataFrame, key: str, size: int) -> DataFrame:
    """Rows in blocks (key, i, j): a key's rows are dealt to chunks of about `size`, and each pair of chunks is a block.

    A block has two chunks at most, whatever the key's size, and every pair of a key's rows meets in a block.
    """
    counts = rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("_c"))
    dealt = _attached(rows, key, counts).withColumn("_k", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("_c")).cast("int"))
    return dealt.withColumn("_x", F.explode(F.sequence(F.lit(0), F.col("_c") - 1))).withColumn("i", F.least("_k", "_x")).withColumn("j", F.greatest("_k", "_x")).drop("_c", "_x")


def _spanning(ids: np.ndarray, comp: np.ndarray, hits) -> pa.Table:
    """Links (u, v) that join components; at most one fewer than there are components.

    hits(label) gives arrays (x, y) of alike places whose labels differ, a stretch at a time. Only one
    pair for each two labels is looked at, labels follow what is joined, and a block that has become
    one component is done.
    """
    _, label = np.unique(comp, return_inverse=True)
    label = label.astype(np.int64)
    many = int(label.max()) + 1 if len(label) else 0
    us, vs = [], []
    for x, y in hits(label):
        _, first = np.unique(np.minimum(label[x], label[y]) * many + np.maximum(label[x], label[y]), return_index=True)
        root = np.arange(many)
        for k in first.tolist():
            a, b = int(label[x[k]]), int(label[y[k]])
            while root[a] != a:
                a = int(root[a])
            while root[b] != b:
                b = int(root[b])
            if a != b:
                root[max(a, b)] = min(a, b)
                us.append(int(ids[x[k]]))
                vs.append(int(ids[y[k]]))
        while not np.array_equal(root, root[root]):
            root = root[root]
        label[:] = root[label]
        if not label.any():  # all places have label 0
            break
    return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})


def _alike_components(rest: DataFrame, least: float) -> DataFrame:
    """From rows (key, doc_id, component, signature): links that join the components of alike members of a bucket."""

    def run(_: tuple, group: pa.Table) -> pa.Table:
        ids, comp = group.column("doc_id").to_numpy(), group.column("component").to_numpy()
        sig = np.frombuffer(b"".join(group.column("signature").to_pylist()), np.uint8).reshape(len(ids), -1)
        step = max(1, (16 << 20) // max(1, sig.size))

        def hits(label: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for a in range(0, len(ids), step):
                apart = label[a : a + step, None] != label[None, a:]
                if apart.any():
                    agree = (sig[a : a + step, None, :] == sig[None, a:, :]).mean(axis=2, dtype=np.float32)
                    x, y = np.nonzero(apart & (agree >= least))
                    if len(x):
                        yield x + a, y + a

        return _spanning(ids, comp, hits)

    return _blocked(rest, "key", BUCKET_ROWS).groupBy("key", "i", "j").applyInArrow(run, "u long, v long").distinct()


def _sets_of(texts: DataFrame, n: int) -> DataFrame:
    """(doc_id, shingles): sorted 64-bit hashes of the full set, packed."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            own = text_bytes(batch.column(1))
            found = [x.tobytes() for a, b in slices(len(own), lambda i: len(own[i])) for x in shingle_sets(own[a:b], n)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["doc_id", "shingles"])

    return texts.select("doc_id", "bytes").mapInArrow(run, "doc_id long, shingles binary")


def intersections(sets: list[np.ndarray], columns: int = 1024) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, sizes of the intersections of up to 256 sets with all sets), by products of 0/1 matrices over shared shingles."""
    size = np.array([len(x) for x in sets])
    row = np.repeat(np.arange(len(sets)), size)
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    ok = count[code] > 1
    row, code = row[ok], number[code[ok]]
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    width = int(code[-1]) + 1 if len(code) else 0
    cut = np.searchsorted(code, np.arange(0, width + columns, columns))
    for a in range(0, len(sets), 256):
        both = np.zeros((min(256, len(sets) - a), len(sets)), np.float32)
        for k in range(len(cut) - 1):
            m = np.zeros((len(sets), columns), np.float32)
            m[row[cut[k] : cut[k + 1]], code[cut[k] : cut[k + 1]] - k * columns] = 1
            both += m[a : a + 256] @ m.T
        yield a, both


def _exact_components(members: DataFrame, percent: int) -> DataFrame:
    """From rows (cluster, doc_id, component, shingles): links that join components, every pair across components of a cluster compared on full sets."""

    def run(_: tuple, group: pa.Table) -> pa.Table:
        ids, comp = group.column("doc_id").to_numpy(), group.column("component").to_numpy()
        sets = [np.frombuffer(x, _U) for x in group.column("shingles").to_pylist()]
        size = np.array([len(x) for x in sets])

        def hits(label: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for a, both in intersections(sets):
                union = size[a : a + 256, None] + size[None, :] - both
                x, y = np.nonzero((label[a : a + 256, None] != label[None, :]) & (both > 0) & (100 * both >= percent * union))
                if len(x):
                    yield x + a, y

        return _spanning(ids, comp, hits)

    return _blocked(members, "cluster", CLUSTER_ROWS).groupBy("cluster", "i", "j").applyInArrow(run, "u long, v long").distinct()


def groups(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of (doc_id, text).

    Rows link where 100 * |A & B| >= percent * |A | B| for their sets of n-word shingles; the
    component id is the smallest doc_id reachable. Documents without words, and rows without a
    doc_id, link with nothing (component: their own doc_id, kept). Rows that share a doc_id are one
    document with the links of all of them. An empty table gives no rows.
    """
    spark = docs.sparkSession
    least, folder = percent / 100 - MARGIN, fresh_dir(spark, "near")
    keep = lambda df, name: kept_in(df, f"{folder}/{name}")
    smallest = -(-percent // (100 - percent))  # a set below this size links with equal sets only
    with arrow_batches(spark):
        sets = keep(signed_sets(docs, n), "sets")
    reps = keep(
        sets.filter(F.col("set_key").isNotNull()).groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("signature").alias("signature")),
        "reps",
    )
    rows = reps.filter(F.col("n_shingles") >= smallest).select("doc_id", F.explode("bands").alias("key")).withColumn("sub", _salt())
    # a bucket's centre, and centres of its SALTS groups, so that no centre is compared with a whole large bucket
    groups_ = rows.groupBy("key", "sub").agg(F.min("doc_id").alias("local"), F.count(F.lit(1)).alias("n"))
    shared = groups_.groupBy("key").agg(F.min("local").alias("centre"), F.sum("n").alias("n")).filter(F.col("n") > 1).select("key", "centre")
    members = keep(rows.join(groups_.select("key", "sub", "local").join(shared, "key"), ["key", "sub"]), "members")
    ids = members.select("doc_id").distinct()
    signed = keep(reps.join(ids, "doc_id", "left_semi").select("doc_id", "signature").distinct(), "signed")
    texts = keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("bytes")).join(ids, "doc_id", "left_semi").distinct(), "texts")

    with arrow_batches(spark, PAIR_ROWS):  # a batch of pairs holds two texts a row
        stars = F.explode(F.array(F.struct(F.col("local").alias("u"), F.col("doc_id").alias("v")), F.struct(F.col("centre").alias("u"), F.col("local").alias("v"))))
        tested = members.select(stars.alias("e")).select("e.u", "e.v").filter(F.col("u") != F.col("v")).distinct()
        tested = keep(_alike(tested, signed, least), "pairs")
        links = keep(_linked(tested, texts, n, percent), "links")
        found = components(links)
        named = keep(members.select("key", "doc_id").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("component")), "named")
        open_keys = named.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter(F.col("a") != F.col("b")).select("key")
        rest = _attached(named, "key", open_keys).join(signed, "doc_id")
        alike = keep(_alike_components(rest, least), "alike")
        if not alike.isEmpty():
            stars = found.select(F.col("component").alias("u"), F.col("node").alias("v"))
            clusters = components(stars.union(alike)).withColumnRenamed("component", "cluster")
            touched = clusters.join(alike.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "node").select("cluster").distinct()
            inside = _attached(clusters.withColumnRenamed("node", "doc_id"), "cluster", touched).join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "cluster", F.coalesce("component", "doc_id").alias("component"))
            ready = keep(inside.join(_sets_of(texts, n), "doc_id"), "clusters")
            found = components(stars.union(keep(_exact_components(ready, percent), "more")))

    named = reps.select("set_key", F.col("doc_id").alias("rep")).join(found, F.col("rep") == found["node"], "left").select("set_key", F.coalesce("component", "rep").alias("component"))
    # rows without a key have no component; a set may be that of any share of the rows
    done = _attached(sets.filter(F.col("set_key").isNotNull()).select("doc_id", "n_shingles", "set_key"), "set_key", named)
    done = done.select("doc_id", "n_shingles", "component").union(sets.filter(F.col("set_key").isNull()).select("doc_id", "n_shingles", F.lit(None).cast("long")))
    # rows that share a doc_id are one document
    done = keep(done, "done")
    for name in ("sets", "reps", "members", "signed", "texts", "pairs", "links", "named", "alike", "clusters", "more"):
        discard(f"{folder}/{name}")
    own = done.groupBy("doc_id").agg(F.min("component").alias("component"), F.max("component").alias("_other"), F.count(F.lit(1)).alias("_n"))
    split = own.filter((F.col("component") != F.col("_other")) & F.col("doc_id").isNotNull())
    component = F.coalesce("component", "doc_id")
    if split.isEmpty():
        out = done.withColumn("component_id", component)
    else:
        joins = done.filter(F.col("component").isNotNull()).join(split.select("doc_id", F.col("component").alias("u")), "doc_id").select("u", F.col("component").alias("v"))
        merged = components(joins).select(F.col("node").alias("component"), F.col("component").alias("_to"))
        out = done.join(merged, "component", "left").withColumn("component_id", F.coalesce("_to", component))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents", "doc_id", "text"), n=3, percent=85)
