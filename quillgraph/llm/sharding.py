"""Sharding by a keyed permutation of global row numbers.

Every row gets a global number (its rank by bucket, doc_id, size and checksum), a Feistel
network over pairs of digits permutes 0..N-1, and the permuted number alone gives shard and slot:
shard = p mod shards, slot = p div shards. Anyone who knows N and the key can compute where a row
number went, or walk the network backwards, without reading the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import table

#: Round arithmetic is modulo this prime, so that products of two digits stay below 2**62.
PRIME = 2_147_483_647
#: Buckets of the global numbering, and rows that one is to have at most beyond that many buckets: a task sorts a bucket at a time.
BUCKETS, BUCKET_ROWS = 4096, 1_000_000
#: Walks through values of N or more until one below N; the walk is checked to have ended.
WALK = 128


def round_keys(seed: int, rounds: int) -> list[int]:
    """Keys of the rounds by a multiplicative generator."""
    keys, x = [], seed % PRIME or 1
    for _ in range(rounds):
        x = x * 48271 % PRIME
        keys.append(x)
    return keys


def _round(right: Column, key: Column) -> Column:
    """A cube of the keyed digit modulo the prime: not linear in the digit, and plain integer arithmetic in any SQL."""
    t = (right + key) % F.lit(PRIME)
    return (t * t % F.lit(PRIME)) * t % F.lit(PRIME)


def feistel(p: Column, side: Column, keys: list[int]) -> Column:
    """One pass over 0..side**2-1: p = left * side + right; each round (l, r) -> (r, (l + f(r)) mod side)."""
    start = F.struct(F.floor(p / side).cast("long").alias("l"), (p % side).alias("r"))
    end = F.aggregate(
        F.array(*[F.lit(k).cast("long") for k in keys]),
        start,
        lambda s, k: F.struct(s["r"].alias("l"), ((s["l"] + _round(s["r"], k)) % side).alias("r")),
    )
    return F.transform(F.array(end), lambda s: s["l"] * side + s["r"])[0]


def permuted(number: Column, total: Column, side: Column, seed: int = 20240229, rounds: int = 6) -> Column:
    """The permutation of 0..total-1: walks on while the value is not below total."""
    keys = round_keys(seed, rounds)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), feistel(number, side, keys), lambda p, _: F.when(p < total, p).otherwise(feistel(p, side, keys)))
    return F.transform(F.array(walked), lambda p: F.when(p < total, p).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long")))[0]


def buckets_of(n: int) -> int:
    """Buckets for n rows; the driver's window over them has one row each."""
    return max(BUCKETS, -(-n // BUCKET_ROWS))


def global_numbers(df: DataFrame, order: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Rows of the `order` columns (integers) with `number`, 0..N-1 by (bucket, order), and `total`, N.

    Alike rows are first counted (combined before the shuffle) and take a run of numbers, so a row
    repeated any number of times loads no task. The buckets mix all ordering columns; each is sorted
    by itself, and the buckets' offsets are an aggregate of one row each.
    """
    mixed = F.lit(0).cast("long")
    for c in order:
        mixed = (mixed * 48271 + F.pmod(F.coalesce(c, F.lit(0)).cast("long"), F.lit(PRIME))) % PRIME
    groups = df.groupBy(*order).agg(F.count(F.lit(1)).alias("_n")).withColumn("_bucket", mixed % buckets)
    sizes = groups.groupBy("_bucket").agg(F.sum("_n").alias("_size"))
    every = Window.partitionBy(F.lit(0))
    offsets = sizes.select("_bucket", (F.sum("_size").over(every.orderBy("_bucket")) - F.col("_size")).alias("_offset"), F.sum("_size").over(every).alias("total"))
    before = F.sum("_n").over(Window.partitionBy("_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    placed = groups.withColumn("_before", before).join(F.broadcast(offsets), "_bucket").withColumn("_first", F.col("_offset") + F.col("_before"))
    step = 4096
    runs = placed.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(step).cast("long"))))
    each = runs.withColumn("_k", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + (step - 1), F.col("_n") - 1))))
    return each.select(*order, (F.col("_first") + F.col("_k")).alias("number"), "total")


def shard(docs: DataFrame, n_shards: int = 24, seed: int = 20240229, rounds: int = 6) -> DataFrame:
    """Rows of (doc_id, text) dealt to shards 0..n_shards-1 under the law `rows`: counts at most one apart.

    Rows equal in doc_id, size and checksum are interchangeable. A null text has size 8 and the checksum of no bytes; an empty table gives no rows; null and
    repeated doc_ids are rows like any other. Other columns of docs are not looked at.
    """
    rows = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8).alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    numbered = global_numbers(rows, ["doc_id", "size", "text_crc32"], buckets_of(docs.count()))
    root = F.ceil(F.sqrt(F.col("total").cast("double"))).cast("long")
    side = F.when(root * root < F.col("total"), root + 1).otherwise(root)
    p = numbered.withColumn("_side", side).withColumn("_p", permuted(F.col("number"), F.col("total"), F.col("_side"), seed, rounds))
    return p.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("_p") % n_shards).cast("int").alias("shard"), F.floor(F.col("_p") / n_shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents", "doc_id", "text"))
