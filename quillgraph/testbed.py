"""Domain tables out of order-processing tables, so that every operator can be held against SQL.

Orders are patents, part names concepts, customers applicants (every fifth order has a second one),
order priorities source files, parts' numbers classification codes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.operators.network import laid_out
from quillgraph.plans.views import Graph

MAX_YEAR = 2035


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def patents(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("patent_id"), F.year("o_orderdate").alias("year"), F.array("o_orderpriority").alias("source_files"), F.col("o_orderstatus").alias("case_status"), F.col("o_custkey").alias("applicant"), "o_orderdate")


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("concept"))
    return laid_out(read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("patent_id"), "l_partkey").join(part, "l_partkey").select("patent_id", "concept"))


def ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("patent_id"), F.col("o_custkey").alias("applicant"))
    return o.union(o.filter(F.col("patent_id") % 5 == 0).select("patent_id", F.col("applicant") + 1)).distinct()


def raw_code():
    """A classification code of a part, as spreadsheets spell it: zero-padded main group."""
    letter = lambda c, of: F.substr(F.lit(of), (c + 1).cast("int"), F.lit(1))
    return F.concat(
        letter(F.col("p_size") % 8, "ABCDEFGH"), F.lpad((F.col("p_size") % 90 + 10).cast("string"), 2, "0"), letter(F.col("p_partkey") % 26, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        F.lit("-"), F.lpad((F.col("p_partkey") % 300 + 1).cast("string"), 3, "0"), F.lit("/"), F.lpad(F.col("p_size").cast("string"), 2, "0"),
    )


def coded_patents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patents with ipc5, the codes of the parts of their lines."""
    from quillgraph.functions.text import normalize_ipc5

    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), normalize_ipc5(raw_code()).alias("code"))
    own = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("patent_id"), "l_partkey").join(part, "l_partkey").groupBy("patent_id").agg(F.array_sort(F.collect_set("code")).alias("ipc5"))
    return patents(spark, sf_dir).join(own, "patent_id", "left")


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed relations between the parts of consecutive lines of an order; in every fifth order the first one's target is no concept of it."""
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("concept"))
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_quantity", "l_suppkey", "l_extendedprice").join(part, "l_partkey")
    w = Window.partitionBy("l_orderkey").orderBy(F.asc_nulls_last("l_linenumber"), "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag")
    both = line.select(F.col("l_orderkey").alias("patent_id"), F.col("l_linenumber").alias("ordinal"), F.col("concept").alias("source"), F.concat(F.lead("concept").over(w), F.when((F.col("l_orderkey") % 5 == 0) & (F.col("l_linenumber") == 1), " outside").otherwise("")).alias("target"), F.col("l_returnflag").alias("relation"), F.col("l_quantity").alias("weight"))
    return both.filter(F.col("target").isNotNull()).withColumn("reason", F.col("relation")).withColumn("confidence", F.lit("EXTRACTED"))


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each patent cites its applicant's previous one; the previous but one is cited back by every third."""
    w = Window.partitionBy("applicant").orderBy("o_orderdate", "patent_id")
    p = patents(spark, sf_dir).select("patent_id", F.lag("patent_id", 1).over(w).alias("p1"), F.lag("patent_id", 2).over(w).alias("p2"))
    one = p.filter(F.col("p1").isNotNull()).select(F.col("patent_id").alias("from_patent"), F.col("p1").alias("to_patent"))
    return one.union(p.filter(F.col("p2").isNotNull() & (F.col("patent_id") % 3 == 0)).select("p2", "patent_id"))


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph(coded_patents(spark, sf_dir), membership(spark, sf_dir), ownership(spark, sf_dir), relations(spark, sf_dir), citations(spark, sf_dir))


def staged_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with colliding identifiers by modular arithmetic: numbers, application numbers, titles, some of them missing."""
    k = F.col("o_orderkey")
    o = read(spark, sf_dir, "orders")
    s = lambda c: c.cast("string")
    return o.select(
        k.alias("row_id"),
        F.when(k % 3 != 0, F.concat(F.lit("TWI"), s(F.floor(k / 4)), F.lit("U"))).alias("patent_number"),
        F.when(k % 7 != 0, F.concat(F.lit("tw"), s(F.floor(k / 6)))).alias("application_number"),
        F.concat(F.lit("title "), s(F.floor(k / 3) % 5)).alias("title"),
        F.concat(F.lit("abstract "), s(k % 11)).alias("abstract"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("filing_date"),
        F.date_format(F.date_add("o_orderdate", F.when(k % 9 == 0, -10).otherwise(500)), "yyyy-MM-dd").alias("publication_date"),
        F.concat(F.lit("P"), s(k % 17)).alias("publication_number"),
        F.array(F.concat(F.lit("inventor "), s(k % 3)), F.concat(F.lit("inventor "), s(k % 4))).alias("inventors"),
        F.concat(F.lit("class "), s(k % 5)).alias("design_class"),
        F.array(F.concat(F.lit("applicant "), s(F.col("o_custkey") % 50))).alias("applicants"),
        F.concat(F.lit("applicant "), s(F.col("o_custkey") % 50)).alias("applicant"),
        F.array("o_orderpriority").alias("source_files"),
        (k % 13).cast("int").alias("cited_by_count"),
        F.when(F.col("o_orderstatus") == "F", "核駁").when(F.col("o_orderstatus") == "O", "公開").otherwise("核准").alias("case_status"),
    )
