"""Small curated tables that are rewritten as a whole: analyses and synonym groups.

A table is a Parquet folder with one subfolder a version; a change writes the next version whole and
readers take the newest finished one, so a reader never sees half a change. Meant for tables that
people edit, of thousands of rows; facts go to store.py.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ANALYSES = "analysis_id string, title string, owner string, status string, error string, created_at timestamp, updated_at timestamp, patent_count long"
SYNONYMS = "id string, canonical string, aliases array<string>, note string"
MOST_LISTED = 200
FINAL = ("completed", "failed", "cancelled")


class Table:
    def __init__(self, spark: SparkSession, path: str, schema: str, key: str) -> None:
        self.spark, self.path, self.schema, self.key = spark, path, schema, key

    def _newest(self) -> int:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(conf)
        if not fs.exists(p):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        done = [int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        return max(done, default=0)

    def read(self) -> DataFrame:
        n = self._newest()
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v{n}") if n else self.spark.createDataFrame([], self.schema)

    def write(self, df: DataFrame) -> None:
        df.write.mode("errorifexists").parquet(f"{self.path}/v{self._newest() + 1}")

    def upsert(self, rows: DataFrame) -> None:
        """Rows replace those with their keys."""
        old = self.read()
        self.write(old.join(rows.select(self.key), self.key, "left_anti").select(*old.columns).unionByName(rows, allowMissingColumns=True))

    def insert_if_absent(self, rows: DataFrame) -> None:
        old = self.read()
        self.write(old.unionByName(rows.join(old.select(self.key), self.key, "left_anti"), allowMissingColumns=True).select(*old.columns))

    def delete(self, keys: list[str]) -> None:
        self.write(self.read().filter(~F.col(self.key).isin(keys)))


def analyses(spark: SparkSession, path: str) -> Table:
    return Table(spark, path, ANALYSES, "analysis_id")


def set_status(t: Table, analysis_id: str, status: str, error: str | None = None) -> None:
    """A finished analysis keeps its status."""
    hit = (F.col("analysis_id") == analysis_id) & ~F.coalesce(F.col("status").isin(*FINAL), F.lit(False))
    t.write(t.read().withColumn("error", F.when(hit, F.lit(error)).otherwise(F.col("error"))).withColumn("status", F.when(hit, F.lit(status)).otherwise(F.col("status"))))


def history(analyses_: DataFrame, owner: str | None = None, most: int = MOST_LISTED) -> DataFrame:
    """The newest analyses, of one owner or of all; at most MOST_LISTED."""
    own = analyses_ if owner is None else analyses_.filter(F.col("owner") == owner)
    return own.orderBy(F.desc("created_at"), "analysis_id").limit(max(0, min(most, MOST_LISTED)))


def synonyms(spark: SparkSession, path: str) -> Table:
    return Table(spark, path, SYNONYMS, "id")


def upsert_group(t: Table, group_id: str, canonical: str, aliases: list[str], note: str | None = None) -> None:
    """A canonical name belongs to one group."""
    if not t.read().filter((F.col("canonical") == canonical) & (F.col("id") != group_id)).isEmpty():
        raise ValueError(f"{canonical}: already the name of another group")
    t.upsert(t.spark.createDataFrame([(group_id, canonical, aliases, note)], SYNONYMS))


def snapshot_synonyms(t: Table, path: str) -> None:
    t.read().write.mode("overwrite").parquet(path)


def restore_synonyms(t: Table, path: str) -> None:
    try:
        t.write(t.spark.read.schema(SYNONYMS).parquet(path))
    except AnalysisException as e:
        raise FileNotFoundError(path) from e


def history_with_owners(analyses_: DataFrame, users: DataFrame, owner: str | None = None, most: int = MOST_LISTED) -> DataFrame:
    """history() with the owner's name from users (owner, name); null where the owner is unknown or gone."""
    return history(analyses_, owner, most).join(users.select("owner", F.col("name").alias("owner_name")), "owner", "left").orderBy(F.desc("created_at"), "analysis_id")


def linked_uploads(wanted: DataFrame, uploads: DataFrame) -> DataFrame:
    """(analysis_id, upload_id, original_name) of (analysis_id, upload_ids, names) lists, each pair once; uploads that do not exist are left out."""
    each = wanted.select("analysis_id", F.explode(F.arrays_zip(F.col("upload_ids").alias("upload_id"), F.col("names").alias("original_name"))).alias("u")).select("analysis_id", "u.*")
    return each.join(uploads.select("upload_id"), "upload_id", "left_semi").groupBy("analysis_id", "upload_id").agg(F.min("original_name").alias("original_name"))


def counters(analyses_: DataFrame, users: DataFrame) -> DataFrame:
    """One row: users, analyses, and analyses that are done, failed or still running."""
    done = F.count_if(F.col("status") == "completed").alias("completed")
    one = analyses_.agg(F.count(F.lit(1)).alias("analyses"), done, F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(~F.coalesce(F.col("status").isin(*FINAL), F.lit(False))).alias("running"))
    return users.agg(F.count(F.lit(1)).alias("users")).crossJoin(one)
