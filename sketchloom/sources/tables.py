"""Readers and writers.

Sketch tables are Parquet: long forms sorted by position, token tables split by
layer so that a filter on the layer prunes directories.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .versions import Files


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``; a temporary one on a single machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_steps: list[str] = []


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: the lineage is cut by a copy that outlives executors.

    ``release`` deletes what was written.
    """
    path = new_path(df.sparkSession, "step")
    df.write.parquet(path)
    _steps.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete the tables that ``written`` made so far, once what was made of them is stored; returns how many."""
    files, n = Files(spark, shared_dir(spark)), len(_steps)
    while _steps:
        files.delete(_steps.pop())
    return n


def bounded(df: DataFrame, most: int) -> list:
    """The rows of a table that has at most ``most`` of them; more are an error, never cut off."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows for the driver")
    return rows


def register_views(spark: SparkSession, sf_dir: str, tables: list[str]) -> None:
    """Temporary views of the tables, and the ratios of estimates as functions of SQL."""
    for name in tables:
        read(spark, sf_dir, name).createOrReplaceTempView(name)
    one = "CREATE OR REPLACE TEMPORARY FUNCTION"
    spark.sql(f"{one} sketch_tau(card_both DOUBLE, card_target DOUBLE) RETURNS DOUBLE RETURN CASE WHEN card_target > 0 THEN greatest(0.0D, least(1.0D, card_both / card_target)) ELSE 0.0D END")
    spark.sql(f"{one} sketch_rho(card_rest DOUBLE, card_target DOUBLE) RETURNS DOUBLE RETURN CASE WHEN card_target > 0 THEN greatest(0.0D, least(1.0D, card_rest / card_target)) ELSE 1.0D END")


def token_lines(spark: SparkSession, path: str) -> DataFrame:
    """One token a line, white space at the ends and empty lines dropped."""
    return spark.read.text(path).select(F.trim("value").alias("token")).where("token <> ''")


def write_long(long: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Each file sorted by (reg, zeros): runs compress, and row groups can be skipped."""
    long.sortWithinPartitions("reg", "zeros").write.mode(mode).parquet(path)


def write_packed(packed: DataFrame, path: str, mode: str = "errorifexists") -> None:
    packed.write.mode(mode).parquet(path)


def write_lut(lut: DataFrame, path: str, mode: str = "errorifexists") -> None:
    lut.repartition("layer").sortWithinPartitions("reg", "zeros").write.mode(mode).partitionBy("layer").parquet(path)


def write_bucketed(df: DataFrame, table: str, buckets: int) -> None:
    """A table bucketed by position: joins on (reg, zeros) then need no shuffle."""
    df.write.bucketBy(buckets, "reg", "zeros").sortBy("reg", "zeros").mode("overwrite").saveAsTable(table)


def nation_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(set_id, token): the parts that each nation's suppliers ship."""
    lines = read(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_partkey").cast("string").alias("token"))
    supplier = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = read(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("set_id"))
    joined = lines.join(supplier, lines.l_suppkey == supplier.s_suppkey).join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.select("set_id", "token")


def brand_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(set_id, token): the words of the names of each brand's parts."""
    part = read(spark, sf_dir, "part")
    return part.select(F.col("p_brand").alias("set_id"), F.explode(F.filter(F.split("p_name", r"\s+"), lambda w: w != "")).alias("token"))


def day_users(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """(day, more..., token): the users of each day's events."""
    return read(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), *more, F.col("user_id").cast("string").alias("token"))
