"""Helpers that the operators of this package share."""

from __future__ import annotations

import pickle
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[str] = []
#: Tasks that share the rows of one key in ``join_salted``.
SALTS = 32


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where that setting is absent and the session is a single machine's, as
    in tests, a temporary folder is made and kept in the session's settings; a
    cluster without the setting is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back.

    This cuts the lineage with a copy that outlives any executor.  ``release``
    deletes what was written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the tables written so far; call it once their results are stored."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)


def join_frequent(left: DataFrame, right: DataFrame, key: str | list[str], size: str, least: int, how: str = "inner") -> DataFrame:
    """Join on keys that ``right`` holds once, with the number of ``left``'s rows of each in ``size``.

    Keys of ``least`` rows or more, of which there are at most rows / least, are
    broadcast, so no task gets all rows of a frequent key; the others meet in a
    merge join.  ``how`` is inner or left.
    """
    hot = F.broadcast(right.where(F.col(size) >= least))
    keys = [key] if isinstance(key, str) else key
    rest = left.join(hot.select(*keys), keys, "left_anti").join(right.where(F.col(size) < least).hint("merge"), keys, how)
    return left.join(hot, keys).unionByName(rest)


def join_salted(left: DataFrame, right: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """Join of narrow tables on a key that ``right`` holds once: ``left``'s rows of a key are dealt to SALTS tasks by ``by``.

    ``right`` is repeated for each of them, which costs less than counting the
    keys where rows are a few numbers.
    """
    spread = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = left.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    return dealt.join(spread.hint("merge"), [key, "_salt"], how).drop("_salt")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """A null text counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fifth of the ids whose labels nothing may learn from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """(text, y) of the ``max_rows`` labelled ids outside the held-out fold whose hashes are smallest.

    The draw depends on the ids alone, so it is the same at every run and in
    every partitioning.  Labels are narrow, so they are drawn first, and at most
    ``max_rows`` of them may be broadcast.  An id labelled twice has its larger
    label; one with several texts, the text of the smallest hash.
    """
    usable = (
        labels.select("doc_id", F.col(label).cast("double").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0.0, 1.0) & ~held_out())
        .groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64(F.col("doc_id"), F.lit(17)), "doc_id").limit(max_rows)
    )
    found = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(usable), "doc_id")
    return found.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "y")


def collect_bounded(sample: DataFrame, max_bytes: int) -> tuple[list[str], list[float]]:
    """Fetch the sample in a fixed order, passing over texts that would exceed ``max_bytes`` in all.

    The few rows are dealt into four partitions, so that the scan behind them
    runs once and in parallel, and the iterator then holds a quarter at a time.
    If the bound leaves no text of a label that the sample has, that is an error.
    """
    texts, ys, left, met = [], [], max_bytes, set()
    rows = sample.withColumn("n", F.octet_length("text")).repartition(4, F.xxhash64("text")).sortWithinPartitions(F.xxhash64("text"), "y")
    for text, y, n in rows.select("text", "y", "n").toLocalIterator():
        met.add(y)
        if n <= left:
            left -= n
            texts.append(text)
            ys.append(y)
    if met != set(ys):
        raise ValueError(f"no text of a label fits in {max_bytes} bytes")
    return texts, ys


def fit_bounded(sample: DataFrame, max_bytes: int, train):
    """``train(texts, ys)`` of the rows that ``collect_bounded`` gives, in their order, run by one task.

    The driver gets the pickled model only; the texts and what training makes of
    them stay with the executor.
    """

    def run(batches):
        texts, ys, left, met = [], [], max_bytes, set()
        for batch in batches:
            for text, y, n in zip(*(c.to_pylist() for c in batch.columns)):
                met.add(y)
                if n <= left:
                    left -= n
                    texts.append(text)
                    ys.append(y)
        model = pickle.dumps(train(texts, ys)) if met == set(ys) else None
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], ["model"])

    text, n = F.xxhash64("text"), F.octet_length("text")
    # the order of collect_bounded: its four partitions, one after the other
    rows = sample.repartition(1).sortWithinPartitions(F.pmod(F.hash(text), F.lit(4)), text, "y")
    # a text that cannot fit is not fetched
    found = rows.select(F.when(n <= max_bytes, F.col("text")).alias("text"), "y", n.alias("n")).mapInArrow(run, "model binary").collect()
    if found and found[0]["model"] is None:
        raise ValueError(f"no text of a label fits in {max_bytes} bytes")
    return pickle.loads(found[0]["model"]) if found else train([], [])
