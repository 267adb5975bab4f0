"""Token sessions as streams: producers, checkpoints, commit, windows, candidates.

A session reads token rows from a source, and each micro-batch leaves a partial
token table and a checkpoint sketch in the session's folder, named by the batch.
A batch that is delivered again overwrites its own files, so neither bits nor
counts are doubled.  Commit folds all batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import hashing as H
from ..operators import sketch as S
from ..operators import tokens as K


def token_stream(spark: SparkSession, path: str, schema: str, per_trigger: int = 100) -> DataFrame:
    """Parquet files of token rows as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def line_stream(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """One token a line."""
    lines = spark.readStream.option("maxFilesPerTrigger", per_trigger).text(path)
    return lines.select(F.trim("value").alias("token")).where("token <> ''")


class Session:
    """A stream of (layer, ngram), or of ``text_ngrams``, into a folder; ``commit`` gives the table and the sketches."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _batch(self, df: DataFrame, batch: int) -> None:
        path = f"{self.folder}/lut/batch={batch}"
        K.lut_rows(df).write.mode("overwrite").parquet(path)
        bits = self.spark.read.parquet(path).select("layer", "reg", "zeros").distinct()
        S.pack(bits, "layer").write.mode("overwrite").parquet(f"{self.folder}/sketch/batch={batch}")

    def run(self, stream: DataFrame, **trigger) -> StreamingQuery:
        """Start; with no trigger given, process what is there and stop."""
        writer = stream.writeStream.foreachBatch(self._batch).option("checkpointLocation", f"{self.folder}/offsets")
        return writer.trigger(**(trigger or {"availableNow": True})).start()

    def checkpoints(self) -> DataFrame:
        """(batch, layer, bitmap) of each micro-batch."""
        return self.spark.read.parquet(f"{self.folder}/sketch")

    def commit(self) -> tuple[DataFrame, DataFrame]:
        """(layer, bitmap) of the whole session, and its token table."""
        lut = self.spark.read.parquet(f"{self.folder}/lut")
        return S.merge(self.checkpoints(), "layer"), K.merge_rows(lut)

    def length(self) -> int:
        """Micro-batches that the session holds."""
        return self.checkpoints().select("batch").distinct().count()

    def trim(self, keep: int) -> tuple[DataFrame, DataFrame]:
        """``commit`` of the last ``keep`` micro-batches only."""
        last = self.checkpoints().agg(F.max("batch")).first()[0]
        recent = lambda df: df.where(F.col("batch") > (-1 if last is None else last) - keep)
        lut = recent(self.spark.read.parquet(f"{self.folder}/lut"))
        return S.merge(recent(self.checkpoints()), "layer"), K.merge_rows(lut)

    def cleanup(self) -> None:
        """Delete the session's folder."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def stats(self) -> DataFrame:
        lut = self.spark.read.parquet(f"{self.folder}/lut")
        return lut.groupBy("layer").agg(F.countDistinct("batch").alias("batches"), F.sum("tf").alias("tokens"))


def windowed_positions(stream: DataFrame, time: str, token: str, late: str = "1 hour", width: str = "1 day", slide: str | None = None) -> DataFrame:
    """(window, bitmap) of the tokens in each window; rows later than the watermark are dropped."""
    at = F.window(time, width, slide) if slide else F.window(time, width)
    rows = S.positions(stream.withWatermark(time, late).select(time, token), token)
    return rows.groupBy(at.alias("window")).agg(F.bitmap_construct_agg((F.col("reg") * H.BITS + F.col("zeros")).cast("long")).alias("bitmap"))


def candidates(stream: DataFrame, lut: DataFrame, token: str) -> DataFrame:
    """Each streamed token's candidates in a static token table."""
    return S.positions(stream.select(token), token).select(token, "reg", "zeros").join(lut, ["reg", "zeros"])


def flux_states(stream: DataFrame, step: str, key: str = "stream") -> DataFrame:
    """(stream, step, cumulative_flux) kept across micro-batches; rows are (stream, step, flux)."""
    import pandas as pd

    def run(keys, frames, state):
        total = state.get[0] if state.exists else 0.0
        for pdf in frames:
            pdf = pdf.sort_values(step)
            run_ = pdf["flux"].cumsum() + total
            total = float(run_.iloc[-1])
            yield pd.DataFrame({key: pdf[key], step: pdf[step], "cumulative_flux": run_})
        state.update((total,))

    return stream.groupBy(key).applyInPandasWithState(run, f"{key} string, {step} string, cumulative_flux double", "total double", "append", "NoTimeout")


def ingest_lines(spark: SparkSession, path: str, folder: str) -> Session:
    """Text files of tokens, one a line, through a session to its end; the session is ready to commit."""
    session = Session(spark, folder)
    session.run(line_stream(spark, path).select(F.lit(0).alias("layer"), F.col("token").alias("ngram"))).awaitTermination()
    return session


def to_sink(stream: DataFrame, path: str, offsets: str) -> StreamingQuery:
    """Rows of a stream appended to Parquet files, each once, until what is there is read."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", offsets).trigger(availableNow=True).start()
