"""Ingest of texts: one pass feeds universes, term counts, token table and ring vectors, with one commit a batch.

A micro-batch's n-grams are hashed once.  What is made of them is written beside
one another, and one manifest names all four, so that a reader sees a batch in
all of them or in none, and a batch that is delivered again is passed over.
"""

from __future__ import annotations

import json

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import hashing as H
from ..operators import sketch as S
from ..operators import tokens as K
from ..sources.versions import Bundle


class Ingest:
    """Texts (key, text) into a folder.

    N-grams have 1 to ``max_n`` words; ``markers`` stand before and behind each
    text, or are None.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, max_n: int = 3, markers: tuple[str, str] | None = ("<S>", "</S>")):
        self.spark, self.folder, self.key, self.max_n, self.markers = spark, folder.rstrip("/"), key, max_n, markers
        self.store = Bundle(spark, f"{self.folder}/tables")

    def ngrams(self, texts: DataFrame) -> DataFrame:
        """(key, layer, ngram) of the texts; a null text has none."""
        words = H.words(F.coalesce("text", F.lit("")))
        if self.markers:
            words = F.when(F.size(words) > 0, F.concat(F.array(F.lit(self.markers[0])), words, F.array(F.lit(self.markers[1])))).otherwise(words)
        return K.ngram_rows(texts.select(self.key, words.alias("w")), "w", self.key, max_n=self.max_n)

    def tables(self, texts: DataFrame) -> dict[str, DataFrame]:
        """What a batch adds to each table; all read the same hashed rows."""
        grams = self.ngrams(texts).groupBy(self.key, "layer", "ngram").agg(F.count(F.lit(1)).alias("tf"))
        at = S.positions(grams, "ngram").persist(StorageLevel.DISK_ONLY)
        counts = at.groupBy("layer", "ngram").agg(F.sum("tf").alias("tf"))
        entries = at.groupBy("layer", "ngram", "hash", "reg", "zeros").agg(F.sum("tf").alias("tf"))
        entries = entries.select("layer", "hash", "reg", "zeros", F.array("ngram").alias("ngrams"), F.array(K.first_token(F.col("ngram"))).alias("first_tokens"), "tf")
        return {
            "universes": S.pack(at.select("layer", "reg", "zeros").distinct(), "layer"),
            "counts": counts,
            "entries": K.merge_lut(entries).drop("collisions"),
            "vectors": S.pack(at.select(self.key, "reg", "zeros").distinct(), self.key),
            "hashed": at,
        }

    def committed(self) -> int:
        """The last batch that all tables have, -1 if there is none."""
        version = self.store.version()
        return json.loads(self.store.manifest(version)["note"])["batch"] if version >= 0 else -1

    def add(self, texts: DataFrame, batch: int) -> bool:
        """Feed one batch; False if it was there already."""
        if batch <= self.committed():
            return False
        made = self.tables(texts)
        hashed = made.pop("hashed")
        try:
            self.store.commit(made, note=json.dumps({"batch": batch}))
        finally:
            hashed.unpersist()
        return True

    def run(self, stream: DataFrame, **trigger) -> StreamingQuery:
        """Start, or go on; with no trigger given, process what is there and stop."""
        writer = stream.writeStream.foreachBatch(self.add).option("checkpointLocation", f"{self.folder}/offsets")
        return writer.trigger(**(trigger or {"availableNow": True})).start()

    def universes(self) -> DataFrame:
        """(layer, bitmap) of all n-grams."""
        return S.merge(self.store.read_table("universes"), "layer")

    def counts(self) -> DataFrame:
        """(layer, ngram, tf) of all n-grams."""
        return self.store.read_table("counts").groupBy("layer", "ngram").agg(F.sum("tf").alias("tf"))

    def lut(self) -> DataFrame:
        """The token table."""
        return K.merge_lut(self.store.read_table("entries"))

    def vectors(self) -> DataFrame:
        """(key, bitmap): each text's n-grams of all layers, for the ring."""
        return S.merge(self.store.read_table("vectors"), self.key)
