"""A draft workspace: ingest batches, search, then commit or roll back.

Nothing is written before ``commit``; a draft is a set of lazy DataFrames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ring as G
from . import sketch as S
from . import tokens as K


class Transaction:
    """Batches (batch, token) on their way into a store."""

    def __init__(self):
        self.phase, self._rows = "ACTIVE", None

    def _active(self) -> None:
        if self.phase != "ACTIVE":
            raise RuntimeError(f"the transaction is {self.phase}")

    def ingest(self, rows: DataFrame) -> "Transaction":
        self._active()
        rows = rows.select(F.col("batch").cast("string").alias("batch"), "token")
        self._rows = rows if self._rows is None else self._rows.unionByName(rows)
        return self

    def rows(self) -> DataFrame:
        if self._rows is None:
            raise RuntimeError("nothing was ingested")
        return self._rows

    def batch_ids(self) -> DataFrame:
        """(batch, batch_id): the address of each batch's sorted distinct tokens."""
        tokens = F.array_sort(F.array_distinct(F.collect_list("token")))
        return self.rows().groupBy("batch").agg(F.sha1(F.array_join(tokens, "\u0000")).alias("batch_id"))

    def long(self) -> DataFrame:
        return S.long_form(self.rows(), "token", "batch")

    def lut(self) -> DataFrame:
        return K.build_lut(self.rows().select(F.lit(0).alias("layer"), F.col("token").alias("ngram")))

    def ranks(self) -> DataFrame:
        """(batch, rank, rank_delta, is_base) in the order of the batches."""
        vectors = G.vectors(self.long(), "batch").withColumn("ring", F.lit("draft"))
        d = G.decompose(vectors, "ring", "batch", "batch")
        return d.select("batch", "rank", F.col("is_base").cast("int").alias("rank_delta"), "is_base")

    def search(self, query: DataFrame, least: float = 0.0, most: float = float("inf")) -> DataFrame:
        """(batch, overlap, card) of batches that share an explained position with the query."""
        self._active()
        return G.search(query, self.lut(), self.long(), "batch", least, most)

    def orphans(self, query: DataFrame) -> DataFrame:
        return K.orphans(self.lut(), query)

    def per_batch(self) -> DataFrame:
        return S.build(self.rows(), "token", "batch")

    def from_bases(self) -> DataFrame:
        """The union of the batches that are independent of earlier ones."""
        kept = self.ranks().where("is_base").select("batch")
        return S.merge(self.per_batch().join(kept, "batch", "left_semi"))

    def commit(self, path: str | None = None) -> DataFrame:
        """The union of all batches, as one named sketch; written to ``path`` if given."""
        self._active()
        out = S.name(S.merge(self.per_batch()))
        if path:
            out.write.mode("errorifexists").parquet(path)
        self.phase = "COMMITTED"
        return out

    def rollback(self) -> None:
        self._active()
        self.phase, self._rows = "ROLLED_BACK", None


def merge_into_ring(base: DataFrame, draft: Transaction) -> DataFrame:
    """(key, is_base, rank, expression): a ring's vectors (key, bits) and after them the draft's batches, decomposed together."""
    old = base.select(F.lit("ring").alias("ring"), F.col("key").cast("string").alias("key"), "bits", F.concat(F.lit("0"), F.col("key").cast("string")).alias("o"))
    new = G.vectors(draft.long(), "batch").select(F.lit("ring").alias("ring"), F.col("batch").alias("key"), "bits", F.concat(F.lit("1"), "batch").alias("o"))
    return G.decompose(old.unionByName(new), "ring", "key", "o").drop("ring")
