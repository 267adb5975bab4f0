"""Exact deduplication by 128-bit content hash, with a comparison of the bytes.

Native: DataFrame functions only.

A first aggregation groups by (md5, text): rows meet by their 128-bit hash and
the grouping then compares the texts themselves, so two texts that share a hash
stay two classes.  It combines copies before the shuffle, thus a group that
holds a third of all rows arrives as one row per task.  The classes, without
their texts, are written once.  Rows find their class again by an address
(md5, sha256, length); should two different texts ever share an address, the
query fails rather than merge them.

The way back to the rows meets the large groups again.  Classes that hold at
least one row in ``HEAVY`` are at most ``HEAVY`` in number, so those are
broadcast, and their rows pass no shuffle.  The rest are joined, where no key
can then hold more than one row in ``HEAVY``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_of

HEAVY = 1000


def _address(text):
    return [
        F.unhex(F.md5(text)).alias("a_md5"),
        F.unhex(F.sha2(text, 256)).alias("a_sha"),
        F.octet_length(text).alias("a_len"),
    ]


def _classes(docs: DataFrame, prefer: str) -> DataFrame:
    """One row per distinct text: its address, the id that stays, and its size."""
    best = F.max("doc_id") if prefer == "largest" else F.min("doc_id")
    text = text_of()
    by_bytes = (
        docs.select("doc_id", F.unhex(F.md5(text)).alias("h"), text.alias("t"))
        .groupBy("h", "t")
        .agg(F.count(F.lit(1)).alias("n"), best.alias("k"))
    )
    return (
        by_bytes.select(*_address(F.col("t")), "n", "k")
        .groupBy("a_md5", "a_sha", "a_len")
        .agg(F.sum("n").alias("group_size"), F.max("k").alias("keep_id"), F.count(F.lit(1)).alias("texts"))
        .withColumn(
            "group_size",
            F.when(F.col("texts") == 1, F.col("group_size")).otherwise(
                F.raise_error(F.lit("different texts share md5, sha256 and length")).cast("long")
            ),
        )
        .drop("texts")
    )


def exact_dedup(docs: DataFrame, prefer: str = "smallest") -> DataFrame:
    """Return (doc_id, keep_id, group_size, kept, text_sha256), one row per row of ``docs``.

    Texts are equal when their bytes are; a null text counts as empty.
    ``prefer`` names the id of a group that stays: "smallest" or "largest".
    Columns other than doc_id and text are ignored.  A null doc_id never stays
    unless its whole group has null ids (keep_id is then null).  Rows that
    repeat both doc_id and text count singly in group_size, and all rows with
    the staying id are marked kept.  An empty table gives an empty result.
    """
    if prefer not in ("smallest", "largest"):
        raise ValueError("prefer is 'smallest' or 'largest'")
    classes = materialize(_classes(docs, prefer), "dedup-classes")
    total = classes.agg(F.sum("group_size")).first()[0] or 0
    key = ["a_md5", "a_sha", "a_len"]
    # at most HEAVY classes can each hold a share of 1 / HEAVY
    heavy = classes.where((F.col("group_size") > 1) & (F.col("group_size") >= total / HEAVY)).select(
        *key, F.col("group_size").alias("h_size"), F.col("keep_id").alias("h_keep")
    )
    rows = docs.select("doc_id", *_address(text_of())).join(F.broadcast(heavy), key, "left")
    # rows of heavy classes have all they need and pass no shuffle; the texts of the rest are hashed in a scan of their own
    rest = classes.select(F.col("a_md5").alias("c_md5"), F.col("a_sha").alias("c_sha"), F.col("a_len").alias("c_len"), "group_size", "keep_id")
    light = rows.where(F.col("h_size").isNull()).drop("h_size", "h_keep")
    joined = light.join(rest, (light.a_md5 == rest.c_md5) & (light.a_sha == rest.c_sha) & (light.a_len == rest.c_len), "left")
    found = joined.select("doc_id", "keep_id", "group_size", "a_sha").unionByName(
        rows.where(F.col("h_size").isNotNull()).select("doc_id", F.col("h_keep").alias("keep_id"), F.col("h_size").alias("group_size"), "a_sha")
    )
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("a_sha")).alias("text_sha256"))


def distinct_documents(docs: DataFrame, prefer: str = "smallest") -> DataFrame:
    """``docs`` with one row for each text, that of the preferred id, in the same columns.

    Equal bytes meet as in ``exact_dedup``, and the other columns of the row that
    stays travel through the aggregation, so the texts are shuffled once.  Of
    rows that share id and text, one stays.  A null text counts as empty and
    equals it.
    """
    rest = [c for c in docs.columns if c != "text"]
    text = text_of()
    tie = F.xxhash64(*[F.col(c) for c in rest if c != "doc_id"], F.col("text"))
    pick = F.max_by if prefer == "largest" else F.min_by
    last = F.lit(-(2**63)) if prefer == "largest" else F.lit(2**63 - 1)
    row = F.struct(F.col("text").isNull().alias("no_text"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(rest)])
    one = (
        docs.groupBy(F.unhex(F.md5(text)).alias("h"), text.alias("t"))
        .agg(pick(row, F.struct(F.coalesce(F.col("doc_id"), last).alias("d"), tie.alias("x"))).alias("r"))
    )
    back = {c: F.col(f"r.c{i}").alias(c) for i, c in enumerate(rest)}
    back["text"] = F.when(~F.col("r.no_text"), F.col("t")).alias("text")
    return one.select(*[back[c] for c in docs.columns])
