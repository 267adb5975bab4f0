"""Sharding by a hierarchical weighted hash tree.

A tree has regions, regions have racks, racks have shards.  A document descends
the three levels; at each, every child draws -ln(u) / weight with u taken from
a hash of (document, child), and the smallest draw wins, so children win in
proportion to their weights.  A child's draw depends on that child alone: when
weights change, documents move only into or out of subtrees whose weights
changed.  A new shard is hung into the tree as a region of its own.  The weights
of all older subtrees stay as they are, hence the new shard takes documents and
no other document moves.

Everything is a Column expression: three hashes and three minima per row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize, text_of

Rack = tuple[float, ...]
Region = tuple[Rack, ...]


@dataclass(frozen=True)
class HashTree:
    """Weights of the shards, nested as regions of racks of shards; all above 0."""

    regions: tuple[Region, ...]

    def __post_init__(self):
        if not self.regions or any(not g or any(not r or min(r) <= 0 for r in g) for g in self.regions):
            raise ValueError("every region needs racks, every rack shards, every shard a weight above 0")

    @classmethod
    def uniform(cls, regions: int = 2, racks: int = 2, shards: int = 2) -> "HashTree":
        return cls(tuple(tuple((1.0,) * shards for _ in range(racks)) for _ in range(regions)))

    def grown(self, weight: float = 1.0) -> "HashTree":
        """The tree with one more shard, numbered after all others."""
        return HashTree(self.regions + (((weight,),),))

    def n_shards(self) -> int:
        return sum(len(rack) for region in self.regions for rack in region)


def _pick(key: Column, level: str, names: list[str], weights: list[float]) -> Column:
    """Index of the child with the smallest weighted draw."""
    if len(names) == 1:
        return F.lit(0)
    draws = []
    for i, (name, weight) in enumerate(zip(names, weights)):
        digest = F.md5(F.concat(F.lit(f"{level}/{name}/"), key))
        u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0**52)
        draws.append(F.struct((-F.log(u) / F.lit(float(weight))).alias("d"), F.lit(i).alias("i")))
    return F.least(*draws)["i"]


def shard_of(key: Column, tree: HashTree) -> Column:
    """The shard of ``key`` (a string column; null counts as a key of its own)."""
    key = F.coalesce(key, F.lit("null"))
    first, starts = 0, []
    for region in tree.regions:
        starts.append([])
        for rack in region:
            starts[-1].append(first)
            first += len(rack)

    def within(g: int) -> Column:
        racks = tree.regions[g]
        out = None
        pick = _pick(key, "rack", [f"{g}.{r}" for r in range(len(racks))], [sum(r) for r in racks])
        for r, rack in enumerate(racks):
            leaf = _pick(key, "shard", [f"{g}.{r}.{s}" for s in range(len(rack))], list(rack)) + F.lit(starts[g][r])
            out = leaf if len(racks) == 1 else (F.when(pick == r, leaf) if out is None else out.when(pick == r, leaf))
        return out

    region = _pick(key, "region", [str(g) for g in range(len(tree.regions))], [sum(map(sum, g)) for g in tree.regions])
    out = None
    for g in range(len(tree.regions)):
        out = within(g) if len(tree.regions) == 1 else (F.when(region == g, within(g)) if out is None else out.when(region == g, within(g)))
    return out.cast("int")


def number_slots(rows: DataFrame, shard: str, order: list[str], slot: str, per_task: int = 200_000) -> DataFrame:
    """Add ``slot``: places 0, 1, 2, ... within each shard in the order given.

    Shards are few and large, so no task gets a whole one.  The rows are dealt
    out by ranges of the order, numbered within (range, shard), and shifted by
    the number of rows that earlier ranges have in the shard.  The ranges are
    written down first, so all later reads see the same ones.
    """
    rows = materialize(rows, "slots-rows")
    n = rows.count()
    parts = max(1, -(-n // per_task), rows.sparkSession.sparkContext.defaultParallelism if n > 10_000 else 1)
    ranged = materialize(
        rows.repartitionByRange(parts, *order).withColumn("s_part", F.spark_partition_id()), "slots-ranges"
    )
    before = W.partitionBy(shard).orderBy("s_part").rowsBetween(W.unboundedPreceding, -1)
    shift = (
        ranged.groupBy(shard, "s_part")
        .agg(F.count(F.lit(1)).alias("s_n"))
        .select(shard, "s_part", F.coalesce(F.sum("s_n").over(before), F.lit(0)).alias("s_before"))
    )
    own = W.partitionBy(shard, "s_part").orderBy(*order)
    return (
        ranged.withColumn("s_row", F.row_number().over(own).cast("long"))
        .join(shift, [shard, "s_part"])
        .withColumn(slot, F.col("s_row") - 1 + F.col("s_before"))
        .drop("s_row", "s_before", "s_part")
    )


def shard_documents(docs: DataFrame, tree: HashTree) -> DataFrame:
    """Return (doc_id, size, text_crc32, law, shard, slot, grown_shard), one row per document.

    doc_id and the tree alone decide the shard (law ``key``), so rows that
    repeat an id share a shard.  ``size`` is the number of UTF-8 bytes plus one,
    a null text counting as empty.  ``slot`` numbers a shard's rows without gaps
    in the order of (doc_id, text_crc32, size); ``grown_shard`` is the shard
    after ``tree.grown()``.  A null doc_id is one key.  Other columns are
    ignored; an empty table gives an empty result.
    """
    key = F.col("doc_id").cast("string")
    rows = docs.select(
        "doc_id",
        (F.octet_length(text_of()) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text_of(), "UTF-8")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(key, tree).alias("shard"),
        shard_of(key, tree.grown()).alias("grown_shard"),
    )
    placed = number_slots(rows, "shard", ["doc_id", "text_crc32", "size"], "slot")
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
