"""Bit vectors over F2: basis, rank, exact decomposition, transactions.

A vector is an array of bit positions.  Elimination goes by stretches of the
order: a vector that depends on earlier ones of its own stretch is no base
anywhere, so each stretch keeps its independent vectors, and neighbouring
stretches are merged pairwise until one is left.  A task holds no more than two
bases, of at most one vector a position each, however many vectors there are.
All vectors are then expressed in the base in slices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..sources.tables import written
from . import sketch as S

#: Vectors of one ring that a task takes at a time.
VECTORS = 2000


def vectors(long: DataFrame, key: str) -> DataFrame:
    """(key, bits): sketches as sorted arrays of positions."""
    return long.groupBy(key).agg(F.array_sort(F.collect_list(F.col("reg") * H.BITS + F.col("zeros"))).alias("bits"))


class Basis:
    """Echelon basis of integers used as bit vectors, with each row's expression in added vectors."""

    def __init__(self):
        self.rows: dict[int, tuple[int, int]] = {}

    def reduce(self, v: int) -> tuple[int, int]:
        """What is left of v, and the added vectors (as a bit mask) whose sum was taken off."""
        used = 0
        while v:
            row = self.rows.get(v.bit_length())
            if row is None:
                break
            v, used = v ^ row[0], used ^ row[1]
        return v, used

    def add(self, v: int, index: int) -> tuple[bool, int]:
        """Whether v is new, and the vectors that it is the sum of (itself, if new)."""
        rest, used = self.reduce(v)
        if rest:
            self.rows[rest.bit_length()] = (rest, used ^ (1 << index))
            return True, 1 << index
        return False, used

    def rank(self) -> int:
        return len(self.rows)


def as_int(bits) -> int:
    out = bytearray(max(bits, default=0) // 8 + 1)
    for b in bits:
        out[b // 8] |= 1 << (b % 8)
    return int.from_bytes(out, "little")


def decompose(rows: DataFrame, ring: str, key: str, order: str, per_task: int = VECTORS) -> DataFrame:
    """(ring, key, is_base, rank, expression): vectors in order, as sums of earlier bases.

    ``expression`` names the original vectors whose XOR is the vector exactly.
    Vectors of one place in the order are taken by key.
    """
    kinds = dict(rows.dtypes)
    out = f"{ring} {kinds[ring]}, {key} {kinds[key]}, is_base boolean, rank int, expression array<{kinds[key]}>"
    rows = written(rows.select(F.col(ring).alias("_ring"), F.col(key).alias("_key"), F.col(order).alias("_order"), "bits", F.monotonically_increasing_id().alias("_row")))
    stretches = max(1, -(-rows.count() // per_task))
    by = ["_order", "_key", "_row"]

    def in_order(pdf):
        # a null has no place among values that pandas compares, so it is taken first
        return pdf.sort_values(by, na_position="first")

    def independent(pdf):
        pdf, basis = in_order(pdf), Basis()
        return pdf[[basis.add(as_int(b), 0)[0] for b in pdf["bits"]]]

    if stretches == 1:

        def whole(pdf):
            pdf, basis, names, found = in_order(pdf), Basis(), [], []
            for k, bits in zip(pdf["_key"], pdf["bits"]):
                new, used = basis.add(as_int(bits), len(names))
                if new:
                    names.append(k)
                found.append((new, basis.rank(), [n for i, n in enumerate(names) if used >> i & 1]))
            return pdf[["_ring", "_key"]].set_axis([ring, key], axis=1).assign(is_base=[f[0] for f in found], rank=[f[1] for f in found], expression=[f[2] for f in found])

        return rows.groupBy("_ring").applyInPandas(whole, out)

    ranged = rows.repartitionByRange(stretches, "_ring", *by).withColumn("_part", F.spark_partition_id())
    base = written(ranged.groupBy("_ring", "_part").applyInPandas(independent, ranged.schema))
    while stretches > 1:
        halved = base.withColumn("_part", F.floor(F.col("_part") / 2).cast("int"))
        base = written(halved.groupBy("_ring", "_part").applyInPandas(independent, base.schema))
        stretches = -(-stretches // 2)

    def echelon(pdf):
        pdf, basis = in_order(pdf), Basis()
        for i, bits in enumerate(pdf["bits"]):
            basis.add(as_int(bits), i)
        as_bytes = lambda x: x.to_bytes((x.bit_length() + 7) // 8, "little")
        held = [(as_bytes(rest), as_bytes(used)) for rest, used in basis.rows.values()]
        return pdf[["_ring", "_key", "_order", "_row"]].assign(_rest=[h[0] for h in held], _used=[h[1] for h in held])

    names = "_ring {0}, _key {1}, _order {2}, _row long, _rest binary, _used binary".format(*(dict(rows.dtypes)[c] for c in ("_ring", "_key", "_order")))
    reduced = written(base.groupBy("_ring").applyInPandas(echelon, names))
    slices = max(1, -(-rows.count() // per_task))
    dealt = rows.withColumn("_slice", F.pmod(F.xxhash64("_row"), F.lit(slices)).cast("int"))
    spread = reduced.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))

    def express(pdf, held):
        import pandas as pd

        held, basis = in_order(held), Basis()
        for rest, used in zip(held["_rest"], held["_used"]):
            rest = int.from_bytes(rest, "little")
            basis.rows[rest.bit_length()] = rest, int.from_bytes(used, "little")
        bases, keys = set(held["_row"]), list(held["_key"])
        placed = in_order(pd.concat([pdf[by], held[by]]).drop_duplicates("_row"))
        rank = dict(zip(placed["_row"], placed["_row"].isin(bases).cumsum()))
        used = [basis.reduce(as_int(b))[1] for b in pdf["bits"]]
        found = [[k for i, k in enumerate(keys) if u >> i & 1] for u in used]
        return pdf[["_ring", "_key"]].set_axis([ring, key], axis=1).assign(is_base=[r in bases for r in pdf["_row"]], rank=[int(rank[r]) for r in pdf["_row"]], expression=pd.Series(found, index=pdf.index, dtype=object))

    return dealt.groupBy("_ring", "_slice").cogroup(spread.groupBy("_ring", "_slice")).applyInPandas(express, out)


def partial_basis(rows: DataFrame, ring: str, key: str) -> DataFrame:
    """Rows of ``rows`` that are independent within their partition; the span stays the same."""

    def run(batches):
        found: dict = {}
        for pdf in batches:
            keep = [found.setdefault(r, Basis()).add(as_int(b), 0)[0] for r, b in zip(pdf[ring], pdf["bits"])]
            yield pdf[keep]

    return rows.select(ring, key, "bits").mapInPandas(run, rows.select(ring, key, "bits").schema)


def reconstruct(decomposed: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """(key, bit): the XOR of each vector's expression, as parity of its bases' bits."""
    named = decomposed.select(F.col(key).alias("target"), F.explode("expression").alias(key))
    bits = named.join(rows.select(key, F.explode("bits").alias("bit")), key)
    return bits.groupBy("target", "bit").count().where("count % 2 = 1").select(F.col("target").alias(key), "bit")


def search(query: DataFrame, lut: DataFrame, members: DataFrame, key: str, least: float = 0.0, most: float = float("inf")) -> DataFrame:
    """(key, overlap, card): sets that share a position with the explained part of a query."""
    known = query.join(lut.select("reg", "zeros").distinct(), ["reg", "zeros"], "left_semi")
    cards = S.cardinality(members, key).where((F.col("card") >= least) & (F.col("card") <= most))
    hits = members.join(known, ["reg", "zeros"], "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("overlap"))
    return hits.join(cards, key)


def snapshot_diff(before: DataFrame, after: DataFrame, *keys: str) -> DataFrame:
    """Ids added, removed and shared between two snapshots (keys..., ids array)."""
    j = after.select(*keys, F.col("ids").alias("new")).join(before.select(*keys, F.col("ids").alias("old")), list(keys), "full")
    none = F.array().cast("array<string>")
    new, old = F.coalesce("new", none), F.coalesce("old", none)
    return j.select(
        *keys, F.array_sort(F.array_except(new, old)).alias("added"), F.array_sort(F.array_except(old, new)).alias("removed"),
        F.array_sort(F.array_intersect(new, old)).alias("shared"), (F.size(new) - F.size(old)).alias("rank_delta"),
    )


def matrix(rows: DataFrame, key: str) -> DataFrame:
    """(key, bit): the ones of the matrix whose rows are the vectors."""
    return rows.select(key, F.explode("bits").alias("bit"))


def rank(rows: DataFrame, ring: str, key: str) -> DataFrame:
    """(ring, vectors, rank): each partition reduces its own vectors first, so one task sees at most a basis of each."""
    n = rows.groupBy(ring).agg(F.count(F.lit(1)).alias("vectors"))
    d = decompose(partial_basis(rows, ring, key), ring, key, key)
    return n.join(d.groupBy(ring).agg(F.max("rank").alias("rank")), ring)


def stats(decomposed: DataFrame, ring: str) -> DataFrame:
    """(ring, vectors, rank, compression): vectors held by how many bases."""
    g = decomposed.groupBy(ring).agg(F.count(F.lit(1)).alias("vectors"), F.count_if("is_base").alias("rank"))
    return g.withColumn("compression", F.col("vectors") / F.greatest(F.col("rank"), F.lit(1)))
