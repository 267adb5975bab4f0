"""Pairwise measures of sketches.

Packed sketches are dealt into blocks; every block of the one side meets every
block of the other, and a cell counts, by one matrix product a bit, the
registers that each pair shares.  With each sketch's own counts this gives the
counts of the intersection, the differences, the union and the symmetric
difference.  A result has n * n rows by definition; with ``disjoint=False``
pairs without a common position are left out, as for graphs under a threshold.
No position that many sketches share becomes a frequent key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import estimators as E
from ..functions import hashing as H
from .sketch import pack

#: Sketches of a block: their bits take 128 KB each as numbers.
BLOCK = 256
#: Counts of a measure from those of a, of b and of both.
MEASURES = {
    "card_a": lambda a, b, ab: a,
    "card_b": lambda a, b, ab: b,
    "card_ab": lambda a, b, ab: ab,
    "card_a_not_b": lambda a, b, ab: a - ab,
    "card_b_not_a": lambda a, b, ab: b - ab,
    "card_or": lambda a, b, ab: a + b - ab,
    "card_xor": lambda a, b, ab: a + b - 2 * ab,
}


def _cell(p: int, disjoint: bool):
    def planes(t: pa.Table) -> np.ndarray:
        bits = np.frombuffer(b"".join(t["bitmap"].to_pylist()), dtype=np.uint8).reshape(t.num_rows, -1)
        return np.unpackbits(bits, axis=1, bitorder="little").reshape(t.num_rows, 2**p, H.BITS).transpose(2, 0, 1).astype(np.float32)

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        x, y = planes(left), planes(right)
        own_a, own_b = x.sum(axis=2).T[:, None, :], y.sum(axis=2).T[None, :, :]
        shared = np.stack([u @ v.T for u, v in zip(x, y)], axis=-1)
        pops = [np.broadcast_to(c.sum(axis=-1), shared.shape[:2]) for c in (own_a, own_b, shared)]
        keep = np.flatnonzero((pops[2] > 0).ravel() | disjoint)
        counts = {k: np.broadcast_to(f(own_a, own_b, shared), shared.shape) for k, f in MEASURES.items()}
        i, j = np.divmod(keep, shared.shape[1])
        columns = {"a": left["k"].take(pa.array(i)), "b": right["k"].take(pa.array(j))}
        columns |= {k: pa.array(E.ht_array(c.reshape(-1, H.BITS)[keep], 2**p)) for k, c in counts.items()}
        columns |= {n: pa.array(c.ravel()[keep].astype(np.int64)) for n, c in zip(("pop_a", "pop_b", "pop_ab"), pops)}
        return pa.table(columns)

    def guarded(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            kinds = [("a", left.schema.field("k").type), ("b", right.schema.field("k").type)]
            kinds += [(k, pa.float64()) for k in MEASURES] + [(n, pa.int64()) for n in ("pop_a", "pop_b", "pop_ab")]
            return pa.schema(kinds).empty_table()
        return run(key, left, right)

    return guarded


def overlaps(long: DataFrame, other: DataFrame | None = None, key: str = "set_id", p: int = H.P_BITS, disjoint: bool = True, block: int = BLOCK) -> DataFrame:
    """(a, b, card_a, card_b, card_ab, card_a_not_b, card_b_not_a, card_or, card_xor, pop_a, pop_b, pop_ab).

    All pairs of a sketch in ``long`` and one in ``other`` (default: ``long``),
    a sketch with itself included; those that share no position only if
    ``disjoint``.
    """
    sides, kinds = [], []
    for df in (long, long if other is None else other):
        kinds.append(dict(df.dtypes)[key])
        sides.append(pack(df.select(F.col(key).alias("k"), "reg", "zeros").distinct(), "k", p=p))
    n = [-(-df.select(key).distinct().count() // block) or 1 for df in ([long] if other is None else [long, other])]
    n = (n * 2)[:2]
    spot = lambda blocks: F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = sides[0].select("k", "bitmap", spot(n[0]).alias("i"), every(n[1]).alias("j"))
    right = sides[1].select("k", "bitmap", spot(n[1]).alias("j"), every(n[0]).alias("i"))
    schema = ", ".join([f"a {kinds[0]}", f"b {kinds[1]}", *(f"{k} double" for k in MEASURES), "pop_a long", "pop_b long", "pop_ab long"])
    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(_cell(p, disjoint), schema)


def similarities(pairs: DataFrame) -> DataFrame:
    """Add jaccard and cosine."""
    return pairs.withColumn("jaccard", E.ratio(F.col("card_ab"), F.col("card_or"))).withColumn(
        "cosine", E.ratio(F.col("card_ab"), F.sqrt(F.col("card_a") * F.col("card_b")))
    )


def hamming(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("hamming", F.col("pop_a") + F.col("pop_b") - 2 * F.col("pop_ab"))


def directed(pairs: DataFrame) -> DataFrame:
    """Add tau and rho of a towards b."""
    return pairs.withColumn("tau", E.tau(F.col("card_ab"), F.col("card_b"))).withColumn("rho", E.rho(F.col("card_a_not_b"), F.col("card_b")))


def directed_by_bits(pairs: DataFrame) -> DataFrame:
    """tau and rho from bits set instead of estimates; only the upper bound is enforced."""
    b = F.col("pop_b")
    one = F.lit(1.0)
    return pairs.withColumn("tau", F.when(b > 0, F.least(one, F.col("pop_ab") / b)).otherwise(0.0)).withColumn(
        "rho", F.when(b > 0, F.least(one, (F.col("pop_a") - F.col("pop_ab")) / b)).otherwise(1.0)
    )


def morphisms(pairs: DataFrame, tau: float = 0.7, rho: float = 0.3) -> DataFrame:
    """Whether a maps to b under the thresholds, and by what margins."""
    if not 0 <= rho < tau <= 1:
        raise ValueError("0 <= rho < tau <= 1")
    d = directed(pairs)
    return d.withColumn("exists", (F.col("tau") >= tau) & (F.col("rho") <= rho)).withColumn("margin_tau", F.col("tau") - tau).withColumn("margin_rho", rho - F.col("rho"))


def morphism_graph(pairs: DataFrame, tau: float = 0.7, rho: float = 0.3) -> DataFrame:
    """Edges a -> b between different sketches."""
    return morphisms(pairs, tau, rho).where("exists AND a <> b").select("a", "b", "tau", "rho")


def summary(pairs: DataFrame) -> DataFrame:
    """A verdict in words on each pair's directed similarity."""
    d = directed(pairs)
    return d.withColumn(
        "verdict",
        F.when(F.col("tau") >= 0.9, "nearly covers").when(F.col("tau") >= 0.7, "mostly covers").when(F.col("tau") >= 0.3, "overlaps").when(F.col("tau") > 0, "touches").otherwise("disjoint"),
    )


def relations(pairs: DataFrame) -> DataFrame:
    """(a, b, a_empty, subset, equal) from the bits of each pair."""
    ab, a, b = F.col("pop_ab"), F.col("pop_a"), F.col("pop_b")
    return pairs.select("a", "b", (a == 0).alias("a_empty"), (ab == a).alias("subset"), ((ab == a) & (ab == b)).alias("equal"))


def near_values(rows: DataFrame, key: str, value: str, within: float) -> DataFrame:
    """(a, b) of keys whose values differ by at most ``within``: a range join through buckets of that width."""
    at = rows.select(F.col(key).alias("k"), F.col(value).alias("v"), F.floor(F.col(value) / within).alias("cell"))
    left = at.select(F.col("k").alias("a"), F.col("v").alias("va"), F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell"))
    right = at.select(F.col("k").alias("b"), F.col("v").alias("vb"), "cell")
    return left.join(right, "cell").where((F.col("a") < F.col("b")) & (F.abs(F.col("va") - F.col("vb")) <= within)).select("a", "b")
