"""Probabilities as ratios of estimated cardinalities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import estimators as E
from ..functions import hashing as H
from . import sketch as S


def with_priors(pairs: DataFrame, universe: float) -> DataFrame:
    """Add p_a, p_b, p_ab, p_a_given_b, p_b_given_a to ``overlaps``."""
    u = F.lit(float(universe))
    return (
        pairs.withColumn("p_a", E.ratio(F.col("card_a"), u)).withColumn("p_b", E.ratio(F.col("card_b"), u)).withColumn("p_ab", E.ratio(F.col("card_ab"), u))
        .withColumn("p_a_given_b", E.ratio(F.col("card_ab"), F.col("card_b"))).withColumn("p_b_given_a", E.ratio(F.col("card_ab"), F.col("card_a")))
    )


def universe_card(long: DataFrame, p: int = H.P_BITS) -> float:
    """Estimated size of the union of all sets."""
    row = S.cardinality(long.select("reg", "zeros").distinct(), p=p).first()
    return float(row["card"]) if row else 0.0


def bayes_theorem(pairs: DataFrame) -> DataFrame:
    """P(A|B) from P(B|A), and how far it is from the direct ratio."""
    inverse = E.ratio(F.col("p_b_given_a") * F.col("p_a"), F.col("p_b"))
    return pairs.withColumn("posterior", inverse).withColumn("error", F.abs(inverse - F.col("p_a_given_b")))


def surprise(p: Column) -> Column:
    return F.when(p <= 0, F.lit(float("inf"))).when(p >= 1, 0.0).otherwise(-F.log2(p))


def entropy_term(p: Column) -> Column:
    return F.when((p > 0) & (p < 1), -p * F.log2(p)).otherwise(0.0)


def divergence_term(p: Column, q: Column) -> Column:
    return F.when((p > 0) & (q > 0), p * F.log2(p / q)).otherwise(0.0)


def surprise_gain(before: Column, after: Column) -> Column:
    """Difference of two surprises; 0 if both are infinite."""
    inf = F.lit(float("inf"))
    return F.when((before == inf) & (after == inf), 0.0).when(before == inf, -inf).when(after == inf, inf).otherwise(after - before)


def binary_entropy(p: Column) -> Column:
    return F.when((p <= 0) | (p >= 1), 0.0).otherwise(-p * F.log2(p) - (1 - p) * F.log2(1 - p))


def mutual_information(p_a: Column, p_b: Column, p_ab: Column) -> Column:
    """From the entropies of the four cells of a 2 x 2 table."""
    zero = F.lit(0.0)
    cells = (p_ab, F.greatest(zero, p_a - p_ab), F.greatest(zero, p_b - p_ab), F.greatest(zero, 1 - p_a - p_b + p_ab))
    joint = sum((F.when(c > 0, -c * F.log2(c)).otherwise(0.0) for c in cells[1:]), F.when(cells[0] > 0, -cells[0] * F.log2(cells[0])).otherwise(0.0))
    return F.greatest(zero, binary_entropy(p_a) + binary_entropy(p_b) - joint)


def independence(p_a: Column, p_b: Column, p_ab: Column, tolerance: float = 0.05) -> Column:
    return F.abs(p_ab - p_a * p_b) <= tolerance


def posteriors(pairs_at: DataFrame, entity_card: str = "card_ab", universe: str = "card_b") -> DataFrame:
    """P_t(A): the share of each time's universe that an entity covers."""
    return pairs_at.withColumn("posterior", E.ratio(F.col(entity_card), F.col(universe)))


def interpretation(flux: Column, dp: Column) -> tuple[Column, Column, Column]:
    """Verdicts on a change by flux and by probability, and how the two stand to each other."""
    by_flux = F.when(flux > 1, "growth").when(flux < -1, "decay").otherwise("balanced")
    by_belief = F.when(dp > 0.02, "strengthened").when(dp < -0.02, "weakened").otherwise("stable")
    up = F.when(flux > 1, 1).when(flux < -1, -1).otherwise(0)
    rise = F.when(dp > 0.02, 1).when(dp < -0.02, -1).otherwise(0)
    note = (
        F.when(up == rise, "agreement").when((up > 0) & (rise < 0), "dilution").when((up < 0) & (rise > 0), "concentration")
        .when(up == 0, "hidden shift").otherwise("divergence")
    )
    return by_flux, by_belief, note


def field_energy(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """One row: the energy of a random field over (p_a) nodes and (mi) edges."""
    own = nodes.agg(F.sum(F.when(F.col("p_a") > 0, -F.log("p_a")).otherwise(0.0)).alias("own"))
    shared = links.agg(F.coalesce(F.sum("mi"), F.lit(0.0)).alias("shared"))
    return own.crossJoin(shared).select((F.col("own") - F.col("shared")).alias("energy"))
