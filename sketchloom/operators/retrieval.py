"""Retrieval over a timeline of sketches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import estimators as E
from ..functions import hashing as H
from . import sketch as S


def encode(queries: DataFrame, text: str, key: str) -> DataFrame:
    """Long form of each query's lower-cased words."""
    return S.long_form(queries.select(key, F.explode(H.words(F.col(text), lower=True)).alias("token")), "token", key)


def relevance(pairs: DataFrame) -> DataFrame:
    """Add forward, reverse and their harmonic mean; a is the query."""
    some = (F.col("card_a") >= 1) & (F.col("card_b") >= 1)
    f = F.when(some, F.col("card_ab") / F.col("card_a")).otherwise(0.0)
    r = F.when(some, F.col("card_ab") / F.col("card_b")).otherwise(0.0)
    return pairs.withColumn("forward", f).withColumn("reverse", r).withColumn("score", F.when(F.col("forward") + F.col("reverse") > 1e-9, 2 * F.col("forward") * F.col("reverse") / (F.col("forward") + F.col("reverse"))).otherwise(0.0))


def expand(query: DataFrame, levels: DataFrame, scored: DataFrame, key: str, tau: float = 0.3, temperature: float = 0.0) -> DataFrame:
    """(reg, zeros) of the query with all levels that are relevant enough."""
    keep = scored.where((F.col("score") > tau * (1 - temperature * 0.5)) | (F.col("forward") > 0.3)).select(F.col("b").alias(key))
    return S.union(query.select("reg", "zeros"), levels.join(keep, key, "left_semi").select("reg", "zeros"))


def collect_context(query: DataFrame, levels: DataFrame, time: str, tau: float = 0.3, temperature: float = 0.0, max_depth: int = 10, p: int = H.P_BITS, accept: Column | None = None) -> DataFrame:
    """(depth, time, tau, rho, accepted, flux, stops_here): walk back in time, newest level first.

    A level is accepted if it covers enough of the query or shares anything with
    it; its flux is what the context gains.  The walk stops after three fluxes
    below 1.  All levels' overlaps come from one join, all gains from the depth
    at which each position is first accepted.
    """
    m = 2**p
    depths = levels.select(time).distinct().withColumn("depth", F.row_number().over(W.orderBy(F.desc(time))) - 1).where(F.col("depth") <= max_depth)
    # at most max_depth + 1 rows
    rows = levels.join(F.broadcast(depths), time).select("depth", time, "reg", "zeros").join(query.select("reg", "zeros", F.lit(1).alias("q")), ["reg", "zeros"], "left")
    counts = rows.groupBy("depth", time, "zeros").agg(F.count(F.lit(1)).alias("c"), F.count("q").alias("c_q"))
    g = counts.groupBy("depth", time).agg(*E.ht_aggregates(m, "c", name="l"), *E.ht_aggregates(m, "c_q", name="o"))
    size = float((S.cardinality(query.select("reg", "zeros"), p=p).first() or {"card": 0.0})["card"])
    seen = g.select("depth", time, E.ht_estimate(m, "l").alias("level_card"), E.ht_estimate(m, "o").alias("overlap"))
    seen = seen.withColumn("tau", E.ratio(F.col("overlap"), F.lit(size))).withColumn("rho", 1 - E.ratio(F.col("overlap"), F.col("level_card")))
    ok = (F.col("tau") >= tau * (1 - temperature)) | (F.col("overlap") >= 1)
    seen = seen.withColumn("accepted", (F.col("level_card") >= 1) & ok & (F.lit(True) if accept is None else accept))
    taken = rows.join(seen.where("accepted").select("depth"), "depth", "left_semi").where("q IS NULL")
    first = taken.groupBy("reg", "zeros").agg(F.min("depth").alias("depth")).groupBy("depth", "zeros").agg(F.count(F.lit(1)).alias("n"))
    own = query.groupBy("zeros").agg(F.count(F.lit(1)).alias("n")).select(F.lit(-1).alias("depth"), "zeros", "n")
    grid = depths.select("depth").union(depths.sparkSession.range(1).select(F.lit(-1))).select("depth", F.explode(F.sequence(F.lit(0), F.lit(H.BITS - 1))).alias("zeros"))
    so_far = W.partitionBy("zeros").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    state = grid.join(first.unionByName(own), ["depth", "zeros"], "left").fillna(0, ["n"]).withColumn("c", F.sum("n").over(so_far))
    total = state.groupBy("depth").agg(*E.ht_aggregates(m)).select("depth", E.ht_estimate(m).alias("total"))
    flux = total.withColumn("flux", F.col("total") - F.lag("total").over(W.orderBy("depth"))).where("depth >= 0").select("depth", "flux")
    three = W.orderBy("depth").rowsBetween(-2, 0)
    still = (F.count("flux").over(three) == 3) & (F.max(F.abs("flux")).over(three) < 1)
    before = W.orderBy("depth").rowsBetween(W.unboundedPreceding, -1)
    out = seen.join(flux, "depth").withColumn("still", still)
    return out.withColumn("stopped", F.coalesce(F.max("still").over(before), F.lit(False))).where("NOT stopped").select("depth", time, "tau", "rho", "accepted", "flux", F.col("still").alias("stops_here"))


def forward(query: DataFrame, levels: DataFrame, time: str, tau: float = 0.3, rho: float = 0.7, temperature: float = 0.0, max_depth: int = 10) -> DataFrame:
    """``collect_context`` with the choice of single-pass retrieval.

    A warm search takes every level that qualifies, a cold one those that cover
    half the query; a level that covers little and holds much else is refused.
    """
    choose = F.lit(True) if temperature > 0.4 else F.col("tau") > 0.5
    veto = (F.col("tau") < 0.3) & (F.col("rho") > rho)
    return collect_context(query, levels, time, tau, temperature, max_depth, accept=choose & ~veto)


def chain(pairs: DataFrame, least: float = 0.01) -> DataFrame:
    """(a, b, p): transitions by tau(a -> b), normalised over all b, the small ones dropped."""
    t = pairs.where("a <> b").withColumn("tau", E.tau(F.col("card_ab"), F.col("card_b"))).where("tau > 0")
    return t.withColumn("p", F.col("tau") / F.sum("tau").over(W.partitionBy("a"))).where(F.col("p") >= least).select("a", "b", "tau", "p")


def centrality(edges: DataFrame) -> DataFrame:
    """(node, centrality): the sum of what points at it."""
    return edges.groupBy(F.col("b").alias("node")).agg(F.sum("tau").alias("centrality"))


def prompt(documents: list[tuple[str, str, float]], query: str, width: int = 200) -> str:
    """Plain text for a language model: the query and the documents, most central first."""
    lines = [f"Query: {query}", "", "Context:"]
    for name, text, weight in sorted(documents, key=lambda d: (-d[2], d[0])):
        cut = text if len(text) <= width else text[:width].rstrip() + "..."
        lines.append(f"- [{name}, weight {weight:.3f}] {cut}")
    return "\n".join(lines)


def forward_two_phase(query: DataFrame, levels: DataFrame, time: str, least: float, **options) -> DataFrame:
    """``collect_context`` over the levels that share enough with the query: a cheap choice first, then the walk.

    The first phase counts common positions, as a share of the query's.
    """
    size = query.select("reg", "zeros").distinct().count()
    shared = levels.join(query.select("reg", "zeros").distinct(), ["reg", "zeros"], "left_semi").groupBy(time).agg(F.count(F.lit(1)).alias("n"))
    chosen = shared.where(F.col("n") >= least * size).select(time)
    return collect_context(query, levels.join(chosen, time, "left_semi"), time, **options)


def forward_chain(scored: DataFrame, transitions: DataFrame, steps: int = 2) -> DataFrame:
    """(node, weight): the query's relevance (b, score) spread along a chain (a, b, p) for some steps.

    The walk is followed in distribution, not drawn, so the result is the mean
    of all walks.
    """
    total = F.sum("score").over(W.partitionBy())
    at = scored.where("score > 0").select(F.col("b").alias("node"), (F.col("score") / total).alias("weight"))
    for _ in range(steps):
        at = at.join(transitions.select(F.col("a").alias("node"), F.col("b").alias("to"), "p"), "node").groupBy(F.col("to").alias("node")).agg(F.sum(F.col("weight") * F.col("p")).alias("weight"))
    return at
