"""Bayesian networks over sketches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written


def edges(pairs: DataFrame, threshold: float = 0.1) -> DataFrame:
    """(parent, child, probability) of pairs that depend enough on each other.

    The larger set is the parent (the first by name, of equals); the probability
    is the share of the parent that the child covers.
    """
    strong = pairs.where("a < b").where(F.greatest(F.when(F.col("card_a") > 0, F.col("card_ab") / F.col("card_a")), F.when(F.col("card_b") > 0, F.col("card_ab") / F.col("card_b"))) >= threshold)
    a_first = F.col("card_a") >= F.col("card_b")
    pick = lambda x, y: F.when(a_first, F.col(x)).otherwise(F.col(y))
    return strong.select(
        pick("a", "b").alias("parent"), pick("b", "a").alias("child"), (F.col("card_ab") / pick("card_a", "card_b")).alias("probability"),
        pick("card_a", "card_b").alias("parent_card"), pick("card_b", "card_a").alias("child_card"),
    )


def from_graph(graph: DataFrame) -> DataFrame:
    """(parent, child) of a morphism graph (a, b): what a maps to is its parent."""
    return graph.select(F.col("b").alias("parent"), F.col("a").alias("child")).distinct()


def structure(net: DataFrame) -> DataFrame:
    """(nodes, edges, roots, leaves)."""
    n = net.select(F.col("parent").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(net.select("child", F.lit(0), F.lit(1)))
    per = n.groupBy("n").agg(F.max("up").alias("up"), F.max("down").alias("down"))
    counts = per.agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("down") == 0).alias("roots"), F.count_if(F.col("up") == 0).alias("leaves"))
    return counts.crossJoin(net.agg(F.count(F.lit(1)).alias("edges"))).select("nodes", "edges", "roots", "leaves")


def blankets(net: DataFrame) -> DataFrame:
    """(node, parents, children, coparents), each a sorted array."""
    up = net.groupBy(F.col("child").alias("node")).agg(F.array_sort(F.collect_set("parent")).alias("parents"))
    down = net.groupBy(F.col("parent").alias("node")).agg(F.array_sort(F.collect_set("child")).alias("children"))
    other = net.select(F.col("parent").alias("other"), "child")
    co = net.join(other, "child").where("other <> parent").groupBy(F.col("parent").alias("node")).agg(F.array_sort(F.collect_set("other")).alias("coparents"))
    none = F.array().cast("array<string>")
    return up.join(down, "node", "full").join(co, "node", "full").select("node", *[F.coalesce(c, none).alias(c) for c in ("parents", "children", "coparents")])


def propagate(net: DataFrame, beliefs: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """(node, belief) after one pass from parents to children.

    ``beliefs`` are (node, belief); nodes in ``evidence`` (node) have belief 1
    and keep it.  A child's belief is the mean of its parents', weighted by
    probability and belief; it keeps its own where those are all 0.  A round
    takes the nodes whose parents are all done, so there are as many rounds as
    the network has levels.  Nodes on or behind a cycle keep their own belief.
    """
    links = written(net.select("parent", "child", "probability"))
    sure = beliefs.select("node").where("false") if evidence is None else evidence.select("node").distinct()
    own = written(beliefs.select("node", "belief").join(sure.withColumn("sure", F.lit(True)), "node", "left").select("node", F.when(F.col("sure"), 1.0).otherwise(F.col("belief")).alias("belief"), F.coalesce("sure", F.lit(False)).alias("sure")))
    above = links.groupBy(F.col("child").alias("node")).agg(F.count(F.lit(1)).alias("parents"))
    done = written(own.join(above, "node", "left_anti").select("node", "belief"))
    while True:
        told = links.join(done.withColumnRenamed("node", "parent"), "parent").groupBy(F.col("child").alias("node")).agg(F.count(F.lit(1)).alias("told"), F.sum("belief").alias("total"), F.sum(F.col("probability") * F.col("belief")).alias("weighted"))
        ready = told.join(above, "node").where("told = parents").join(done, "node", "left_anti").join(own, "node")
        fresh = written(ready.select("node", F.when(~F.col("sure") & (F.col("total") > 0), F.col("weighted") / F.col("total")).otherwise(F.col("belief")).alias("belief")))
        if not fresh.limit(1).count():
            return done.unionByName(own.join(done, "node", "left_anti").select("node", "belief"))
        done = written(done.unionByName(fresh))


def cut_incoming(net: DataFrame, node: str) -> DataFrame:
    """The network under an intervention on ``node``."""
    return net.where(F.col("child") != node)


def average_effect(net: DataFrame, beliefs: DataFrame, cause: str, effect: str) -> float:
    """Belief in ``effect`` when ``cause`` is set, less the belief when it is not."""
    mutilated = cut_incoming(net, cause)
    node = beliefs.sparkSession.createDataFrame([(cause,)], "node string")
    unset = beliefs.withColumn("belief", F.when(F.col("node") == cause, 0.0).otherwise(F.col("belief")))
    on, off = (p.where(F.col("node") == effect).first()["belief"] for p in (propagate(mutilated, beliefs, node), propagate(mutilated, unset)))
    return on - off


def report(net: DataFrame) -> DataFrame:
    """(nodes, edges, roots, leaves, mean_blanket): the network's structure and the mean size of a Markov blanket."""
    b = blankets(net)
    size = F.size(F.array_union(F.array_union("parents", "children"), "coparents"))
    return structure(net).crossJoin(b.agg(F.avg(size).alias("mean_blanket")))


def isomorphism_witness(pairs: DataFrame) -> DataFrame:
    """How far tau(a -> b) and P(a | b) differ over all pairs: (pairs, max_error, mean_error)."""
    d = pairs.where("a <> b").select(
        F.abs(F.when(F.col("card_b") > 0, F.least(F.lit(1.0), F.col("card_ab") / F.col("card_b"))).otherwise(0.0) - F.when(F.col("card_b") > 0, F.col("card_ab") / F.col("card_b")).otherwise(0.0)).alias("e")
    )
    return d.agg(F.count("e").alias("pairs"), F.max("e").alias("max_error"), F.avg("e").alias("mean_error"))


def from_lattice(reduced: DataFrame) -> DataFrame:
    """(parent, child) of a subset order's reduction (a, b): the larger set is the parent."""
    return reduced.select(F.col("b").alias("parent"), F.col("a").alias("child")).distinct()


def from_ring(decomposed: DataFrame, pairs: DataFrame, key: str, threshold: float = 0.1) -> DataFrame:
    """The network over a ring's base vectors only."""
    base = decomposed.where("is_base").select(F.col(key).alias("k"))
    inside = pairs.join(base.withColumnRenamed("k", "a"), "a", "left_semi").join(base.withColumnRenamed("k", "b"), "b", "left_semi")
    return edges(inside, threshold)
