"""Patterns of variable length over a graph (a, b): shortest ways, what lies within so many steps, ways by label.

The frontier of all sources moves one step a round.  A node that a source has
reached leaves that source's frontier by an anti-join, so cycles end.  A round's
tables are written to the shared folder; a row is a (source, node) pair, and its
way is no longer than the depth asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written


def shortest_paths(edges: DataFrame, sources: DataFrame, most: int, targets: DataFrame | None = None) -> DataFrame:
    """(source, target, depth, path): the shortest way from each source to each node within ``most`` steps.

    ``sources`` and ``targets`` are tables of ``node``.  Of several shortest ways
    the first by the names of its nodes is given.  A source reaches itself with
    depth 0.  Steps against the direction of edges count if ``edges`` has both.
    """
    if most < 0:
        raise ValueError("a depth is 0 or more")
    steps = written(edges.select("a", "b").where("a <> b").distinct())
    seen = written(sources.select(F.col("node").alias("source"), F.col("node").alias("target")).distinct().select("source", "target", F.lit(0).alias("depth"), F.array("target").alias("path")))
    frontier = seen
    for depth in range(1, most + 1):
        reached = frontier.join(steps, frontier.target == steps.a).select("source", F.col("b").alias("target"), F.concat("path", F.array("b")).alias("path"))
        fresh = reached.groupBy("source", "target").agg(F.min("path").alias("path")).join(seen.select("source", "target"), ["source", "target"], "left_anti")
        frontier = written(fresh.select("source", "target", F.lit(depth).alias("depth"), "path"))
        if not frontier.limit(1).count():
            break
        seen = seen.unionByName(frontier)
    return seen if targets is None else seen.join(targets.select(F.col("node").alias("target")).distinct(), "target", "left_semi").select("source", "target", "depth", "path")


def cheapest_paths(edges: DataFrame, sources: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """(source, target, cost, path): the way of the least total cost from each source to each node it reaches.

    ``edges`` are (a, b, cost); a cost below 0 is an error.  Of equally cheap ways
    that of the fewest steps is given, then the first by the names of its nodes.
    In each round only nodes whose way got better pass it on.
    """
    least = edges.select("a", "b", F.when(F.col("cost") < 0, F.raise_error(F.lit("a cost below 0")).cast("double")).otherwise(F.col("cost").cast("double")).alias("step"))
    steps = written(least.where("a <> b").groupBy("a", "b").agg(F.min("step").alias("step")))
    best = written(sources.select(F.col("node").alias("source"), F.col("node").alias("target")).distinct().select("source", "target", F.struct(F.lit(0.0).alias("cost"), F.lit(1).alias("nodes"), F.array("target").alias("path")).alias("way")))
    better = best
    while better.limit(1).count():
        way = F.struct((F.col("way.cost") + F.col("step")).alias("cost"), (F.col("way.nodes") + 1).alias("nodes"), F.concat("way.path", F.array("b")).alias("path"))
        tried = better.join(steps, better.target == steps.a).select("source", F.col("b").alias("target"), way.alias("way")).groupBy("source", "target").agg(F.min("way").alias("new"))
        both = written(best.join(tried, ["source", "target"], "full").select("source", "target", F.least("way", "new").alias("way"), (F.col("new").isNotNull() & (F.col("way").isNull() | (F.col("new") < F.col("way")))).alias("changed")))
        best, better = both.drop("changed"), both.where("changed").drop("changed")
    found = best if targets is None else best.join(targets.select(F.col("node").alias("target")).distinct(), "target", "left_semi")
    return found.select("source", "target", F.col("way.cost").alias("cost"), F.col("way.path").alias("path"))


def undirected(edges: DataFrame) -> DataFrame:
    """The edges in both directions."""
    return edges.select("a", "b").union(edges.select("b", "a")).distinct()


def walks(edges: DataFrame, sources: DataFrame, least: int, most: int) -> DataFrame:
    """(source, target, length) for every length from ``least`` to ``most`` of which there is a walk.

    A walk may come back to a node.  There are no more rows than pairs and
    lengths, however many walks there are.
    """
    if not 0 <= least <= most:
        raise ValueError("lengths run from least to most")
    steps = written(edges.select("a", "b").distinct())
    at = written(sources.select(F.col("node").alias("source"), F.col("node").alias("target")).distinct())
    out = at.withColumn("length", F.lit(0)) if least == 0 else None
    for length in range(1, most + 1):
        at = written(at.join(steps, at.target == steps.a).select("source", F.col("b").alias("target")).distinct())
        if length >= least:
            rows = at.withColumn("length", F.lit(length))
            out = rows if out is None else out.unionByName(rows)
    return out


def along_labels(edges: DataFrame, labels: list[str | None]) -> DataFrame:
    """(source, target, ways): pairs that a chain of edges (a, label, b) with these labels in turn joins, and by how many chains.

    None stands for any label.  Chains are counted, not listed.
    """
    if not labels:
        raise ValueError("a pattern has one label at least")
    out = None
    for label in labels:
        step = edges if label is None else edges.where(F.col("label") == label)
        step = step.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
        if out is None:
            out = written(step.select(F.col("a").alias("source"), F.col("b").alias("target"), F.col("n").alias("ways")))
        else:
            joined = out.join(step, out.target == step.a).groupBy("source", F.col("b").alias("target")).agg(F.sum(F.col("ways") * F.col("n")).alias("ways"))
            out = written(joined)
    return out
