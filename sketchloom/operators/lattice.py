"""Subset order of sketches: edges, transitive reduction, levels.

``closure`` finds reachability by doubling, so a chain of n sets takes log n
joins; the tables have a row per ordered pair of related sets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import estimators as E
from ..sources.tables import written


def edges(pairs: DataFrame, subset: float = 0.95, overlap: float = 0.9) -> DataFrame:
    """(a, b, tau_forward, tau_backward, kind) of different sets; disjoint pairs have no row."""
    d = pairs.where("a <> b").withColumn("tau_forward", E.tau(F.col("card_ab"), F.col("card_b"))).withColumn("tau_backward", E.tau(F.col("card_ab"), F.col("card_a")))
    below, above = F.col("tau_backward") >= subset, F.col("tau_forward") >= subset
    kind = F.when(below & above, "equal").when(below, "subset").when(above, "superset").when((F.col("tau_forward") >= overlap) | (F.col("tau_backward") >= overlap), "overlap")
    return d.withColumn("kind", kind).where("kind IS NOT NULL").select("a", "b", "tau_forward", "tau_backward", "kind")


def closure(order: DataFrame, cut: Callable[[DataFrame], DataFrame] = written, longest: bool = True) -> DataFrame:
    """(a, b, depth) for every b reachable from a; depth is the longest way, or the shortest. The order has no cycles.

    Ways of twice the length are found in each round, from a table written by the
    one before.
    """
    best = F.max if longest else F.min
    paths = cut(order.select("a", "b").distinct().withColumn("depth", F.lit(1)))
    size = (paths.count(), paths.agg(F.sum("depth")).first()[0])
    while True:
        step = paths.alias("x").join(paths.alias("y"), F.col("x.b") == F.col("y.a")).select(F.col("x.a").alias("a"), F.col("y.b").alias("b"), (F.col("x.depth") + F.col("y.depth")).alias("depth"))
        paths = cut(paths.unionByName(step).groupBy("a", "b").agg(best("depth").alias("depth")))
        now = (paths.count(), paths.agg(F.sum("depth")).first()[0])
        if now == size:
            return paths
        size = now


def hasse(order: DataFrame, reach: DataFrame) -> DataFrame:
    """The edges of an order without those that a longer way replaces."""
    longer = reach.where("depth > 1").select("a", "b")
    return order.select("a", "b").distinct().join(longer, ["a", "b"], "left_anti")


def levels(nodes: DataFrame, reach: DataFrame) -> DataFrame:
    """(node, level): the longest way from a minimal set; 0 for sets without predecessors."""
    deepest = reach.groupBy(F.col("b").alias("node")).agg(F.max("depth").alias("level"))
    return nodes.join(deepest, "node", "left").select("node", F.coalesce("level", F.lit(0)).alias("level"))


def shape(levels_: DataFrame, reduced: DataFrame) -> DataFrame:
    """(height, width, tops, bottoms)."""
    per = levels_.groupBy("level").agg(F.count(F.lit(1)).alias("n")).agg(F.max("level").alias("height"), F.max("n").alias("width"))
    ends = levels_.select("node").join(reduced.select(F.col("a").alias("node")).distinct().withColumn("up", F.lit(1)), "node", "left").join(reduced.select(F.col("b").alias("node")).distinct().withColumn("down", F.lit(1)), "node", "left")
    return per.crossJoin(ends.agg(F.count_if(F.col("up").isNull()).alias("tops"), F.count_if(F.col("down").isNull()).alias("bottoms")))


def to_dot(edges_: DataFrame, name: str = "lattice") -> DataFrame:
    """One row of DOT text."""
    lines = edges_.select(F.format_string('  "%s" -> "%s";', F.col("a").cast("string"), F.col("b").cast("string")).alias("l"))
    return lines.agg(F.concat(F.lit(f"digraph {name} {{\n"), F.array_join(F.array_sort(F.collect_list("l")), "\n"), F.lit("\n}")).alias("dot"))


def neighbours(nodes: DataFrame, reduced: DataFrame) -> DataFrame:
    """(node, predecessors, successors) along the edges of the reduction, each a sorted array."""
    none = F.array().cast("array<string>")
    up = reduced.groupBy(F.col("b").alias("node")).agg(F.array_sort(F.collect_set("a")).alias("predecessors"))
    down = reduced.groupBy(F.col("a").alias("node")).agg(F.array_sort(F.collect_set("b")).alias("successors"))
    out = nodes.select("node").join(up, "node", "left").join(down, "node", "left")
    return out.select("node", F.coalesce("predecessors", none).alias("predecessors"), F.coalesce("successors", none).alias("successors"))


def chain(reduced: DataFrame, node, up: bool = True) -> DataFrame:
    """(place, node): from a node to a top (or a bottom), always to the first neighbour by name."""
    a, b = ("a", "b") if up else ("b", "a")
    steps = reduced.groupBy(F.col(a).alias("a")).agg(F.min(b).alias("b"))
    kind = dict(reduced.dtypes)["a"]
    start = reduced.sparkSession.range(1).select(F.lit(0).alias("place"), F.lit(node).cast(kind).alias("node"))
    return start.unionByName(closure(steps).where(F.col("a") == node).select(F.col("depth").alias("place"), F.col("b").alias("node")))


def parts_of(links: DataFrame) -> DataFrame:
    """(node, part): the smallest node that each node of an undirected graph (a, b) reaches."""
    both = written(links.select("a", "b").union(links.select("b", "a")).distinct())
    part = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("part")))
    while True:
        # one step along the links, then one along the parts' own parts
        near = both.join(part.select(F.col("node").alias("b"), "part"), "b").groupBy(F.col("a").alias("node")).agg(F.min("part").alias("near"))
        hop = part.join(near, "node").select("node", F.col("part").alias("old"), F.least("part", "near").alias("part"))
        far = part.select(F.col("node").alias("part"), F.col("part").alias("far"))
        hop = written(hop.join(far, "part").select("node", "old", F.least("part", "far").alias("part")))
        part = hop.select("node", "part")
        if not hop.where("old <> part").limit(1).count():
            return part


def triangles(edges_: DataFrame) -> DataFrame:
    """(a, b, c) with an edge in some direction between each two, a < b < c."""
    e = edges_.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).where("x < y").distinct()
    ab, bc, ac = (e.select(F.col("x").alias(p), F.col("y").alias(q)) for p, q in (("a", "b"), ("b", "c"), ("a", "c")))
    return ab.join(bc, "b").join(ac, ["a", "c"]).select("a", "b", "c")


def two_hops(edges_: DataFrame) -> DataFrame:
    """(a, via, b) of two edges in a row, the pattern of a graph query a -> via -> b."""
    first, second = edges_.select("a", F.col("b").alias("via")), edges_.select(F.col("a").alias("via"), "b")
    return first.join(second, "via").where("a <> b").select("a", "via", "b")
