"""Connected components by contraction, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_salted, materialize


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """Return (id, comp) for every id in ``links``; comp is the smallest id reachable.

    Each round points every node to its smallest neighbour, follows the pointers
    to their ends by doubling, and replaces the links by links between the ends.
    Every node of a component with a link left joins another one, so the number
    of nodes at least halves.  Each round's tables are written to the shared
    folder.  The links of a node, or the nodes that point to it, are dealt to
    several tasks.  Empty links give an empty result.
    """
    edges = materialize(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "cc-edges")
    total = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        up = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("p")), "cc-up")
        while True:
            above = up.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            jumped = materialize(join_salted(up, above, "p", "u").select("u", F.col("p").alias("old"), F.col("pp").alias("p")), "cc-jump")
            moved = jumped.where("old <> p").limit(1).count()
            up = jumped.select("u", "p")
            if not moved:
                break
        if total is None:
            total = up.select(F.col("u").alias("id"), F.col("p").alias("comp"))
        else:
            further = up.select(F.col("u").alias("comp"), F.col("p").alias("q"))
            total = materialize(join_salted(total, further, "comp", "id", "left").select("id", F.coalesce("q", "comp").alias("comp")), "cc-total")
        half = materialize(join_salted(edges, up.select("u", F.col("p").alias("pu")), "u", "v").select("pu", "v"), "cc-half")
        edges = materialize(
            join_salted(half, up.select(F.col("u").alias("v"), F.col("p").alias("pv")), "v", "pu")
            .where("pu <> pv")
            .select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v"))
            .distinct(),
            "cc-edges",
        )
        if not edges.limit(1).count():
            return total
