"""De Bruijn graphs of corpora: graphs of batches merged, unbranched chains contracted.

Edges are those of ``debruijn.kmers``.  A chain is a longest run of edges whose
inner nodes have one way in and one way out.  The place of each edge in its
chain is found by list ranking: every edge points to the one before it, and the
pointers double, so a chain of n edges takes log n joins and no task walks it.
Pointers are numbers of edges, and a round moves only the edges that have not
found their head; k-mers stand in for them on rings alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written
from .debruijn import SEP, spelled


def merge_graphs(*edges: DataFrame) -> DataFrame:
    """One graph of several: multiplicities of a k-mer add up."""
    every = None
    for e in edges:
        rows = e.select("kmer", "multiplicity")
        every = rows if every is None else every.unionByName(rows)
    return spelled(every.groupBy("kmer").agg(F.sum("multiplicity").alias("multiplicity")))


def numbered(edges: DataFrame) -> DataFrame:
    """The edges with a number each, ``id``, written so that it stays."""
    return written(edges.withColumn("id", F.monotonically_increasing_id()))


def inner_nodes(edges: DataFrame) -> DataFrame:
    """(node) with one edge in and one edge out, copies of an edge counting once."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("node").agg(F.sum("o").alias("o"), F.sum("i").alias("i")).where("o = 1 AND i = 1").select("node")


def _rank(before: DataFrame) -> DataFrame:
    """(kmer, up, rank, low) from (kmer, up): ``up`` null and ``rank`` steps from the head, or, of an edge on a ring, ``low`` its smallest k-mer."""
    at = written(before.select("kmer", "up", F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("rank"), F.coalesce("up", "kmer").alias("head"), F.least("kmer", F.coalesce("up", "kmer")).alias("low")))
    open_, span = at.where("up IS NOT NULL").count(), 1
    while open_:
        far = at.select(F.col("kmer").alias("up"), F.col("up").alias("up_"), F.col("rank").alias("rank_"), F.col("head").alias("head_"), F.col("low").alias("low_"))
        jumped = at.join(far, "up", "left").select(
            "kmer", F.col("up_").alias("up"), (F.col("rank") + F.coalesce("rank_", F.lit(0))).alias("rank"), F.coalesce("head_", "head").alias("head"), F.least("low", F.coalesce("low_", "low")).alias("low")
        )
        at = written(jumped)
        now, span = at.where("up IS NOT NULL").count(), 2 * span
        # on a way with an end some edges find it in every round, so what stays open lies on rings, seen whole by now
        if now == open_ and span >= now:
            break
        open_ = now
    return at


def _links(edges: DataFrame) -> DataFrame:
    """(id, up): the number of each edge that an inner node leads to, and that of the edge before it."""
    none = F.lit(None).cast("long")
    ends = edges.select(F.col("src").alias("node"), F.col("id").alias("o"), none.alias("i")).unionByName(edges.select(F.col("dst").alias("node"), none.alias("o"), F.col("id").alias("i")))
    g = ends.groupBy("node").agg(F.count("o").alias("n_o"), F.count("i").alias("n_i"), F.max("o").alias("id"), F.max("i").alias("up"))
    return g.where("n_o = 1 AND n_i = 1").select("id", "up")


def _places(edges: DataFrame) -> DataFrame:
    """(id, head, place) of numbered edges that do not begin their chain; ``head`` is the number of its first edge.

    A ring of inner nodes alone is a chain that begins at its smallest k-mer.
    """
    links = written(_links(edges))
    open_ = links.select("id", "up", F.lit(1).cast("long").alias("rank"), F.col("up").alias("head"))
    done, n, span = None, open_.count(), 1
    while n:
        known = open_ if done is None else open_.unionByName(done)
        far = known.select(F.col("id").alias("up"), F.col("up").alias("up_"), F.col("rank").alias("rank_"), F.col("head").alias("head_"))
        jumped = written(open_.join(far, "up", "left").select("id", F.col("up_").alias("up"), (F.col("rank") + F.coalesce("rank_", F.lit(0))).alias("rank"), F.coalesce("head_", "head").alias("head")))
        closed, open_ = jumped.where("up IS NULL"), jumped.where("up IS NOT NULL")
        done = closed if done is None else done.unionByName(closed)
        now, span = open_.count(), 2 * span
        # on a way with an end some edges find it in every round, so what stays open lies on rings, seen whole by now
        if now == n and span >= now:
            break
        n = now
    found = (open_ if done is None else done).select("id", "head", F.col("rank").alias("place"))
    if not n:
        return found
    # rings, by their k-mers
    names = edges.select("id", "kmer")
    ring = links.join(open_.select("id"), "id", "left_semi").join(names, "id").select("kmer", "up").join(names.select(F.col("id").alias("up"), F.col("kmer").alias("before")), "up")
    before = written(ring.select("kmer", F.col("before").alias("up")))
    low = written(_rank(before).select("kmer", "low"))
    cut = low.join(before, "kmer").select("kmer", F.when(F.col("kmer") != F.col("low"), F.col("up")).alias("up"))
    ranked = _rank(cut).where("rank > 0").join(names, "kmer").join(names.select(F.col("id").alias("first"), F.col("kmer").alias("head")), "head")
    return found.unionByName(ranked.select("id", F.col("first").alias("head"), F.col("rank").alias("place")))


def chains(edges: DataFrame) -> DataFrame:
    """(kmer, head, place): the chain that each edge is on, named by its first edge, and its place there from 0.

    A ring of inner nodes alone is a chain that begins at its smallest k-mer.
    """
    edges = edges if "id" in edges.columns else numbered(edges)
    at = edges.select("id", "kmer").join(_places(edges), "id", "left").select("kmer", F.coalesce("head", "id").alias("first"), F.coalesce("place", F.lit(0)).alias("place"))
    return at.join(edges.select(F.col("id").alias("first"), F.col("kmer").alias("head")), "first").select("kmer", "head", "place")


def contracted(edges: DataFrame) -> DataFrame:
    """(src, dst, edges, sequence, least, total): each chain as one edge.

    ``sequence`` spells it: the tokens of its first node and the last token of
    each further one.  ``least`` and ``total`` are of the multiplicities.  A
    chain is one row, so its text is as long as the chain.
    """
    edges = edges if "id" in edges.columns else numbered(edges)
    placed = edges.select("id", "kmer", "multiplicity").join(_places(edges), "id", "left").select(
        F.coalesce("head", "id").alias("head"), F.coalesce("place", F.lit(0)).alias("place"), F.when(F.col("place").isNull(), F.col("kmer")).otherwise(F.substring_index("kmer", SEP, -1)).alias("tokens"), "multiplicity"
    )
    step = F.struct("place", "tokens")
    g = placed.groupBy("head").agg(F.count(F.lit(1)).alias("edges"), F.array_sort(F.collect_list(step)).alias("steps"), F.min("multiplicity").alias("least"), F.sum("multiplicity").alias("total"))
    # the first step is a whole k-mer, so what it spells has k - 1 tokens before and after the edges
    g = g.withColumn("sequence", F.array_join(F.transform("steps", lambda s: s["tokens"]), SEP)).withColumn("w", F.split("sequence", SEP)).withColumn("n", (F.size("w") - F.col("edges")).cast("int"))
    ends = [F.array_join(F.slice("w", at, F.col("n")), SEP) for at in (F.lit(1), F.size("w") - F.col("n") + 1)]
    return g.select(ends[0].alias("src"), ends[1].alias("dst"), "edges", "sequence", "least", "total")


def expanded(chains_: DataFrame, k: int = 3) -> DataFrame:
    """(kmer) of every edge that contracted chains spell."""
    from ..functions import hashing as H

    return chains_.select(F.explode(H.ngrams(F.split("sequence", SEP), k)).alias("kmer"))
