"""De Bruijn graphs of token sequences."""

from __future__ import annotations

from collections import Counter, defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import hashing as H
from ..sources.tables import written

SEP = " "


def kmers(docs: DataFrame, tokens: str, *keys: str, k: int = 3) -> DataFrame:
    """(keys..., src, dst, label, kmer, multiplicity): nodes are runs of k - 1 tokens."""
    if k < 2:
        raise ValueError("k is 2 or more")
    rows = docs.select(*keys, F.explode(H.ngrams(F.col(tokens), k)).alias("kmer")).groupBy(*keys, "kmer").agg(F.count(F.lit(1)).alias("multiplicity"))
    return spelled(rows, *keys)


def spelled(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys..., src, dst, label, kmer, multiplicity) of rows (keys..., kmer, multiplicity)."""
    parts = F.split("kmer", SEP)
    most = F.size(parts) - 1
    return rows.select(
        *keys, F.array_join(F.slice(parts, 1, most), SEP).alias("src"), F.array_join(F.slice(parts, 2, most), SEP).alias("dst"),
        F.element_at(parts, -1).alias("label"), "kmer", "multiplicity",
    )


def degrees(edges: DataFrame, *keys: str) -> DataFrame:
    """(keys..., node, out_degree, in_degree, balance), counted with multiplicity."""
    out = edges.select(*keys, F.col("src").alias("node"), F.col("multiplicity").alias("o"), F.lit(0).alias("i"))
    in_ = edges.select(*keys, F.col("dst").alias("node"), F.lit(0).alias("o"), F.col("multiplicity").alias("i"))
    g = out.unionByName(in_).groupBy(*keys, "node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    return g.withColumn("balance", F.col("out_degree") - F.col("in_degree"))


def eulerian(edges: DataFrame, *keys: str) -> DataFrame:
    """(keys..., nodes, starts, ends, balanced): an Eulerian walk needs at most one start and one end."""
    d = degrees(edges, *keys)
    g = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("balance") == 1).alias("starts"), F.count_if(F.col("balance") == -1).alias("ends"), F.count_if(F.abs("balance") > 1).alias("odd"))
    return g.withColumn("balanced", (F.col("odd") == 0) & (F.col("starts") <= 1) & (F.col("ends") <= 1)).drop("odd")


def probabilities(edges: DataFrame) -> DataFrame:
    """Add p, each edge's share of all, and p_next, its share of the edges from its node."""
    total = edges.agg(F.sum("multiplicity")).first()[0] or 1
    return edges.withColumn("p", F.col("multiplicity") / F.lit(total)).withColumn("p_next", F.col("multiplicity") / F.sum("multiplicity").over(W.partitionBy("src")))


def next_tokens(edges: DataFrame, k: int = 3) -> DataFrame:
    """(src, rank, label, p_next): the likeliest continuations of each node."""
    by = W.partitionBy("src").orderBy(F.desc("multiplicity"), "label")
    return probabilities(edges).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("src", "rank", "label", "p_next")


def log_likelihood(sequences: DataFrame, tokens: str, key: str, edges: DataFrame, k: int = 3) -> DataFrame:
    """(key, kmers, unseen, log2_likelihood) of sequences under a graph's edge probabilities."""
    rows = sequences.select(key, F.explode(H.ngrams(F.col(tokens), k)).alias("kmer"))
    scored = rows.join(probabilities(edges).select("kmer", "p"), "kmer", "left")
    return scored.groupBy(key).agg(F.count(F.lit(1)).alias("kmers"), F.count_if(F.col("p").isNull()).alias("unseen"), F.sum(F.log2("p")).alias("log2_likelihood"))


def euler_path(edges: list[tuple[str, str, int]], start: str | None = None) -> tuple[list[str], bool]:
    """Hierholzer's walk over (src, dst, multiplicity) in the order given, and whether it uses all edges.

    Of several ways the first edge given goes first.  Without ``start`` it begins
    where one edge more leaves than enters, else at the first node.
    """
    out: dict[str, list[list]] = defaultdict(list)
    balance: Counter = Counter()
    for s, d, n in edges:
        out[s].append([d, n])
        balance[s] += n
        balance[d] -= n
    if start is None:
        start = next((n for n in balance if balance[n] == 1), edges[0][0] if edges else None)
    stack, path, used = ([start] if start is not None else []), [], 0
    while stack:
        ways = out[stack[-1]]
        while ways and not ways[0][1]:
            ways.pop(0)
        if ways:
            ways[0][1] -= 1
            used += 1
            stack.append(ways[0][0])
        else:
            path.append(stack.pop())
    return path[::-1], used == sum(n for *_, n in edges)


def greedy_path(edges: list[tuple[str, str, int]], start: str) -> list[str]:
    """Walk along the edge with the most copies left."""
    left = {(s, d): n for s, d, n in edges}
    out = defaultdict(list)
    for s, d, _ in edges:
        out[s].append(d)
    path = [start]
    while ways := [(-left[path[-1], d], d) for d in out[path[-1]] if left[path[-1], d]]:
        d = min(ways)[1]
        left[path[-1], d] -= 1
        path.append(d)
    return path


def sequence_of(path: list[str]) -> list[str]:
    """The tokens that a path of nodes spells."""
    return [*path[0].split(SEP), *(n.split(SEP)[-1] for n in path[1:])] if path else []


def restore(edges: DataFrame, key: str, order: str, start: str = "<S>", end: str = "</S>") -> DataFrame:
    """(key, sequence, is_eulerian): each key's token order from its own edges.

    ``order`` gives the order in which edges are tried.  The walk starts at the
    node that begins with ``start``; markers at both ends are taken off.
    """

    def run(pdf):
        rows = [(r.src, r.dst, int(r.multiplicity)) for r in pdf.sort_values(order).itertuples()]
        first = next((s for s, *_ in rows if s.split(SEP)[0] == start), None)
        path, whole = euler_path(rows, first)
        tokens = sequence_of(path)
        tokens = tokens[1:] if tokens[:1] == [start] else tokens
        while tokens[-1:] == [end]:
            tokens.pop()
        return pdf[[key]].head(1).assign(sequence=SEP.join(tokens), is_eulerian=whole)

    kind = dict(edges.dtypes)[key]
    return edges.groupBy(key).applyInPandas(run, f"{key} {kind}, sequence string, is_eulerian boolean")


def generate(edges: DataFrame, start: str, steps: int) -> DataFrame:
    """(place, node): from a node along the likeliest continuation, each ``steps`` at most.

    Every node has one likeliest continuation, so a round's jumps follow from
    joining the last one's with themselves, and the places known double: ``steps``
    take log2(steps) joins.
    """
    first = edges.groupBy("src").agg(F.min_by("dst", F.struct(-F.col("multiplicity"), F.col("label"))).alias("dst"))
    jump, known = written(first.select("src", "dst")), 1
    way = edges.sparkSession.range(1).select(F.lit(0).alias("place"), F.lit(start).alias("node"))
    while known <= steps:
        further = way.join(jump, way.node == jump.src).select((F.col("place") + known).alias("place"), F.col("dst").alias("node")).where(F.col("place") <= steps)
        way = written(way.unionByName(further))
        jump, known = written(jump.alias("x").join(jump.alias("y"), F.col("x.dst") == F.col("y.src")).select("x.src", "y.dst")), 2 * known
    return way


def connected(edges: DataFrame) -> DataFrame:
    """(nodes, parts, is_connected) of the graph without directions."""
    from .lattice import parts_of

    part = parts_of(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return part.agg(F.count(F.lit(1)).alias("nodes"), F.countDistinct("part").alias("parts"), (F.countDistinct("part") <= 1).alias("is_connected"))
