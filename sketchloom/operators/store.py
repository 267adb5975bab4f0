"""Content-addressed store: entries, derivations, lineage, commits.

Evaluation is lazy as DataFrames are; the derivation table records how each id
came about, so that ids can be traced and rebuilt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import sketch as S
from .lattice import closure

OPS = {"union": S.union, "intersect": S.intersect, "diff": S.difference, "xor": S.symmetric_difference}


def register(packed: DataFrame, source: Column, tags: Column, created: Column, layer: Column | int = 0, base: bool = True) -> DataFrame:
    """Entries (id, source, tags, created, layer, is_base, bitmap); equal content is one entry."""
    layer = F.lit(layer) if isinstance(layer, int) else layer
    named = S.name(packed).select(F.col("name").alias("id"), source.alias("source"), tags.alias("tags"), created.alias("created"), layer.alias("layer"), F.lit(base).alias("is_base"), "bitmap")
    return named.groupBy("id").agg(*[F.min_by(c, "created").alias(c) for c in ("source", "tags", "layer", "is_base", "bitmap")], F.min("created").alias("created"))


def derivation(op: str, *operands: str) -> tuple[str, str, list[str]]:
    """(id, op, operands) of a compound; the id depends on operation and operands."""
    import hashlib

    if op not in OPS:
        raise ValueError(f"op is one of {sorted(OPS)}")
    held = sorted(operands) if op != "diff" else list(operands)
    return hashlib.sha1("\0".join([op, *held]).encode()).hexdigest(), op, held


def evaluate(base: DataFrame, plan: dict[str, tuple[str, list[str]]], wanted: str) -> DataFrame:
    """(reg, zeros) of an id: a base's rows, or its operation over its operands, lazily."""
    if wanted not in plan:
        return base.where(F.col("id") == wanted).select("reg", "zeros")
    op, operands = plan[wanted]
    parts = [evaluate(base, plan, o) for o in operands]
    out = parts[0]
    for p in parts[1:]:
        out = OPS[op](out, p)
    return out


def lineage(derivations: DataFrame) -> DataFrame:
    """(id, ancestor, depth) over all derivations (id, operands); depth is the longest way."""
    steps = derivations.select(F.col("id").alias("a"), F.explode("operands").alias("b"))
    return closure(steps).select(F.col("a").alias("id"), F.col("b").alias("ancestor"), "depth")


def bases(derivations: DataFrame) -> DataFrame:
    """(id, bases, depth): ancestors that derive from nothing, and the longest way to one."""
    w = lineage(derivations)
    return (
        w.join(derivations.select(F.col("id").alias("ancestor")), "ancestor", "left_anti").groupBy("id")
        .agg(F.array_sort(F.collect_set("ancestor")).alias("bases"), F.max("depth").alias("depth"))
    )


def dependents(derivations: DataFrame, id_: str) -> DataFrame:
    return derivations.where(F.array_contains("operands", id_)).select("id")


def by_source(entries: DataFrame, source: str, limit: int = 100) -> DataFrame:
    return entries.where(F.col("source") == source).orderBy(F.desc("created"), "id").limit(limit)


def by_tags(entries: DataFrame, tags: list[str], every: bool = False, limit: int = 100) -> DataFrame:
    wanted = F.array(*map(F.lit, tags))
    hit = F.size(F.array_intersect("tags", wanted)) == len(set(tags)) if every else F.arrays_overlap("tags", wanted)
    return entries.where(hit).orderBy(F.desc("created"), "id").limit(limit)


def by_time(entries: DataFrame, first, last, limit: int = 100) -> DataFrame:
    return entries.where(F.col("created").between(first, last)).orderBy(F.desc("created"), "id").limit(limit)


def by_layer(entries: DataFrame, layer: int, limit: int = 100) -> DataFrame:
    return entries.where(F.col("layer") == layer).orderBy(F.desc("created"), "id").limit(limit)


def by_cardinality(entries: DataFrame, least: float, most: float, limit: int = 100) -> DataFrame:
    return entries.where(F.col("card").between(least, most)).orderBy(F.desc("card"), "id").limit(limit)


def unreferenced(entries: DataFrame, derivations: DataFrame, rings: DataFrame) -> DataFrame:
    """Bases that no derivation and no ring names; dropping them is up to the caller."""
    used = derivations.select(F.explode("operands").alias("id")).union(rings.select(F.explode("ids").alias("id")))
    return entries.where("is_base").join(used, "id", "left_anti")


def commits(long: DataFrame, time: str) -> DataFrame:
    """(seq, time, state_card, delta_card): the store's union at each commit, and its change from the parent."""
    from .timeline import cumulative

    state = cumulative(long, time)
    seen = S.first_seen(long, time)
    delta = S.cardinality(seen.select(F.col("seen").alias(time), "reg", "zeros"), time).withColumnRenamed("card", "delta_card")
    rows = state.select(time, F.col("card").alias("state_card")).join(delta, time, "left").fillna(0.0, ["delta_card"])
    return rows.withColumn("seq", F.row_number().over(W.orderBy(time))).select("seq", time, "state_card", "delta_card")


def evolution_rate(log: DataFrame, last: int = 5) -> DataFrame:
    return log.orderBy(F.desc("seq")).limit(last).agg(F.avg("delta_card").alias("rate"))


def history(links: DataFrame) -> DataFrame:
    """(id, ancestor, distance) of commits (id, parent), each its own ancestor at distance 0, by the shortest way."""
    steps = links.where(F.col("parent").isNotNull()).select(F.col("id").alias("a"), F.col("parent").alias("b"))
    up = closure(steps, longest=False).select(F.col("a").alias("id"), F.col("b").alias("ancestor"), F.col("depth").alias("distance"))
    return links.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("distance")).distinct().unionByName(up)


def common_ancestor(links: DataFrame, x, y) -> DataFrame:
    """(ancestor, from_x, from_y): the nearest commit that both descend from."""
    h = history(links)
    a = h.where(F.col("id") == x).select("ancestor", F.col("distance").alias("from_x"))
    b = h.where(F.col("id") == y).select("ancestor", F.col("distance").alias("from_y"))
    return a.join(b, "ancestor").orderBy(F.col("from_x") + F.col("from_y"), "ancestor").limit(1)


def roll_back(links: DataFrame, target, new) -> DataFrame:
    """Commits with one more whose state is that of ``target``: a new id on the same parent chain."""
    return links.unionByName(links.where(F.col("id") == target).select(F.lit(new).cast(dict(links.dtypes)["id"]).alias("id"), F.col("id").alias("parent")))


def merge_commits(links: DataFrame, ours, theirs, new) -> DataFrame:
    """Commits with one more that has both as parents; its state is the union of theirs."""
    kind = dict(links.dtypes)["id"]
    return links.unionByName(links.where(F.col("id").isin(ours, theirs)).select(F.lit(new).cast(kind).alias("id"), F.col("id").alias("parent")).distinct())


def state_at(links: DataFrame, deltas: DataFrame, id_) -> DataFrame:
    """(reg, zeros) of a commit: what it and its ancestors added, ``deltas`` being (id, reg, zeros)."""
    line = history(links).where(F.col("id") == id_).select(F.col("ancestor").alias("id")).distinct()
    return deltas.join(line, "id", "left_semi").select("reg", "zeros").distinct()


def create_branch(branches: DataFrame, name: str, head) -> DataFrame:
    """Branches (name, head) with one more; a name that is taken moves to the new head."""
    kind = dict(branches.dtypes)["head"]
    row = branches.sparkSession.range(1).select(F.lit(name).alias("name"), F.lit(head).cast(kind).alias("head"))
    return branches.where(F.col("name") != name).unionByName(row)


def log_of(branches: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """(ancestor, distance) from a branch's head back."""
    heads = branches.where(F.col("name") == name).select(F.col("head").alias("id"))
    return history(links).join(heads, "id", "left_semi").select("ancestor", "distance")


def remove(entries: DataFrame, ids: DataFrame) -> DataFrame:
    """Entries without those of the given ids."""
    return entries.join(ids.select("id"), "id", "left_anti")


def exist(entries: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, found) of the asked ids."""
    return ids.select("id").distinct().join(entries.select("id", F.lit(True).alias("found")).distinct(), "id", "left").fillna(False, ["found"])


def refcounts(entries: DataFrame, derivations: DataFrame, rings: DataFrame) -> DataFrame:
    """(id, refs): how many derivations and rings name each entry."""
    used = derivations.select(F.explode("operands").alias("id")).unionByName(rings.select(F.explode("ids").alias("id")))
    return entries.select("id").join(used.groupBy("id").agg(F.count(F.lit(1)).alias("refs")), "id", "left").fillna(0, ["refs"])


def check_out(branches: DataFrame, links: DataFrame, deltas: DataFrame, name: str) -> DataFrame:
    """(reg, zeros) of the state at a branch's head, ``deltas`` being (id, reg, zeros)."""
    line = log_of(branches, links, name).select(F.col("ancestor").alias("id")).distinct()
    return deltas.join(line, "id", "left_semi").select("reg", "zeros").distinct()
