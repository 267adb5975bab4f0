"""Sketches over time: states, transitions, flux, dynamics.

Inputs are long forms (step..., reg, zeros).  Everything that depends on order
is computed on counts per (step, bit), of which there are 32 a step, so the
windows that run over all steps see few rows however many tokens there were.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import estimators as E
from ..functions import hashing as H
from ..sources.tables import bounded
from . import sketch as S
from .pairs import directed, overlaps
from .patterns import cheapest_paths

DRIFT_ROWS = 50
#: Edges between states that a walk on the driver may have.
MOST_EDGES = 4_000_000


def nodes(tokens: DataFrame, token: str, time: str, p: int = H.P_BITS) -> DataFrame:
    """The timeline: (time, node_id, parent_id, parent_time, bitmap, card, popcount).

    A node's id is its content's address; its parent is the node before it, and
    as equal states share an id, the parent's time tells which of them it is.
    """
    packed = S.name(S.build(tokens, token, time, p=p)).withColumnRenamed("name", "node_id")
    long = S.long_form(tokens, token, time, p=p)
    stats = S.cardinality(long, time, p=p).join(S.popcount(long, time), time)
    # ids and times alone pass through the window over all steps
    links = packed.select(time, "node_id").withColumn("parent_id", F.lag("node_id").over(W.orderBy(time))).withColumn("parent_time", F.lag(time).over(W.orderBy(time)))
    return packed.join(stats, time).join(links.drop("node_id"), time).select(time, "node_id", "parent_id", "parent_time", "bitmap", "card", "popcount")


def in_range(df: DataFrame, time: str, first, last) -> DataFrame:
    return df.where(F.col(time).between(first, last))


def latest(df: DataFrame, time: str) -> DataFrame:
    return df.orderBy(F.desc(time)).limit(1)


def join_nodes(long: DataFrame, time: str, times: list) -> DataFrame:
    """(time, reg, zeros): the union of the nodes at the given times, at the latest of them."""
    return long.where(F.col(time).isin(times)).groupBy("reg", "zeros").agg(F.lit(max(times)).alias(time)).select(time, "reg", "zeros")


def meet_nodes(long: DataFrame, time: str, times: list) -> DataFrame:
    """(time, reg, zeros): what all the nodes hold, at the earliest time."""
    held = long.where(F.col(time).isin(times)).groupBy("reg", "zeros").agg(F.countDistinct(time).alias("n"))
    return held.where(F.col("n") == len(set(times))).select(F.lit(min(times)).alias(time), "reg", "zeros")


def cumulative(long: DataFrame, time: str, p: int = H.P_BITS) -> DataFrame:
    """(time, card, popcount, novel) of the union of all sets so far.

    A position counts from the time it is first seen, so each is read once
    rather than once for every later time.
    """
    m = 2**p
    seen = S.first_seen(long, time).groupBy(F.col("seen").alias(time), "zeros").agg(F.count(F.lit(1)).alias("n"))
    times = long.select(time).distinct()
    grid = times.select(time, F.explode(F.sequence(F.lit(0), F.lit(H.BITS - 1))).alias("zeros")).join(seen, [time, "zeros"], "left").fillna(0, ["n"])
    so_far = W.partitionBy("zeros").orderBy(time).rowsBetween(W.unboundedPreceding, 0)
    counts = grid.withColumn("c", F.sum("n").over(so_far))
    return (
        counts.groupBy(time).agg(*E.ht_aggregates(m), F.sum("c").alias("popcount"), F.sum("n").alias("novel"))
        .select(time, E.ht_estimate(m).alias("card"), "popcount", "novel")
    )


def delta(long: DataFrame, time: str, after, until, p: int = H.P_BITS) -> DataFrame:
    """What the cumulative state gains after one time until another: (reg, zeros)."""
    return S.first_seen(long, time).where((F.col("seen") > after) & (F.col("seen") <= until)).select("reg", "zeros")


def _steps(long: DataFrame, time: str) -> DataFrame:
    """(time, step): the times numbered from 0."""
    return long.select(time).distinct().withColumn("step", F.row_number().over(W.orderBy(time)) - 1)


def transitions(long: DataFrame, time: str, p: int = H.P_BITS) -> DataFrame:
    """Each step against the one before: deleted, retained, novel and what follows from them.

    (step, time, before, deleted, retained, novel, card, card_before, bits_deleted,
    bits_retained, bits_novel, kind, tau, rho, flux, cost)
    """
    m = 2**p
    steps = _steps(long, time)
    here = long.join(steps, time).select("step", "reg", "zeros")
    marks = here.select("step", "reg", "zeros", F.lit(1).alias("w")).unionByName(here.select((F.col("step") + 1).alias("step"), "reg", "zeros", F.lit(2).alias("w")))
    merged = marks.groupBy("step", "reg", "zeros").agg(F.sum("w").alias("w"))
    counts = merged.groupBy("step", "zeros").agg(*[F.sum((F.col("w") == v).cast("long")).alias(n) for v, n in ((2, "d"), (3, "r"), (1, "n"))])
    counts = counts.withColumn("cur", F.col("r") + F.col("n")).withColumn("prev", F.col("r") + F.col("d"))
    names = {"d": "deleted", "r": "retained", "n": "novel", "cur": "card", "prev": "card_before"}
    g = counts.groupBy("step").agg(*[x for c in names for x in E.ht_aggregates(m, c, name=c)], *[F.sum(c).alias(f"bits_{names[c]}") for c in "drn"])
    g = g.select("step", *[E.ht_estimate(m, c).alias(n) for c, n in names.items()], "bits_deleted", "bits_retained", "bits_novel")
    previous = steps.select((F.col("step") + 1).alias("step"), F.col(time).alias("before"))
    return (
        g.join(steps, "step").join(previous, "step")
        .withColumn("kind", E.transition_kind(F.col("deleted"), F.col("retained"), F.col("novel")))
        .withColumn("tau", E.tau(F.col("retained"), F.col("card"))).withColumn("rho", E.rho(F.col("deleted"), F.col("card")))
        .withColumn("flux", F.col("novel") - F.col("deleted")).withColumn("cost", F.col("novel") + F.col("deleted"))
    )


def reconstructs(t: DataFrame) -> DataFrame:
    """Whether retained and novel together estimate the new state, within 2."""
    return t.withColumn("reconstructs", F.abs(F.col("card") - (F.col("retained") + F.col("novel"))) < 2)


def anomalies(t: DataFrame, flux: float = 50.0, retention: float = 0.3) -> DataFrame:
    """Names of what is unusual about each transition."""
    retained = F.when(F.col("card_before") > 0, F.col("retained") / F.col("card_before")).otherwise(0.0)
    names = F.array(
        F.when(F.abs("flux") > flux, "HIGH_FLUX"),
        F.when(retained < retention, "LOW_RETENTION"),
        F.when(F.col("kind") == "replacement", "REPLACEMENT"),
    )
    return t.withColumn("retention", retained).withColumn("anomalies", F.filter(names, lambda x: x.isNotNull()))


def compare(t: DataFrame) -> DataFrame:
    """The order of a step's state and the one before: equal, grows, shrinks or neither."""
    less, more = F.col("deleted") < 1, F.col("novel") < 1
    return t.withColumn("relation", F.when(less & more, "a = b").when(less, "a ⊆ b").when(more, "b ⊆ a").otherwise("a ∥ b"))


def noether(added: DataFrame, removed: DataFrame, step: str, p: int = H.P_BITS) -> DataFrame:
    """State R' = (R minus D) with N at each step, and the balance of flux.

    (step, added, deleted, flux, cumulative_flux, drift, phase, card, popcount,
    conservation_error).  Within a step additions beat removals.
    """
    m = 2**p
    ops = added.select(step, "reg", "zeros", F.lit(1).alias("up")).unionByName(removed.select(step, "reg", "zeros", F.lit(0).alias("up")))
    last = ops.groupBy(step, "reg", "zeros").agg(F.max("up").alias("up"))
    own = W.partitionBy("reg", "zeros").orderBy(step)
    change = last.withColumn("diff", F.col("up") - F.coalesce(F.lag("up").over(own), F.lit(0))).where("diff <> 0")
    steps = added.select(step).union(removed.select(step)).distinct()
    grid = steps.select(step, F.explode(F.sequence(F.lit(0), F.lit(H.BITS - 1))).alias("zeros"))
    moves = change.groupBy(step, "zeros").agg(F.sum("diff").alias("diff"))
    so_far = W.partitionBy("zeros").orderBy(step).rowsBetween(W.unboundedPreceding, 0)
    state = grid.join(moves, [step, "zeros"], "left").fillna(0, ["diff"]).withColumn("c", F.sum("diff").over(so_far))
    state = state.groupBy(step).agg(*E.ht_aggregates(m), F.sum("c").alias("popcount")).select(step, E.ht_estimate(m).alias("card"), "popcount")
    n = S.cardinality(added, step, p=p).withColumnRenamed("card", "added")
    d = S.cardinality(removed, step, p=p).withColumnRenamed("card", "deleted")
    rows = steps.join(n, step, "left").join(d, step, "left").join(state, step).fillna(0.0, ["added", "deleted"])
    rows = rows.withColumn("flux", F.col("added") - F.col("deleted"))
    return balance(rows, step)


def balance(rows: DataFrame, step: str) -> DataFrame:
    """Cumulative flux, drift (mean of the last rows), phase and conservation error."""
    all_ = W.orderBy(step).rowsBetween(W.unboundedPreceding, 0)
    some = W.orderBy(step).rowsBetween(1 - DRIFT_ROWS, 0)
    return (
        rows.withColumn("cumulative_flux", F.sum("flux").over(all_)).withColumn("drift", F.avg("flux").over(some))
        .withColumn("phase", E.phase(F.count("flux").over(some), F.avg(F.abs("flux")).over(some), F.col("drift"), F.var_pop("flux").over(some)))
        .withColumn("conservation_error", F.abs(F.col("popcount") - F.col("cumulative_flux")))
    )


def flux_statistics(rows: DataFrame, step: str) -> DataFrame:
    """(count, mean, std, min, max, trend); the trend is per row."""
    at = rows.withColumn("i", (F.row_number().over(W.orderBy(step)) - 1).cast("double"))
    return at.agg(
        F.count("flux").alias("count"), F.avg("flux").alias("mean"), F.stddev_pop("flux").alias("std"), F.min("flux").alias("min"),
        F.max("flux").alias("max"), F.regr_slope("flux", "i").alias("trend"),
    )


def conservation(rows: DataFrame, step: str, p: int = H.P_BITS) -> DataFrame:
    """Balance at the last step, with the error that collisions alone explain."""
    density = F.col("card") / F.lit(float(2**p * H.BITS))
    return latest(rows, step).select(
        step, "popcount", "cumulative_flux", "conservation_error", density.alias("density"), (density * F.col("card")).alias("collision_estimate"),
        (F.col("conservation_error") <= F.greatest(F.lit(1.0), density * F.col("card") * 2)).alias("is_conserved"),
    )


def bernoulli(long: DataFrame, time: str, p: int = H.P_BITS) -> DataFrame:
    """Statistics of the walk through bit states, one row."""
    bits = 2**p * H.BITS
    pops = S.popcount(long, time)
    steps = transitions(long, time, p).select((F.col("bits_deleted") + F.col("bits_novel")).alias("cost"))
    walk = pops.agg(F.count(F.lit(1)).alias("length"), F.countDistinct("popcount").alias("unique_signatures"), (F.avg("popcount") / bits).alias("density"))
    costs = steps.agg(
        F.avg("cost").alias("avg_cost"), F.max("cost").alias("max_cost"), F.min("cost").alias("min_cost"), F.sum("cost").alias("bits_changed"),
        (F.sum("cost") / (F.count("cost") * bits)).alias("mixing_rate"), F.avg(F.log(F.greatest("cost", F.lit(1)).cast("double"))).alias("lyapunov"),
    )
    d = F.col("density")
    entropy = F.when((d == 0) | (d == 1), 0.0).otherwise(-(d * F.log2(d) + (1 - d) * F.log2(1 - d)))
    return walk.crossJoin(costs).withColumn("entropy", entropy)


def recurrence(long: DataFrame, time: str, threshold: float = 0.1, p: int = H.P_BITS) -> DataFrame:
    """Steps whose state is near the first one, nearest step first: (step, distance)."""
    steps = _steps(long, time)
    here = long.join(steps, time).select("step", "reg", "zeros")
    start = here.where("step = 0").select("reg", "zeros", F.lit(1).alias("first"))
    size = start.count()
    shared = here.where("step > 0").join(start, ["reg", "zeros"], "left").groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.count("first").alias("both"))
    distance = (F.col("n") + size - 2 * F.col("both")) / F.lit(float(2**p * H.BITS))
    return shared.select("step", distance.alias("distance")).where(F.col("distance") < threshold).orderBy("step")


def steering(pairs: DataFrame, step: float = 0.2, near: float = 0.95) -> DataFrame:
    """What it takes to get from a to b: (a, b, tau, rho, at_target, direct, incremental, conservative).

    Direct changes everything, incremental at most a share of the current state,
    conservative only adds.
    """
    d = pairs.withColumn("tau", E.tau(F.col("card_ab"), F.col("card_b"))).withColumn("rho", E.rho(F.col("card_a_not_b"), F.col("card_b")))
    total = F.col("card_a_not_b") + F.col("card_b_not_a")
    there = (F.col("tau") >= near) & (F.col("rho") < 0.1)
    cost = lambda c: F.when(F.col("at_target"), 0.0).otherwise(c)
    return d.withColumn("at_target", there).select(
        "a", "b", "tau", "rho", "at_target", cost(total).alias("direct"), cost(F.least(total, F.col("card_a") * step)).alias("incremental"), cost(F.col("card_b_not_a")).alias("conservative")
    )


def components(before: DataFrame, after: DataFrame) -> DataFrame:
    """(component, reg, zeros): the positions that went, stayed and came."""
    a, b = before.select("reg", "zeros", F.lit(1).alias("old")), after.select("reg", "zeros", F.lit(1).alias("new"))
    which = F.when(F.col("new").isNull(), "deleted").when(F.col("old").isNull(), "novel").otherwise("retained")
    return a.join(b, ["reg", "zeros"], "full").select(which.alias("component"), "reg", "zeros")


def recover_tokens(before: DataFrame, after: DataFrame, lut: DataFrame) -> DataFrame:
    """(component, token): what a token table knows about what went, stayed and came."""
    return components(before, after).join(lut.select("reg", "zeros", F.explode("ngrams").alias("token")), ["reg", "zeros"]).select("component", "token").distinct()


def evolution_path(edges: DataFrame) -> list:
    """Greedy walk along the strongest edges from the most source-like node.

    ``edges`` (a, b, tau) is between states, of which there are few; more than
    MOST_EDGES are an error.
    """
    rows = [(r["a"], r["b"], r["tau"]) for r in bounded(edges.select("a", "b", "tau"), MOST_EDGES)]
    out: dict = {}
    for a, b, tau in rows:
        out.setdefault(a, []).append((b, tau))
        out.setdefault(b, [])
    if not out:
        return []
    score = {n: len(x) for n, x in out.items()}
    for _, b, _ in rows:
        score[b] -= 1
    path = [min(out, key=lambda n: (-score[n], n))]
    while step := [(-tau, b) for b, tau in out[path[-1]] if b not in path]:
        path.append(min(step)[1])
    return path


def cheapest_path(edges: DataFrame, source, target) -> tuple[list, float] | None:
    """The path of the least total cost over (a, b, cost) between states, and its cost; None if there is none."""
    kind = dict(edges.dtypes)["a"]
    node = lambda x: edges.sparkSession.range(1).select(F.lit(x).cast(kind).alias("node"))
    row = cheapest_paths(edges, node(source), node(target)).first()
    return (row["path"], row["cost"]) if row else None


def by_id(df: DataFrame, node_id: str) -> DataFrame:
    return df.where(F.col("node_id") == node_id)


def as_of(left: DataFrame, right: DataFrame, time: str, value: str, *keys: str, stretch: Column | None = None) -> DataFrame:
    """``left`` with the ``value`` of the latest row of ``right`` at or before its time, under the same keys.

    One window over the union of both sides, so a row meets no other row but the
    last of the other side; keys deal the work.  ``stretch``, a value that never
    falls as time goes on, such as the day, deals a key's rows further: what the
    last stretch with a value leaves is carried on, one row a key and stretch.
    """
    types = dict(left.dtypes) | {value: dict(right.dtypes)[value]}
    columns = [*keys, time, *(c for c in left.columns if c not in (*keys, time))]
    a = left.select(*columns, F.lit(None).cast(types[value]).alias(value), F.lit(1).alias("_side"))
    b = right.select(*keys, time, *[F.lit(None).cast(types[c]).alias(c) for c in columns if c not in (*keys, time)], value, F.lit(0).alias("_side"))
    both = a.unionByName(b)
    dealt = list(keys)
    if stretch is not None:
        both = both.withColumn("_stretch", stretch)
        dealt.append("_stretch")
    last = W.partitionBy(*dealt).orderBy(time, "_side").rowsBetween(W.unboundedPreceding, 0)
    found = both.withColumn(value, F.last(value, ignorenulls=True).over(last)).where("_side = 1").drop("_side")
    if stretch is None:
        return found
    marks = both.groupBy(*dealt).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(time))).alias("_left"))
    before = W.partitionBy(*keys).orderBy("_stretch").rowsBetween(W.unboundedPreceding, -1)
    carried = marks.select(*[F.col(k).alias(f"_{k}") for k in dealt], F.last("_left", ignorenulls=True).over(before).alias("_carried"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in dealt]
    return found.join(carried, same, "left").withColumn(value, F.coalesce(value, "_carried")).drop("_stretch", "_carried").select(*columns, value)


def shift_masks(long: DataFrame, time: str) -> DataFrame:
    """(step, op, reg, zeros): the bits to clear and to set to get from each state to the next."""
    here = long.join(_steps(long, time), time).select("step", "reg", "zeros")
    last = here.agg(F.max("step")).first()[0] or 0
    marks = here.select("step", "reg", "zeros", F.lit(1).alias("w")).unionByName(here.select((F.col("step") + 1).alias("step"), "reg", "zeros", F.lit(2).alias("w")))
    w = marks.groupBy("step", "reg", "zeros").agg(F.sum("w").alias("w")).where((F.col("step") > 0) & (F.col("step") <= last) & (F.col("w") < 3))
    return w.select("step", F.when(F.col("w") == 1, "set").otherwise("clear").alias("op"), "reg", "zeros")


def apply_masks(state: DataFrame, masks: DataFrame) -> DataFrame:
    """(reg, zeros) of a state after one step's masks (op, reg, zeros)."""
    kept = S.difference(state.select("reg", "zeros"), masks.where("op = 'clear'").select("reg", "zeros"))
    return S.union(kept, masks.where("op = 'set'").select("reg", "zeros"))


def trajectory(pairs: DataFrame, steps: int, share: float = 0.2) -> DataFrame:
    """(a, b, step, remaining): the distance left when each step changes at most a share of a's size."""
    total = F.col("card_a_not_b") + F.col("card_b_not_a")
    rows = pairs.select("a", "b", "card_a", total.alias("total"), F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("step"))
    return rows.select("a", "b", "step", F.greatest(F.lit(0.0), F.col("total") - F.col("step") * F.col("card_a") * share).alias("remaining"))


def analyze(t: DataFrame) -> DataFrame:
    """One row on a whole evolution: steps, gains, losses, net change, steps of each kind."""
    kinds = [F.count_if(F.col("kind") == k).alias(k) for k in ("growth", "decay", "stable", "replacement")]
    return t.agg(F.count(F.lit(1)).alias("steps"), F.sum("novel").alias("gained"), F.sum("deleted").alias("lost"), F.sum("flux").alias("net"), *kinds)


def w_graph(long: DataFrame, time: str, first, last, tau: float, rho: float) -> DataFrame:
    """(a, b, tau, rho) of the transitions among the states from ``first`` to ``last`` that cover and exclude enough."""
    inside = long.where(F.col(time).between(first, last))
    d = directed(overlaps(inside, key=time, disjoint=False))
    return d.where((F.col("a") != F.col("b")) & (F.col("tau") >= tau) & (F.col("rho") <= rho)).select("a", "b", "tau", "rho")


class System:
    """A system that adds and removes tokens step by step: ``step`` records, ``status`` tells where it is."""

    def __init__(self):
        self._added = self._removed = None

    def step(self, number: int, added: DataFrame, removed: DataFrame) -> "System":
        """Record a step's sketches (reg, zeros)."""
        for name, new in (("_added", added), ("_removed", removed)):
            rows, held = new.select(F.lit(number).alias("step"), "reg", "zeros"), getattr(self, name)
            setattr(self, name, rows if held is None else held.unionByName(rows))
        return self

    def record(self, added: DataFrame, removed: DataFrame) -> "System":
        """Record many steps at once: sketches (step, reg, zeros)."""
        for name, rows in (("_added", added), ("_removed", removed)):
            rows, held = rows.select("step", "reg", "zeros"), getattr(self, name)
            setattr(self, name, rows if held is None else held.unionByName(rows))
        return self

    def status(self) -> DataFrame:
        """The last step's row of ``noether``."""
        return latest(noether(self._added, self._removed, "step"), "step")
