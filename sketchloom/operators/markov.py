"""Markov chains, hidden Markov models and random fields over sketches.

Transition tables are DataFrames (i, j, p).  Chains over at most ``DENSE``
states are small matrices, for which the driver uses numpy; above that the
power iteration stays a join and an aggregation per step, by the same rule of
when to stop.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.tables import bounded, written

DENSE = 2000


def transition(pairs: DataFrame) -> DataFrame:
    """(i, j, p): the share of i that j covers, normalised by row, no self-transition.

    A state without overlap has a row of zeros.
    """
    raw = F.when((F.col("a") != F.col("b")) & (F.col("card_a") > 0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("card_ab") / F.col("card_a")))).otherwise(0.0)
    rows = pairs.select(F.col("a").alias("i"), F.col("b").alias("j"), raw.alias("raw"))
    total = F.sum("raw").over(W.partitionBy("i"))
    return rows.withColumn("p", F.when(total > 0, F.col("raw") / total).otherwise(0.0)).select("i", "j", "p")


def dense(t: DataFrame) -> tuple[list, np.ndarray]:
    """Labels and matrix of a chain of at most DENSE states; a larger one is an error."""
    rows = bounded(t, DENSE * DENSE)
    labels = sorted({r["i"] for r in rows} | {r["j"] for r in rows})
    at = {x: k for k, x in enumerate(labels)}
    m = np.zeros((len(labels), len(labels)))
    for r in rows:
        m[at[r["i"]], at[r["j"]]] = r["p"]
    return labels, m


def power(m: np.ndarray, damping: float = 1.0, steps: int = 200, tolerance: float = 1e-10) -> np.ndarray:
    n = len(m)
    x = np.full(n, 1 / n)
    for _ in range(steps):
        y = damping * (x @ m) + (1 - damping) * x.sum() / n
        done = np.abs(y - x).sum() < tolerance
        x = y
        if done:
            break
    return x / x.sum() if x.sum() > 0 else x


def power_distributed(t: DataFrame, damping: float, steps: int, tolerance: float = 0.0, cut: Callable[[DataFrame], DataFrame] = written) -> DataFrame:
    """(state, score) by at most ``steps`` joins, fewer if the scores change by less than ``tolerance`` in all; ``cut`` ends the lineage."""
    states = t.select(F.col("i").alias("state")).distinct()
    n = states.count()
    x, total = states.withColumn("score", F.lit(1.0 / n)), 1.0
    for _ in range(steps):
        flow = t.join(x, t.i == x.state).groupBy(F.col("j").alias("state")).agg(F.sum(F.col("p") * F.col("score")).alias("flow"))
        new = states.join(flow, "state", "left").select("state", (damping * F.coalesce("flow", F.lit(0.0)) + (1 - damping) * total / n).alias("score"))
        new = cut(new.join(x.withColumnRenamed("score", "old"), "state"))
        total, moved = new.agg(F.sum("score"), F.sum(F.abs(F.col("score") - F.col("old")))).first()
        x = new.select("state", "score")
        if moved < tolerance:
            break
    return x.withColumn("score", F.col("score") / total) if total > 0 else x


def ranked(t: DataFrame, damping: float = 0.85, steps: int = 200, tolerance: float = 1e-8) -> DataFrame:
    """(state, score), the PageRank of each state."""
    spark = t.sparkSession
    n = t.select("i").distinct().count()
    if n > DENSE:
        return power_distributed(t, damping, steps, tolerance)
    labels, m = dense(t)
    scores = power(m, damping, steps, tolerance)
    return spark.createDataFrame([(x, float(v)) for x, v in zip(labels, scores)], "state string, score double")


def stationary(t: DataFrame) -> DataFrame:
    return ranked(t, damping=1.0, steps=1000, tolerance=1e-10)


def entropy_rate(m: np.ndarray) -> tuple[float, float, float]:
    """(rate, largest possible, their ratio)."""
    pi = power(m, steps=1000)
    terms = np.where(m > 0, m * np.log2(np.where(m > 0, m, 1)), 0)
    rate = float(-(pi @ terms.sum(axis=1)))
    most = math.log2(len(m)) if len(m) > 1 else 0.0
    return rate, most, rate / most if most else 0.0


def entropy_of(t: DataFrame) -> DataFrame:
    """(entropy_rate, max_possible) of a chain of any size, from its stationary scores."""
    rows = t.join(stationary(t), t.i == F.col("state"))
    term = F.when(F.col("p") > 0, -F.col("score") * F.col("p") * F.log2("p")).otherwise(0.0)
    return rows.agg(F.sum(term).alias("entropy_rate"), F.log2(F.countDistinct("i")).alias("max_possible"))


def products(t: DataFrame, labels: list) -> Callable[[np.ndarray], np.ndarray]:
    """The product of a chain's matrix with a vector: rows stay where they are, and the driver holds a number a state."""
    at = {x: k for k, x in enumerate(labels)}
    numbers = t.sparkSession.createDataFrame(list(at.items()), f"state {dict(t.dtypes)['i']}, k int")
    rows = t.where("p <> 0").join(numbers.select(F.col("state").alias("i"), F.col("k").alias("r")), "i").join(numbers.select(F.col("state").alias("j"), F.col("k").alias("c")), "j")
    rows = written(rows.select("r", "c", "p"))

    def product(x: np.ndarray) -> np.ndarray:
        held = t.sparkSession.sparkContext.broadcast(x)

        def run(batches):
            y = np.zeros(len(held.value))
            for b in batches:
                y += np.bincount(b["r"].to_numpy(), b["p"].to_numpy() * held.value[b["c"].to_numpy()], minlength=len(y))
            some = np.flatnonzero(y)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(y[some])], ["r", "y"])

        out = np.zeros(len(x))
        for r, y in rows.mapInArrow(run, "r int, y double").groupBy("r").agg(F.sum("y")).collect():
            out[r] = y
        held.unpersist()
        return out

    return product


def solved(product: Callable[[np.ndarray], np.ndarray], b: np.ndarray, tolerance: float = 1e-12, most: int = 500) -> np.ndarray:
    """x with product(x) = b, by stabilised biconjugate gradients; no solution within ``most`` steps is an error."""
    x, r = np.zeros(len(b)), b.copy()
    shadow, p, rho = r.copy(), r.copy(), float(r @ r)
    least = tolerance * max(1.0, float(np.linalg.norm(b)))
    for _ in range(most):
        if np.linalg.norm(r) <= least:
            return x
        v = product(p)
        alpha = rho / float(shadow @ v)
        s = r - alpha * v
        if np.linalg.norm(s) <= least:
            return x + alpha * p
        u = product(s)
        omega = float(u @ s) / float(u @ u)
        x, r = x + alpha * p + omega * s, s - omega * u
        now = float(shadow @ r)
        p, rho = r + now / rho * alpha / omega * (p - omega * v), now
    raise ArithmeticError(f"no solution within {most} steps")


def hitting_of(t: DataFrame, target, dense_most: int = DENSE) -> dict:
    """Expected steps to ``target`` from every state; infinite where a way may end without it.

    Up to ``dense_most`` states the system is solved on the driver, beyond by
    products of the distributed matrix with vectors.
    """
    labels = sorted({r["i"] for r in t.select("i").distinct().toLocalIterator()} | {r["j"] for r in t.select("j").distinct().toLocalIterator()})
    if len(labels) <= dense_most:
        return dict(zip(labels, hitting_times(dense(t)[1], labels.index(target)).tolist()))
    # states from which the target cannot be missed: all their ways lead to where it can be reached
    steps = t.where("p > 0").select(F.col("i").alias("a"), F.col("j").alias("b"))
    nodes = t.select(F.col("i").alias("node")).union(t.select("j")).distinct()
    goal = nodes.where(F.col("node") == target)
    sure = reached(steps.select(F.col("b").alias("a"), F.col("a").alias("b")), goal)
    lost = nodes.join(sure, "node", "left_anti")
    out_of_goal = steps.where(F.col("a") != target)
    may_miss = reached(out_of_goal.select(F.col("b").alias("a"), F.col("a").alias("b")), lost)
    infinite = {r["node"] for r in may_miss.toLocalIterator()}
    rest = [x for x in labels if x != target and x not in infinite]
    inside = t.join(may_miss.select(F.col("node").alias("i")), "i", "left_anti").join(may_miss.select(F.col("node").alias("j")), "j", "left_anti").where((F.col("i") != target) & (F.col("j") != target))
    times = {}
    if rest:
        q = products(inside.select("i", "j", "p"), rest)
        times = dict(zip(rest, solved(lambda x: x - q(x), np.ones(len(rest))).tolist()))
    return {x: 0.0 if x == target else times.get(x, math.inf) for x in labels}


def reached(steps: DataFrame, start: DataFrame) -> DataFrame:
    """(node): all nodes that ways along (a, b) reach from ``start`` (node), itself included."""
    steps = written(steps.where("a <> b").distinct())
    seen = frontier = written(start.select("node").distinct())
    while frontier.limit(1).count():
        frontier = written(frontier.join(steps, frontier.node == steps.a).select(F.col("b").alias("node")).distinct().join(seen, "node", "left_anti"))
        seen = written(seen.unionByName(frontier))
    return seen


def class_table(t: DataFrame) -> DataFrame:
    """(node, member_of): communicating classes, named by their smallest state.

    Each round passes the smallest label along the ways that are left; the nodes
    of a label from which its owner is reached are the owner's class.
    """
    left = written(t.select(F.col("i").alias("node")).union(t.select("j")).distinct())
    steps = written(t.where("p > 0 AND i <> j").select(F.col("i").alias("a"), F.col("j").alias("b")).distinct())
    found = None
    while left.limit(1).count():
        label = written(left.select("node", F.col("node").alias("label")))
        while True:
            told = steps.join(label, steps.a == label.node).groupBy(F.col("b").alias("node")).agg(F.min("label").alias("told"))
            now = written(label.join(told, "node", "left").select("node", F.least("label", "told").alias("label"), (F.col("told") < F.col("label")).alias("less")))
            label = now.drop("less")
            if not now.where("less").limit(1).count():
                break
        ends = label.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        within = steps.join(label.select(F.col("node").alias("a"), F.col("label").alias("la")), "a").join(ends, "b").where("la = lb")
        back = reached(within.select(F.col("b").alias("a"), F.col("a").alias("b")), label.where("node = label").select("node"))
        own = written(label.join(back, "node", "left_semi").select("node", F.col("label").alias("member_of")))
        found = own if found is None else found.unionByName(own)
        left = written(left.join(own, "node", "left_anti"))
        steps = written(steps.join(left.select(F.col("node").alias("a")), "a", "left_semi").join(left.select(F.col("node").alias("b")), "b", "left_semi"))
    return found if found is not None else left.select("node", F.col("node").alias("member_of"))


def periods(t: DataFrame, classes_: DataFrame) -> DataFrame:
    """(member_of, members, period) of each class; the period is 0 where no way comes back.

    With the distance d of each state from the class's first, the period is the
    greatest common divisor of d(i) + 1 - d(j) over the steps within the class:
    the smallest of these numbers, then of the remainders by it, until none is left.
    """
    a = classes_.select(F.col("node").alias("i"), "member_of")
    b = classes_.select(F.col("node").alias("j"), F.col("member_of").alias("other"))
    steps = written(t.where("p > 0").join(a, "i").join(b, "j").where("member_of = other").select("i", "j", "member_of"))
    seen = frontier = written(classes_.where("node = member_of").select("node", F.lit(0).alias("d")))
    while frontier.limit(1).count():
        further = frontier.join(steps.where("i <> j"), frontier.node == F.col("i")).groupBy(F.col("j").alias("node")).agg((F.min("d") + 1).alias("d"))
        frontier = written(further.join(seen, "node", "left_anti"))
        seen = written(seen.unionByName(frontier))
    near, far = seen.select(F.col("node").alias("i"), F.col("d").alias("di")), seen.select(F.col("node").alias("j"), F.col("d").alias("dj"))
    gaps = written(steps.join(near, "i").join(far, "j").select("member_of", F.abs(F.col("di") + 1 - F.col("dj")).alias("gap")).where("gap > 0").distinct())
    while True:
        least = gaps.groupBy("member_of").agg(F.min("gap").alias("g"), F.count(F.lit(1)).alias("n"))
        if not least.where("n > 1").limit(1).count():
            break
        rest = gaps.join(least.select("member_of", "g"), "member_of").select("member_of", F.explode(F.array("g", F.pmod("gap", "g"))).alias("gap"))
        gaps = written(rest.where("gap > 0").distinct())
    sizes = classes_.groupBy("member_of").agg(F.count(F.lit(1)).alias("members"))
    return sizes.join(gaps.withColumnRenamed("gap", "period"), "member_of", "left").select("member_of", "members", F.coalesce("period", F.lit(0)).cast("int").alias("period"))


def walk_of(t: DataFrame, start, steps: int) -> list:
    """States along the likeliest step to one not met yet, the first by name of equals; one row a step comes to the driver."""
    rows, path = written(t.where("p > 0").select("i", "j", "p")), [start]
    for _ in range(steps):
        best = rows.where((F.col("i") == path[-1]) & ~F.col("j").isin(path)).agg(F.min_by("j", F.struct(-F.col("p"), F.col("j"))).alias("j")).first()["j"]
        if best is None:
            break
        path.append(best)
    return path


def hitting_times(m: np.ndarray, target: int) -> np.ndarray:
    """Expected steps to ``target`` from every state; infinite where it is out of reach."""
    n = len(m)
    rest = [i for i in range(n) if i != target]
    out = np.zeros(n)
    try:
        out[rest] = np.linalg.solve(np.eye(n - 1) - m[np.ix_(rest, rest)], np.ones(n - 1))
    except np.linalg.LinAlgError:
        out[rest] = np.inf
    return out


def return_times(m: np.ndarray) -> np.ndarray:
    pi = power(m, steps=1000)
    return np.where(pi > 0, 1 / np.where(pi > 0, pi, 1), np.inf)


def classes(m: np.ndarray) -> list[list[int]]:
    """Communicating classes, by mutual reachability."""
    n = len(m)
    reach = (m > 0) | np.eye(n, dtype=bool)
    for _ in range(max(1, math.ceil(math.log2(max(2, n))))):
        reach = reach | (reach.astype(np.float32) @ reach.astype(np.float32) > 0)
    both = reach & reach.T
    found: dict[int, list[int]] = {}
    for i in range(n):
        found.setdefault(int(np.argmax(both[i])), []).append(i)
    return list(found.values())


def period(m: np.ndarray, members: list[int]) -> int:
    """Greatest common divisor of the lengths of the cycles through a class."""
    inside, depth, queue, g = set(members), {members[0]: 0}, [members[0]], 0
    while queue:
        u = queue.pop(0)
        for v in np.flatnonzero(m[u] > 0).tolist():
            if v in inside:
                if v in depth:
                    g = math.gcd(g, depth[u] + 1 - depth[v])
                else:
                    depth[v] = depth[u] + 1
                    queue.append(v)
    return abs(g)


def absorbing(m: np.ndarray, least: float = 0.95) -> list[int]:
    return np.flatnonzero(np.diag(m) >= least).tolist()


def mixing(m: np.ndarray, epsilon: float = 0.01) -> dict[str, float]:
    """Second eigenvalue, spectral gap and the time to come within ``epsilon``."""
    values = np.sort(np.abs(np.linalg.eigvals(m)))[::-1]
    second = float(values[1]) if len(values) > 1 else 0.0
    gap = 1 - second
    return {"second": second, "gap": gap, "time": math.log(1 / epsilon) / gap if gap > 1e-12 else math.inf}


def random_walk(m: np.ndarray, start: int, steps: int, seed: int = 0) -> list[int]:
    rng, path = np.random.default_rng(seed), [start]
    for _ in range(steps):
        row = m[path[-1]]
        if row.sum() <= 0:
            break
        path.append(int(rng.choice(len(row), p=row / row.sum())))
    return path


def likeliest_path(m: np.ndarray, start: int, steps: int) -> list[int]:
    """Greedy walk without revisits."""
    path = [start]
    for _ in range(steps):
        row = m[path[-1]].copy()
        row[path] = -1
        if row.max() <= 0:
            break
        path.append(int(row.argmax()))
    return path


def emissions(pairs: DataFrame) -> DataFrame:
    """(i, j, p): the share of hidden set a that observed set b covers, normalised by row."""
    rows = pairs.select(F.col("a").alias("i"), F.col("b").alias("j"), F.when(F.col("card_a") > 0, F.col("card_ab") / F.col("card_a")).otherwise(0.0).alias("raw"))
    total = F.sum("raw").over(W.partitionBy("i"))
    return rows.withColumn("p", F.when(total > 0, F.col("raw") / total).otherwise(0.0)).select("i", "j", "p")


def forward(prior: np.ndarray, t: np.ndarray, b: np.ndarray, observed: list[int]) -> float:
    """Log-likelihood of a sequence of observations, scaled at every step."""
    total, alpha = 0.0, prior * b[:, observed[0]]
    for k in range(len(observed)):
        if k:
            alpha = (alpha @ t) * b[:, observed[k]]
        s = alpha.sum()
        if s <= 0:
            return -math.inf
        total += math.log(s)
        alpha = alpha / s
    return total


def viterbi(prior: np.ndarray, t: np.ndarray, b: np.ndarray, observed: list[int]) -> list[int]:
    """Likeliest hidden states; ties go to the earlier state."""
    with np.errstate(divide="ignore"):
        lp, lt, lb = np.log(prior), np.log(t), np.log(b)
    score, back = lp + lb[:, observed[0]], []
    for o in observed[1:]:
        step = score[:, None] + lt
        back.append(step.argmax(axis=0))
        score = step.max(axis=0) + lb[:, o]
    path = [int(score.argmax())]
    for choice in reversed(back):
        path.append(int(choice[path[-1]]))
    return path[::-1]


def decode_sequences(sequences: DataFrame, key: str, order: str, observed: str, prior: dict, t: tuple, b: tuple, strict: bool = True) -> DataFrame:
    """(key, place, state): the likeliest hidden states of every sequence.

    The models are small and travel with the task; sequences are decoded apart.
    An observation that the model lacks is an error, or with ``strict=False``
    the first one's column.
    """
    labels, m = t
    hidden, columns, e = b
    p = np.array([prior[x] for x in labels], dtype=float)
    p = p / p.sum()
    rows = [labels.index(h) for h in hidden]
    emit = np.zeros((len(labels), len(columns)))
    emit[rows] = e
    at = {c: k for k, c in enumerate(columns)}

    def run(pdf):
        pdf = pdf.sort_values(order)
        unknown = set(pdf[observed]) - set(at)
        if unknown and strict:
            raise ValueError(f"unknown observations: {sorted(unknown)[:5]}")
        path = viterbi(p, m, emit, [at.get(x, 0) for x in pdf[observed]])
        return pdf[[key]].assign(place=range(len(path)), state=[labels[i] for i in path])

    kind = dict(sequences.dtypes)[key]
    return sequences.select(key, order, observed).groupBy(key).applyInPandas(run, f"{key} {kind}, place long, state string")


def cliques(pairs: list[tuple]) -> list[tuple]:
    """Maximal cliques of an undirected graph (Bron-Kerbosch with pivots)."""
    near: dict = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = []

    def grow(r, p, x):
        if not p and not x:
            out.append(tuple(sorted(r)))
            return
        pivot = max(p | x, key=lambda v: (len(near[v] & p), str(v)))
        for v in sorted(p - near[pivot]):
            grow(r | {v}, p & near[v], x & near[v])
            p = p - {v}
            x = x | {v}

    grow(set(), set(near), set())
    return sorted(out)
