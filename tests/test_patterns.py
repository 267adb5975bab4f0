"""Patterns of variable length and corpus graphs against walks over plain dictionaries."""

import collections
import random

import pytest

from sketchloom.operators import corpus as C
from sketchloom.operators import debruijn as D
from sketchloom.operators import patterns as P


def graph(seed, n, m):
    rng = random.Random(seed)
    return sorted({(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)})


def nodes(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def shortest_brute(edges, source, most):
    ways = collections.defaultdict(list)
    for a, b in edges:
        ways[a].append(b)
    best, level = {source: (0, [source])}, [[source]]
    for depth in range(1, most + 1):
        level = sorted([*w, b] for w in level for b in set(ways[w[-1]]) if b not in best or best[b][0] == depth)
        for w in level:
            best.setdefault(w[-1], (depth, w))
        level = [best[b][1] for b in {w[-1] for w in level}]
    return best


@pytest.mark.parametrize("most", [0, 2, 6])
def test_shortest_paths_in_a_graph_with_cycles(spark, most):
    edges = graph(1, 12, 26) + [("n1", "n1"), ("x", "y"), ("y", "x")]
    df = spark.createDataFrame([*edges, *edges[:5]], "a string, b string")
    got = {(r["source"], r["target"]): (r["depth"], r["path"]) for r in P.shortest_paths(df, nodes(spark, "n1", "n2", "x", "alone"), most).collect()}
    want = {(s, t): v for s in ("n1", "n2", "x", "alone") for t, v in shortest_brute([e for e in edges if e[0] != e[1]], s, most).items()}
    assert got == want


def test_targets_and_both_directions(spark):
    df = spark.createDataFrame([("a", "b"), ("c", "b"), ("c", "d")], "a string, b string")
    both = P.shortest_paths(P.undirected(df), nodes(spark, "a"), 5, nodes(spark, "d", "zz"))
    assert [tuple(r) for r in both.collect()] == [("a", "d", 3, ["a", "b", "c", "d"])]
    assert P.shortest_paths(df, nodes(spark, "a"), 5, nodes(spark, "d")).count() == 0
    with pytest.raises(ValueError):
        P.shortest_paths(df, nodes(spark, "a"), -1)


def test_walks_of_every_length(spark):
    edges = graph(2, 8, 14) + [("n0", "n0")]
    df = spark.createDataFrame(edges, "a string, b string")
    got = {tuple(r) for r in P.walks(df, nodes(spark, "n0", "n3"), 2, 5).collect()}
    want = set()
    for s in ("n0", "n3"):
        at = {s}
        for length in range(1, 6):
            at = {b for a, b in edges if a in at}
            want |= {(s, t, length) for t in at if length >= 2}
    assert got == want
    assert {tuple(r) for r in P.walks(df, nodes(spark, "n0"), 0, 0).collect()} == {("n0", "n0", 0)}
    with pytest.raises(ValueError):
        P.walks(df, nodes(spark, "n0"), 3, 2)


def test_chains_of_labels_are_counted(spark):
    rows = [("a", "x", "b"), ("a", "x", "c"), ("b", "y", "d"), ("c", "y", "d"), ("c", "z", "d"), ("d", "x", "a")]
    df = spark.createDataFrame(rows, "a string, label string, b string")
    assert {tuple(r) for r in P.along_labels(df, ["x", "y"]).collect()} == {("a", "d", 2)}
    assert {tuple(r) for r in P.along_labels(df, ["x", None, "x"]).collect()} == {("a", "a", 3)}
    assert P.along_labels(df, ["y", "y"]).count() == 0


def test_cheapest_paths_are_those_of_dijkstra(spark):
    import heapq

    rng = random.Random(7)
    edges = [(a, b, float(rng.choice([0, 1, 2, 5, 9]))) for a, b in graph(3, 15, 45)]
    best, heap = {}, [(0.0, 1, ["n0"])]
    while heap:
        cost, n, path = heapq.heappop(heap)
        if path[-1] not in best:
            best[path[-1]] = cost, path
            for a, b, c in edges:
                if a == path[-1] and a != b:
                    heapq.heappush(heap, (cost + c, n + 1, [*path, b]))
    df = spark.createDataFrame([*edges, *[(a, b, c + 3) for a, b, c in edges[:9]]], "a string, b string, cost double")
    got = {r["target"]: (r["cost"], r["path"]) for r in P.cheapest_paths(df, nodes(spark, "n0")).collect()}
    assert got == best
    assert P.cheapest_paths(df, nodes(spark, "n0"), nodes(spark, "nowhere")).count() == 0
    with pytest.raises(Exception, match="below 0"):
        P.cheapest_paths(spark.createDataFrame([("a", "b", -1.0)], "a string, b string, cost double"), nodes(spark, "a")).collect()


def test_beliefs_by_levels(spark):
    from sketchloom.operators import network as N

    net = [("a", "c", 0.5), ("b", "c", 0.8), ("c", "d", 0.9), ("a", "d", 0.2), ("z", "e", 0.7), ("x", "y", 0.5), ("y", "x", 0.5), ("y", "w", 1.0), ("q", "r", 0.4)]
    own = {n: 0.1 * i for i, n in enumerate("abcdexywqr", 1)} | {"q": 0.0}  # z has no belief of its own
    df = spark.createDataFrame(net, "parent string, child string, probability double")
    table = spark.createDataFrame(list(own.items()), "node string, belief double")

    def brute(sure):
        out = {n: 1.0 if n in sure else b for n, b in own.items()}
        done = {n for n in out if not any(c == n for _, c, _ in net)}
        while ready := [n for n in out if n not in done and all(p in done for p, c, _ in net if c == n)]:
            for n in ready:
                up = [(w, out[p]) for p, c, w in net if c == n]
                if n not in sure and sum(b for _, b in up) > 0:
                    out[n] = sum(w * b for w, b in up) / sum(b for _, b in up)
            done |= set(ready)
        return out

    for sure in ([], ["b"], ["c", "q"]):
        found = N.propagate(df, table, nodes(spark, *sure) if sure else None)
        assert {r["node"]: r["belief"] for r in found.collect()} == pytest.approx(brute(sure))
    on, off = brute(["b"]), {}
    own["b"] = 0.0
    off = brute([])
    own["b"] = 0.2
    assert N.average_effect(df, table, "b", "d") == pytest.approx(on["d"] - off["d"])


def test_generation_by_doubling(spark):
    ring = D.kmers(spark.createDataFrame([("a b c a b c a x".split(),)], "w array<string>"), "w", k=2)
    for steps in (0, 1, 2, 7, 8):
        got = sorted(map(tuple, D.generate(ring, "a", steps).collect()))
        assert got == [(i, "abc"[i % 3]) for i in range(steps + 1)]


# corpus graphs ----------------------------------------------------------------


def kmers_of(texts, k=3):
    return collections.Counter(" ".join(w[i : i + k]) for t in texts for w in [t.split()] for i in range(len(w) - k + 1))


def edges_of(spark, texts, k=3):
    return D.kmers(spark.createDataFrame([(t.split(),) for t in texts], "w array<string>"), "w", k=k)


def chains_brute(kmers, k=3):
    src, dst = lambda m: " ".join(m.split()[:-1]), lambda m: " ".join(m.split()[1:])
    o, i = collections.defaultdict(list), collections.defaultdict(list)
    for m in kmers:
        o[src(m)].append(m)
        i[dst(m)].append(m)
    inner = {n for n in o if len(o[n]) == 1 and len(i[n]) == 1}
    left, out = set(kmers), []
    heads = sorted(m for m in kmers if src(m) not in inner)
    while left:
        m = heads.pop(0) if heads else min(left)
        chain = []
        while m in left:
            left.discard(m)
            chain.append(m)
            if dst(m) not in inner:
                break
            (m,) = o[dst(m)]
        out.append(" ".join([src(chain[0]), *(x.split()[-1] for x in chain)]))
    return sorted(out)


TEXTS = {
    "branches": ["the cat sat on the mat and the cat ran off", "a dog sat on the mat too", "the cat ran off"],
    "line": [" ".join(f"w{i}" for i in range(150))],
    "ring": ["a b c d e f a b", "x y z"],
    "two rings": ["a b c a b", "p q r s p q", "lone short text here"],
    "repeats": ["u u u u", "u v u v u"],
    "none": ["ab cd"],
}


@pytest.mark.parametrize("name", TEXTS)
def test_contracted_chains(spark, name):
    texts = TEXTS[name]
    edges = edges_of(spark, texts)
    counts = kmers_of(texts)
    got = C.contracted(edges).collect()
    assert sorted(r["sequence"] for r in got) == chains_brute(list(counts))
    assert sum(r["edges"] for r in got) == len(counts) and sum(r["total"] for r in got) == sum(counts.values())
    for r in got:
        own = kmers_of([r["sequence"]])
        assert r["least"] == min(counts[m] for m in own) and r["src"] == " ".join(r["sequence"].split()[:2]) and r["dst"] == " ".join(r["sequence"].split()[-2:])
    assert sorted(r["kmer"] for r in C.expanded(C.contracted(edges)).collect()) == sorted(counts)


def test_graphs_of_batches_merge_to_that_of_the_corpus(spark):
    texts = TEXTS["branches"] + TEXTS["ring"]
    parts = C.merge_graphs(*[edges_of(spark, [t]) for t in texts])
    assert {r["kmer"]: r["multiplicity"] for r in parts.collect()} == kmers_of(texts)
    assert sorted(map(tuple, C.contracted(parts).collect())) == sorted(map(tuple, C.contracted(edges_of(spark, texts)).collect()))


def test_edges_at_their_head_are_not_moved_again(spark, monkeypatch):
    texts = [" ".join(f"w{i}" for i in range(64)), *(f"p{i} q{i} r{i} s{i}" for i in range(200))]
    moved, write = [], C.written
    monkeypatch.setattr(C, "written", lambda df: (out := write(df), moved.append(out.count()))[0])
    edges = edges_of(spark, texts)
    assert C.contracted(edges).count() == 201
    # numbers, links and a first round of all; then only the long chain goes on
    assert sum(moved) < 3 * edges.count()
