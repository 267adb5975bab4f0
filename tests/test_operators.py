"""Small fixtures of the other operators."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sketchloom.functions import hashing as H
from sketchloom.operators import bayes as B
from sketchloom.operators import debruijn as D
from sketchloom.operators import lattice as L
from sketchloom.operators import markov as K
from sketchloom.operators import network as N
from sketchloom.operators import pairs as P
from sketchloom.operators import retrieval as R
from sketchloom.operators import ring as G
from sketchloom.operators import sketch as S
from sketchloom.operators import store as X
from sketchloom.operators import timeline as T
from sketchloom.operators import tokens as Q


def long_of(spark, sets, key="set_id"):
    return S.long_form(spark.createDataFrame([(k, t) for k, v in sets.items() for t in v], f"{key} string, token string"), "token", key)


def test_transitions_of_sliding_sets(spark):
    t = T.transitions(long_of(spark, {"S0": "abc", "S1": "bcd", "S2": "cde", "S3": "def"}, "ts"), "ts").orderBy("step").collect()
    assert [(r["deleted"], r["retained"], r["novel"]) for r in t] == [(1, 2, 1)] * 3
    assert [r["kind"] for r in t] == ["stable"] * 3


def test_cumulative_is_the_union_so_far(spark):
    sets = {"1": "abc", "2": "cd", "3": "a"}
    got = {r["ts"]: (r["card"], r["novel"]) for r in T.cumulative(long_of(spark, sets, "ts"), "ts").collect()}
    assert got == {"1": (3, 3), "2": (4, 1), "3": (4, 0)}


def test_noether_state_and_phase(spark):
    added = long_of(spark, {"1": ["cat", "dog", "bird"], "2": ["fish", "snake"]}, "ts")
    removed = long_of(spark, {"2": ["cat"], "3": ["dog", "bird"]}, "ts")
    rows = T.noether(added, removed, "ts").orderBy("ts").collect()
    assert [r["flux"] for r in rows] == [3, 1, -2]
    assert [r["card"] for r in rows] == [3, 4, 2]
    assert [r["conservation_error"] for r in rows] == [0, 0, 0]


def test_additions_beat_removals_within_a_step(spark):
    one = long_of(spark, {"1": ["a"]}, "ts")
    assert T.noether(one, one, "ts").first()["popcount"] == 1


def test_paths(spark):
    edges = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.8), ("a", "c", 0.5)], "a string, b string, tau double")
    assert T.evolution_path(edges) == ["a", "b", "c"]
    costs = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 5.0)], "a string, b string, cost double")
    assert T.cheapest_path(costs, "a", "c") == (["a", "b", "c"], 2.0)
    assert T.cheapest_path(costs, "c", "a") is None


def test_subset_lattice(spark):
    sets = {"c": "c", "bc": "bc", "cd": "cd", "abc": "abc", "bcd": "bcd", "cde": "cde", "all": "abcde"}
    order = L.edges(P.overlaps(long_of(spark, sets))).where("kind = 'subset'").cache()
    reach = L.closure(order)
    assert {(r["a"], r["b"]) for r in L.hasse(order, reach).collect()} == {
        ("c", "bc"), ("c", "cd"), ("bc", "abc"), ("bc", "bcd"), ("cd", "bcd"), ("cd", "cde"), ("abc", "all"), ("bcd", "all"), ("cde", "all")
    }
    nodes = spark.createDataFrame([(k,) for k in sets], "node string")
    levels = L.levels(nodes, reach)
    assert {r["node"]: r["level"] for r in levels.collect()} == {"c": 0, "bc": 1, "cd": 1, "abc": 2, "bcd": 2, "cde": 2, "all": 3}
    assert tuple(L.shape(levels, L.hasse(order, reach)).first()) == (3, 3, 1, 1)
    assert "digraph" in L.to_dot(order).first()["dot"]


def test_euler_path_and_restore(spark):
    path, whole = D.euler_path([("START A", "A B", 1), ("A B", "B C", 1), ("B C", "C D", 1), ("C D", "D END", 1)])
    assert D.sequence_of(path) == ["START", "A", "B", "C", "D", "END"] and whole
    text = "the quick brown fox jumps over the lazy dog"
    docs = spark.createDataFrame([(1, text)], "id int, text string").select("id", H.padded(H.words(F.col("text")), 3).alias("w"))
    grams = docs.select("id", F.posexplode(H.ngrams(F.col("w"), 3)).alias("at", "kmer"))
    e = D.kmers(docs, "w", "id", k=3).join(grams.groupBy("id", "kmer").agg(F.min("at").alias("at")), ["id", "kmer"])
    r = D.restore(e, "id", "at").first()
    assert (r["sequence"], r["is_eulerian"]) == (text, True)
    assert D.eulerian(e, "id").first()["balanced"]
    assert D.greedy_path([("a", "b", 2), ("b", "a", 1)], "a") == ["a", "b", "a", "b"]


def test_probabilities_of_overlapping_sets(spark):
    sets = {"A": range(30), "B": range(10, 40), "C": range(25, 50), "D": range(100, 120)}
    long = long_of(spark, {k: [f"token_{i}" for i in v] for k, v in sets.items()}).cache()
    pairs = P.overlaps(long)
    pr = {(r["a"], r["b"]): r for r in B.bayes_theorem(B.with_priors(pairs, B.universe_card(long))).collect()}
    assert (pr["A", "B"]["card_ab"], pr["A", "C"]["card_ab"], pr["B", "C"]["card_ab"], pr["A", "D"]["card_ab"]) == (20, 5, 15, 0)
    assert max(r["error"] for r in pr.values()) < 1e-9
    net = N.edges(pairs, 0.1)
    assert {(r["parent"], r["child"]) for r in net.collect()} == {("A", "B"), ("A", "C"), ("B", "C")}
    assert N.blankets(net).where("node = 'A'").first()["coparents"] == ["B"]
    out = {r["node"]: r["belief"] for r in N.propagate(net, spark.createDataFrame([(k, 0.5) for k in sets], "node string, belief double")).collect()}
    assert out["A"] == 0.5 and 0 < out["C"] < 1
    t = K.transition(pairs)
    assert all(abs(r["s"] - 1) < 1e-9 or r["s"] == 0 for r in t.groupBy("i").agg(F.sum("p").alias("s")).collect())


def test_chain_statistics():
    m = np.array([[0, 1.0], [1.0, 0]])
    assert K.power(m).tolist() == [0.5, 0.5]
    assert K.hitting_times(m, 0).tolist() == [0, 1]
    assert K.classes(m) == [[0, 1]] and K.period(m, [0, 1]) == 2
    assert K.classes(np.array([[0.5, 0.5], [0, 1.0]])) == [[0], [1]] and K.absorbing(np.array([[0.5, 0.5], [0, 1.0]])) == [1]
    assert K.entropy_rate(np.full((2, 2), 0.5))[0] == 1.0
    assert K.random_walk(m, 0, 3) == [0, 1, 0, 1] and K.likeliest_path(m, 0, 3) == [0, 1]
    assert K.cliques([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d")]) == [("a", "b", "c"), ("c", "d")]


def test_distributed_power_iteration_agrees(spark):
    m = np.array([[0, 0.5, 0.5], [1.0, 0, 0], [0.3, 0.7, 0]])
    t = spark.createDataFrame([(str(i), str(j), float(m[i, j])) for i in range(3) for j in range(3)], "i string, j string, p double")
    got = {r["state"]: r["score"] for r in K.power_distributed(t, 0.85, 12).collect()}
    want = K.power(m, 0.85)
    assert all(abs(got[str(i)] - want[i]) < 1e-2 for i in range(3))


def test_viterbi_against_all_paths():
    from itertools import product

    rng = np.random.default_rng(1)
    p, t, b = rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(2), 3)
    seen = [0, 1, 1, 0]
    score = lambda s: p[s[0]] * b[s[0], seen[0]] * np.prod([t[x, y] * b[y, o] for x, y, o in zip(s, s[1:], seen[1:])])
    assert K.viterbi(p, t, b, seen) == list(max(product(range(3), repeat=4), key=score))
    assert abs(K.forward(p, t, b, seen) - np.log(sum(score(s) for s in product(range(3), repeat=4)))) < 1e-9


def test_ring_decomposition_is_exact(spark):
    rows = [("r", "a", [1, 2], 0), ("r", "b", [2, 3], 1), ("r", "c", [1, 3], 2), ("r", "d", [7], 3), ("r", "e", [1, 3, 7], 4)]
    df = spark.createDataFrame(rows, "ring string, id string, bits array<int>, o int")
    d = {r["id"]: r for r in G.decompose(df, "ring", "id", "o").collect()}
    assert [d[k]["rank"] for k in "abcde"] == [1, 2, 2, 3, 3]
    assert d["c"]["expression"] == ["a", "b"] and sorted(d["e"]["expression"]) == ["a", "b", "d"]
    rebuilt = {(r["id"], r["bit"]) for r in G.reconstruct(G.decompose(df, "ring", "id", "o"), df, "id").collect()}
    assert rebuilt == {(i, b) for _, i, bits, _ in rows for b in bits}
    assert G.partial_basis(df.coalesce(1), "ring", "id").count() == 3


def test_token_table_and_registers(spark):
    docs = spark.createDataFrame([(1, "a b c".split()), (2, "a b".split())], "id int, w array<string>")
    lut = Q.build_lut(Q.ngram_rows(docs, "w", "id")).cache()
    one = {r["ngrams"][0]: r for r in lut.collect()}
    assert one["a b"]["tf"] == 2 and one["a b c"]["layer"] == 2 and one["b c"]["first_tokens"] == ["b"]
    merged = {r["ngrams"][0]: r["tf"] for r in Q.merge_lut(lut.unionByName(lut).drop("collisions")).collect()}
    assert merged["a b"] == 4
    pos = S.long_form(docs.select(F.explode("w").alias("t")), "t")
    assert Q.disambiguate(lut, pos).where("method = 'no_candidates'").count() == 0
    assert {t for r in Q.register_filter(lut).collect() for t in r["surviving"]} <= set("abc")
    assert Q.orphans(lut, pos).count() == 0 and Q.lut_stats(lut).first()["entries"] == lut.count()


def test_coverage_and_novelty(spark):
    sets = long_of(spark, {"u": "abcdef", "x": "abgh"})
    got = Q.coverage_novelty(sets.where("set_id = 'x'"), sets.where("set_id = 'u'").select("reg", "zeros"), "set_id").first()
    assert (got["coverage"], got["novelty"]) == (2 / 6, 0.5)


def test_store_lineage_and_evaluation(spark):
    base = long_of(spark, {"x": "abc", "y": "bcd"}, "id")
    u, op, operands = X.derivation("union", "x", "y")
    d, op2, operands2 = X.derivation("diff", u, "x")
    plan = {u: (op, operands), d: (op2, operands2)}
    assert S.cardinality(X.evaluate(base, plan, d)).first()["card"] == 1
    table = spark.createDataFrame([(u, operands), (d, operands2)], "id string, operands array<string>")
    assert {r["id"]: (r["bases"], r["depth"]) for r in X.bases(table).collect()} == {u: (["x", "y"], 1), d: (["x", "y"], 2)}
    assert [r["id"] for r in X.dependents(table, u).collect()] == [d]


def test_commits_and_ancestors(spark):
    links = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 2)], "id int, parent int")
    assert tuple(X.common_ancestor(links, 3, 4).first()) == (2, 1, 1)
    assert X.roll_back(links, 2, 9).where("id = 9").first()["parent"] == 2
    log = X.commits(long_of(spark, {"1": "abc", "2": "cd"}, "t"), "t").orderBy("seq").collect()
    assert [(r["state_card"], r["delta_card"]) for r in log] == [(3, 3), (4, 1)]


def test_retrieval(spark):
    q = R.encode(spark.createDataFrame([("q", "Deep Learning models")], "set_id string, text string"), "text", "set_id")
    docs = long_of(spark, {"d1": ["deep", "learning", "models"], "d2": ["cooking"]})
    scored = {r["b"]: r["score"] for r in R.relevance(P.overlaps(q, docs)).collect()}
    assert scored == {"d1": 1.0, "d2": 0.0}
    ctx = R.collect_context(q.select("reg", "zeros"), docs.withColumnRenamed("set_id", "t"), "t").orderBy("depth").collect()
    assert [(r["t"], r["accepted"]) for r in ctx] == [("d2", False), ("d1", True)]
    assert "Query: x" in R.prompt([("a", "y" * 300, 0.5)], "x")


def test_registered_queries_have_matching_names():
    from sketchloom.catalog import FLAGSHIP, ORACLES, QUERIES

    assert FLAGSHIP in QUERIES and set(ORACLES) <= set(QUERIES)


def test_transaction_phases(spark):
    import pytest

    from sketchloom.operators.transaction import Transaction

    rows = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "b"), ("2", "c"), ("3", "a"), ("3", "c")], "batch string, token string")
    draft = Transaction().ingest(rows)
    assert [(r["batch"], r["rank"]) for r in draft.ranks().orderBy("batch").collect()] == [("1", 1), ("2", 2), ("3", 2)]
    q = S.long_form(spark.createDataFrame([("a",), ("zzz",)], "token string"), "token")
    assert draft.orphans(q).count() == 1 and {r["batch"] for r in draft.search(q).collect()} == {"1", "3"}
    assert draft.search(q, least=10).count() == 0 and draft.batch_ids().count() == 3
    assert S.unpack(draft.from_bases()).count() == S.unpack(draft.commit()).count() == 3
    with pytest.raises(RuntimeError):
        draft.rollback()
    other = Transaction().ingest(rows)
    other.rollback()
    with pytest.raises(RuntimeError):
        other.rows()


def test_steering_and_recovered_tokens(spark):
    long = long_of(spark, {"a": "abcd", "b": "cdef"})
    r = T.steering(P.overlaps(long)).where("a = 'a' AND b = 'b'").first()
    assert (r["direct"], r["incremental"], r["conservative"], r["at_target"]) == (4, 0.8, 2, False)
    assert T.steering(P.overlaps(long)).where("a = b AND NOT at_target").count() == 0
    lut = Q.build_lut(spark.createDataFrame([(0, c) for c in "abcdef"], "layer int, ngram string"))
    at = lambda k: long.where(F.col("set_id") == k)
    got = {(r["component"], r["token"]) for r in T.recover_tokens(at("a"), at("b"), lut).collect()}
    assert got == {("deleted", "a"), ("deleted", "b"), ("retained", "c"), ("retained", "d"), ("novel", "e"), ("novel", "f")}


def test_text_positions_equal_exploded_ngrams(spark):
    texts = [("en", "the quick  brown\nfox the quick"), ("en", "a"), ("de", "über straße über"), (None, "the quick"), ("de", None), ("de", "  ")]
    docs = spark.createDataFrame(texts, "lang string, text string")
    got = {tuple(r) for r in Q.text_positions(docs, "text", "lang", max_n=3).collect()}
    rows = Q.ngram_rows(docs.where("text is not null").select("lang", H.words(F.col("text")).alias("w")), "w", "lang")
    want = S.positions(rows, "ngram").groupBy("lang", "layer", "reg", "zeros").agg(F.count(F.lit(1)).alias("n"))
    assert got == {tuple(r) for r in want.collect()}
    assert Q.text_positions(docs.where("false"), "text").count() == 0


def test_branches_and_merges(spark):
    links = spark.createDataFrame([(1, None), (2, 1), (3, 1)], "id int, parent int")
    merged = X.merge_commits(links, 2, 3, 4)
    deltas = long_of(spark, {"1": "a", "2": "b", "3": "c"}).select(F.col("set_id").cast("int").alias("id"), "reg", "zeros")
    assert S.cardinality(X.state_at(merged, deltas, 4)).first()["card"] == 3
    assert S.cardinality(X.state_at(merged, deltas, 3)).first()["card"] == 2
    assert X.common_ancestor(merged, 4, 3).first()["ancestor"] == 3
    b = X.create_branch(spark.createDataFrame([("main", 2)], "name string, head int"), "side", 3)
    assert {r["ancestor"] for r in X.log_of(b, links, "side").collect()} == {3, 1}
    assert X.create_branch(b, "side", 4).where("name = 'side'").first()["head"] == 4


def test_join_and_meet_of_nodes(spark):
    long = long_of(spark, {"1": "abc", "2": "bcd", "3": "c"}, "ts")
    assert S.cardinality(T.join_nodes(long, "ts", ["1", "2"]), "ts").first() == ("2", 4.0)
    assert S.cardinality(T.meet_nodes(long, "ts", ["1", "2", "3"]), "ts").first() == ("1", 1.0)


def test_text_is_hashed_in_bounded_stretches(spark, monkeypatch):
    """However many texts a batch has, what is taken apart at once is bounded, and the counts are those of the exploded n-grams."""
    texts = ["a b c a b", "é b\x0bb", None, "", " x ", "a b " * 50, "longword" * 9 + " a b"]
    docs = spark.createDataFrame([("l" if i % 2 else None, t) for i, t in enumerate(texts)], "k string, text string").coalesce(1)
    words = docs.select("k", H.words(F.col("text")).alias("w"))
    want = {(r["k"], r["layer"], r["reg"], r["zeros"]): r["count"] for r in S.positions(Q.ngram_rows(words, "w", "k"), "ngram").groupBy("k", "layer", "reg", "zeros").count().collect()}
    got = lambda: {(r["k"], r["layer"], r["reg"], r["zeros"]): r["n"] for r in Q.text_positions(docs, "text", "k", max_n=3).collect()}
    assert got() == want
    monkeypatch.setattr(Q, "PIECE", 40)
    monkeypatch.setattr(Q, "STEP", 7)
    column = pa.array(texts, pa.string())
    grams = [(first + r, layer, bytes(data[s : s + n]).decode()) for first, piece in Q._pieces(column) for data, row, layers, start, length in Q._grams(piece, 3) for r, layer, s, n in zip(row, layers, start, length)]
    want = [(i, n - 1, " ".join(w[j : j + n])) for i, w in enumerate((t or "").split() for t in texts) for n in (1, 2, 3) for j in range(len(w) - n + 1)]
    assert sorted(grams) == sorted(want)
    assert max(len(row) for _, piece in Q._pieces(column) for _, row, *_ in Q._grams(piece, 3)) <= 21


def test_entries_of_texts_equal_the_token_table(spark):
    texts = ["a b c a b", "é b", None, "", *(" ".join(f"w{i * j % 91}" for j in range(60)) for i in range(40))]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    lut = Q.build_lut(Q.ngram_rows(docs.select(H.words(F.col("text")).alias("w")), "w"))
    columns = ("layer", "hash", "reg", "zeros", "tf", "collisions")
    entries = lambda df: sorted(tuple(r[c] for c in columns) for r in df.collect())
    for per_bucket in (50, 4_000_000):
        assert entries(Q.text_entries(docs, "text", per_bucket=per_bucket)) == entries(lut)
    assert Q.text_entries(docs.limit(0), "text").count() == 0
    # no n-gram passes a shuffle
    plan = Q.text_entries(docs, "text")._jdf.queryExecution().executedPlan().toString()
    assert "ngram" not in plan and "FlatMapGroupsInArrow" in plan


def test_hash_of_spans_at_all_lengths():
    data = np.frombuffer(bytes(range(256)) * 3, dtype=np.uint8)
    n = np.arange(0, 300)
    start = np.arange(300) % 97
    want = [H.murmur64a_numpy(pa.array([data[s : s + k].tobytes()], pa.binary()))[0] for s, k in zip(start, n)]
    assert H.murmur64a_spans(data, start, n).tolist() == want
    assert H.murmur64a_spans(data[:0], np.array([0]), np.array([0])).tolist() == H.murmur64a_numpy(pa.array([b""])).tolist()
