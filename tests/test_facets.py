"""Bounds, errors and long chains of the core operators."""

import random

import pytest
from pyspark.sql import functions as F

from sketchloom.functions import hashing as H
from sketchloom.operators import debruijn as D
from sketchloom.operators import lattice as L
from sketchloom.operators import markov as M
from sketchloom.operators import pairs as P
from sketchloom.operators import ring as G
from sketchloom.operators import sketch as S
from sketchloom.operators import store as X
from sketchloom.operators import timeline as T
from sketchloom.operators import tokens as K
from sketchloom.sources import tables as I
from sketchloom.streaming import session as Z


def sets(spark, held, p=10):
    rows = [(k, t) for k, ts in held.items() for t in ts]
    return S.long_form(spark.createDataFrame(rows, "set_id string, token string"), "token", "set_id", p=p)


def test_sketches_of_different_precision_do_not_unite(spark):
    a, b = (S.pack(sets(spark, {"x": ["u", "v"]}, p), "set_id", p=p) for p in (8, 10))
    with pytest.raises(Exception, match="different precision"):
        S.merge(a.unionByName(b)).collect()
    assert S.merge(a.unionByName(a)).first()["bitmap"] == a.first()["bitmap"]
    assert [S.precision(x).first()["p"] for x in (a, b)] == [8, 10]


@pytest.mark.parametrize("block", [1, 2, 256])
def test_pairs_in_blocks_of_any_size(spark, block):
    held = {"a": [f"t{i}" for i in range(400)], "b": [f"t{i}" for i in range(300, 900)], "c": ["z"], "d": [f"t{i}" for i in range(400)]}
    long = sets(spark, held)
    got = {(r["a"], r["b"]): r for r in P.overlaps(long, block=block).collect()}
    assert len(got) == 16
    bits = {}
    for r in long.collect():
        bits.setdefault(r["set_id"], set()).add((r["reg"], r["zeros"]))

    def card(x):
        rows = spark.createDataFrame(sorted(x), "reg int, zeros int") if x else None
        return S.cardinality(rows).first()["card"] if x else 0.0

    for a, b in (("a", "b"), ("a", "d"), ("c", "a"), ("b", "b")):
        r, x, y = got[a, b], bits[a], bits[b]
        assert (r["pop_a"], r["pop_b"], r["pop_ab"]) == (len(x), len(y), len(x & y))
        assert (r["card_a"], r["card_ab"], r["card_a_not_b"], r["card_or"], r["card_xor"]) == (card(x), card(x & y), card(x - y), card(x | y), card(x ^ y))
    assert {(r["a"], r["b"]) for r in P.overlaps(long, disjoint=False, block=block).collect()} == {k for k, r in got.items() if r["pop_ab"]}


def test_long_histories_and_diamonds(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(300)], "id int, parent int")
    h = X.history(chain)
    assert h.where("id = 299").count() == 300 and h.where("id = 299 AND ancestor = 0").first()["distance"] == 299
    # forty diamonds in a row: 2^40 ways, 120 edges
    rows = [(f"n{3 * i}", [f"n{3 * i + 1}", f"n{3 * i + 2}"]) for i in range(40)] + [(f"n{3 * i + j}", [f"n{3 * i + 3}"]) for i in range(40) for j in (1, 2)]
    line = X.lineage(spark.createDataFrame(rows, "id string, operands array<string>"))
    assert line.where("id = 'n0' AND ancestor = 'n120'").first()["depth"] == 80


def test_guards_on_the_driver(spark):
    with pytest.raises(ValueError, match="more than 3 rows"):
        I.bounded(spark.range(4), 3)
    assert len(I.bounded(spark.range(3), 3)) == 3


def test_pagerank_by_joins_equals_the_matrix(spark):
    rng = random.Random(0)
    rows = []
    for i in range(12):
        w = [rng.random() if rng.random() < 0.4 and i != j else 0.0 for j in range(12)]
        rows += [(f"s{i}", f"s{j}", x / sum(w) if sum(w) else 0.0) for j, x in enumerate(w)]
    t = spark.createDataFrame(rows, "i string, j string, p double")
    labels, m = M.dense(t)
    want = dict(zip(labels, M.power(m, 0.85, 200, 1e-6)))
    got = {r["state"]: r["score"] for r in M.power_distributed(t, 0.85, 200, 1e-6).collect()}
    assert max(abs(got[k] - want[k]) for k in want) < 1e-6


def test_parents_of_equal_states(spark):
    tokens = spark.createDataFrame([(d, t) for d, ts in {"d1": "ab", "d2": "c", "d3": "ab", "d4": "x"}.items() for t in ts], "day string, token string")
    n = {r["day"]: r for r in T.nodes(tokens, "token", "day").collect()}
    assert n["d1"]["node_id"] == n["d3"]["node_id"]
    assert [n[d]["parent_time"] for d in ("d1", "d2", "d3", "d4")] == [None, "d1", "d2", "d3"]


def test_parts_of_a_graph(spark):
    rng = random.Random(1)
    links = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(i, i + 1) for i in range(100, 140)]
    want = {}
    for a, b in links:
        for x in (a, b):
            want.setdefault(x, {x})
        both = want[a] | want[b]
        for x in both:
            want[x] = both
    got = {r["node"]: r["part"] for r in L.parts_of(spark.createDataFrame(links, "a int, b int")).collect()}
    assert got == {x: min(s) for x, s in want.items()}


def test_restored_order_against_the_texts(spark):
    texts = ["the quick brown fox jumps over the lazy dog", "a b c d e f g", "one two", "x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", H.padded(H.words(F.col("text")), 3).alias("w"))
    grams = docs.select("id", F.explode(H.ngrams(F.col("w"), 3)).alias("ngram"))
    lut = K.build_lut(grams.select(F.lit(2).alias("layer"), "ngram"), p=20)
    got = {r["id"]: (r["sequence"], r["is_eulerian"]) for r in K.restore_order(lut, S.long_form(grams, "ngram", "id", p=20), "id").collect()}
    assert got == {i: (t, True) for i, t in enumerate(texts)}


def test_generate_stops_without_continuation(spark):
    e = D.kmers(spark.createDataFrame([(["a", "b", "c", "d"],)], "w array<string>"), "w", k=3)
    assert [r["node"] for r in D.generate(e, "a b", 9).orderBy("place").collect()] == ["a b", "b c", "c d"]
    assert D.generate(e, "nowhere", 9).count() == 1


def test_masks_lead_to_the_next_state(spark):
    long = sets(spark, {"1": ["a", "b"], "2": ["b", "c"], "3": []}).withColumnRenamed("set_id", "day")
    now = T.apply_masks(long.where("day = '1'"), T.shift_masks(long, "day").where("step = 1"))
    assert sorted(map(tuple, now.collect())) == sorted(tuple(r)[1:] for r in long.where("day = '2'").collect())


def test_as_of_takes_the_latest_earlier_row(spark):
    left = spark.createDataFrame([("u", 5, "x"), ("u", 1, "y"), ("v", 9, "z"), (None, 3, "n")], "k string, t int, what string")
    right = spark.createDataFrame([("u", 2, 20), ("u", 5, 50), ("u", 7, 70), ("w", 1, 10)], "k string, t int, value int")
    got = {r["what"]: r["value"] for r in T.as_of(left, right, "t", "value", "k").collect()}
    assert got == {"x": 50, "y": None, "z": None, "n": None}


def test_as_of_by_stretches(spark):
    """Dealt by stretches of time, also with a key of all rows, null keys, times and values: as without."""
    rng = random.Random(3)
    at = lambda: rng.choice([None, *range(40)])
    left = spark.createDataFrame([(rng.choice(["a", "a", "b", None]), at(), f"r{i}") for i in range(200)], "k string, t long, what string")
    right = spark.createDataFrame([(rng.choice(["a", "b", None]), t, rng.choice([None, t * 10])) for t in rng.sample(range(40), 25)], "k string, t long, value long")
    whole = {tuple(r) for r in T.as_of(left, right, "t", "value", "k").select("k", "t", "what", "value").collect()}
    for width in (1, 7, 100):
        dealt = T.as_of(left, right, "t", "value", "k", stretch=F.floor(F.col("t") / width))
        assert dealt.columns == ["k", "t", "what", "value"] and {tuple(r) for r in dealt.collect()} == whole and dealt.count() == 200


def test_ring_rank_by_partial_bases(spark):
    rng = random.Random(3)
    vectors = [rng.sample(range(30), 6) for _ in range(60)]
    basis = G.Basis()
    for v in vectors:
        basis.add(G.as_int(v), 0)
    rows = spark.createDataFrame([("r", i, v) for i, v in enumerate(vectors)], "ring string, key int, bits array<int>").repartition(5)
    assert G.rank(rows, "ring", "key").first()[:] == ("r", 60, basis.rank())


def test_session_of_text_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("apple\n\n fig \n")
    (tmp_path / "in" / "b.txt").write_text("fig\n")
    session = Z.ingest_lines(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/s")
    packed, lut = session.commit()
    assert S.cardinality(S.unpack(packed, "layer")).first()["card"] == 2 and lut.agg(F.sum("tf")).first()[0] == 3
    assert session.length() == 1 and session.trim(1)[1].count() == 2
    session.cleanup()
    assert not (tmp_path / "s").exists()
    assert I.token_lines(spark, f"file://{tmp_path}/in").count() == 3


def test_bucketed_tables_join_without_a_shuffle(spark):
    long = sets(spark, {"a": ["x", "y"], "b": ["y"]})
    I.write_bucketed(long, "bucketed_positions", 4)
    try:
        t = spark.table("bucketed_positions")
        j = t.hint("merge").join(t.select("reg", "zeros", F.col("set_id").alias("other")), ["reg", "zeros"])
        assert "Exchange hashpartitioning" not in j._jdf.queryExecution().executedPlan().toString() and j.count() == 5
    finally:
        spark.sql("DROP TABLE bucketed_positions")


def test_scans_and_removal(spark, tmp_path):
    entries = spark.createDataFrame([("a",), ("b",)], "id string")
    assert [r["id"] for r in X.remove(entries, entries.where("id = 'a'")).collect()] == ["b"]
    found = {r["id"]: r["found"] for r in X.exist(entries, spark.createDataFrame([("a",), ("c",)], "id string")).collect()}
    assert found == {"a": True, "c": False}


def test_restored_order_equals_its_sql_where_trigrams_repeat_or_collide(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    shared = "".join(f"{a}{b} " for a in "abcdefgh" for b in "abcdefgh")
    texts = ["a b c a b c a b d", "", " x ", None, "x y x y x z x y", shared * 2, *(" ".join(f"w{i * 7 + j * j % 13}" for j in range(40)) for i in range(60))]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["item_id"]: (r["sequence"], r["is_eulerian"]) for r in entry.queries()["q_restore_order"](spark, str(tmp_path)).collect()}
    db = duckdb.connect()
    db.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{tmp_path}/benchmark.parquet/*.parquet'")
    want = {r[0]: r[1:] for r in db.execute(entry.oracle_sql()["q_restore_order"]).fetchall()}
    assert got == want and len(got) == len(texts) - 1 and got[0][0] != texts[0]
