"""Roaring bitmaps against sets of positions and the dense form."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from sketchloom.functions import roaring as R
from sketchloom.operators import roaring as RB
from sketchloom.operators import sketch as S


def made(rng, p, kind):
    size = 2**p * 32
    if kind == "sparse":
        at = rng.sample(range(size), 50)
    elif kind == "dense":
        at = [i for i in range(size) if rng.random() < 0.4]
    elif kind == "runs":
        at = {i for _ in range(8) for s in [rng.randrange(size)] for i in range(s, min(size, s + 3000))}
    elif kind == "mixed":
        at = {*range(min(size, 70_000)), *rng.sample(range(size), 900)}
    else:
        at = []
    return np.array(sorted(at), dtype=np.uint32)


KINDS = ["sparse", "dense", "runs", "mixed", "empty"]


@pytest.mark.parametrize("p", [8, 10, 12, 14])
def test_operations_equal_those_of_sets(p):
    rng = random.Random(p)
    sets = {k: made(rng, p, k) for k in KINDS}
    bitmaps = {k: R.from_positions(v) for k, v in sets.items()}
    size = 2**p * 4
    for k, v in sets.items():
        r = bitmaps[k]
        assert R.positions(r).tolist() == v.tolist() and R.count(r) == len(v)
        back = R.loads(R.dumps(r))
        assert R.positions(back).tolist() == v.tolist() and [c[0] for c in back.values()] == [c[0] for c in r.values()]
        packed = R.to_dense(r, size)
        assert len(packed) == size and np.flatnonzero(np.unpackbits(np.frombuffer(packed, np.uint8), bitorder="little")).tolist() == v.tolist()
        assert R.dumps(R.from_dense(packed)) == R.dumps(r)
        assert R.zeros_counts(r).tolist() == np.bincount(v & 31, minlength=32).tolist()
    for a in KINDS:
        for b in KINDS:
            x, y = set(sets[a].tolist()), set(sets[b].tolist())
            r, q = bitmaps[a], bitmaps[b]
            for op, want in ((R.union, x | y), (R.intersection, x & y), (R.difference, x - y), (R.symmetric_difference, x ^ y)):
                got = op(r, q)
                assert R.positions(got).tolist() == sorted(want), (a, b, op.__name__)
                assert R.dumps(got) == R.dumps(R.from_positions(np.array(sorted(want), dtype=np.uint32)))  # one form for one set
            assert R.shared(r, q) == len(x & y)


def test_containers_have_the_smallest_form():
    form = lambda at: R.from_positions(np.array(at, dtype=np.uint32))[0][0]
    assert form([1, 5, 9]) == R.ARRAY and form(range(100)) == R.RUNS and form(range(0, 60_000, 2)) == R.BITMAP
    assert form(range(0, 8192, 2)) == R.ARRAY and form(range(0, 8194, 2)) == R.BITMAP
    assert form([7]) == R.ARRAY and form([7, 8, 9]) == R.ARRAY and form([7, 8, 9, 10]) == R.RUNS


def test_bytes_of_the_portable_format():
    """Spelled out from the format's description."""
    assert R.dumps({}) == struct.pack("<II", 12346, 0)
    assert R.dumps(R.from_positions(np.array([3, 65536 + 7]))) == struct.pack("<II", 12346, 2) + struct.pack("<HHHH", 0, 0, 1, 0) + struct.pack("<II", 24, 26) + struct.pack("<HH", 3, 7)
    assert R.dumps(R.from_positions(np.arange(10, 30))) == struct.pack("<I", 12347) + b"\x01" + struct.pack("<HH", 0, 19) + struct.pack("<HHH", 1, 10, 19)
    full = R.dumps(R.from_positions(np.concatenate([np.arange(k << 16, (k << 16) + 50) for k in range(5)])))
    assert struct.unpack_from("<I", full) == (12347 | 4 << 16,) and full[4] == 0b11111
    assert struct.unpack_from("<5I", full, 5 + 20) == tuple(45 + 6 * i for i in range(5))
    for bad in (b"", b"\x00" * 8, R.dumps(R.from_positions(np.array([3]))) + b"x"):
        with pytest.raises(ValueError):
            R.loads(bad)
    with pytest.raises(ValueError):
        R.to_dense(R.from_positions(np.array([40_000])), 4096)


def tokens(spark, n=4000):
    rows = [(f"s{i % 3}", i % 2, f"t{(i * 7919) % (50 if i % 3 == 0 else 900 if i % 3 == 1 else n)}") for i in range(n)]
    return spark.createDataFrame(rows, "set_id string, part int, token string")


@pytest.mark.parametrize("p", [8, 10, 12])
def test_bitmaps_of_sketches(spark, p):
    long = S.long_form(tokens(spark), "token", "set_id", p=p)
    r = RB.from_long(long, "set_id").cache()
    packed = S.pack(long, "set_id", p=p)
    assert {x["set_id"]: bytes(x["roaring"]) for x in r.collect()} == {x["set_id"]: bytes(x["r"]) for x in packed.select("set_id", RB.compressed(F.col("bitmap")).alias("r")).collect()}
    assert {x["set_id"]: bytes(x["b"]) for x in r.select("set_id", RB.dense(F.col("roaring"), p).alias("b")).collect()} == {x["set_id"]: bytes(x["bitmap"]) for x in packed.collect()}
    assert sorted(map(tuple, RB.to_long(r, "set_id").collect())) == sorted(map(tuple, long.collect()))
    assert sorted(map(tuple, RB.cardinality(r, "set_id", p=p).collect())) == sorted(map(tuple, S.cardinality(long, "set_id", p=p).collect()))
    sizes = {x["set_id"]: x for x in RB.sizes(r, "set_id", p=p).collect()}
    assert all(x["bits"] == long.where(F.col("set_id") == k).count() and x["dense_bytes"] == 2**p * 4 for k, x in sizes.items())
    assert sizes["s0"]["roaring_bytes"] < 150 and sizes["s0"]["arrays"] == max(1, 2**p * 32 >> 16)


def test_merging_of_many_rows_and_pairs(spark):
    parts = RB.from_long(S.long_form(tokens(spark), "token", "set_id", "part"), "set_id", "part").cache()
    rows = parts.unionByName(parts).unionByName(parts.select("set_id", "part", F.lit(None).cast("binary").alias("roaring"))).repartition(5)
    whole = {x["set_id"]: bytes(x["roaring"]) for x in RB.from_long(S.long_form(tokens(spark), "token", "set_id"), "set_id").collect()}
    assert {x["set_id"]: bytes(x["roaring"]) for x in RB.merge(rows, "set_id").collect()} == whole
    a, b = (parts.where(F.col("part") == i).select("set_id", F.col("roaring").alias(f"r{i}")) for i in (0, 1))
    x, y = F.col("r0"), F.col("r1")
    got = a.join(b, "set_id").select(
        "set_id", RB.union(x, y).alias("u"), RB.intersection(x, y).alias("i"), RB.difference(x, y).alias("d"), RB.symmetric_difference(x, y).alias("s"),
        RB.shared(x, y).alias("n"), RB.count(x).alias("n0"), RB.count(y).alias("n1"),
    ).collect()
    met = {r["set_id"]: bytes(r["roaring"]) for r in RB.meet_all(rows, "set_id").collect()}
    assert len(got) == 3
    for r in got:
        u, i, d, s = (R.count(R.loads(bytes(r[c]))) for c in "uids")
        assert bytes(r["u"]) == whole[r["set_id"]] and bytes(r["i"]) == met[r["set_id"]]
        assert (i, d, s, u) == (r["n"], r["n0"] - r["n"], r["n0"] + r["n1"] - 2 * r["n"], r["n0"] + r["n1"] - r["n"])


def test_empty_and_null_bitmaps(spark):
    long = S.long_form(spark.createDataFrame([], "set_id string, token string"), "token", "set_id")
    assert RB.from_long(long, "set_id").count() == 0 and RB.merge(RB.from_long(long, "set_id"), "set_id").count() == 0
    df = spark.createDataFrame([("a", None), ("b", bytearray(R.dumps({})))], "set_id string, roaring binary")
    assert [tuple(r) for r in df.select("set_id", RB.count(F.col("roaring")), RB.shared(F.col("roaring"), F.col("roaring"))).orderBy("set_id").collect()] == [("a", None, None), ("b", 0, 0)]
    assert [r["set_id"] for r in RB.merge(df, "set_id").collect()] == ["b"]
