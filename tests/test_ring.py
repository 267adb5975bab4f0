"""Decomposition by stretches against elimination of one vector after the other."""

import random

import pytest
from pyspark.sql import functions as F

from sketchloom.operators import ring as G


def made(seed, n, positions, copies=0):
    """(ring, key, order, bits): rings of different rank, with sums of vectors, repeats and empty vectors."""
    rng = random.Random(seed)
    rows = []
    for ring, width in (("a", positions), ("b", 5), ("c", 3)):
        for i in range(n if ring == "a" else n // 3):
            bits = sorted(rng.sample(range(width), rng.randint(0, min(width, 4))))
            rows.append((ring, f"{ring}{i:04d}", rng.randrange(n // 2), bits))
    rows += [("hot", f"h{i:04d}", i, [1, 2, 3] if i % 2 else [2]) for i in range(copies)]
    return rows


def brute(rows):
    out = {}
    for ring in {r[0] for r in rows}:
        basis, names, seen = G.Basis(), [], []
        for _, key, _, bits in sorted((r for r in rows if r[0] == ring), key=lambda r: (r[2], r[1])):
            new, used = basis.add(G.as_int(bits), len(names))
            if new:
                names.append(key)
            out[key] = (ring, new, basis.rank(), [n for i, n in enumerate(names) if used >> i & 1])
            seen.append(key)
    return out


SCHEMA = "ring string, key string, o long, bits array<int>"


@pytest.mark.parametrize("per_task", [2000, 40, 7])
def test_stretches_give_what_one_pass_gives(spark, per_task):
    rows = made(1, 120, 60, copies=50)
    random.Random(0).shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r["key"]: (r["ring"], r["is_base"], r["rank"], r["expression"]) for r in G.decompose(df, "ring", "key", "o", per_task).collect()}
    assert got == brute(rows)
    # the expressions give the vectors back
    bits = {r[1]: set(r[3]) for r in rows}
    for key, (_, _, _, names) in got.items():
        total = set()
        for n in names:
            total ^= bits[n]
        assert total == bits[key]


@pytest.mark.parametrize("per_task", [2000, 3])
def test_vectors_of_one_key_and_order(spark, per_task):
    rows = [("r", "same", 1, [1])] * 4 + [("r", "next", 1, [2]), ("r", "sum", 2, [1, 2]), ("r", "none", 0, [])]
    got = G.decompose(spark.createDataFrame(rows, SCHEMA), "ring", "key", "o", per_task)
    assert got.where("is_base").count() == 2 and got.agg(F.max("rank")).first()[0] == 2
    assert got.where("key = 'sum'").first()["expression"] == ["next", "same"] and got.where("key = 'none'").first()[2:] == (False, 0, [])
    assert G.decompose(spark.createDataFrame([], SCHEMA), "ring", "key", "o", per_task).count() == 0


def test_reconstruction_of_expressions(spark):
    rows = made(5, 60, 30)
    df = spark.createDataFrame(rows, SCHEMA)
    back = G.reconstruct(G.decompose(df, "ring", "key", "o", 16), df, "key")
    want = {(r[1], b) for r in rows for b in r[3]}
    assert {tuple(r) for r in back.collect()} == want
    rank = {r["ring"]: r["rank"] for r in G.stats(G.decompose(df, "ring", "key", "o", 16), "ring").collect()}
    found = brute(rows)
    assert rank == {ring: sum(new for r, new, _, _ in found.values() if r == ring) for ring in rank}
