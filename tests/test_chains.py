"""Chains as tables against their dense matrices."""

import math

import numpy as np
import pytest

from sketchloom.operators import markov as K


def chain(spark, m, names=None):
    names = names or [f"s{i:03d}" for i in range(len(m))]
    return spark.createDataFrame([(names[i], names[j], float(m[i][j])) for i in range(len(m)) for j in range(len(m))], "i string, j string, p double")


def made(seed, n, sparse=0.5):
    rng = np.random.default_rng(seed)
    m = rng.random((n, n)) * (rng.random((n, n)) < sparse)
    m[np.arange(n), (np.arange(n) + 1) % n] += 0.1
    return m / m.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("n", [5, 40])
def test_hitting_times_by_products(spark, n):
    m = made(n, n)
    t = chain(spark, m)
    far, near = K.hitting_of(t, "s002", dense_most=0), K.hitting_of(t, "s002")
    assert list(far) == list(near) and np.allclose(list(far.values()), list(near.values()), rtol=1e-8)
    assert np.allclose(list(near.values()), K.hitting_times(m, 2))


def test_hitting_times_where_a_way_may_end_elsewhere(spark):
    # 0 -> 1 -> target; 3 may end in 4, which never leaves; 4 never comes; a state without steps never comes either
    m = np.array([[0, 1, 0, 0, 0, 0], [0.5, 0, 0.5, 0, 0, 0], [0, 0, 0, 1, 0, 0], [0.5, 0, 0, 0, 0.5, 0], [0, 0, 0, 0, 1, 0], [0, 0, 0, 0, 0, 0]])
    times = K.hitting_of(chain(spark, m), "s002", dense_most=0)
    assert times == pytest.approx({"s000": 4, "s001": 3, "s002": 0, "s003": math.inf, "s004": math.inf, "s005": math.inf})


def test_entropy_and_walk(spark):
    m = made(3, 12)
    t = chain(spark, m)
    rate, most, _ = K.entropy_rate(m)
    assert K.entropy_of(t).first()[:] == pytest.approx((rate, most), abs=1e-7)
    assert K.walk_of(t, "s000", 8) == [f"s{i:03d}" for i in K.likeliest_path(m, 0, 8)]
    assert len(K.walk_of(t, "s000", 99)) <= 12


def test_classes_and_periods(spark):
    n = 14
    m = np.zeros((n, n))
    for a, b in [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 3), (4, 5), (5, 6), (6, 7), (7, 8), (8, 5), (7, 5), (9, 9), (10, 11), (11, 10), (10, 12), (12, 10), (13, 0)]:
        m[a, b] = 1
    m /= np.maximum(m.sum(axis=1, keepdims=True), 1)
    t = chain(spark, m)
    found = K.class_table(t)
    got = {}
    for r in found.collect():
        got.setdefault(r["member_of"], set()).add(int(r["node"][1:]))
    want = {f"s{c[0]:03d}": set(c) for c in K.classes(m)}
    assert got == want
    assert {r["member_of"]: (r["members"], r["period"]) for r in K.periods(t, found).collect()} == {k: (len(v), K.period(m, sorted(v))) for k, v in want.items()}


def test_a_solution_that_does_not_exist_is_an_error():
    with pytest.raises((ArithmeticError, ZeroDivisionError)):
        K.solved(lambda x: np.array([x[0] + x[1], x[0] + x[1]]), np.array([1.0, 2.0]), most=20)
