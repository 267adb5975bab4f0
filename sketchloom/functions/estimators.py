"""Estimates from per-bit register counts, ratios of estimates, verdicts."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the HyperLogLog estimator.
ALPHA = {16: 0.673, 32: 0.697, 64: 0.709}
ALPHA_LARGE = 0.7213 / (1 + 1.079 / 65536)


def ht_aggregates(m: int, c: str = "c", zeros: str = "zeros", name: str = "ht") -> list[Column]:
    """Aggregates over rows (zeros, c) of one set, from which ``ht_estimate`` is made."""
    z, n = F.col(zeros), F.col(c)
    some, full = (n > 0) & (n < m), n >= m
    return [
        F.sum(F.when(some, -m * F.log(1 - n / F.lit(float(m)))).otherwise(0.0)).alias(f"{name}_sum"),
        F.min(F.when(some, z)).alias(f"{name}_k"),
        F.min_by(F.when(some, n), F.when(some, z)).alias(f"{name}_ck"),
        F.sum(F.when(full, F.pow(F.lit(2.0), -z)).otherwise(0.0)).alias(f"{name}_full"),
        F.sum(full.cast("long")).alias(f"{name}_n_full"),
    ]


def ht_estimate(m: int, name: str = "ht") -> Column:
    """Rounded number of distinct tokens.

    A bit set in c of m registers stands for -m ln(1 - c/m) tokens.  A bit set
    in all registers is extrapolated from the lowest bit that is not.
    """
    c = lambda x: F.col(f"{name}_{x}")
    lowest = -m * F.log(1 - c("ck") / F.lit(float(m))) * F.pow(F.lit(2.0), c("k"))
    full = F.when(c("n_full") == 0, 0.0).when(c("k").isNotNull(), lowest * c("full")).otherwise(c("n_full") * (m * math.log(m)))
    return F.greatest(F.lit(0.0), F.round(c("sum") + full))


def ht_array(c: np.ndarray, m: int) -> np.ndarray:
    """``ht_estimate`` of counts whose last axis is the bit."""
    c = c.astype(np.float64)
    z = 2.0 ** np.arange(c.shape[-1])
    some, full = (c > 0) & (c < m), c >= m
    part = -m * np.log1p(-np.where(some, c, 0) / m)
    lowest = np.take_along_axis(part * z, some.argmax(axis=-1)[..., None], -1)[..., 0]
    extra = np.where(some.any(axis=-1), lowest * (full / z).sum(axis=-1), full.sum(axis=-1) * (m * math.log(m)))
    return np.maximum(0.0, np.floor(part.sum(axis=-1) + extra + 0.5))


def alpha(m: int) -> float:
    return ALPHA.get(m, ALPHA_LARGE)


def bias_table(p: int, steps: int = 160) -> list[tuple[float, float]]:
    """(raw estimate, bias) for set sizes from 0 to 5 m.

    The expected sum over the registers follows from the distribution of each
    register's largest observation, n tokens falling on m registers at random.
    """
    m = 2**p
    out = []
    for i in range(steps):
        n = 5 * m * i / (steps - 1)
        at_most = [math.exp(-n / m * 2.0**-k) for k in range(0, 64)]
        total = at_most[0] + sum(2.0**-k * (at_most[k] - at_most[k - 1]) for k in range(1, 64))
        raw = alpha(m) * m / total
        out.append((round(raw, 4), round(raw - n, 4)))
    return out


def hll_estimate(raw: Column, empty: Column, bias: Column, m: int) -> Column:
    """Raw estimate, corrected: linear counting while registers are empty, else minus the bias."""
    return (
        F.when(empty == m, 0.0)
        .when((empty > 0) & (raw <= 2.5 * m), F.greatest(F.lit(0.0), F.round(m * F.log(F.lit(float(m)) / empty))))
        .otherwise(F.greatest(F.lit(0.0), F.round(raw - bias - 1)))
    )


def ratio(a: Column, b: Column, otherwise: float = 0.0) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(otherwise))


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def tau(both: Column, target: Column) -> Column:
    """Share of the target that the source covers."""
    return F.when(target > 0, clamp(both / target)).otherwise(0.0)


def rho(rest: Column, target: Column) -> Column:
    """What the source has beyond, relative to the target."""
    return F.when(target > 0, clamp(rest / target)).otherwise(1.0)


def transition_kind(deleted: Column, retained: Column, novel: Column) -> Column:
    """stable, replacement, growth or decay."""
    total = deleted + retained + novel
    return (
        F.when(total == 0, "stable")
        .when(retained < (deleted + novel) / 2, "replacement")
        .when(F.abs(novel - deleted) / F.greatest(total, F.lit(1.0)) < 0.1, "stable")
        .when(novel > deleted, "growth")
        .otherwise("decay")
    )


def phase(n: Column, mean_abs: Column, drift: Column, variance: Column) -> Column:
    """Phase of a series of fluxes so far."""
    return (
        F.when(n < 3, "balanced").when(mean_abs < 0.5, "balanced").when(drift > 1, "growth").when(drift < -1, "decay")
        .when(variance > 2 * mean_abs, "volatile").otherwise("balanced")
    )
