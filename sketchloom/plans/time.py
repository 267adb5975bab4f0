"""Timelines of the events' users."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing as H
from ..operators import pairs as P
from ..operators.patterns import cheapest_paths
from ..operators import sketch as S
from ..operators import timeline as L
from ..operators import tokens as K
from ..sources import tables as T
from . import oracle as O
from .registry import DAY_TYPE_USERS, DAY_USERS, query

_DAYS = O.long_cte(DAY_USERS, "day")


def _long(spark, sf_dir):
    return S.long_form(T.day_users(spark, sf_dir), "token", "day")


@query(f"""WITH {_DAYS}, {O.cards_cte('lf', 'day')}, s AS (SELECT day, count(*) AS popcount FROM lf GROUP BY day)
SELECT day, card, popcount, lag(day) OVER (ORDER BY day) AS before FROM card JOIN s USING (day)""")
def q_timeline(spark, sf_dir):
    n = L.nodes(T.day_users(spark, sf_dir), "token", "day")
    return n.select("day", "card", "popcount", F.col("parent_time").alias("before"))


@query(f"""WITH {_DAYS}, f AS (SELECT reg, zeros, min(day) AS day FROM lf GROUP BY ALL), d AS (SELECT DISTINCT day FROM lf),
g AS (SELECT d.day, z.range AS zeros, count(f.reg) AS n FROM d CROSS JOIN range({H.BITS}) z LEFT JOIN f ON f.day = d.day AND f.zeros = z.range GROUP BY ALL),
c AS (SELECT day, zeros, n, sum(n) OVER (PARTITION BY zeros ORDER BY day)::BIGINT AS c FROM g), {O.card_cte('c', 'day')}
SELECT day, card, sum(c)::BIGINT AS popcount, sum(n)::BIGINT AS novel FROM c JOIN card USING (day) GROUP BY day, card""")
def q_cumulative(spark, sf_dir):
    return L.cumulative(_long(spark, sf_dir), "day")


@query(f"""WITH {_DAYS}, f AS (SELECT reg, zeros, min(day) AS seen FROM lf GROUP BY ALL), x AS (SELECT reg, zeros FROM f WHERE seen > '2024-01-05' AND seen <= '2024-01-20'), {O.cards_cte('x', '')}
SELECT card FROM card""")
def q_delta(spark, sf_dir):
    return S.cardinality(L.delta(_long(spark, sf_dir), "day", "2024-01-05", "2024-01-20"))


_KIND = """CASE WHEN deleted+retained+novel = 0 THEN 'stable' WHEN retained < (deleted+novel)/2 THEN 'replacement'
WHEN abs(novel-deleted)/greatest(deleted+retained+novel, 1.0) < 0.1 THEN 'stable' WHEN novel > deleted THEN 'growth' ELSE 'decay' END"""
_TRANSITIONS = f"""WITH {_DAYS}, st AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS step FROM (SELECT DISTINCT day FROM lf)),
h AS (SELECT step, reg, zeros FROM lf JOIN st USING (day)),
mk AS (SELECT step, reg, zeros, sum(w) AS w FROM (SELECT step, reg, zeros, 1 AS w FROM h UNION ALL SELECT step+1, reg, zeros, 2 FROM h) GROUP BY ALL),
n AS (SELECT step, zeros, count(*) FILTER (w = 2) AS d, count(*) FILTER (w = 3) AS r, count(*) FILTER (w = 1) AS n FROM mk WHERE step > 0 AND step < (SELECT count(*) FROM st) GROUP BY ALL),
n2 AS (SELECT *, r+n AS cur, r+d AS prev FROM n),
{O.card_cte('n2', 'step', 'c1', 'deleted', 'd')}, {O.card_cte('n2', 'step', 'c2', 'retained', 'r')}, {O.card_cte('n2', 'step', 'c3', 'novel', 'n')}, {O.card_cte('n2', 'step', 'c4', 'card', 'cur')}, {O.card_cte('n2', 'step', 'c5', 'card_before', 'prev')},
bits AS (SELECT step, sum(d)::BIGINT AS bits_deleted, sum(r)::BIGINT AS bits_retained, sum(n)::BIGINT AS bits_novel FROM n2 GROUP BY step),
t AS (SELECT step, st.day, b.day AS before, deleted, retained, novel, card, card_before, bits_deleted, bits_retained, bits_novel, {_KIND} AS kind, novel-deleted AS flux, novel+deleted AS cost
FROM c1 JOIN c2 USING (step) JOIN c3 USING (step) JOIN c4 USING (step) JOIN c5 USING (step) JOIN bits USING (step) JOIN st USING (step) JOIN st b ON b.step = c1.step - 1)"""


def _transitions(spark, sf_dir):
    return L.transitions(_long(spark, sf_dir), "day")


@query(f"{_TRANSITIONS} SELECT day, before, deleted, retained, novel, card, bits_deleted, bits_retained, bits_novel, abs(card - (retained + novel)) < 2 AS reconstructs FROM t")
def q_drn(spark, sf_dir):
    t = L.reconstructs(_transitions(spark, sf_dir))
    return t.select("day", "before", "deleted", "retained", "novel", "card", "bits_deleted", "bits_retained", "bits_novel", "reconstructs")


@query(f"{_TRANSITIONS} SELECT day, kind, flux, cost, abs(novel-deleted)/greatest(novel, deleted, 1.0) < 0.05 AS is_balanced FROM t")
def q_phase(spark, sf_dir):
    balanced = F.abs(F.col("novel") - F.col("deleted")) / F.greatest("novel", "deleted", F.lit(1.0)) < 0.05
    return _transitions(spark, sf_dir).select("day", "kind", "flux", "cost", balanced.alias("is_balanced"))


@query(f"""{_TRANSITIONS}, z AS (SELECT *, CASE WHEN card_before > 0 THEN retained/card_before ELSE 0.0 END AS retention FROM t)
SELECT day, flux, sum(flux) OVER (ORDER BY day) AS cumulative_flux, retention,
list_filter([CASE WHEN abs(flux) > 10 THEN 'HIGH_FLUX' END, CASE WHEN retention < 0.3 THEN 'LOW_RETENTION' END, CASE WHEN kind = 'replacement' THEN 'REPLACEMENT' END], lambda x: x IS NOT NULL) AS anomalies FROM z""")
def q_monitor(spark, sf_dir):
    from pyspark.sql import Window as W

    t = L.anomalies(_transitions(spark, sf_dir), flux=10.0)
    return t.select("day", "flux", F.sum("flux").over(W.orderBy("day")).alias("cumulative_flux"), "retention", "anomalies")


@query(f"{_TRANSITIONS} SELECT day, before, CASE WHEN deleted < 1 AND novel < 1 THEN 'a = b' WHEN deleted < 1 THEN 'a ⊆ b' WHEN novel < 1 THEN 'b ⊆ a' ELSE 'a ∥ b' END AS relation FROM t")
def q_compare_nodes(spark, sf_dir):
    return L.compare(_transitions(spark, sf_dir)).select("day", "before", "relation")


_NOETHER = f"""WITH {O.long_cte(DAY_TYPE_USERS, 'day, event_type')},
a AS (SELECT DISTINCT day, reg, zeros FROM lf WHERE event_type IN ('signup', 'click')), d AS (SELECT DISTINCT day, reg, zeros FROM lf WHERE event_type = 'error'),
l AS (SELECT day, reg, zeros, max(up) AS up FROM (SELECT *, 1 AS up FROM a UNION ALL SELECT *, 0 FROM d) GROUP BY ALL),
x AS (SELECT day, zeros, up - coalesce(lag(up) OVER (PARTITION BY reg, zeros ORDER BY day), 0) AS diff FROM l), st AS (SELECT DISTINCT day FROM l),
g AS (SELECT st.day, z.range AS zeros, coalesce(sum(diff), 0) AS diff FROM st CROSS JOIN range({H.BITS}) z LEFT JOIN x ON x.day = st.day AND x.zeros = z.range GROUP BY ALL),
c AS (SELECT day, zeros, sum(diff) OVER (PARTITION BY zeros ORDER BY day)::BIGINT AS c FROM g), {O.card_cte('c', 'day')}, {O.cards_cte('a', 'day', 'na', 'added')}, {O.cards_cte('d', 'day', 'nd', 'deleted')},
r AS (SELECT day, coalesce(added, 0.0) AS added, coalesce(deleted, 0.0) AS deleted, coalesce(added, 0) - coalesce(deleted, 0) AS flux, card.card, popcount FROM st LEFT JOIN na USING (day) LEFT JOIN nd USING (day) JOIN card USING (day) JOIN (SELECT day, sum(c)::BIGINT AS popcount FROM c GROUP BY day) USING (day)),
w AS (SELECT *, sum(flux) OVER (ORDER BY day) AS cumulative_flux, avg(flux) OVER s AS drift, count(flux) OVER s AS k, avg(abs(flux)) OVER s AS ma, var_pop(flux) OVER s AS vp FROM r WINDOW s AS (ORDER BY day ROWS {L.DRIFT_ROWS - 1} PRECEDING)),
b AS (SELECT day, added, deleted, flux, card, popcount, cumulative_flux, drift, CASE WHEN k < 3 THEN 'balanced' WHEN ma < 0.5 THEN 'balanced' WHEN drift > 1 THEN 'growth' WHEN drift < -1 THEN 'decay' WHEN vp > 2*ma THEN 'volatile' ELSE 'balanced' END AS phase, abs(popcount - cumulative_flux) AS conservation_error FROM w)"""


def _noether(spark, sf_dir):
    e = T.day_users(spark, sf_dir, "event_type")
    added = S.long_form(e.where("event_type IN ('signup', 'click')"), "token", "day")
    removed = S.long_form(e.where("event_type = 'error'"), "token", "day")
    return L.noether(added, removed, "day")


@query(f"{_NOETHER} SELECT day, added, deleted, flux, card, popcount, cumulative_flux, round(drift, 6) AS drift, phase, conservation_error FROM b")
def q_noether(spark, sf_dir):
    columns = ("day", "added", "deleted", "flux", "card", "popcount", "cumulative_flux")
    return _noether(spark, sf_dir).select(*columns, F.round("drift", 6).alias("drift"), "phase", "conservation_error")


@query(f"""{_NOETHER}, i AS (SELECT flux, row_number() OVER (ORDER BY day) - 1 AS i FROM b)
SELECT count(flux) AS count, round(avg(flux), 6) AS mean, round(stddev_pop(flux), 6) AS std, min(flux) AS min, max(flux) AS max, round(regr_slope(flux, i), 6) AS trend FROM i""")
def q_flux_statistics(spark, sf_dir):
    s = L.flux_statistics(_noether(spark, sf_dir), "day")
    return s.select("count", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "min", "max", F.round("trend", 6).alias("trend"))


@query(f"""{_NOETHER} SELECT day, popcount, cumulative_flux, conservation_error, card/{O.M * 32}.0::DOUBLE AS density, card/{O.M * 32}.0::DOUBLE*card AS collision_estimate,
conservation_error <= greatest(1.0, card/{O.M * 32}.0::DOUBLE*card*2) AS is_conserved FROM b ORDER BY day DESC LIMIT 1""")
def q_conservation(spark, sf_dir):
    return L.conservation(_noether(spark, sf_dir), "day")


@query(f"""{_TRANSITIONS}, s AS (SELECT day, count(*) AS popcount FROM lf GROUP BY day), k AS (SELECT bits_deleted+bits_novel AS cost FROM t),
w AS (SELECT count(*) AS length, count(DISTINCT popcount) AS unique_signatures, avg(popcount)/{O.M * 32} AS density FROM s)
SELECT length, unique_signatures, round(density, 9) AS density, round(avg(cost), 6) AS avg_cost, max(cost) AS max_cost, min(cost) AS min_cost, sum(cost)::BIGINT AS bits_changed,
round(sum(cost)/(count(cost)*{O.M * 32}), 9) AS mixing_rate, round(avg(ln(greatest(cost, 1))), 6) AS lyapunov,
round(-(density*log2(density) + (1-density)*log2(1-density)), 6) AS entropy FROM w CROSS JOIN k GROUP BY length, unique_signatures, density""")
def q_bernoulli(spark, sf_dir):
    b = L.bernoulli(_long(spark, sf_dir), "day")
    r = lambda c, n=6: F.round(c, n).alias(c)
    return b.select("length", "unique_signatures", r("density", 9), r("avg_cost"), "max_cost", "min_cost", "bits_changed", r("mixing_rate", 9), r("lyapunov"), r("entropy"))


@query(f"""WITH {_DAYS}, st AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS step FROM (SELECT DISTINCT day FROM lf)), h AS (SELECT step::INT AS step, reg, zeros FROM lf JOIN st USING (day)),
f AS (SELECT reg, zeros FROM h WHERE step = 0)
SELECT h.step, (count(*) + (SELECT count(*) FROM f) - 2*count(f.reg))/{O.M * 32}.0::DOUBLE AS distance FROM h LEFT JOIN f USING (reg, zeros) WHERE step > 0 GROUP BY h.step HAVING distance < 0.1""")
def q_recurrence(spark, sf_dir):
    return L.recurrence(_long(spark, sf_dir), "day")


@query(f"""WITH {_DAYS}, {O.pairs_cte('lf', key='day')}, d AS (SELECT a, b, {O.TAU} AS tau, {O.RHO} AS rho FROM ps) SELECT a, b, tau, rho FROM d WHERE a <> b AND tau >= 0.2 AND rho <= 0.8""")
def q_state_graph(spark, sf_dir):
    """Edges between days' states under the thresholds for evolution paths."""
    return _state_edges(spark, sf_dir)


def _state_edges(spark, sf_dir):
    d = P.directed(P.overlaps(_long(spark, sf_dir), key="day", disjoint=False))
    return d.where("a <> b AND tau >= 0.2 AND rho <= 0.8").select("a", "b", "tau", "rho")


_STATE_EDGES = f"WITH RECURSIVE {_DAYS}, {O.pairs_cte('lf', key='day')}, e AS (SELECT a, b, {O.TAU} AS tau, card_a_not_b + card_b_not_a AS cost, {O.RHO} AS rho FROM ps WHERE a <> b)"


@query(f"""{_STATE_EDGES}, w AS (SELECT a, b, tau FROM e WHERE tau >= 0.2 AND rho <= 0.8),
s AS (SELECT n FROM (SELECT a AS n, 1 AS d FROM w UNION ALL SELECT b, -1 FROM w) GROUP BY n ORDER BY sum(d) DESC, n LIMIT 1),
r(place, day, seen) AS (SELECT 0, n, [n] FROM s UNION ALL SELECT place + 1, b.b, list_append(seen, b.b) FROM r CROSS JOIN LATERAL (SELECT b FROM w WHERE w.a = r.day AND NOT list_contains(r.seen, b) ORDER BY tau DESC, b LIMIT 1) b)
SELECT place, day FROM r""")
def q_evolution_path(spark, sf_dir):
    path = L.evolution_path(_state_edges(spark, sf_dir))
    return spark.createDataFrame([(i, d) for i, d in enumerate(path)], "place int, day string")


@query(f"""{_STATE_EDGES}, w AS (SELECT a, b, cost FROM e WHERE tau >= 0.1), ends AS (SELECT min(a) AS first, max(a) AS last FROM w),
g(node, cost, path) USING KEY (node) AS (SELECT first, 0.0::DOUBLE, [first] FROM ends UNION (SELECT b, min(c), arg_min(n.path, (c, len(n.path), n.path)) FROM (
  SELECT w.b, g.cost + w.cost AS c, list_append(g.path, w.b) AS path FROM g JOIN w ON w.a = g.node) n LEFT JOIN recurring.g AS o ON o.node = n.b WHERE o.node IS NULL OR (c, len(n.path), n.path) < (o.cost, len(o.path), o.path) GROUP BY b)),
x AS (SELECT path FROM g JOIN ends ON node = last) SELECT (i - 1)::INT AS place, path[i] AS day FROM (SELECT path, unnest(range(1, len(path) + 1)) AS i FROM x)""")
def q_cheapest_path(spark, sf_dir):
    """Transitions of the least total cost between the first and the last day."""
    pairs = P.directed(P.overlaps(_long(spark, sf_dir), key="day", disjoint=False)).where("a <> b AND tau >= 0.1")
    edges = T.written(pairs.select("a", "b", (F.col("card_a_not_b") + F.col("card_b_not_a")).alias("cost")))
    ends = edges.agg(F.min("a").alias("first"), F.max("a").alias("last"))
    found = cheapest_paths(edges, ends.select(F.col("first").alias("node")), ends.select(F.col("last").alias("node")))
    return found.select(F.posexplode("path").alias("place", "day"))


@query(f"""WITH {_DAYS}, {O.pairs_cte('lf', key='day')}, d AS (SELECT *, {O.TAU} AS tau, {O.RHO} AS rho FROM ps WHERE a <> b), z AS (SELECT *, tau >= 0.95 AND rho < 0.1 AS at_target FROM d)
SELECT a, b, tau, rho, at_target, CASE WHEN at_target THEN 0.0 ELSE card_a_not_b + card_b_not_a END AS direct, CASE WHEN at_target THEN 0.0 ELSE least(card_a_not_b + card_b_not_a, card_a*0.2::DOUBLE) END AS incremental, CASE WHEN at_target THEN 0.0 ELSE card_b_not_a END AS conservative FROM z""")
def q_steering(spark, sf_dir):
    return L.steering(P.overlaps(_long(spark, sf_dir), key="day").where("a <> b"))


@query(f"""WITH {_DAYS}, ends AS (SELECT min(day) AS a, max(day) AS b FROM lf), x AS (SELECT reg, zeros FROM lf JOIN ends ON day = a), y AS (SELECT reg, zeros FROM lf JOIN ends ON day = b),
c AS (SELECT coalesce(x.reg, y.reg) AS reg, coalesce(x.zeros, y.zeros) AS zeros, CASE WHEN y.reg IS NULL THEN 'deleted' WHEN x.reg IS NULL THEN 'novel' ELSE 'retained' END AS component FROM x FULL JOIN y ON x.reg = y.reg AND x.zeros = y.zeros)
SELECT DISTINCT component, token FROM c JOIN p USING (reg, zeros)""")
def q_drn_tokens(spark, sf_dir):
    """Users that went, stayed and came between the first and the last day, out of the token table."""
    long = _long(spark, sf_dir)
    first, last = long.agg(F.min("day"), F.max("day")).first()
    lut = K.build_lut(T.day_users(spark, sf_dir).select(F.lit(0).alias("layer"), F.col("token").alias("ngram")))
    at = lambda d: long.where(F.col("day") == d).select("reg", "zeros")
    return L.recover_tokens(at(first), at(last), lut)
