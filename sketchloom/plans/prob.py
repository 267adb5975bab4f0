"""Probabilities, networks and chains over the nations' parts and the days' users."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bayes as B
from ..operators import markov as K
from ..operators import network as N
from ..operators import pairs as P
from ..operators import sketch as S
from ..sources import tables as T
from . import oracle as O
from .registry import DAY_USERS, NATION_PARTS, query

#: Edges of a graph that the driver may hold.
N_EDGES = 4_000_000
_TYPE_USERS = "SELECT event_type AS set_id, CAST(user_id AS VARCHAR) AS token FROM events"
_PAIRS = f"WITH {O.long_cte(NATION_PARTS)}, {O.pairs_cte()}, u AS (SELECT DISTINCT reg, zeros FROM lf), {O.cards_cte('u', '', 'uc', 'u')}"
_PRIORS = f"{_PAIRS}, pr AS (SELECT ps.*, card_a/uc.u AS p_a, card_b/uc.u AS p_b, card_ab/uc.u AS p_ab, CASE WHEN card_b > 0 THEN card_ab/card_b ELSE 0.0 END AS p_a_given_b, CASE WHEN card_a > 0 THEN card_ab/card_a ELSE 0.0 END AS p_b_given_a FROM ps CROSS JOIN uc)"


def _long(spark, sf_dir):
    return S.long_form(T.nation_parts(spark, sf_dir), "token", "set_id")


def _priors(spark, sf_dir):
    long = _long(spark, sf_dir)
    return B.with_priors(P.overlaps(long), B.universe_card(long))


@query(f"""{_PRIORS} SELECT a, b, round(p_a, 9) AS p_a, round(p_ab, 9) AS p_ab, round(p_a_given_b, 9) AS p_a_given_b, round(p_b_given_a*p_a/p_b, 9) AS posterior FROM pr WHERE a <> b""")
def q_bayes(spark, sf_dir):
    r = lambda c: F.round(c, 9).alias(c)
    return B.bayes_theorem(_priors(spark, sf_dir)).where("a <> b").select("a", "b", r("p_a"), r("p_ab"), r("p_a_given_b"), r("posterior"))


@query(f"""{_PRIORS} SELECT a, round(CASE WHEN p_a >= 1 THEN 0.0 ELSE -log2(p_a) END, 6) AS surprise, round(sum(CASE WHEN p_a > 0 AND p_a < 1 THEN -p_a*log2(p_a) ELSE 0.0 END) OVER (), 6) AS entropy FROM pr WHERE a = b""")
def q_entropy(spark, sf_dir):
    own = _priors(spark, sf_dir).where("a = b").select("a", "p_a")
    total = own.agg(F.sum(B.entropy_term(F.col("p_a"))).alias("entropy"))
    return own.crossJoin(total).select("a", F.round(B.surprise(F.col("p_a")), 6).alias("surprise"), F.round("entropy", 6).alias("entropy"))


_HALVES = f"""WITH {O.long_cte("SELECT event_type, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 1 ELSE 2 END AS half, CAST(user_id AS VARCHAR) AS token FROM events", "event_type, half")},
{O.cards_cte('lf', 'event_type, half')}, hl AS (SELECT DISTINCT half, reg, zeros FROM lf), {O.cards_cte('hl', 'half', 'uc', 'u')},
pr AS (SELECT event_type, max(CASE WHEN half = 1 THEN card.card/u END) AS p, max(CASE WHEN half = 2 THEN card.card/u END) AS q FROM card JOIN uc USING (half) GROUP BY event_type)"""


def _halves(spark, sf_dir):
    e = T.read(spark, sf_dir, "events").select("event_type", F.when(F.col("ts") < "2024-01-16", 1).otherwise(2).alias("half"), F.col("user_id").cast("string").alias("token"))
    long = S.long_form(e, "token", "event_type", "half")
    u = S.cardinality(long.select("half", "reg", "zeros").distinct(), "half").withColumnRenamed("card", "u")
    rows = S.cardinality(long, "event_type", "half").join(u, "half").withColumn("share", F.col("card") / F.col("u"))
    return rows.groupBy("event_type").agg(F.max(F.when(F.col("half") == 1, F.col("share"))).alias("p"), F.max(F.when(F.col("half") == 2, F.col("share"))).alias("q"))


@query(f"{_HALVES} SELECT round(sum(CASE WHEN p > 0 AND q > 0 THEN p*log2(p/q) ELSE 0.0 END), 6) AS kl FROM pr")
def q_kl(spark, sf_dir):
    return _halves(spark, sf_dir).agg(F.round(F.sum(B.divergence_term(F.col("p"), F.col("q"))), 6).alias("kl"))


@query(f"{_HALVES} SELECT event_type, round((CASE WHEN q >= 1 THEN 0.0 ELSE -log2(q) END) - (CASE WHEN p >= 1 THEN 0.0 ELSE -log2(p) END), 6) AS gain FROM pr WHERE p > 0 AND q > 0")
def q_bayesian_surprise(spark, sf_dir):
    h = _halves(spark, sf_dir).where("p > 0 AND q > 0")
    return h.select("event_type", F.round(B.surprise_gain(B.surprise(F.col("p")), B.surprise(F.col("q"))), 6).alias("gain"))


def _mi_sql(a="p_a", b="p_b", ab="p_ab") -> str:
    h = lambda p: f"(CASE WHEN {p} <= 0 OR {p} >= 1 THEN 0.0 ELSE -{p}*log2({p}) - (1-{p})*log2(1-{p}) END)"
    cell = lambda c: f"(CASE WHEN ({c}) > 0 THEN -({c})*log2({c}) ELSE 0.0 END)"
    cells = [ab, f"greatest(0, {a}-{ab})", f"greatest(0, {b}-{ab})", f"greatest(0, 1-{a}-{b}+{ab})"]
    return f"greatest(0.0, {h(a)} + {h(b)} - ({' + '.join(map(cell, cells))}))"


@query(f"{_PRIORS} SELECT a, b, round({_mi_sql()}, 6) AS mi, abs(p_ab - p_a*p_b) <= 0.05 AS independent FROM pr WHERE a < b")
def q_mi(spark, sf_dir):
    p = [F.col(c) for c in ("p_a", "p_b", "p_ab")]
    return _priors(spark, sf_dir).where("a < b").select("a", "b", F.round(B.mutual_information(*p), 6).alias("mi"), B.independence(*p).alias("independent"))


_CMI = f"""WITH {O.long_cte(_TYPE_USERS)}, g AS (SELECT reg, zeros FROM lf WHERE set_id = 'view'), {O.cards_cte('g', '', 'gc', 'u')},
inside AS (SELECT lf.* FROM lf SEMI JOIN g ON lf.reg = g.reg AND lf.zeros = g.zeros WHERE set_id <> 'view'), {O.pairs_cte('inside')}, pr AS (SELECT a, b, card_a/u AS p_a, card_b/u AS p_b, card_ab/u AS p_ab FROM ps CROSS JOIN gc)"""


@query(f"{_CMI} SELECT a, b, round({_mi_sql()}, 6) AS cmi, abs(p_ab - p_a*p_b) <= 0.05 AS independent FROM pr WHERE a < b")
def q_cmi(spark, sf_dir):
    """Event types' users against each other, given the users who viewed: three-way intersections."""
    e = T.read(spark, sf_dir, "events").select(F.col("event_type").alias("set_id"), F.col("user_id").cast("string").alias("token"))
    long = S.long_form(e, "token", "set_id")
    given = long.where("set_id = 'view'").select("reg", "zeros")
    inside = long.where("set_id <> 'view'").join(given, ["reg", "zeros"], "left_semi").select("set_id", "reg", "zeros")
    pr = B.with_priors(P.overlaps(inside), B.universe_card(given))
    p = [F.col(c) for c in ("p_a", "p_b", "p_ab")]
    return pr.where("a < b").select("a", "b", F.round(B.mutual_information(*p), 6).alias("cmi"), B.independence(*p).alias("independent"))


@query(f"""WITH {O.long_cte(DAY_USERS, 'day')}, f AS (SELECT reg, zeros, min(day) AS seen FROM lf GROUP BY ALL),
cl AS (SELECT d.day AS set_id, reg, zeros FROM (SELECT DISTINCT day FROM lf) d JOIN f ON f.seen <= d.day), e AS (SELECT 'first' AS set_id, reg, zeros FROM lf WHERE day = (SELECT min(day) FROM lf)),
{O.pairs_cte('e', 'cl')} SELECT b AS day, card_ab, card_b AS universe, card_ab/card_b AS posterior FROM ps""")
def q_temporal_posterior(spark, sf_dir):
    """The first day's users within everything seen so far, day by day."""
    long = S.long_form(T.day_users(spark, sf_dir), "token", "day")
    first = long.agg(F.min("day")).first()[0]
    seen = S.first_seen(long, "day")
    so_far = long.select("day").distinct().join(seen, F.col("seen") <= F.col("day")).select(F.col("day").alias("set_id"), "reg", "zeros")
    entity = long.where(F.col("day") == first).select(F.lit("first").alias("set_id"), "reg", "zeros")
    return B.posteriors(P.overlaps(entity, so_far)).select(F.col("b").alias("day"), "card_ab", F.col("card_b").alias("universe"), "posterior")


_NET = f"""{_PAIRS}, bn AS (SELECT CASE WHEN card_a >= card_b THEN a ELSE b END AS parent, CASE WHEN card_a >= card_b THEN b ELSE a END AS child, card_ab/(CASE WHEN card_a >= card_b THEN card_a ELSE card_b END) AS probability
FROM ps WHERE a < b AND greatest(card_ab/card_a, card_ab/card_b) >= 0.56)"""


def _net(spark, sf_dir):
    return N.edges(P.overlaps(_long(spark, sf_dir), disjoint=False), 0.56)


@query(f"{_NET} SELECT parent, child, probability FROM bn")
def q_bn_edges(spark, sf_dir):
    return _net(spark, sf_dir).select("parent", "child", "probability")


@query(f"""{_NET}, up AS (SELECT child AS node, list_sort(list(DISTINCT parent)) AS parents FROM bn GROUP BY ALL), dn AS (SELECT parent AS node, list_sort(list(DISTINCT child)) AS children FROM bn GROUP BY ALL),
co AS (SELECT x.parent AS node, list_sort(list(DISTINCT y.parent)) AS coparents FROM bn x JOIN bn y ON x.child = y.child AND x.parent <> y.parent GROUP BY ALL), n AS (SELECT parent AS node FROM bn UNION SELECT child FROM bn)
SELECT node, coalesce(parents, []::VARCHAR[]) AS parents, coalesce(children, []::VARCHAR[]) AS children, coalesce(coparents, []::VARCHAR[]) AS coparents FROM n LEFT JOIN up USING (node) LEFT JOIN dn USING (node) LEFT JOIN co USING (node)""")
def q_blanket(spark, sf_dir):
    return N.blankets(_net(spark, sf_dir))


def _belief_sql(name: str, edges: str, own: str, sure: str = "false") -> str:
    """``name``(node, belief) after a pass over edges (parent, child, probability), of ``own``(node, belief); ``sure`` says of a node that it is evidence."""
    return f"""{name}(node, belief) USING KEY (node) AS (SELECT node, CASE WHEN {sure} THEN 1.0::DOUBLE ELSE belief END FROM {own} o WHERE node NOT IN (SELECT child FROM {edges})
  UNION (SELECT node, CASE WHEN {sure} THEN 1.0::DOUBLE WHEN total > 0 THEN weighted/total ELSE belief END FROM (
    SELECT e.child AS node, count(*) AS told, sum(g.belief) AS total, sum(e.probability * g.belief) AS weighted FROM recurring.{name} AS g JOIN {edges} e ON e.parent = g.node WHERE e.child NOT IN (SELECT node FROM recurring.{name}) GROUP BY e.child) m
    JOIN (SELECT child, count(*) AS parents FROM {edges} GROUP BY child) k ON k.child = m.node JOIN {own} o USING (node) WHERE told = parents))"""


_PRIOR_NET = f"""WITH RECURSIVE {_PRIORS.removeprefix('WITH ')}, own AS (SELECT a AS node, p_a AS belief FROM pr WHERE a = b),
bn AS (SELECT CASE WHEN card_a >= card_b THEN a ELSE b END AS parent, CASE WHEN card_a >= card_b THEN b ELSE a END AS child, card_ab/(CASE WHEN card_a >= card_b THEN card_a ELSE card_b END) AS probability
FROM ps WHERE a < b AND greatest(card_ab/card_a, card_ab/card_b) >= 0.56)"""


def _own_beliefs(priors):
    return priors.where("a = b").select(F.col("a").alias("node"), F.col("p_a").alias("belief"))


@query(f"{_PRIOR_NET}, {_belief_sql('bl', 'bn', 'own')} SELECT node, round(belief, 9) AS belief FROM bl")
def q_belief(spark, sf_dir):
    pr = T.written(_priors(spark, sf_dir))
    return N.propagate(N.edges(pr, 0.56), _own_beliefs(pr)).select("node", F.round("belief", 9).alias("belief"))


@query(f"""{_PRIOR_NET}, fx AS (SELECT parent AS cause, child AS effect FROM bn ORDER BY probability DESC, parent, child LIMIT 1), cut AS (SELECT * FROM bn WHERE child <> (SELECT cause FROM fx)),
unset AS (SELECT node, CASE WHEN node = (SELECT cause FROM fx) THEN 0.0 ELSE belief END AS belief FROM own),
{_belief_sql('t1', 'cut', 'own', 'node = (SELECT cause FROM fx)')}, {_belief_sql('t0', 'cut', 'unset')}
SELECT cause, effect, round(t1.belief - t0.belief, 9) AS ace FROM fx JOIN t1 ON t1.node = effect JOIN t0 ON t0.node = effect""")
def q_causal_effect(spark, sf_dir):
    """The effect along the strongest edge."""
    pr = T.written(_priors(spark, sf_dir))
    net, own = T.written(N.edges(pr, 0.56)), _own_beliefs(pr)
    first = net.orderBy(F.desc("probability"), "parent", "child").first()
    rows = [(first["parent"], first["child"], round(N.average_effect(net, own, first["parent"], first["child"]), 9))] if first else []
    return spark.createDataFrame(rows, "cause string, effect string, ace double")


@query(f"""{_NET}, n AS (SELECT parent AS node FROM bn UNION SELECT child FROM bn), mb AS (SELECT child AS node, parent AS other FROM bn UNION SELECT parent, child FROM bn UNION SELECT x.parent, y.parent FROM bn x JOIN bn y ON x.child = y.child AND x.parent <> y.parent)
SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM bn) AS edges, (SELECT count(*) FROM n WHERE node NOT IN (SELECT child FROM bn)) AS roots, (SELECT count(*) FROM n WHERE node NOT IN (SELECT parent FROM bn)) AS leaves,
(SELECT count(*) FROM mb) / (SELECT count(*) FROM n) AS mean_blanket""")
def q_network_report(spark, sf_dir):
    return N.report(_net(spark, sf_dir))


@query(f"""{_PAIRS} SELECT count(*) AS pairs, 0.0::DOUBLE + max(abs(least(1.0, card_ab/card_b) - card_ab/card_b)) AS max_error, avg(abs(least(1.0, card_ab/card_b) - card_ab/card_b)) AS mean_error FROM ps WHERE a <> b""")
def q_isomorphism_witness(spark, sf_dir):
    return N.isomorphism_witness(P.overlaps(_long(spark, sf_dir)))


_CHAIN = f"""{_PAIRS}, raw AS (SELECT a AS i, b AS j, CASE WHEN a <> b AND card_a > 0 THEN greatest(0.0, least(1.0, card_ab/card_a)) ELSE 0.0 END AS raw FROM ps),
t AS (SELECT i, j, CASE WHEN sum(raw) OVER (PARTITION BY i) > 0 THEN raw/sum(raw) OVER (PARTITION BY i) ELSE 0.0 END AS p FROM raw), n AS (SELECT count(DISTINCT i) AS n FROM t)"""


def _chain(spark, sf_dir):
    return K.transition(P.overlaps(_long(spark, sf_dir)))


@query(f"{_CHAIN} SELECT i, j, round(p, 9) AS p FROM t")
def q_markov_matrix(spark, sf_dir):
    return _chain(spark, sf_dir).select("i", "j", F.round("p", 9).alias("p"))


def _power_sql(damping: float, steps: int) -> str:
    out = "x0 AS (SELECT DISTINCT i AS state, 1.0::DOUBLE/n AS score FROM t CROSS JOIN n)"
    for k in range(1, steps + 1):
        out += f", x{k} AS (SELECT j AS state, {damping}::DOUBLE*sum(p*score) + {1 - damping}::DOUBLE/any_value(n) AS score FROM t JOIN x{k - 1} ON state = i CROSS JOIN n GROUP BY j)"
    return out


@query(f"{_CHAIN}, {_power_sql(0.85, 16)} SELECT state, round(score/sum(score) OVER (), 6) AS score FROM x16")
def q_pagerank(spark, sf_dir):
    return K.ranked(_chain(spark, sf_dir)).select("state", F.round("score", 6).alias("score"))


@query(f"""{_CHAIN}, {_power_sql(1.0, 16)} SELECT round(sum(CASE WHEN p > 0 THEN -score*p*log2(p) ELSE 0.0 END), 5) AS entropy_rate, round(log2(any_value(n)), 5) AS max_possible FROM t JOIN x16 ON state = i CROSS JOIN n""")
def q_entropy_rate(spark, sf_dir):
    found = K.entropy_of(_chain(spark, sf_dir))
    return found.select(F.round("entropy_rate", 5).alias("entropy_rate"), F.round("max_possible", 5).alias("max_possible"))


@query(f"""{_CHAIN.replace('WITH', 'WITH RECURSIVE', 1)}, fr AS (SELECT list(row ORDER BY i) AS m FROM (SELECT i, list(p ORDER BY j) AS row FROM t GROUP BY i)), tc AS (SELECT list(col ORDER BY j) AS m, list(j ORDER BY j) AS labels FROM (SELECT j, list(p ORDER BY i) AS col FROM t GROUP BY j)),
hr(k, h) AS (SELECT 0, list_transform(m, lambda r: 0.0::DOUBLE) FROM fr UNION ALL SELECT k + 1, list_transform(m, lambda r, x: CASE WHEN x = 1 THEN 0.0 ELSE 1 + list_inner_product(r, h) END) FROM hr CROSS JOIN fr WHERE k < 1500),
pr_(k, x) AS (SELECT 0, list_transform(m, lambda r: 1.0::DOUBLE / len(m)) FROM tc UNION ALL SELECT k + 1, list_transform(m, lambda c: list_inner_product(c, x)) FROM pr_ CROSS JOIN tc WHERE k < 400),
a AS (SELECT h FROM hr ORDER BY k DESC LIMIT 1), b AS (SELECT x FROM pr_ ORDER BY k DESC LIMIT 1)
SELECT labels[i] AS state, round(h[i], 4) AS to_first, round(list_sum(x) / x[i], 4) AS return_time FROM (SELECT labels, h, x, unnest(range(1, len(labels) + 1)) AS i FROM tc CROSS JOIN a CROSS JOIN b)""")
def q_hitting_time(spark, sf_dir):
    t = T.written(_chain(spark, sf_dir))
    first = t.agg(F.min("i")).first()[0]
    times = spark.createDataFrame(list(K.hitting_of(t, first).items()), "state string, to_first double")
    back = K.stationary(t).select("state", F.when(F.col("score") > 0, 1 / F.col("score")).otherwise(float("inf")).alias("back"))
    return times.join(back, "state").select("state", F.round("to_first", 4).alias("to_first"), F.round("back", 4).alias("return_time"))


@query(f"""{_CHAIN.replace('WITH', 'WITH RECURSIVE', 1)}, s AS (SELECT i, j FROM t WHERE p > 0), r(a, b) AS (SELECT i, i FROM t UNION SELECT r.a, s.j FROM r JOIN s ON s.i = r.b),
c AS (SELECT x.a AS node, min(x.b) AS member_of FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a), loops AS (SELECT member_of, min(steps) AS period FROM (SELECT member_of, 1 AS steps FROM s JOIN c x ON x.node = s.i WHERE s.i = s.j
  UNION ALL SELECT x.member_of, 1 FROM s p JOIN s q ON q.i = p.j JOIN s u ON u.i = q.j AND u.j = p.i JOIN s v ON v.i = p.j AND v.j = p.i JOIN c x ON x.node = p.i JOIN c y ON y.node = p.j AND y.member_of = x.member_of JOIN c z ON z.node = q.j AND z.member_of = x.member_of) GROUP BY member_of)
SELECT member_of, count(*) AS members, any_value(period)::INT AS period FROM c LEFT JOIN loops USING (member_of) GROUP BY member_of""")
def q_chain_classes(spark, sf_dir):
    """Communicating classes and their periods (1 where ways of two and of three steps come back)."""
    t = T.written(_chain(spark, sf_dir))
    return K.periods(t, K.class_table(t))


@query(f"""{_CHAIN.replace('WITH', 'WITH RECURSIVE', 1)}, fr AS (SELECT list(row ORDER BY i) AS m FROM (SELECT i, list(p ORDER BY j) AS row FROM t GROUP BY i)), tc AS (SELECT list(col ORDER BY j) AS m FROM (SELECT j, list(p ORDER BY i) AS col FROM t GROUP BY j)),
st(k, x) AS (SELECT 0, list_transform(m, lambda r: 1.0::DOUBLE / len(m)) FROM tc UNION ALL SELECT k + 1, list_transform(m, lambda c: list_inner_product(c, x)) FROM st CROSS JOIN tc WHERE k < 400),
pi AS (SELECT list_transform(x, lambda v: v / list_sum(x)) AS pi FROM st ORDER BY k DESC LIMIT 1),
dv(k, v, size) AS (SELECT 0, list_transform(m, lambda r, n: sin(n * n)::DOUBLE), 1.0::DOUBLE FROM fr UNION ALL SELECT k + 1, list_transform(w, lambda x: x / norm), norm FROM (SELECT k, w, sqrt(list_inner_product(w, w)) AS norm FROM (
  SELECT k, list_transform(m, lambda r: list_inner_product(r, v) - list_inner_product(pi.pi, v)) AS w FROM dv CROSS JOIN fr CROSS JOIN pi WHERE k < 500))),
la AS (SELECT size AS second FROM dv ORDER BY k DESC LIMIT 1), g(a, b) AS (SELECT i, i FROM t UNION SELECT g.a, t.j FROM g JOIN t ON t.i = g.b WHERE t.p > 0),
c AS (SELECT min(x.b) AS own FROM g x JOIN g y ON x.a = y.b AND x.b = y.a GROUP BY x.a), nm AS (SELECT own, count(*) AS members FROM c GROUP BY own)
SELECT members::INT AS members, 1 AS period, (SELECT count(*) FROM t WHERE i = j AND p >= 0.95)::INT AS absorbing, round(second, 3) AS second, round(1 - second, 3) AS gap, round(ln(100) / (1 - second), 1) AS mixing_time FROM nm CROSS JOIN la""")
def q_mixing(spark, sf_dir):
    """Of each communicating class: its members and period (1, since ways of two and of three steps come back), and the chain's spectral gap."""
    labels, m = K.dense(_chain(spark, sf_dir))
    found = K.classes(m)
    mix = K.mixing(m)
    rows = [(len(c), K.period(m, c), len(K.absorbing(m)), round(mix["second"], 3), round(mix["gap"], 3), round(mix["time"], 1)) for c in found]
    return spark.createDataFrame(rows, "members int, period int, absorbing int, second double, gap double, mixing_time double")


@query()
def q_hmm_viterbi(spark, sf_dir):
    """Hidden states: days' user sets; observations: event types' user sets; sequences: each user's events."""
    e = T.read(spark, sf_dir, "events")
    hidden = S.long_form(e.select(F.concat(F.lit("week "), F.weekofyear("ts").cast("string")).alias("set_id"), F.col("user_id").cast("string").alias("token")), "token", "set_id")
    seen = S.long_form(e.select(F.col("event_type").alias("set_id"), F.col("user_id").cast("string").alias("token")), "token", "set_id")
    t = K.dense(K.transition(P.overlaps(hidden)))
    rows = T.bounded(K.emissions(P.overlaps(hidden, seen)), K.DENSE * K.DENSE)
    hs, os = sorted({r["i"] for r in rows}), sorted({r["j"] for r in rows})
    import numpy as np

    b = np.zeros((len(hs), len(os)))
    for r in rows:
        b[hs.index(r["i"]), os.index(r["j"])] = r["p"]
    prior = {r["set_id"]: r["card"] for r in T.bounded(S.cardinality(hidden, "set_id"), K.DENSE)}
    return K.decode_sequences(e.select("user_id", "ts", "event_type"), "user_id", "ts", "event_type", prior, t, (hs, os, b))


@query(f"""{_PRIORS.replace('WITH', 'WITH RECURSIVE', 1)}, e AS (SELECT a, b, {_mi_sql()} AS mi FROM pr WHERE a < b), l AS (SELECT a, b FROM e WHERE mi > 0.01 UNION ALL SELECT b, a FROM e WHERE mi > 0.01), near AS (SELECT a, list(b) AS to FROM l GROUP BY a),
c(members, top) AS (SELECT [a], a FROM near UNION ALL SELECT list_append(members, l.b), l.b FROM c JOIN l ON l.a = c.top AND l.b > c.top JOIN near k ON k.a = l.b WHERE list_has_all(k.to, members)),
m AS (SELECT members FROM c WHERE NOT EXISTS (SELECT 1 FROM near k WHERE list_has_all(k.to, c.members)))
SELECT (row_number() OVER (ORDER BY members) - 1)::INT AS clique, len(members)::INT AS size, array_to_string(members, ',') AS members FROM m""".replace("AS to ", "AS tos ").replace("k.to,", "k.tos,"))
def q_cliques(spark, sf_dir):
    """Maximal cliques of the random field whose edges carry information."""
    p = [F.col(c) for c in ("p_a", "p_b", "p_ab")]
    linked = _priors(spark, sf_dir).where("a < b").where(B.mutual_information(*p) > 0.01).select("a", "b")
    linked = T.bounded(linked, N_EDGES)
    return spark.createDataFrame([(i, len(c), ",".join(c)) for i, c in enumerate(K.cliques([(r["a"], r["b"]) for r in linked]))], "clique int, size int, members string")


@query(f"""{_PRIORS}, e AS (SELECT a, b, {_mi_sql()} AS mi FROM pr WHERE a < b) SELECT a, b, round(exp(mi), 6) AS potential FROM e WHERE mi > 0.01""")
def q_mrf_edges(spark, sf_dir):
    p = [F.col(c) for c in ("p_a", "p_b", "p_ab")]
    mi = B.mutual_information(*p)
    return _priors(spark, sf_dir).where("a < b").where(mi > 0.01).select("a", "b", F.round(F.exp(mi), 6).alias("potential"))


@query(f"""{_PRIORS}, e AS (SELECT a, b, {_mi_sql()} AS mi FROM pr WHERE a < b) SELECT round((SELECT sum(CASE WHEN p_a > 0 THEN -ln(p_a) ELSE 0.0 END) FROM pr WHERE a = b) - coalesce((SELECT sum(mi) FROM e WHERE mi > 0.01), 0), 6) AS energy""")
def q_mrf_energy(spark, sf_dir):
    p = [F.col(c) for c in ("p_a", "p_b", "p_ab")]
    pr = _priors(spark, sf_dir)
    links = pr.where("a < b").select(B.mutual_information(*p).alias("mi")).where("mi > 0.01")
    return B.field_energy(pr.where("a = b"), links).select(F.round("energy", 6).alias("energy"))


@query(f"""{_PAIRS}, d AS (SELECT a, b, {O.TAU} AS tau, {O.RHO} AS rho FROM ps), g AS (SELECT DISTINCT b AS parent, a AS child FROM d WHERE a <> b AND tau >= 0.5 AND rho <= 0.45),
n AS (SELECT n, max(up) AS up, max(down) AS down FROM (SELECT parent AS n, 1 AS up, 0 AS down FROM g UNION ALL SELECT child, 0, 1 FROM g) GROUP BY n)
SELECT count(*) AS nodes, (SELECT count(*) FROM g) AS edges, count(*) FILTER (down = 0) AS roots, count(*) FILTER (up = 0) AS leaves FROM n""")
def q_bn_from_graph(spark, sf_dir):
    return N.structure(N.from_graph(P.morphism_graph(P.overlaps(_long(spark, sf_dir), disjoint=False), 0.5, 0.45)))


_DAY_STATES = f"""WITH {O.long_cte(DAY_USERS, 'day')}, f AS (SELECT reg, zeros, min(day) AS seen FROM lf GROUP BY ALL), cl AS (SELECT d.day AS set_id, reg, zeros FROM (SELECT DISTINCT day FROM lf) d JOIN f ON f.seen <= d.day)"""


def _day_states(spark, sf_dir):
    long = S.long_form(T.day_users(spark, sf_dir), "token", "day")
    return long, long.select("day").distinct().join(S.first_seen(long, "day"), F.col("seen") <= F.col("day")).select(F.col("day").alias("set_id"), "reg", "zeros")


@query(f"""{_DAY_STATES}, {O.pairs_cte('cl')}, raw AS (SELECT a AS i, b AS j, CASE WHEN a <> b AND card_a > 0 THEN least(1.0, card_ab/card_a) ELSE 0.0 END AS raw FROM ps)
SELECT i, j, round(CASE WHEN sum(raw) OVER (PARTITION BY i) > 0 THEN raw/sum(raw) OVER (PARTITION BY i) ELSE 0.0 END, 9) AS p FROM raw""")
def q_markov_lattice(spark, sf_dir):
    """The chain over the timeline's cumulative states."""
    return K.transition(P.overlaps(_day_states(spark, sf_dir)[1])).select("i", "j", F.round("p", 9).alias("p"))


@query(f"""{_DAY_STATES}, {O.cards_cte('cl', 'set_id', 'uc', 'u')}, {O.cards_cte('lf', 'day', 'dc', 'own')}, x AS (SELECT set_id AS day, u, own, (SELECT own FROM dc ORDER BY day LIMIT 1) AS entity FROM uc JOIN dc ON dc.day = set_id),
y AS (SELECT day, own - lag(own) OVER (ORDER BY day) AS flux, entity/u - lag(entity/u) OVER (ORDER BY day) AS dp FROM x)
SELECT day, flux, round(dp, 9) AS dp, CASE WHEN flux > 1 THEN 'growth' WHEN flux < -1 THEN 'decay' ELSE 'balanced' END AS by_flux, CASE WHEN dp > 0.02 THEN 'strengthened' WHEN dp < -0.02 THEN 'weakened' ELSE 'stable' END AS by_belief,
CASE WHEN (CASE WHEN flux > 1 THEN 1 WHEN flux < -1 THEN -1 ELSE 0 END) = (CASE WHEN dp > 0.02 THEN 1 WHEN dp < -0.02 THEN -1 ELSE 0 END) THEN 'agreement' WHEN flux > 1 AND dp < -0.02 THEN 'dilution' WHEN flux < -1 AND dp > 0.02 THEN 'concentration' WHEN abs(flux) <= 1 THEN 'hidden shift' ELSE 'divergence' END AS note FROM y WHERE flux IS NOT NULL""")
def q_interpretation(spark, sf_dir):
    """The first day's users as the entity: what a day's change means by flux and by probability."""
    from pyspark.sql import Window as W

    long, states = _day_states(spark, sf_dir)
    own = S.cardinality(long, "day").withColumnRenamed("card", "own")
    u = S.cardinality(states, "set_id").select(F.col("set_id").alias("day"), F.col("card").alias("u"))
    w = W.orderBy("day")
    rows = own.join(u, "day").withColumn("entity", F.first("own").over(w))
    rows = rows.select("day", (F.col("own") - F.lag("own").over(w)).alias("flux"), (F.col("entity") / F.col("u") - F.lag(F.col("entity") / F.col("u")).over(w)).alias("dp")).where("flux IS NOT NULL")
    a, b, note = B.interpretation(F.col("flux"), F.col("dp"))
    return rows.select("day", "flux", F.round("dp", 9).alias("dp"), a.alias("by_flux"), b.alias("by_belief"), note.alias("note"))


_WEEKS = "SELECT 'week ' || weekofyear(ts) AS set_id, CAST(user_id AS VARCHAR) AS token FROM events"


@query(f"""WITH tk AS ({_WEEKS} UNION ALL {_TYPE_USERS}), {O.hash_cte('tk')}, hd AS (SELECT DISTINCT set_id, reg, zeros FROM ({_WEEKS}) JOIN p USING (token) WHERE zeros IS NOT NULL), ob AS (SELECT DISTINCT set_id, reg, zeros FROM ({_TYPE_USERS}) JOIN p USING (token) WHERE zeros IS NOT NULL),
{O.pairs_cte('hd', 'ob')}, r AS (SELECT a AS i, b AS j, CASE WHEN card_a > 0 THEN card_ab/card_a ELSE 0.0 END AS raw FROM ps) SELECT i, j, round(CASE WHEN sum(raw) OVER (PARTITION BY i) > 0 THEN raw/sum(raw) OVER (PARTITION BY i) ELSE 0.0 END, 9) AS p FROM r""")
def q_hmm_emissions(spark, sf_dir):
    """Weeks' users as hidden sets, event types' users as observations."""
    e = T.read(spark, sf_dir, "events").select(F.concat(F.lit("week "), F.weekofyear("ts").cast("string")).alias("week"), "event_type", F.col("user_id").cast("string").alias("token"))
    hidden = S.long_form(e.select(F.col("week").alias("set_id"), "token"), "token", "set_id")
    seen = S.long_form(e.select(F.col("event_type").alias("set_id"), "token"), "token", "set_id")
    return K.emissions(P.overlaps(hidden, seen)).select("i", "j", F.round("p", 9).alias("p"))
