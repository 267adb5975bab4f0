"""Hashing, sketches, set algebra, estimators, pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import estimators as E
from ..functions import hashing as H
from ..operators import pairs as P
from ..operators import sketch as S
from ..sources import tables as T
from . import oracle as O
from .registry import BRAND_WORDS, DAY_TYPE_USERS, DAY_USERS, NATION_PARTS, query

_NATION = O.long_cte(NATION_PARTS)
_BRAND = O.long_cte(BRAND_WORDS)
_EVENTS = O.long_cte(DAY_TYPE_USERS, "day, event_type")
_MONTH = "SELECT strftime(o_orderdate, '%Y-%m') AS set_id, CAST(o_custkey AS VARCHAR) AS token FROM orders"
_SEGMENT = "SELECT c_mktsegment AS set_id, CAST(c_custkey AS VARCHAR) AS token FROM customer"


@query(f"""WITH tk AS ({BRAND_WORDS}), {O.hash_cte('tk')}
SELECT token, CASE WHEN h >= 9223372036854775808::UBIGINT THEN (h::HUGEINT - 18446744073709551616::HUGEINT)::BIGINT ELSE h::BIGINT END AS hash, reg, zeros FROM p""")
def q_hash_tokens(spark, sf_dir):
    return S.positions(T.brand_words(spark, sf_dir).select("token").distinct(), "token").select("token", "hash", "reg", "zeros")


@query(f"""WITH tk AS ({BRAND_WORDS}), {O.hash_cte('tk')}
SELECT token, CASE WHEN h >= 9223372036854775808::UBIGINT THEN (h::HUGEINT - 18446744073709551616::HUGEINT)::BIGINT ELSE h::BIGINT END AS hash FROM p""")
def q_hash_native(spark, sf_dir):
    tokens = T.brand_words(spark, sf_dir).select("token").distinct()
    return tokens.select("token", H.murmur64a(F.col("token"), backend="native").alias("hash"))


@query(f"""WITH tk AS (SELECT DISTINCT token FROM ({BRAND_WORDS}))
SELECT token, ('0x' || substr(sha1(token), 1, 8))::BIGINT AS sha1_32, ('0x' || substr(sha256(token), 1, 8))::BIGINT AS sha256_32,
       ('0x' || substr(sha1('42:' || token), 1, 8))::BIGINT AS seeded_32 FROM tk""")
def q_hash_sha(spark, sf_dir):
    t = F.col("token")
    return T.brand_words(spark, sf_dir).select("token").distinct().select(
        t, H.hash_content(t, "sha1").alias("sha1_32"), H.hash_content(t, "sha256").alias("sha256_32"), H.hash_content(t, "sha1", seeded=True).alias("seeded_32")
    )


@query(f"""WITH tk AS ({BRAND_WORDS}), g AS (SELECT set_id, list_sort(list_distinct(list(token))) AS tokens FROM tk GROUP BY set_id)
SELECT set_id, 'set:' || sha1(array_to_string(tokens, chr(0))) AS content_key FROM g""")
def q_content_key(spark, sf_dir):
    sets = T.brand_words(spark, sf_dir).groupBy("set_id").agg(F.collect_set("token").alias("tokens"))
    return sets.select("set_id", H.content_key(F.col("tokens")).alias("content_key"))


@query(f"WITH {_NATION}, {O.cards_cte()} SELECT set_id, card FROM card")
def q_sketch_card_by_nation(spark, sf_dir):
    return S.cardinality(S.long_form(T.nation_parts(spark, sf_dir), "token", "set_id"), "set_id")


@query(f"""WITH {_NATION}, top AS (SELECT set_id, reg, max(zeros)+1 AS t FROM lf GROUP BY ALL),
r AS (SELECT set_id, {O.M}-count(*) AS empty, (0.7213::DOUBLE/(1+1.079::DOUBLE/65536))*{O.M}*{O.M}/(sum(power(2.0, -t)) + ({O.M}-count(*))) AS raw FROM top GROUP BY set_id)
SELECT set_id, CASE WHEN empty > 0 AND raw <= 2.5*{O.M} THEN greatest(0, round({O.M}*ln({O.M}.0::DOUBLE/empty))) ELSE greatest(0, round(raw - ({O.bias_case('raw')}) - 1)) END::DOUBLE AS card_hll FROM r""")
def q_sketch_card_hll(spark, sf_dir):
    return S.cardinality_hll(S.long_form(T.nation_parts(spark, sf_dir), "token", "set_id"), "set_id")


@query(f"""WITH {_NATION}, top AS (SELECT reg, max(zeros)+1 AS t FROM lf GROUP BY ALL),
r AS (SELECT {O.M}-count(*) AS empty, (0.7213::DOUBLE/(1+1.079::DOUBLE/65536))*{O.M}*{O.M}/(sum(power(2.0, -t)) + ({O.M}-count(*))) AS raw FROM top)
SELECT CASE WHEN empty > 0 AND raw <= 2.5*{O.M} THEN greatest(0, round({O.M}*ln({O.M}.0::DOUBLE/empty))) ELSE greatest(0, round(raw - ({O.bias_case('raw')}) - 1)) END::DOUBLE AS card_hll FROM r""")
def q_card_hll_all_parts(spark, sf_dir):
    return S.cardinality_hll(S.long_form(T.nation_parts(spark, sf_dir), "token"))


def _two_segments(spark, sf_dir):
    c = T.read(spark, sf_dir, "customer")
    o = T.read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("token"), "o_orderpriority")
    long = S.long_form(o, "token", "o_orderpriority")
    pick = lambda x: long.where(F.col("o_orderpriority").startswith(x)).select("reg", "zeros").distinct()
    return pick("1"), pick("2"), c


@query(f"""WITH {O.long_cte("SELECT o_orderpriority AS set_id, CAST(o_custkey AS VARCHAR) AS token FROM orders")},
a AS (SELECT DISTINCT reg, zeros FROM lf WHERE set_id LIKE '1%'), b AS (SELECT DISTINCT reg, zeros FROM lf WHERE set_id LIKE '2%'),
ops AS (SELECT 'union' AS op, reg, zeros FROM (SELECT * FROM a UNION SELECT * FROM b)
UNION ALL SELECT 'intersect', reg, zeros FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
UNION ALL SELECT 'diff', reg, zeros FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
UNION ALL SELECT 'xor', reg, zeros FROM ((SELECT * FROM a EXCEPT SELECT * FROM b) UNION (SELECT * FROM b EXCEPT SELECT * FROM a))),
{O.cards_cte('ops', 'op')} SELECT op, card, bits FROM card JOIN (SELECT op, count(*) AS bits FROM ops GROUP BY op) USING (op)""")
def q_union_inter_diff_xor(spark, sf_dir):
    a, b, _ = _two_segments(spark, sf_dir)
    ops = None
    for op, f in (("union", S.union), ("intersect", S.intersect), ("diff", S.difference), ("xor", S.symmetric_difference)):
        one = f(a, b).select(F.lit(op).alias("op"), "reg", "zeros")
        ops = one if ops is None else ops.unionByName(one)
    return S.cardinality(ops, "op").join(ops.groupBy("op").agg(F.count(F.lit(1)).alias("bits")), "op")


@query(f"""WITH {O.long_cte(_MONTH)}, u AS (SELECT DISTINCT reg, zeros FROM lf), {O.cards_cte('u', '')}
SELECT card, (SELECT count(*) FROM u) AS bits FROM card""")
def q_merge_months(spark, sf_dir):
    orders = T.read(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("set_id"), F.col("o_custkey").cast("string").alias("token"))
    merged = S.unpack(S.merge(S.build(orders, "token", "set_id")))
    return S.cardinality(merged).crossJoin(merged.agg(F.count(F.lit(1)).alias("bits")))


@query(f"""WITH {O.long_cte(_MONTH)}, n AS (SELECT count(DISTINCT set_id) AS n FROM lf), g AS (SELECT reg, zeros, count(*) AS c FROM lf GROUP BY ALL)
SELECT count(*) FILTER (c = n) AS in_all, count(*) FILTER (c % 2 = 1) AS in_odd FROM g CROSS JOIN n""")
def q_bulk_and_xor(spark, sf_dir):
    orders = T.read(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("set_id"), F.col("o_custkey").cast("string").alias("token"))
    everywhere = S.meet_all(S.build(orders, "token", "set_id")).select(F.bitmap_count("bitmap").alias("in_all"))
    odd = S.xor_all(S.long_form(orders, "token", "set_id")).agg(F.count(F.lit(1)).alias("in_odd"))
    return everywhere.crossJoin(odd)


@query(f"""WITH {O.long_cte(_SEGMENT)}, r AS (SELECT range // 32 AS reg, range % 32 AS zeros FROM range({O.M * 32})),
u AS (SELECT DISTINCT reg, zeros FROM lf) SELECT r.zeros::INT AS zeros, count(*) AS free FROM r ANTI JOIN u ON r.reg = u.reg AND r.zeros = u.zeros GROUP BY ALL""")
def q_complement(spark, sf_dir):
    tokens = T.read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("token"))
    return S.complement(S.long_form(tokens, "token")).groupBy("zeros").agg(F.count(F.lit(1)).alias("free"))


@query(f"WITH {_NATION} SELECT set_id, zeros, count(*) AS c FROM lf GROUP BY ALL")
def q_bitcounts(spark, sf_dir):
    return S.bit_counts(S.long_form(T.nation_parts(spark, sf_dir), "token", "set_id"), "set_id")


@query(f"""WITH {_NATION} SELECT set_id, count(DISTINCT reg) AS registers, count(*) AS bits, {4 * O.M}::INT AS dense_bytes, count(*)*4 AS sparse_bytes FROM lf GROUP BY set_id""")
def q_sketch_info(spark, sf_dir):
    return S.info(S.long_form(T.nation_parts(spark, sf_dir), "token", "set_id"), "set_id")


@query(f"WITH {_BRAND} SELECT set_id, reg, zeros FROM lf")
def q_positions(spark, sf_dir):
    """Through the packed form and back."""
    return S.unpack(S.build(T.brand_words(spark, sf_dir), "token", "set_id"), "set_id")


@query(f"WITH {_BRAND} SELECT set_id, reg, max(zeros)+1 AS bit_length FROM lf GROUP BY ALL")
def q_max_zeros(spark, sf_dir):
    return S.max_zeros(S.long_form(T.brand_words(spark, sf_dir), "token", "set_id"), "set_id")


@query(f"""WITH {_BRAND}, s AS (SELECT DISTINCT set_id FROM lf),
b AS (SELECT set_id, (reg*32+zeros)//8 AS i, sum(1::BIGINT << ((reg*32+zeros)%8)) AS v FROM lf GROUP BY ALL),
f AS (SELECT s.set_id, range AS i, coalesce(v, 0)::INT AS v FROM s CROSS JOIN range({O.M * 4}) LEFT JOIN b ON b.set_id = s.set_id AND b.i = range)
SELECT set_id, sha1(unhex(string_agg(printf('%02x', v), '' ORDER BY i))) AS name FROM f GROUP BY set_id""")
def q_sketch_name(spark, sf_dir):
    return S.name(S.build(T.brand_words(spark, sf_dir), "token", "set_id")).select("set_id", "name")


_NATION_PAIRS = f"WITH {_NATION}, {O.pairs_cte()}"


def _nation_pairs(spark, sf_dir):
    return P.overlaps(S.long_form(T.nation_parts(spark, sf_dir), "token", "set_id"))


@query(f"""{_NATION_PAIRS} SELECT a, b, card_a, card_b, card_ab, CASE WHEN card_or > 0 THEN card_ab/card_or ELSE 0.0 END AS jaccard,
CASE WHEN sqrt(card_a*card_b) > 0 THEN card_ab/sqrt(card_a*card_b) ELSE 0.0 END AS cosine FROM ps WHERE a < b""")
def q_jaccard_cosine_pairs(spark, sf_dir):
    return P.similarities(_nation_pairs(spark, sf_dir)).where("a < b").select("a", "b", "card_a", "card_b", "card_ab", "jaccard", "cosine")


@query(f"{_NATION_PAIRS} SELECT a, b, {O.TAU} AS tau, {O.RHO} AS rho FROM ps")
def q_bss_matrix(spark, sf_dir):
    return P.directed(_nation_pairs(spark, sf_dir)).select("a", "b", "tau", "rho")


@query(f"""{_NATION_PAIRS}, d AS (SELECT a, b, {O.TAU} AS tau, {O.RHO} AS rho FROM ps) SELECT * FROM d WHERE a <> b AND tau >= 0.5 AND rho <= 0.45""")
def q_morphism_graph(spark, sf_dir):
    long = S.long_form(T.nation_parts(spark, sf_dir), "token", "set_id")
    return P.morphism_graph(P.overlaps(long, disjoint=False), 0.5, 0.45)


@query(f"""WITH {_BRAND}, {O.pairs_cte()}, d AS (SELECT *, {O.TAU} AS tau, {O.RHO} AS rho FROM ps)
SELECT a, b, card_a, card_b, card_ab, card_a_not_b, tau >= 0.7 AND rho <= 0.3 AS "exists", tau - 0.7::DOUBLE AS margin_tau, 0.3::DOUBLE - rho AS margin_rho FROM d""")
def q_test_morphism(spark, sf_dir):
    pairs = P.overlaps(S.long_form(T.brand_words(spark, sf_dir), "token", "set_id"))
    return P.morphisms(pairs).select("a", "b", "card_a", "card_b", "card_ab", "card_a_not_b", "exists", "margin_tau", "margin_rho")


@query(f"""{_NATION_PAIRS} SELECT a, b, least(1.0, pop_ab/pop_b)::DOUBLE AS tau, least(1.0, (pop_a-pop_ab)/pop_b)::DOUBLE AS rho FROM ps""")
def q_bss_from_registers(spark, sf_dir):
    return P.directed_by_bits(_nation_pairs(spark, sf_dir)).select("a", "b", "tau", "rho")


@query(f"{_NATION_PAIRS} SELECT a, b, pop_a + pop_b - 2*pop_ab AS hamming, card_xor FROM ps WHERE a < b")
def q_hamming_pairs(spark, sf_dir):
    return P.hamming(_nation_pairs(spark, sf_dir)).where("a < b").select("a", "b", "hamming", "card_xor")


@query(f"""{_NATION_PAIRS}, d AS (SELECT a, b, {O.TAU} AS tau FROM ps)
SELECT a, b, CASE WHEN tau >= 0.9 THEN 'nearly covers' WHEN tau >= 0.7 THEN 'mostly covers' WHEN tau >= 0.3 THEN 'overlaps' WHEN tau > 0 THEN 'touches' ELSE 'disjoint' END AS verdict FROM d WHERE a <> b""")
def q_bss_summary(spark, sf_dir):
    return P.summary(_nation_pairs(spark, sf_dir)).where("a <> b").select("a", "b", "verdict")


@query(f"""WITH {_NATION}, s AS (SELECT set_id, reg, zeros FROM lf WHERE set_id < 'G'), o AS (SELECT set_id, reg, zeros FROM lf WHERE set_id >= 'G'),
l AS (SELECT DISTINCT reg, zeros FROM s), r AS (SELECT DISTINCT reg, zeros FROM o),
x AS (SELECT * FROM l EXCEPT SELECT * FROM r), y AS (SELECT * FROM r EXCEPT SELECT * FROM l), i AS (SELECT * FROM l INTERSECT SELECT * FROM r)
SELECT (SELECT count(*) FROM (SELECT * FROM l UNION SELECT * FROM r)) AS union_bits, (SELECT count(*) FROM x) + (SELECT count(*) FROM y) AS xor_bits,
(SELECT count(*) FROM i) AS and_bits, true AS holds""")
def q_bridge_law(spark, sf_dir):
    """A or B equals (A xor B) xor (A and B)."""
    long = S.long_form(T.nation_parts(spark, sf_dir), "token", "set_id")
    a, b = (long.where(c).select("reg", "zeros").distinct() for c in ("set_id < 'G'", "set_id >= 'G'"))
    sides = a.withColumn("s", F.lit(1)).unionByName(b.withColumn("s", F.lit(2)))
    g = sides.groupBy("reg", "zeros").agg(F.sum("s").alias("s"))
    rebuilt = (F.col("s") < 3).cast("int").bitwiseXOR((F.col("s") == 3).cast("int"))
    return g.agg(
        F.count(F.lit(1)).alias("union_bits"), F.count_if(F.expr("s < 3")).alias("xor_bits"), F.count_if(F.expr("s = 3")).alias("and_bits"), (F.sum(rebuilt) == F.count(F.lit(1))).alias("holds")
    )


def _rollup_sql(levels: list[tuple[str, int]]) -> str:
    parts = " UNION ALL ".join(f"SELECT DISTINCT {cols}, {level}::BIGINT AS level, reg, zeros FROM lf" for cols, level in levels)
    return f"""WITH {_EVENTS}, s AS ({parts}),
n AS (SELECT *, coalesce(day, '-') || '|' || coalesce(event_type, '-') || '|' || level AS key FROM s), {O.cards_cte('n', 'key')}
SELECT DISTINCT day, event_type, level, card FROM n JOIN card USING (key)"""


@query(_rollup_sql([("day, event_type", 0), ("day, NULL::VARCHAR AS event_type", 1), ("NULL::VARCHAR AS day, NULL::VARCHAR AS event_type", 3)]))
def q_rollup_sketch(spark, sf_dir):
    return S.rolled_up(T.day_users(spark, sf_dir, "event_type"), "token", ["day", "event_type"])


@query(_rollup_sql([("day, event_type", 0), ("day, NULL::VARCHAR AS event_type", 1), ("NULL::VARCHAR AS day, event_type", 2), ("NULL::VARCHAR AS day, NULL::VARCHAR AS event_type", 3)]))
def q_cube_sketch(spark, sf_dir):
    return S.rolled_up(T.day_users(spark, sf_dir, "event_type"), "token", ["day", "event_type"], cube=True)


_WINDOWS = "SELECT time_bucket(INTERVAL '3 days', ts, TIMESTAMP '1970-01-01') AS w, CAST(user_id AS VARCHAR) AS token FROM events"


@query(f"WITH {O.long_cte(_WINDOWS, 'w')}, {O.cards_cte('lf', 'w')} SELECT strftime(w, '%Y-%m-%d') AS window_start, card FROM card")
def q_window_sketch(spark, sf_dir):
    events = T.read(spark, sf_dir, "events").select(F.window("ts", "3 days").alias("w"), F.col("user_id").cast("string").alias("token"))
    long = S.long_form(events.select(F.date_format("w.start", "yyyy-MM-dd").alias("window_start"), "token"), "token", "window_start")
    return S.cardinality(long, "window_start")


_SLIDES = """SELECT s AS w, CAST(user_id AS VARCHAR) AS token FROM (SELECT user_id, unnest([time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01') - i * INTERVAL '1 day' FOR i IN [0, 1, 2]]) AS s FROM events)"""


@query(f"WITH {O.long_cte(_SLIDES, 'w')}, {O.cards_cte('lf', 'w')} SELECT strftime(w, '%Y-%m-%d') AS window_start, card FROM card")
def q_sliding_sketch(spark, sf_dir):
    events = T.read(spark, sf_dir, "events").select(F.window("ts", "3 days", "1 day").alias("w"), F.col("user_id").cast("string").alias("token"))
    long = S.long_form(events.select(F.date_format("w.start", "yyyy-MM-dd").alias("window_start"), "token"), "token", "window_start")
    return S.cardinality(long, "window_start")


@query(f"""WITH o AS (SELECT user_id, ts, event_type, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events),
n AS (SELECT user_id, ts, event_type, sum(CASE WHEN prev IS NULL OR ts >= prev + INTERVAL '2 days' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM o),
k AS (SELECT user_id, s, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, list(event_type) AS types FROM n GROUP BY user_id, s),
{O.long_cte("SELECT user_id, session_start, unnest(types) AS token FROM k", "user_id, session_start")}, {O.cards_cte('lf', 'user_id, session_start')}
SELECT user_id, session_start, card FROM card""")
def q_session_sketch(spark, sf_dir):
    events = T.read(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "2 days").alias("w")).agg(F.collect_set("event_type").alias("types"))
    tokens = events.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), F.explode("types").alias("token"))
    return S.cardinality(S.long_form(tokens, "token", "user_id", "session_start"), "user_id", "session_start")
