"""Orders, De Bruijn graphs, rings, stores, retrieval and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing as H
from ..operators import debruijn as D
from ..operators import lattice as L
from ..operators import pairs as P
from ..operators import retrieval as R
from ..operators import ring as G
from ..operators import sketch as S
from ..operators import store as X
from ..operators import tokens as K
from ..operators import transaction as Y
from ..sources import tables as T
from ..streaming import session as Z
from . import oracle as O
from .registry import DAY_USERS, NATION_PARTS, query
from .texts import _LUT, _lut, ngrams_sql, words_sql

_DAYS = O.long_cte(DAY_USERS, "day")
_SO_FAR = f"""WITH {_DAYS}, f AS (SELECT reg, zeros, min(day) AS seen FROM lf GROUP BY ALL), cl AS (SELECT d.day AS set_id, reg, zeros FROM (SELECT DISTINCT day FROM lf) d JOIN f ON f.seen <= d.day), {O.pairs_cte('cl')},
e AS (SELECT a, b, least(1.0, card_ab/card_b) AS tau_forward, least(1.0, card_ab/card_a) AS tau_backward FROM ps WHERE a <> b),
k AS (SELECT *, CASE WHEN tau_backward >= 0.95 AND tau_forward >= 0.95 THEN 'equal' WHEN tau_backward >= 0.95 THEN 'subset' WHEN tau_forward >= 0.95 THEN 'superset' WHEN tau_forward >= 0.9 OR tau_backward >= 0.9 THEN 'overlap' END AS kind FROM e)"""
_ORDER = f"{_SO_FAR}, o AS (SELECT a, b FROM k WHERE kind = 'subset'), w AS (WITH RECURSIVE r(a, b, depth) AS (SELECT a, b, 1 FROM o UNION SELECT r.a, o.b, r.depth + 1 FROM r JOIN o ON o.a = r.b) SELECT a, b, max(depth) AS depth FROM r GROUP BY a, b)"


def _days(spark, sf_dir):
    return S.long_form(T.day_users(spark, sf_dir), "token", "day")


def _order(spark, sf_dir):
    """Each day's users so far: a chain, but for days that bring little."""
    long = _days(spark, sf_dir)
    so_far = long.select("day").distinct().join(S.first_seen(long, "day"), F.col("seen") <= F.col("day")).select(F.col("day").alias("set_id"), "reg", "zeros")
    return L.edges(P.overlaps(so_far))


@query(f"{_SO_FAR} SELECT a, b, tau_forward, tau_backward, kind FROM k WHERE kind IS NOT NULL")
def q_subset_lattice(spark, sf_dir):
    return _order(spark, sf_dir)


@query(f"{_ORDER} SELECT o.a, o.b FROM o JOIN w USING (a, b) WHERE depth = 1")
def q_hasse(spark, sf_dir):
    order = _order(spark, sf_dir).where("kind = 'subset'").transform(T.written)
    return L.hasse(order, L.closure(order))


@query(f"{_ORDER}, n AS (SELECT DISTINCT day AS node FROM lf) SELECT node, coalesce(max(depth), 0)::INT AS level FROM n LEFT JOIN w ON w.b = node GROUP BY node")
def q_levels(spark, sf_dir):
    order = _order(spark, sf_dir).where("kind = 'subset'").transform(T.written)
    return L.levels(_days(spark, sf_dir).select(F.col("day").alias("node")).distinct(), L.closure(order))


@query(f"""{_ORDER}, n AS (SELECT DISTINCT day AS node FROM lf), lv AS (SELECT node, coalesce(max(depth), 0)::INT AS level FROM n LEFT JOIN w ON w.b = node GROUP BY node), h AS (SELECT o.a, o.b FROM o JOIN w USING (a, b) WHERE depth = 1)
SELECT (SELECT max(level) FROM lv) AS height, (SELECT max(c) FROM (SELECT count(*) AS c FROM lv GROUP BY level)) AS width, (SELECT count(*) FROM n WHERE node NOT IN (SELECT a FROM h)) AS tops, (SELECT count(*) FROM n WHERE node NOT IN (SELECT b FROM h)) AS bottoms""")
def q_lattice_shape(spark, sf_dir):
    order = _order(spark, sf_dir).where("kind = 'subset'").transform(T.written)
    reach = L.closure(order)
    lv = L.levels(_days(spark, sf_dir).select(F.col("day").alias("node")).distinct(), reach)
    return L.shape(lv, L.hasse(order, reach))


@query(f"{_ORDER}, h AS (SELECT o.a, o.b FROM o JOIN w USING (a, b) WHERE depth = 1) SELECT 'digraph lattice {{' || chr(10) || string_agg(format('  \"{{}}\" -> \"{{}}\";', a, b), chr(10) ORDER BY a, b) || chr(10) || '}}' AS dot FROM h")
def q_lattice_dot(spark, sf_dir):
    order = _order(spark, sf_dir).where("kind = 'subset'").transform(T.written)
    return L.to_dot(L.hasse(order, L.closure(order)))


_KMERS = f"""ws AS ({words_sql('conversations', 'conv_id')}), km AS (SELECT kmer, count(*) AS multiplicity FROM (SELECT unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))) AS kmer FROM ws WHERE len(w) >= 3) GROUP BY kmer),
ed AS (SELECT string_split(kmer, ' ')[1] || ' ' || string_split(kmer, ' ')[2] AS src, string_split(kmer, ' ')[2] || ' ' || string_split(kmer, ' ')[3] AS dst, string_split(kmer, ' ')[3] AS label, kmer, multiplicity FROM km)"""


def _edges(spark, sf_dir):
    c = T.read(spark, sf_dir, "conversations").select("conv_id", H.words(F.col("text")).alias("w"))
    return D.kmers(c, "w", k=3)


@query(f"WITH {_KMERS}, d AS (SELECT src AS node, multiplicity AS o, 0 AS i FROM ed UNION ALL SELECT dst, 0, multiplicity FROM ed) SELECT node, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree, (sum(o)-sum(i))::BIGINT AS balance FROM d GROUP BY node")
def q_debruijn_degrees(spark, sf_dir):
    return D.degrees(_edges(spark, sf_dir))


@query(f"WITH {_KMERS}, d AS (SELECT src AS node, multiplicity AS o, 0 AS i FROM ed UNION ALL SELECT dst, 0, multiplicity FROM ed), g AS (SELECT node, sum(o)-sum(i) AS b FROM d GROUP BY node) SELECT count(*) AS nodes, count(*) FILTER (b = 1) AS starts, count(*) FILTER (b = -1) AS ends, count(*) FILTER (abs(b) > 1) = 0 AND count(*) FILTER (b = 1) <= 1 AND count(*) FILTER (b = -1) <= 1 AS balanced FROM g")
def q_debruijn_eulerian(spark, sf_dir):
    return D.eulerian(_edges(spark, sf_dir))


@query(f"WITH {_KMERS}, r AS (SELECT src, label, multiplicity, multiplicity/sum(multiplicity) OVER (PARTITION BY src) AS p_next, row_number() OVER (PARTITION BY src ORDER BY multiplicity DESC, label) AS rank FROM ed) SELECT src, rank::INT AS rank, label, p_next FROM r WHERE rank <= 3")
def q_next_tokens(spark, sf_dir):
    return D.next_tokens(_edges(spark, sf_dir), 3)


@query(f"""WITH {_KMERS}, tot AS (SELECT sum(multiplicity) AS t FROM ed), bw AS ({words_sql('conversations', 'conv_id, turn')}),
k AS (SELECT conv_id, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))) AS kmer FROM bw WHERE len(w) >= 3)
SELECT conv_id, count(*) AS kmers, count(*) FILTER (multiplicity IS NULL) AS unseen, round(sum(log2(multiplicity/t)), 4) AS log2_likelihood FROM k LEFT JOIN ed USING (kmer) CROSS JOIN tot GROUP BY conv_id""")
def q_path_likelihood(spark, sf_dir):
    c = T.read(spark, sf_dir, "conversations").select("conv_id", H.words(F.col("text")).alias("w"))
    out = D.log_likelihood(c, "w", "conv_id", _edges(spark, sf_dir), k=3)
    return out.withColumn("log2_likelihood", F.round("log2_likelihood", 4))


@query(f"WITH ws AS ({words_sql('benchmark', 'item_id')}) SELECT item_id, array_to_string(w, ' ') AS sequence, true AS is_eulerian FROM ws")
def q_euler_restore(spark, sf_dir):
    """Each benchmark item's words put back in order from its own trigrams."""
    items = T.read(spark, sf_dir, "benchmark").select("item_id", H.padded(H.words(F.col("text")), 3).alias("w"))
    grams = items.select("item_id", F.posexplode(H.ngrams(F.col("w"), 3)).alias("at", "kmer")).groupBy("item_id", "kmer").agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("multiplicity"))
    parts = F.split("kmer", " ")
    edges = grams.select("item_id", F.concat_ws(" ", parts[0], parts[1]).alias("src"), F.concat_ws(" ", parts[1], parts[2]).alias("dst"), "at", "multiplicity")
    return D.restore(edges, "item_id", "at")


def _ring(spark, sf_dir):
    rows = G.vectors(S.long_form(T.nation_parts(spark, sf_dir), "token", "set_id"), "set_id")
    return rows.withColumn("ring", F.lit("nations"))


@query(f"WITH RECURSIVE {O.long_cte(NATION_PARTS)}, {O.rank_cte('lf', 'set_id', 'set_id')} SELECT 'nations' AS ring, max(rank)::INT AS rank, max(rank)::BIGINT AS bases, count(*) AS vectors FROM rk")
def q_ring_rank(spark, sf_dir):
    return G.rank(_ring(spark, sf_dir), "ring", "set_id").select("ring", "rank", F.col("rank").cast("long").alias("bases"), "vectors")


@query(f"""WITH {_DAYS}, b AS (SELECT day, count(*) AS bits FROM lf GROUP BY day), nb AS (SELECT x.day || '+' || y.day AS set_id, x.day AS p1, y.day AS p2, (SELECT count(*) FROM (SELECT reg, zeros FROM lf WHERE day IN (x.day, y.day) GROUP BY ALL HAVING count(*) = 1)) AS bits
FROM (SELECT day, row_number() OVER (ORDER BY day) AS i FROM b) x JOIN (SELECT day, row_number() OVER (ORDER BY day) AS i FROM b) y ON y.i = x.i + 1) SELECT set_id, bits, [p1, p2] AS expression, true AS exact FROM nb""")
def q_xor_decompose(spark, sf_dir):
    """The XOR of neighbouring days is found as the sum of the two, exactly."""
    long = _days(spark, sf_dir)
    days = long.select("day").distinct()
    from pyspark.sql import Window as W

    neighbours = days.withColumn("next", F.lead("day").over(W.orderBy("day"))).where("next IS NOT NULL")
    both = neighbours.select(F.concat_ws("+", "day", "next").alias("set_id"), F.explode(F.array("day", "next")).alias("day"))
    sums = S.xor_all(both.join(long, "day").select("set_id", "reg", "zeros"), "set_id")
    base = G.vectors(long.withColumnRenamed("day", "set_id"), "set_id").withColumn("o", F.lit(0))
    rows = base.unionByName(G.vectors(sums, "set_id").withColumn("o", F.lit(1))).select(F.lit("days").alias("ring"), "set_id", "bits", F.concat_ws("/", "o", "set_id").alias("o"))
    d = G.decompose(rows, "ring", "set_id", "o").where("NOT is_base")
    rebuilt = G.reconstruct(d, rows, "set_id").groupBy("set_id").agg(F.array_sort(F.collect_list("bit")).alias("rebuilt"))
    out = d.join(rows.select("set_id", "bits"), "set_id").join(rebuilt, "set_id")
    return out.select("set_id", F.size("bits").cast("long").alias("bits"), F.array_sort("expression").alias("expression"), (F.col("bits") == F.col("rebuilt")).alias("exact"))


@query(f"""WITH {_LUT}, m AS (SELECT DISTINCT item_id, reg, zeros FROM ng JOIN p ON p.token = ng.ngram WHERE layer = 0 AND zeros IS NOT NULL), q AS (SELECT reg, zeros FROM m WHERE item_id = (SELECT min(item_id) FROM m)),
kn AS (SELECT DISTINCT q.reg, q.zeros FROM q SEMI JOIN lut ON lut.reg = q.reg AND lut.zeros = q.zeros), {O.cards_cte('m', 'item_id')}, h AS (SELECT item_id, count(*) AS overlap FROM m SEMI JOIN kn ON kn.reg = m.reg AND kn.zeros = m.zeros GROUP BY item_id)
SELECT item_id, overlap, card FROM h JOIN card USING (item_id) WHERE card BETWEEN 5 AND 1000""")
def q_ring_search(spark, sf_dir):
    items = T.read(spark, sf_dir, "benchmark").select("item_id", F.explode(H.words(F.col("text"))).alias("token"))
    members = S.long_form(items, "token", "item_id")
    first = members.agg(F.min("item_id")).first()[0]
    q = members.where(F.col("item_id") == first).select("reg", "zeros")
    return G.search(q, _lut(spark, sf_dir), members, "item_id", 5, 1000)


@query("""WITH d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, list_sort(list(DISTINCT CAST(user_id AS VARCHAR))) AS ids FROM events GROUP BY day), n AS (SELECT day, ids, lag(ids) OVER (ORDER BY day) AS old FROM d)
SELECT day, list_sort(list_filter(ids, lambda x: NOT list_contains(old, x))) AS added, list_sort(list_filter(old, lambda x: NOT list_contains(ids, x))) AS removed, list_sort(list_filter(ids, lambda x: list_contains(old, x))) AS shared, (len(ids) - len(old))::INT AS rank_delta FROM n WHERE old IS NOT NULL""")
def q_w_diff(spark, sf_dir):
    from pyspark.sql import Window as W

    days = T.day_users(spark, sf_dir).groupBy("day").agg(F.array_sort(F.collect_set("token")).alias("ids"))
    both = days.withColumn("old", F.lag("ids").over(W.orderBy("day"))).where("old IS NOT NULL")
    return G.snapshot_diff(both.select("day", F.col("old").alias("ids")), both.select("day", "ids"), "day")


@query(f"""WITH RECURSIVE {_DAYS}, {O.rank_cte('lf', 'day', 'day')}, u AS (SELECT DISTINCT reg, zeros FROM lf),
b AS (SELECT (reg*32+zeros)//8 AS i, sum(1::BIGINT << ((reg*32+zeros)%8)) AS v FROM u GROUP BY ALL), f AS (SELECT range AS i, coalesce(v, 0)::INT AS v FROM range({O.M * 4}) LEFT JOIN b ON b.i = range)
SELECT max(rank)::INT AS rank, count(*) FILTER (is_base) AS bases, count(*) AS batches, (SELECT sha1(unhex(string_agg(printf('%02x', v), '' ORDER BY i))) FROM f) AS name, (SELECT count(*) FROM u) AS bits FROM rk""")
def q_transaction(spark, sf_dir):
    """Days' users ingested into a draft: ranks, then the committed union's name."""
    draft = Y.Transaction().ingest(T.day_users(spark, sf_dir).withColumnRenamed("day", "batch"))
    ranks = draft.ranks().agg(F.max("rank").alias("rank"), F.sum("rank_delta").cast("long").alias("bases"), F.count(F.lit(1)).alias("batches"))
    return ranks.crossJoin(draft.commit().select("name", F.bitmap_count("bitmap").alias("bits")))


def _entries(spark, sf_dir):
    nation = T.read(spark, sf_dir, "nation").select(F.col("n_name").alias("set_id"), "n_nationkey", "n_regionkey")
    cards = S.cardinality(S.long_form(T.nation_parts(spark, sf_dir), "token", "set_id"), "set_id")
    return cards.join(nation, "set_id").select(
        F.col("set_id").alias("id"), F.concat(F.lit("region-"), F.col("n_regionkey").cast("string")).alias("source"),
        F.array(F.when(F.col("n_nationkey") % 2 == 0, "even").otherwise("odd"), F.concat(F.lit("k"), (F.col("n_nationkey") % 3).cast("string"))).alias("tags"),
        F.col("n_nationkey").cast("long").alias("created"), (F.col("n_nationkey") % 3).cast("int").alias("layer"), F.lit(True).alias("is_base"), "card",
    )


_ENTRIES = f"""WITH {O.long_cte(NATION_PARTS)}, {O.cards_cte()}, en AS (SELECT set_id AS id, 'region-' || n_regionkey AS source, [CASE WHEN n_nationkey % 2 = 0 THEN 'even' ELSE 'odd' END, 'k' || (n_nationkey % 3)] AS tags, n_nationkey::BIGINT AS created, (n_nationkey % 3)::INT AS layer, card FROM card JOIN nation ON n_name = set_id)"""


@query(f"""{_ENTRIES} SELECT * FROM (SELECT 'source' AS q, id, created FROM (SELECT * FROM en WHERE source = 'region-1' ORDER BY created DESC, id LIMIT 100)) UNION ALL SELECT * FROM (SELECT 'tags', id, created FROM en WHERE list_has_any(tags, ['k1']) ORDER BY created DESC, id LIMIT 5)
UNION ALL SELECT * FROM (SELECT 'all tags', id, created FROM en WHERE list_has_all(tags, ['odd', 'k2']) ORDER BY created DESC, id LIMIT 100) UNION ALL SELECT * FROM (SELECT 'time', id, created FROM en WHERE created BETWEEN 5 AND 12 ORDER BY created DESC, id LIMIT 4)
UNION ALL SELECT * FROM (SELECT 'layer', id, created FROM en WHERE layer = 2 ORDER BY created DESC, id LIMIT 100) UNION ALL SELECT * FROM (SELECT 'card', id, created FROM en WHERE card BETWEEN 100 AND 100000 ORDER BY card DESC, id LIMIT 7)""")
def q_catalog_query(spark, sf_dir):
    e = _entries(spark, sf_dir)
    parts = [
        ("source", X.by_source(e, "region-1")), ("tags", X.by_tags(e, ["k1"], limit=5)), ("all tags", X.by_tags(e, ["odd", "k2"], every=True)),
        ("time", X.by_time(e, 5, 12, limit=4)), ("layer", X.by_layer(e, 2)), ("card", X.by_cardinality(e, 100, 100000, limit=7)),
    ]
    out = None
    for name, df in parts:
        one = df.select(F.lit(name).alias("q"), "id", "created")
        out = one if out is None else out.unionByName(one)
    return out


def _derivations(spark, sf_dir):
    """A compound for each nation's parent region, one for each pair of regions in a row, one on top."""
    n = T.read(spark, sf_dir, "nation")
    r = n.groupBy(F.concat(F.lit("region-"), F.col("n_regionkey").cast("string")).alias("id")).agg(F.array_sort(F.collect_list("n_name")).alias("operands"))
    keys = T.read(spark, sf_dir, "region").select("r_regionkey")
    p = keys.select(F.concat(F.lit("pair-"), F.col("r_regionkey").cast("string")).alias("id"), F.array(F.concat(F.lit("region-"), F.col("r_regionkey").cast("string")), F.concat(F.lit("region-"), ((F.col("r_regionkey") + 1) % 5).cast("string"))).alias("operands"))
    top = keys.agg(F.array_sort(F.collect_list(F.concat(F.lit("pair-"), F.col("r_regionkey").cast("string")))).alias("operands")).select(F.lit("all").alias("id"), "operands")
    return r.unionByName(p).unionByName(top)


@query("""WITH RECURSIVE d(id, operand) AS (SELECT 'region-' || n_regionkey, n_name FROM nation UNION ALL SELECT 'pair-' || r_regionkey, 'region-' || r_regionkey FROM region UNION ALL SELECT 'pair-' || r_regionkey, 'region-' || ((r_regionkey + 1) % 5) FROM region UNION ALL SELECT 'all', 'pair-' || r_regionkey FROM region),
w(id, ancestor, depth) AS (SELECT id, operand, 1 FROM d UNION SELECT w.id, d.operand, w.depth + 1 FROM w JOIN d ON d.id = w.ancestor)
SELECT id, list_sort(list(DISTINCT ancestor)) AS bases, max(depth)::INT AS depth FROM w WHERE ancestor NOT IN (SELECT id FROM d) GROUP BY id""")
def q_lineage(spark, sf_dir):
    return X.bases(_derivations(spark, sf_dir))


@query("SELECT n_name AS id FROM nation WHERE n_regionkey NOT IN (0, 1, 2) AND n_nationkey % 5 <> 0")
def q_unreferenced(spark, sf_dir):
    """Nations that neither a compound of the first three regions nor a ring names."""
    n = T.read(spark, sf_dir, "nation").select(F.col("n_name").alias("id"), "n_nationkey", "n_regionkey", F.lit(True).alias("is_base"))
    compounds = n.where("n_regionkey < 3").groupBy("n_regionkey").agg(F.collect_list("id").alias("operands"))
    ring = n.where("n_nationkey % 5 = 0").agg(F.collect_list("id").alias("ids"))
    return X.unreferenced(n, compounds, ring).select("id")


_MONTHS = "SELECT strftime(o_orderdate, '%Y-%m') AS month, CAST(o_custkey AS VARCHAR) AS token FROM orders"
_COMMITS = f"""WITH {O.long_cte(_MONTHS, 'month')}, f AS (SELECT reg, zeros, min(month) AS month FROM lf GROUP BY ALL), d AS (SELECT DISTINCT month FROM lf),
g AS (SELECT d.month, z.range AS zeros, count(f.reg) AS n FROM d CROSS JOIN range({H.BITS}) z LEFT JOIN f ON f.month = d.month AND f.zeros = z.range GROUP BY ALL),
c AS (SELECT month, zeros, n, sum(n) OVER (PARTITION BY zeros ORDER BY month)::BIGINT AS c FROM g), {O.card_cte('c', 'month', 'sc', 'state_card')}, {O.card_cte('g', 'month', 'dc', 'delta_card', 'n')},
cm AS (SELECT row_number() OVER (ORDER BY month)::INT AS seq, month, state_card, delta_card FROM sc JOIN dc USING (month))"""


def _commits(spark, sf_dir):
    o = T.read(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_custkey").cast("string").alias("token"))
    return X.commits(S.long_form(o, "token", "month"), "month")


@query(f"{_COMMITS} SELECT seq, month, state_card, delta_card FROM cm")
def q_commits(spark, sf_dir):
    return _commits(spark, sf_dir)


@query(f"{_COMMITS} SELECT avg(delta_card) AS rate FROM (SELECT delta_card FROM cm ORDER BY seq DESC LIMIT 5)")
def q_evolution_rate(spark, sf_dir):
    return X.evolution_rate(_commits(spark, sf_dir))


@query("""WITH RECURSIVE c(id, parent) AS (SELECT n_nationkey, CASE WHEN n_nationkey > 0 THEN (n_nationkey - 1) // 2 END FROM nation), u(id, ancestor, distance) AS (SELECT id, id, 0 FROM c UNION ALL SELECT u.id, c.parent, u.distance + 1 FROM u JOIN c ON c.id = u.ancestor WHERE c.parent IS NOT NULL)
SELECT x.ancestor, x.distance::INT AS from_x, y.distance::INT AS from_y FROM u x JOIN u y USING (ancestor) WHERE x.id = 17 AND y.id = 20 ORDER BY x.distance + y.distance, ancestor LIMIT 1""")
def q_common_ancestor(spark, sf_dir):
    k = F.col("n_nationkey")
    links = T.read(spark, sf_dir, "nation").select(k.alias("id"), F.when(k > 0, F.floor((k - 1) / 2).cast("int")).alias("parent"))
    return X.common_ancestor(links, 17, 20)


_QUERY_TEXT = "SELECT lower(text) AS text FROM benchmark WHERE item_id = (SELECT min(item_id) FROM benchmark)"
_RELEVANCE = f"""WITH qt AS (SELECT 'query' AS set_id, unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS token FROM ({_QUERY_TEXT})), dt AS (SELECT DISTINCT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')) AS token FROM benchmark),
tk AS (SELECT token FROM qt UNION SELECT token FROM dt), {O.hash_cte('tk')}, q AS (SELECT DISTINCT set_id, reg, zeros FROM qt JOIN p USING (token) WHERE zeros IS NOT NULL), dl AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS set_id, reg, zeros FROM dt JOIN p USING (token) WHERE zeros IS NOT NULL), {O.pairs_cte('q', 'dl')}"""


def _query_and_items(spark, sf_dir):
    b = T.read(spark, sf_dir, "benchmark")
    first = b.agg(F.min("item_id")).first()[0]
    q = R.encode(b.where(F.col("item_id") == first).select(F.lit("query").alias("set_id"), "text"), "text", "set_id")
    return q, R.encode(b.select(F.col("item_id").cast("string").alias("set_id"), "text"), "text", "set_id")


@query(f"{_RELEVANCE} SELECT b AS item, card_ab/card_a AS forward, card_ab/card_b AS reverse, CASE WHEN card_ab > 0 THEN 2*(card_ab/card_a)*(card_ab/card_b)/(card_ab/card_a + card_ab/card_b) ELSE 0.0 END AS score FROM ps WHERE card_a >= 1 AND card_b >= 1")
def q_retrieval_relevance(spark, sf_dir):
    q, items = _query_and_items(spark, sf_dir)
    return R.relevance(P.overlaps(q, items)).select(F.col("b").alias("item"), "forward", "reverse", "score")


@query(f"{_RELEVANCE}, s AS (SELECT b, CASE WHEN card_ab > 0 THEN 2*(card_ab/card_a)*(card_ab/card_b)/(card_ab/card_a + card_ab/card_b) ELSE 0.0 END AS score, card_ab/card_a AS forward FROM ps), x AS (SELECT reg, zeros FROM q UNION SELECT dl.reg, dl.zeros FROM dl JOIN s ON s.b = dl.set_id WHERE score > 0.3 OR forward > 0.3) SELECT reg, zeros FROM x")
def q_expand_query(spark, sf_dir):
    q, items = _query_and_items(spark, sf_dir)
    return R.expand(q, items, R.relevance(P.overlaps(q, items)), "set_id")


_CONTEXT = f"""WITH {_DAYS}, q AS (SELECT reg, zeros FROM lf WHERE day = (SELECT min(day) FROM lf)), dp AS (SELECT day, (row_number() OVER (ORDER BY day DESC) - 1)::INT AS depth FROM (SELECT DISTINCT day FROM lf)), lv AS (SELECT depth, day, lf.reg, lf.zeros, q.reg AS q FROM lf JOIN dp USING (day) LEFT JOIN q ON q.reg = lf.reg AND q.zeros = lf.zeros WHERE depth <= 10),
{O.cards_cte('q', '', 'qc', 'qcard')}, lz AS (SELECT depth, zeros, count(*) AS c, count(q) AS cq FROM lv GROUP BY ALL), {O.card_cte('lz', 'depth', 'lc', 'level_card')}, {O.card_cte('lz', 'depth', 'oc', 'overlap', 'cq')},
s AS (SELECT depth, level_card, overlap, overlap/qcard AS tau, 1 - overlap/level_card AS rho, level_card >= 1 AND (overlap/qcard >= 0.3 OR overlap >= 1) AS accepted FROM lc JOIN oc USING (depth) CROSS JOIN qc),
fs AS (SELECT reg, zeros, min(depth) AS depth FROM lv SEMI JOIN (SELECT depth FROM s WHERE accepted) a ON a.depth = lv.depth WHERE q IS NULL GROUP BY reg, zeros UNION ALL SELECT reg, zeros, -1 FROM q),
g AS (SELECT d.depth, z.range AS zeros, count(fs.reg) AS n FROM (SELECT depth FROM s UNION SELECT -1) d CROSS JOIN range({H.BITS}) z LEFT JOIN fs ON fs.depth = d.depth AND fs.zeros = z.range GROUP BY ALL), c AS (SELECT depth, zeros, sum(n) OVER (PARTITION BY zeros ORDER BY depth)::BIGINT AS c FROM g), {O.card_cte('c', 'depth', 'tc', 'total')},
fx AS (SELECT depth, total - lag(total) OVER (ORDER BY depth) AS flux FROM tc), r AS (SELECT depth, flux, count(flux) OVER w = 3 AND max(abs(flux)) OVER w < 1 AS still FROM fx WHERE depth >= 0 WINDOW w AS (ORDER BY depth ROWS 2 PRECEDING)),
t AS (SELECT *, coalesce(bool_or(still) OVER (ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS stopped FROM r)"""


@query(f"{_CONTEXT} SELECT depth, day, tau, rho, accepted, flux, still AS stops_here FROM s JOIN t USING (depth) JOIN dp USING (depth) WHERE NOT stopped")
def q_collect_context(spark, sf_dir):
    """The first day's users looked for in the days from the last one back."""
    long = _days(spark, sf_dir)
    first = long.agg(F.min("day")).first()[0]
    return R.collect_context(long.where(F.col("day") == first).select("reg", "zeros"), long, "day")


_COLD = "overlap >= 1) AND overlap/qcard > 0.5 AND NOT (overlap/qcard < 0.3 AND 1 - overlap/level_card > 0.7) AS accepted"


@query(f"{_CONTEXT} SELECT depth, day, tau, rho, accepted, flux, still AS stops_here FROM s JOIN t USING (depth) JOIN dp USING (depth) WHERE NOT stopped".replace("overlap >= 1) AS accepted", _COLD))
def q_forward(spark, sf_dir):
    long = _days(spark, sf_dir)
    first = long.agg(F.min("day")).first()[0]
    return R.forward(long.where(F.col("day") == first).select("reg", "zeros"), long, "day")


@query(f"""WITH {_DAYS}, {O.pairs_cte('lf', key='day')}, t AS (SELECT a, b, {O.TAU} AS tau FROM ps WHERE a <> b), n AS (SELECT a, b, tau, tau/sum(tau) OVER (PARTITION BY a) AS p FROM t WHERE tau > 0) SELECT a, b, tau, p FROM n WHERE p >= 0.03""")
def q_retrieval_chain(spark, sf_dir):
    return R.chain(P.overlaps(_days(spark, sf_dir), key="day"), 0.03)


@query(f"""WITH {_DAYS}, {O.pairs_cte('lf', key='day')}, t AS (SELECT a, b, {O.TAU} AS tau FROM ps WHERE a <> b), n AS (SELECT a, b, tau, tau/sum(tau) OVER (PARTITION BY a) AS p FROM t WHERE tau > 0) SELECT b AS node, sum(tau) AS centrality FROM n WHERE p >= 0.03 GROUP BY b""")
def q_centrality(spark, sf_dir):
    return R.centrality(R.chain(P.overlaps(_days(spark, sf_dir), key="day"), 0.03))


_CONV = f"WITH {ngrams_sql('conversations', 'conv_id')}, {O.hash_cte('ng', 'ngram')}, lf AS (SELECT DISTINCT layer, reg, zeros FROM ng JOIN p ON p.token = ng.ngram WHERE zeros IS NOT NULL)"


def _folder(spark) -> str:
    """A folder that driver and executors share, for a stream's files."""
    return T.new_path(spark, "session")


@query(f"{_CONV}, {O.cards_cte('lf', 'layer')}, n AS (SELECT layer, count(*) AS tokens FROM ng JOIN p ON p.token = ng.ngram WHERE zeros IS NOT NULL GROUP BY layer) SELECT layer, card, tokens FROM card JOIN n USING (layer)")
def q_stream_checkpoint_commit(spark, sf_dir):
    """Conversations' n-grams through a stream of several micro-batches, then committed."""
    folder = _folder(spark)
    T.read(spark, sf_dir, "conversations").repartition(3).write.parquet(f"{folder}/in")
    raw = Z.token_stream(spark, f"{folder}/in", "conv_id long, turn long, role string, text string", per_trigger=1)
    stream = K.text_ngrams(raw.repartition(spark.sparkContext.defaultParallelism), "text")
    session = Z.Session(spark, f"{folder}/session")
    session.run(stream).awaitTermination()
    packed, lut = session.commit()
    return S.cardinality(S.unpack(packed, "layer"), "layer").join(lut.groupBy("layer").agg(F.sum("tf").alias("tokens")), "layer")


@query(f"WITH {O.long_cte('SELECT date_trunc(' + chr(39) + 'day' + chr(39) + ', ts) AS w, CAST(user_id AS VARCHAR) AS token FROM events', 'w')}, {O.cards_cte('lf', 'w')} SELECT strftime(w, '%Y-%m-%d') AS window_start, card FROM card")
def q_stream_windows(spark, sf_dir):
    """Daily sketches of the event stream under a watermark longer than its disorder."""
    folder = _folder(spark)
    events = T.read(spark, sf_dir, "events").select("ts", F.col("user_id").cast("string").alias("token"))
    events.coalesce(1).write.parquet(f"{folder}/in")
    stream = Z.token_stream(spark, f"{folder}/in", "ts timestamp, token string")
    out = Z.windowed_positions(stream, "ts", "token", late="60 days").select(F.date_format("window.start", "yyyy-MM-dd").alias("window_start"), "bitmap")
    keep = lambda df, _: df.write.mode("overwrite").parquet(f"{folder}/out")
    out.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start().awaitTermination()
    return S.cardinality(S.unpack(spark.read.parquet(f"{folder}/out"), "window_start"), "window_start")
