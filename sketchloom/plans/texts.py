"""Token tables, registries and disambiguation over the text tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing as H
from ..operators import sketch as S
from ..operators import tokens as K
from ..sources import tables as T
from . import oracle as O
from .registry import query


def words_sql(table: str, key: str, lower: bool = False) -> str:
    text = "lower(text)" if lower else "text"
    return f"SELECT {key}, list_filter(regexp_split_to_array({text}, '\\s+'), lambda w: w <> '') AS w FROM {table}"


def ngrams_sql(table: str, key: str, lower: bool = False) -> str:
    """(key, layer, ngram) of runs of 1 to 3 words."""
    runs = " UNION ALL ".join(
        f"SELECT {key}, {n - 1} AS layer, unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i+{n - 1}], ' '))) AS ngram FROM ws WHERE len(w) >= {n}"
        for n in (1, 2, 3)
    )
    return f"ws AS ({words_sql(table, key, lower)}), ng AS ({runs})"


def _ngrams(spark, sf_dir, table, key):
    docs = T.read(spark, sf_dir, table).select(F.col(key), H.words(F.col("text")).alias("w"))
    return K.ngram_rows(docs, "w", key)


_BENCH = f"{ngrams_sql('benchmark', 'item_id')}, {O.hash_cte('ng', 'ngram')}"
_LUT = f"""{_BENCH}, cnt AS (SELECT layer, ngram, count(*) AS tf FROM ng GROUP BY ALL),
lut AS (SELECT layer, h AS hash, reg, zeros, list_sort(list(ngram)) AS ngrams, list_sort(list_distinct(list(split_part(ngram, ' ', 1)))) AS first_tokens, sum(tf)::BIGINT AS tf, count(*)::INT AS collisions
FROM cnt JOIN p ON p.token = cnt.ngram WHERE zeros IS NOT NULL GROUP BY ALL)"""


def _lut(spark, sf_dir):
    return K.build_lut(_ngrams(spark, sf_dir, "benchmark", "item_id"))


@query(f"""WITH ws AS ({words_sql('documents', 'doc_id')}), tk AS (SELECT DISTINCT unnest(w) AS token FROM ws), {O.hash_cte('tk')} SELECT token, reg, zeros FROM p WHERE zeros IS NOT NULL""")
def q_hash_document_words(spark, sf_dir):
    docs = T.read(spark, sf_dir, "documents").select(F.explode(H.words(F.col("text"))).alias("token"))
    return S.positions(docs.distinct(), "token").select("token", "reg", "zeros")


@query(f"""WITH {ngrams_sql('documents', 'doc_id')}, {O.hash_cte('ng', 'ngram')},
lf AS (SELECT DISTINCT layer, reg, zeros FROM ng JOIN p ON p.token = ng.ngram WHERE zeros IS NOT NULL), {O.cards_cte('lf', 'layer')},
n AS (SELECT layer, count(*) AS occurrences FROM ng GROUP BY layer) SELECT layer, card, occurrences FROM card JOIN n USING (layer)""")
def q_ngram_registry(spark, sf_dir):
    """The universes of the documents' n-grams, counted as their bytes stream by."""
    bits = K.text_positions(T.read(spark, sf_dir, "documents"), "text", max_n=3)
    card = S.cardinality(bits.select("layer", "reg", "zeros"), "layer")
    return card.join(bits.groupBy("layer").agg(F.sum("n").alias("occurrences")), "layer")


@query(f"""WITH ws AS ({words_sql('documents', 'lang')}), tk AS (SELECT lang AS set_id, unnest(w) AS token FROM ws), {O.hash_cte('tk')},
lf AS (SELECT DISTINCT set_id, reg, zeros FROM tk JOIN p USING (token) WHERE zeros IS NOT NULL),
u AS (SELECT DISTINCT reg, zeros FROM lf WHERE set_id = 'en'), {O.cards_cte('u', '', 'us')}, {O.cards_cte()},
i AS (SELECT set_id, zeros, count(*) AS c FROM lf SEMI JOIN u ON lf.reg = u.reg AND lf.zeros = u.zeros GROUP BY ALL), {O.card_cte('i', 'set_id', 'ci', 'inside')},
o AS (SELECT set_id, zeros, count(*) AS c FROM lf ANTI JOIN u ON lf.reg = u.reg AND lf.zeros = u.zeros GROUP BY ALL), {O.card_cte('o', 'set_id', 'co', 'outside')}
SELECT set_id, card.card, least(1.0::DOUBLE, coalesce(inside, 0)/us.card) AS coverage, least(1.0::DOUBLE, coalesce(outside, 0)/card.card) AS novelty
FROM card LEFT JOIN ci USING (set_id) LEFT JOIN co USING (set_id) CROSS JOIN us""")
def q_coverage_novelty(spark, sf_dir):
    """Each language's words against the English universe."""
    docs = T.read(spark, sf_dir, "documents").select(F.col("lang").alias("set_id"), "text")
    long = K.text_positions(docs, "text", "set_id").select("set_id", "reg", "zeros")
    return K.coverage_novelty(long, long.where("set_id = 'en'").select("reg", "zeros"), "set_id")


@query(f"WITH {_LUT} SELECT layer, reg, zeros, ngrams, first_tokens, tf, collisions FROM lut")
def q_lut_build(spark, sf_dir):
    return _lut(spark, sf_dir).select("layer", "reg", "zeros", "ngrams", "first_tokens", "tf", "collisions")


@query(f"""WITH {_LUT}, a AS (SELECT reg, zeros, count(*) AS n FROM lut GROUP BY ALL)
SELECT sum(n)::BIGINT AS entries, count(*) AS positions, count(*) FILTER (n > 1)/count(*) AS collision_rate, max(n) AS max_depth FROM a""")
def q_lut_collisions(spark, sf_dir):
    return K.lut_stats(_lut(spark, sf_dir))


@query(f"""WITH {_LUT} SELECT layer, reg, zeros, count(*) AS entries FROM lut GROUP BY ALL HAVING count(*) >= 2 ORDER BY entries DESC, layer, reg, zeros LIMIT 20""")
def q_lut_topk(spark, sf_dir):
    return K.high_collisions(K.at_positions(_lut(spark, sf_dir)), 2, 20)


_ITEM = "q AS (SELECT DISTINCT reg, zeros FROM ng JOIN p ON p.token = ng.ngram WHERE item_id = (SELECT min(item_id) FROM benchmark) AND layer = 0 AND zeros IS NOT NULL)"


def _first_item(spark, sf_dir):
    b = T.read(spark, sf_dir, "benchmark")
    first = b.agg(F.min("item_id").alias("item_id"))
    words = b.join(F.broadcast(first), "item_id").select(F.explode(H.words(F.col("text"))).alias("token"))
    return S.long_form(words, "token")


@query(f"WITH {_LUT}, {_ITEM} SELECT layer, reg, zeros, ngrams, collisions FROM lut JOIN q USING (reg, zeros) WHERE layer = 1")
def q_candidates(spark, sf_dir):
    """Bigrams at the positions of one item's sketch."""
    return K.lookup(_lut(spark, sf_dir), _first_item(spark, sf_dir), layer=1).select("layer", "reg", "zeros", "ngrams", "collisions")


@query(f"WITH {_LUT}, {_ITEM}, s AS (SELECT DISTINCT reg, zeros FROM lut WHERE layer = 2) SELECT count(*) AS positions, count(s.reg) AS with_trigrams, count(*) - count(s.reg) AS orphans FROM q LEFT JOIN s USING (reg, zeros)")
def q_lut_orphans(spark, sf_dir):
    positions = _first_item(spark, sf_dir)
    trigrams = _lut(spark, sf_dir).where("layer = 2").select("reg", "zeros").distinct().withColumn("hit", F.lit(1))
    return positions.join(trigrams, ["reg", "zeros"], "left").agg(
        F.count(F.lit(1)).alias("positions"), F.count("hit").alias("with_trigrams"), (F.count(F.lit(1)) - F.count("hit")).alias("orphans")
    )


@query(f"""WITH {_LUT}, u AS (SELECT DISTINCT layer, reg, unnest(ngrams) AS ngram, unnest(first_tokens) AS f FROM lut),
l0 AS (SELECT DISTINCT reg, ngram AS t FROM u WHERE layer = 0), l1 AS (SELECT DISTINCT reg, unnest(first_tokens) AS t FROM lut WHERE layer = 1), l2 AS (SELECT DISTINCT reg, unnest(first_tokens) AS t FROM lut WHERE layer = 2),
s1 AS (SELECT l0.* FROM l0 WHERE NOT EXISTS (SELECT 1 FROM l1 WHERE l1.reg = l0.reg) OR EXISTS (SELECT 1 FROM l1 WHERE l1.reg = l0.reg AND l1.t = l0.t)),
s2 AS (SELECT s1.* FROM s1 WHERE NOT EXISTS (SELECT 1 FROM l2 WHERE l2.reg = s1.reg) OR EXISTS (SELECT 1 FROM l2 WHERE l2.reg = s1.reg AND l2.t = s1.t)),
r AS (SELECT DISTINCT reg FROM lut), n0 AS (SELECT reg, count(*) AS c FROM l0 GROUP BY reg), n1 AS (SELECT reg, count(*) AS c FROM s1 GROUP BY reg), n2 AS (SELECT reg, count(*) AS c, list_sort(list(t)) AS t FROM s2 GROUP BY reg)
SELECT r.reg, coalesce(n0.c, 0)::INT AS initial, coalesce(n1.c, 0)::INT AS after_layer1, coalesce(n2.t, []::VARCHAR[]) AS surviving, CASE WHEN n2.c > 0 THEN 1.0::DOUBLE/n2.c ELSE 0.0 END AS confidence
FROM r LEFT JOIN n0 USING (reg) LEFT JOIN n1 USING (reg) LEFT JOIN n2 USING (reg)""")
def q_register_filter(spark, sf_dir):
    return K.register_filter(_lut(spark, sf_dir)).withColumn("surviving", F.array_sort("surviving"))


_TRIANGULATE = f"""WITH {_LUT}, {_ITEM},
f AS (SELECT q.reg, q.zeros, layer, ngrams, first_tokens FROM q LEFT JOIN lut USING (reg, zeros)),
g AS (SELECT reg, zeros, layer, unnest(ngrams) AS ngram FROM f),
a AS (SELECT reg, zeros, count(DISTINCT layer) AS nl, list_sort(list(DISTINCT ngram)) AS al FROM g GROUP BY ALL),
t AS (SELECT DISTINCT reg, zeros, layer, unnest(CASE WHEN layer = 0 THEN ngrams ELSE first_tokens END) AS t FROM f),
v AS (SELECT reg, zeros, t, count(*) AS c FROM t GROUP BY ALL),
k AS (SELECT a.reg, a.zeros, nl, al, list(t) FILTER (c = nl) AS ka, list(t) FILTER (c*2 >= nl) AS kh FROM a JOIN v USING (reg, zeros) GROUP BY ALL),
m AS (SELECT reg, zeros, nl, al, CASE WHEN nl > 1 THEN list_filter(al, lambda x: list_has_any(string_split(x, ' '), CASE WHEN len(ka) > 0 THEN ka ELSE kh END)) END AS na FROM k)"""


@query(f"""{_TRIANGULATE}, z AS (SELECT *, CASE WHEN len(al) = 0 THEN 'no_candidates' WHEN len(al) = 1 THEN 'exact' WHEN nl > 1 AND len(na) > 0 THEN 'triangulated' ELSE 'best_guess' END AS method FROM m)
SELECT reg, zeros, CASE WHEN method = 'triangulated' THEN na ELSE al END AS candidates,
CASE method WHEN 'exact' THEN 1.0 WHEN 'triangulated' THEN nl/3.0::DOUBLE WHEN 'best_guess' THEN 1.0::DOUBLE/len(al) ELSE 0.0 END AS confidence, method FROM z""")
def q_triangulate(spark, sf_dir):
    return K.disambiguate(_lut(spark, sf_dir), _first_item(spark, sf_dir))


@query(f"""WITH bw AS (SELECT DISTINCT item_id, unnest(w) AS token FROM ({words_sql('benchmark', 'item_id')})),
dw AS (SELECT DISTINCT lang, unnest(w) AS token FROM ({words_sql('documents', 'lang')})),
tk AS (SELECT token FROM bw UNION SELECT token FROM dw), {O.hash_cte('tk')},
b AS (SELECT DISTINCT item_id, reg, zeros FROM bw JOIN p USING (token) WHERE zeros IS NOT NULL),
u AS (SELECT DISTINCT lang, reg, zeros FROM dw JOIN p USING (token) WHERE zeros IS NOT NULL)
SELECT item_id, lang, count(*) AS bits_found, any_value(n) AS bits FROM b JOIN (SELECT item_id, count(*) AS n FROM b GROUP BY ALL) USING (item_id) JOIN u USING (reg, zeros) GROUP BY item_id, lang""")
def q_contamination(spark, sf_dir):
    """Bits of each benchmark item's sketch found among each language's documents."""
    items = T.read(spark, sf_dir, "benchmark").select("item_id", F.explode(H.words(F.col("text"))).alias("token"))
    u = K.text_positions(T.read(spark, sf_dir, "documents"), "text", "lang").select("lang", "reg", "zeros")
    b = S.long_form(items, "token", "item_id")
    found = b.join(u, ["reg", "zeros"]).groupBy("item_id", "lang").agg(F.count(F.lit(1)).alias("bits_found"))
    return found.join(b.groupBy("item_id").agg(F.count(F.lit(1)).alias("bits")), "item_id")


@query(f"""WITH {_BENCH}, lf AS (SELECT DISTINCT layer, reg, zeros FROM ng JOIN p ON p.token = ng.ngram WHERE zeros IS NOT NULL),
b AS (SELECT layer, (reg*32+zeros)//8 AS i, sum(1::BIGINT << ((reg*32+zeros)%8)) AS v FROM lf GROUP BY ALL), f AS (SELECT l.layer, range AS i, coalesce(v, 0)::INT AS v FROM (SELECT DISTINCT layer FROM lf) l CROSS JOIN range({O.M * 4}) LEFT JOIN b ON b.layer = l.layer AND b.i = range)
SELECT sha1(unhex(string_agg(printf('%02x', v), '' ORDER BY layer, i))) AS snapshot, count(DISTINCT layer) AS layers FROM f""")
def q_registry_snapshot(spark, sf_dir):
    """Merging a registry with itself leaves it as it is."""
    packed = S.build(_ngrams(spark, sf_dir, "benchmark", "item_id"), "ngram", "layer")
    return K.snapshot(K.merge_registries(packed, packed))


@query(f"""WITH {_LUT}, {_ITEM} SELECT 'unigrams' AS stage, layer, reg, zeros, ngrams FROM lut JOIN q USING (reg, zeros) WHERE layer = 0
UNION ALL SELECT 'repeated', layer, reg, zeros, ngrams FROM lut JOIN q USING (reg, zeros) WHERE tf >= 2""")
def q_disambiguation_stages(spark, sf_dir):
    return K.staged(_lut(spark, sf_dir), _first_item(spark, sf_dir), [("unigrams", 0, None), ("repeated", None, F.col("tf") >= 2)])


@query(f"""{_TRIANGULATE}, z AS (SELECT *, CASE WHEN len(al) = 1 THEN 'exact' WHEN nl > 1 AND len(na) > 0 THEN 'triangulated' ELSE 'best_guess' END AS method FROM m WHERE len(al) > 0),
r AS (SELECT unnest(CASE WHEN method = 'triangulated' THEN na ELSE al END) AS token, method FROM z)
SELECT token, count(*) AS positions, max((method = 'exact')::INT) AS exact FROM r GROUP BY token ORDER BY positions DESC, token LIMIT 10""")
def q_ranked_tokens(spark, sf_dir):
    return K.ranked_tokens(K.disambiguate(_lut(spark, sf_dir), _first_item(spark, sf_dir)), 10)


@query(f"""WITH {_LUT}, f AS (SELECT split_part(ngram, ' ', 1) AS t FROM cnt WHERE layer = 0 ORDER BY tf DESC, ngram LIMIT 1) SELECT layer, reg, zeros, ngrams, tf FROM lut WHERE list_contains(first_tokens, (SELECT t FROM f))""")
def q_lut_first_token(spark, sf_dir):
    """Entries that begin with the most frequent word."""
    lut = _lut(spark, sf_dir)
    words = _ngrams(spark, sf_dir, "benchmark", "item_id").where("layer = 0").groupBy("ngram").count()
    top = words.orderBy(F.desc("count"), "ngram").first()["ngram"]
    return K.by_first_token(lut, top).select("layer", "reg", "zeros", "ngrams", "tf")
