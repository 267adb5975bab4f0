"""Graph patterns of variable length, corpus graphs, nested JSON, ingest with one commit."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import nested as N
from ..operators import corpus as C
from ..operators import debruijn as D
from ..operators import patterns as P
from ..operators import ring as G
from ..operators import sketch as S
from ..sources import tables as T
from ..streaming import ingest as I
from . import oracle as O
from .registry import query
from .texts import ngrams_sql, words_sql

_WORDS = f"ws AS ({words_sql('benchmark', 'item_id')}), pairs AS (SELECT w[i] AS a, w[i + 1] AS b FROM (SELECT w, unnest(range(1, len(w))) AS i FROM ws)), e AS (SELECT DISTINCT a, b FROM pairs), s AS (SELECT DISTINCT w[1] AS source FROM ws WHERE len(w) > 0)"


def _words(spark, sf_dir):
    return T.read(spark, sf_dir, "benchmark").select("item_id", H.words(F.col("text")).alias("w"))


def _bigrams(spark, sf_dir):
    """(a, b) of successive words."""
    k = D.kmers(_words(spark, sf_dir), "w", k=2)
    return k.select(F.col("src").alias("a"), F.col("dst").alias("b"), "multiplicity")


def _ends(spark, sf_dir, at):
    return _words(spark, sf_dir).where(F.size("w") > 0).select(F.element_at("w", at).alias("node"))


@query(f"""WITH RECURSIVE {_WORDS}, g AS (SELECT * FROM e WHERE a <> b), t AS (SELECT DISTINCT w[len(w)] AS target FROM ws WHERE len(w) > 0),
r(source, node, depth) AS (SELECT source, source, 0 FROM s UNION SELECT r.source, g.b, depth + 1 FROM r JOIN g ON g.a = r.node WHERE depth < 6),
d AS (SELECT source, node, min(depth) AS depth FROM r GROUP BY ALL),
x(source, node, depth, path) AS (SELECT source, source, 0, [source] FROM s UNION ALL SELECT x.source, g.b, x.depth + 1, list_append(path, g.b) FROM x JOIN g ON g.a = x.node JOIN d ON d.source = x.source AND d.node = g.b AND d.depth = x.depth + 1)
SELECT source, node AS target, depth, array_to_string(min(path), ' ') AS path FROM x SEMI JOIN t ON t.target = x.node GROUP BY source, node, depth""")
def q_graph_paths(spark, sf_dir):
    """From first words of the items to last words, along successive words, six steps at most."""
    found = P.shortest_paths(_bigrams(spark, sf_dir), _ends(spark, sf_dir, 1), 6, _ends(spark, sf_dir, -1))
    return found.select("source", "target", "depth", F.array_join("path", " ").alias("path"))


@query(f"""WITH RECURSIVE {_WORDS}, r(source, node, length) AS (SELECT source, source, 0 FROM s UNION SELECT r.source, e.b, length + 1 FROM r JOIN e ON e.a = r.node WHERE length < 5)
SELECT source, length, count(*) AS targets FROM r WHERE length >= 2 GROUP BY ALL""")
def q_graph_walks(spark, sf_dir):
    """How many words walks of two to five steps reach from each first word."""
    found = P.walks(_bigrams(spark, sf_dir), _ends(spark, sf_dir, 1), 2, 5)
    return found.groupBy("source", "length").agg(F.count(F.lit(1)).alias("targets"))


@query(f"""WITH {_WORDS}, l AS (SELECT a, b, CASE WHEN len(b) > 6 THEN 'long' ELSE 'short' END AS label FROM e)
SELECT x.a AS source, z.b AS target, count(*) AS ways FROM l x JOIN l y ON x.b = y.a JOIN l z ON y.b = z.a WHERE x.label = 'long' AND z.label = 'short' GROUP BY ALL""")
def q_graph_labels(spark, sf_dir):
    """A step to a long word, any step, a step to a short one."""
    e = _bigrams(spark, sf_dir).withColumn("label", F.when(F.char_length("b") > 6, "long").otherwise("short"))
    return P.along_labels(e, ["long", None, "short"])


_KMERS = f"""ws AS ({words_sql('benchmark', 'item_id')}), km AS (SELECT kmer, count(*) AS multiplicity FROM (SELECT unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))) AS kmer FROM ws WHERE len(w) >= 3) GROUP BY kmer),
ed AS (SELECT string_split(kmer, ' ')[1] || ' ' || string_split(kmer, ' ')[2] AS src, string_split(kmer, ' ')[2] || ' ' || string_split(kmer, ' ')[3] AS dst, string_split(kmer, ' ')[3] AS label, kmer, multiplicity FROM km)"""


@query(f"""WITH RECURSIVE {_KMERS}, inner_ AS (SELECT node FROM (SELECT src AS node, 1 AS o, 0 AS i FROM ed UNION ALL SELECT dst, 0, 1 FROM ed) GROUP BY node HAVING sum(o) = 1 AND sum(i) = 1),
c(head, src, dst, edges, sequence, least, total) AS (
  SELECT kmer, src, dst, 1, kmer, multiplicity, multiplicity FROM ed ANTI JOIN inner_ ON inner_.node = ed.src
  UNION ALL SELECT c.head, c.src, ed.dst, edges + 1, sequence || ' ' || label, least(c.least, multiplicity), total + multiplicity FROM c JOIN inner_ ON inner_.node = c.dst JOIN ed ON ed.src = c.dst)
SELECT src, arg_max(dst, edges) AS dst, max(edges)::BIGINT AS edges, arg_max(sequence, edges) AS sequence, arg_max(least, edges) AS least, arg_max(total, edges)::BIGINT AS total FROM c GROUP BY head, src""")
def q_corpus_chains(spark, sf_dir):
    """The items' trigram graph with its unbranched chains contracted."""
    return C.contracted(D.kmers(_words(spark, sf_dir), "w", k=3))


@query(f"WITH {_KMERS.replace('benchmark', 'conversations').replace('item_id', 'conv_id')} SELECT kmer, multiplicity::BIGINT AS multiplicity FROM km")
def q_corpus_merge(spark, sf_dir):
    """Graphs of the speakers' turns merged into one, its chains contracted, and spelled again."""
    turns = T.read(spark, sf_dir, "conversations").select("role", H.words(F.col("text")).alias("w"))
    roles = [r[0] for r in T.bounded(turns.select("role").distinct(), 100)]
    merged = C.numbered(C.merge_graphs(*[D.kmers(turns.where(F.col("role").eqNullSafe(r)), "w", k=3) for r in roles]))
    return C.expanded(C.contracted(merged)).join(merged, "kmer").select("kmer", "multiplicity")


@query("""WITH j AS (SELECT event_type, CASE event_type WHEN 'click' THEN 0 WHEN 'purchase' THEN 1 WHEN 'view' THEN 1 WHEN 'error' THEN 0 ELSE 1 END AS ok, CASE event_type WHEN 'purchase' THEN 3 ELSE 0 END AS n FROM events)
SELECT event_type, count(*) AS n_rows, sum(ok)::BIGINT AS good, sum(1 - ok)::BIGINT AS bad, sum(n)::BIGINT AS elements FROM j GROUP BY event_type""")
def q_json_arrays(spark, sf_dir):
    """Properties as they are, arrays of arrays made of them, and arrays that are cut off: good and bad rows apart."""
    e = T.read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    made = F.concat(F.lit('[["'), "event_type", F.lit('",'), F.col("user_id").cast("string"), F.lit("],["), k, F.lit("]]"))
    text = F.when(F.col("event_type") == "click", F.col("props")).when(F.col("event_type") == "purchase", made).when(F.col("event_type") == "view", "[]").when(F.col("event_type") == "error", F.substring(made, 1, 9)).otherwise("")
    p = e.select("event_type", N.string_arrays(text).alias("p")).select("event_type", "p.*")
    return p.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("value").alias("good"), F.count("bad").alias("bad"), F.coalesce(F.sum(F.size(F.flatten("value"))), F.lit(0)).cast("long").alias("elements")
    )


_PADDED = ngrams_sql("benchmark", "item_id").replace(words_sql("benchmark", "item_id"), f"SELECT item_id, CASE WHEN len(w) > 0 THEN list_concat(['<S>'], w, ['</S>']) ELSE w END AS w FROM ({words_sql('benchmark', 'item_id')})")


@query(f"""WITH {_PADDED}, {O.hash_cte('ng', 'ngram')}, g AS (SELECT * FROM ng JOIN p ON p.token = ng.ngram WHERE zeros IS NOT NULL),
lf AS (SELECT DISTINCT layer, reg, zeros FROM g), {O.cards_cte('lf', 'layer')}, n AS (SELECT layer, count(*) AS tokens, count(DISTINCT ngram) AS ngrams, count(DISTINCT h) AS entries FROM g GROUP BY layer),
v AS (SELECT sum(n)::BIGINT AS vector_bits FROM (SELECT count(DISTINCT (reg, zeros)) AS n FROM g GROUP BY item_id))
SELECT layer, card, tokens, ngrams, entries, vector_bits FROM card JOIN n USING (layer) CROSS JOIN v""")
def q_ring_ingest(spark, sf_dir):
    """Items in three batches: universes, counts, token table and ring vectors as their common commits have them."""
    folder = T.new_path(spark, "ingest")
    T.read(spark, sf_dir, "benchmark").select("item_id", "text").repartition(3).write.parquet(f"{folder}/in")
    ingest = I.Ingest(spark, f"{folder}/out", "item_id")
    ingest.run(spark.readStream.schema("item_id long, text string").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")).awaitTermination()
    counts = ingest.counts().groupBy("layer").agg(F.sum("tf").alias("tokens"), F.count(F.lit(1)).alias("ngrams"))
    entries = ingest.lut().groupBy("layer").agg(F.count(F.lit(1)).alias("entries"))
    bits = S.unpack(ingest.vectors(), "item_id").agg(F.count(F.lit(1)).alias("vector_bits"))
    return S.cardinality(S.unpack(ingest.universes(), "layer"), "layer").join(counts, "layer").join(entries, "layer").crossJoin(bits)


_REGION_PARTS = "SELECT DISTINCT r_name AS name, CAST(l_partkey AS VARCHAR) AS token FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


@query(f"""WITH tk AS ({_REGION_PARTS}), {O.hash_cte('tk')}, lf AS (SELECT DISTINCT name, (reg * 32 + zeros)::INT AS pos FROM tk JOIN p USING (token) WHERE zeros IS NOT NULL),
v AS (SELECT name AS key, pos FROM lf UNION ALL SELECT key, pos FROM (SELECT x.name || '^' || y.name AS key, lf.pos FROM (SELECT DISTINCT name FROM lf) x JOIN (SELECT DISTINCT name FROM lf) y ON x.name < y.name JOIN lf ON lf.name IN (x.name, y.name)) GROUP BY key, pos HAVING count(*) = 1),
h AS (SELECT key, bit_xor(hash(pos)) AS h FROM v GROUP BY key), n AS (SELECT key, h, row_number() OVER (ORDER BY key) - 1 AS i FROM h),
m AS (SELECT mask, bit_xor(h) AS x FROM (SELECT range AS mask FROM range(1, (1 << (SELECT count(*) FROM n))::BIGINT)) r JOIN n ON (mask >> i) & 1 = 1 GROUP BY mask),
k AS (SELECT n.i, round(log2(1 + count(DISTINCT CASE WHEN x <> 0 THEN x END)))::INT AS rank FROM n JOIN m ON mask < (1 << (n.i + 1)) GROUP BY n.i),
b AS (SELECT i, rank, rank > coalesce(lag(rank) OVER (ORDER BY i), 0) AS is_base FROM k), a AS (SELECT sum(1 << i)::BIGINT AS bases FROM b WHERE is_base),
e AS (SELECT n.key, n.i, m.mask FROM n JOIN m ON m.x = n.h CROSS JOIN a WHERE m.mask & a.bases = m.mask)
SELECT e.key, b.is_base, b.rank, (SELECT string_agg(o.key, ' + ' ORDER BY o.i) FROM n o WHERE (e.mask >> o.i) & 1 = 1) AS expression FROM e JOIN b USING (i)""")
def q_ring_elimination(spark, sf_dir):
    """The regions' parts and all their symmetric differences: which are bases, and what the others are sums of."""
    supplier = T.read(spark, sf_dir, "supplier").join(T.read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(T.read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    parts = T.read(spark, sf_dir, "lineitem").join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("r_name").alias("name"), F.col("l_partkey").cast("string").alias("token"))
    long = T.written(S.long_form(parts, "token", "name"))
    names = long.select(F.col("name").alias("a")).distinct()
    both = names.join(names.withColumnRenamed("a", "b"), F.col("a") < F.col("b")).select(F.concat_ws("^", "a", "b").alias("key"), F.explode(F.array("a", "b")).alias("name"))
    sums = S.xor_all(both.join(long, "name").select("key", "reg", "zeros"), "key")
    vectors = G.vectors(long.withColumnRenamed("name", "key").unionByName(sums), "key").withColumn("ring", F.lit("regions"))
    found = G.decompose(vectors, "ring", "key", "key", per_task=4)
    return found.select("key", "is_base", "rank", F.array_join("expression", " + ").alias("expression"))
