"""The registered queries of this package, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bestfit, bpe, exact_dedup, licenses, minhash, packing, pii, quality, sharding, spelling, topk, toxicity, trie
from .common import held_out, release, table  # noqa: F401

#: Surrogates are keyed by this setting of the session.  The test tables hold invented persons, so
#: the queries have a value without it; a corpus of real ones needs a secret there.
PII_SETTING, PII_TEST_KEY = "spark.sketchloom.pii.key", "invented persons only"
VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


def _vocabulary(name: str) -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def pii_key(spark: SparkSession) -> str:
    return spark.conf.get(PII_SETTING, PII_TEST_KEY)


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", topk.quantized(F.col("embedding")).alias("vec"))
    return topk.top_k(rows, rows.where(F.col("vec_id") % 50 == 0), k=5)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), prefer="largest")


def _scored(scored: DataFrame, cut: float) -> DataFrame:
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), 0.5)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), 0.3)


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("expressions", "alternatives")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), sharding.HashTree.uniform(2, 2, 2))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    make = packing.json_vocabulary(*_vocabulary(VOCABULARY))
    return packing.pack_documents(table(spark, sf_dir, "documents"), make, n_terms=50_257)


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_dedup(table(spark, sf_dir, "documents"), percent=85, width=5)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), pii_key(spark))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_round_trip(table(spark, sf_dir, "documents"), *_vocabulary(RANKS))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), min_length=5, min_count=3)


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit.best_fit(table(spark, sf_dir, "documents"), packing.json_vocabulary(*_vocabulary(VOCABULARY)))


QUERIES = {
    f.__name__: f
    for f in (
        op1_top_k, op2_exact_dedup, op3_toxicity, op4_quality, op5_licenses, op6_sharding, op7_packing, op8_minhash, op9_pii, op10_bpe,
        op11_spelling, op12_trie, op13_best_fit,
    )
}


def _crc32_sql(hex_bytes: str) -> str:
    """The checksum of a column of bytes in hexadecimal; the table t of 256 remainders is in scope."""
    return f"""xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(0, len({hex_bytes}) // 2), lambda i: ('0x' || substr({hex_bytes}, (2*i+1)::INT, 2))::UBIGINT)),
                lambda c, x: xor(c >> 8, t.t[(xor(c, x) & 255)::INT + 1])))::BIGINT"""


_CRC_TABLE = """t AS (SELECT list(v ORDER BY b) AS t FROM (
            SELECT b, list_reduce(list_prepend(b::UBIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]),
                lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS v
            FROM (SELECT unnest(range(256)) AS b)))"""


def _draw(names: list[str], level: str, weight: float) -> str:
    """The draws of a tree's children, as SQL expressions."""
    return ", ".join(f"-ln((('0x' || substr(md5('{level}/{n}/' || k), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / {weight}::DOUBLE" for n in names)


def _first_smaller(names: list[str], level: str) -> str:
    a, b = (_draw([n], level, 1.0) for n in names)
    return f"{a} <= {b}"


def _region_sql(g: int) -> str:
    def rack(r: int) -> str:
        return f"CASE WHEN {_first_smaller([f'{g}.{r}.0', f'{g}.{r}.1'], 'shard')} THEN {4 * g + 2 * r} ELSE {4 * g + 2 * r + 1} END"

    return f"CASE WHEN {_first_smaller([f'{g}.0', f'{g}.1'], 'rack')} THEN {rack(0)} ELSE {rack(1)} END"


_TREE_SQL = f"CASE WHEN {_first_smaller(['0', '1'], 'region')} THEN {_region_sql(0)} ELSE {_region_sql(1)} END"

#: SQL for DuckDB, where SQL can express the operator.
ORACLES = {
    "op1_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS vec
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, d.vec_id AS vec_id,
                   list_sum(list_transform(list_zip(q.vec, d.vec), lambda p: p[1] * p[2]))::BIGINT AS score
            FROM v q JOIN v d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id AND len(q.vec) = len(d.vec)
        )
        SELECT query_id, rank::INTEGER AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        WHERE rank <= 5""",
    "op2_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op6_sharding": f"""
        WITH d AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS k, hex(encode(coalesce(text, ''))) AS hx FROM documents),
        t AS (SELECT list(v ORDER BY b) AS t FROM (
            SELECT b, list_reduce(list_prepend(b::UBIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]),
                lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS v
            FROM (SELECT unnest(range(256)) AS b))),
        c AS (SELECT doc_id, k, len(hx) // 2 + 1 AS size,
            xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(0, len(hx) // 2), lambda i: ('0x' || substr(hx, (2*i+1)::INT, 2))::UBIGINT)),
                lambda c, x: xor(c >> 8, t.t[(xor(c, x) & 255)::INT + 1])))::BIGINT AS text_crc32
            FROM d CROSS JOIN t),
        s AS (SELECT doc_id, size, text_crc32, {_TREE_SQL} AS shard, {_draw(["2"], "region", 1.0)} AS fresh,
            least({_draw(["0", "1"], "region", 4.0)}) AS old FROM c)
        SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot,
               CASE WHEN fresh < old THEN 8 ELSE shard END AS grown_shard FROM s""",
    "op8_minhash": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))
            WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (g) WHERE x.doc_id < y.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r(id, root) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id),
        c AS (SELECT id, min(root) AS c FROM r GROUP BY id)
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id, coalesce(c, d.doc_id) = d.doc_id AS kept
        FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.id = d.doc_id""",
    "op11_spelling": rf"""
        WITH RECURSIVE {_CRC_TABLE},
        r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents),
        k AS (SELECT doc_id, run, count(*) AS k, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS hx FROM r GROUP BY doc_id, run),
        c AS (SELECT run, k, {_crc32_sql("hx")} AS h FROM k CROSS JOIN t),
        m AS (SELECT k, CASE WHEN h % 97 = 0 THEN left(run, (h % len(run))::INT) || substr(run, (h % len(run))::INT + 2) ELSE run END AS word FROM c),
        v AS (SELECT word, sum(k)::BIGINT AS n FROM m WHERE len(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
        p AS (SELECT word, n, unnest(range(len(word))) AS i FROM v),
        d AS (SELECT DISTINCT word, n, left(word, i::INT) || substr(word, i::INT + 2) AS shorter FROM p),
        g AS (SELECT word, n, i, left(word, i::INT) || '*' || substr(word, i::INT + 2) AS pattern FROM p),
        e AS (SELECT d.word AS a, d.n AS na, v.word AS b, v.n AS nb FROM d JOIN v ON v.word = d.shorter
            UNION ALL SELECT x.word, x.n, y.word, y.n FROM g x JOIN g y USING (i, pattern) WHERE x.word < y.word),
        b AS (SELECT a AS word, na AS n, b AS near, nb AS near_n FROM e UNION ALL SELECT b, nb, a, na FROM e),
        s AS (SELECT word, n, count(*) AS n_near, first(near ORDER BY near_n DESC, encode(near)) AS near, max(near_n) AS near_n FROM b GROUP BY word, n),
        f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * v.n THEN near END AS form, CASE WHEN near_n >= 2 * v.n THEN near_n END AS form_n FROM v LEFT JOIN s USING (word)),
        w(word, here, depth) AS (SELECT word, word, 0 FROM f UNION ALL SELECT w.word, f.form, depth + 1 FROM w JOIN f ON f.word = w.here WHERE f.form IS NOT NULL),
        o AS (SELECT word, last(here ORDER BY depth) AS root FROM w GROUP BY word)
        SELECT word, form, root, n, n_near, form_n FROM f JOIN o USING (word)""",
    "op12_trie": f"""
        WITH {_CRC_TABLE},
        c AS (SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
        x AS (SELECT conv_id, turns, hex(encode(CAST(conv_id AS VARCHAR))) AS hx FROM c),
        h AS (SELECT conv_id, turns, {_crc32_sql("hx")} % 6 AS h FROM x CROSS JOIN t),
        b AS (SELECT h.conv_id, list_concat(coalesce(c.turns, [])[1:h.h], h.turns[h.h + 1:]) AS turns FROM
            (SELECT conv_id, turns, h FROM h) h LEFT JOIN c ON c.conv_id = h.conv_id - h.conv_id % 100),
        p AS (SELECT conv_id, len(turns) AS n, unnest(range(len(turns) + 1)) AS depth, turns FROM b),
        q AS (SELECT conv_id, n, depth, turns[1:depth] AS path FROM p),
        g AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(CASE WHEN n = depth THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id) AS ends FROM q GROUP BY path, depth),
        k AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM g WHERE depth > 0 GROUP BY ALL),
        m AS (SELECT g.*, coalesce(n_children, 0) AS n_children, CASE WHEN depth > 0 THEN (n_convs - 1) * len(path[depth].t) ELSE 0 END AS own FROM g LEFT JOIN k USING (path)),
        u AS (SELECT path, own, n_children, unnest(range(depth + 1)) AS up FROM m),
        s AS (SELECT path[1:up] AS path, sum(own)::BIGINT AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM u GROUP BY ALL)
        SELECT m.conv_id, m.depth, a.conv_id AS parent_conv_id, m.n_convs, m.n_children, s.n_leaves, s.saved_tokens, sha256(coalesce(m.ends, '')) AS ends_sha256
        FROM m JOIN s USING (path) LEFT JOIN g a ON m.depth > 0 AND a.path = m.path[1:m.depth - 1]""",
}
