"""Stream state, consumer groups, rates, versions of tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing as H
from ..operators import sketch as S
from ..operators import tokens as K
from ..sources import tables as T
from ..sources import versions as V
from ..streaming import groups as G
from ..streaming import session as Z
from ..streaming import upsert as U
from . import oracle as O
from .registry import query
from .texts import ngrams_sql, words_sql

_CONV = f"WITH {ngrams_sql('conversations', 'conv_id')}, {O.hash_cte('ng', 'ngram')}"
_TURNS = "conv_id long, turn long, role string, text string"


def _turns(spark, folder):
    """The n-grams of conversations' turns, one file a batch."""
    raw = Z.token_stream(spark, folder, _TURNS, per_trigger=1)
    return K.text_ngrams(raw.repartition(raw.sparkSession.sparkContext.defaultParallelism), "text")


@query(f"""{_CONV}, t AS (SELECT layer, h, count(*) AS tf, count(DISTINCT ngram) AS n FROM ng JOIN p ON p.token = ng.ngram WHERE zeros IS NOT NULL GROUP BY layer, h)
SELECT layer, count(*) AS entries, sum(tf)::BIGINT AS tokens, max(tf) AS most, max(n)::INT AS collisions FROM t GROUP BY layer""")
def q_stream_upsert(spark, sf_dir):
    """Conversations in three deliveries; the stream stops after each and goes on from its state."""
    folder = T.new_path(spark, "upsert")
    turns = T.read(spark, sf_dir, "conversations")
    for part in turns.randomSplit([1.0, 1.0, 1.0], seed=3):
        part.repartition(3).write.mode("append").parquet(f"{folder}/in")  # as many batches whatever files the table has
        U.TokenTable(spark, f"{folder}/table").run(_turns(spark, f"{folder}/in")).awaitTermination()
    table = U.TokenTable(spark, f"{folder}/table").table()
    return table.groupBy("layer").agg(F.count(F.lit(1)).alias("entries"), F.sum("tf").alias("tokens"), F.max("tf").alias("most"), F.max("collisions").alias("collisions"))


@query(f"SELECT sum(len(w))::BIGINT AS tokens, 3 AS batches, true AS timed FROM ({words_sql('benchmark', 'item_id')})")
def q_stream_rates(spark, sf_dir):
    """Words of three files, as the stream's own metrics count them, and whether each batch has a rate."""
    folder = T.new_path(spark, "rates")
    words = T.read(spark, sf_dir, "benchmark").select(F.lit(0).alias("layer"), F.explode(H.words(F.col("text"))).alias("ngram"))
    words.repartition(3).write.parquet(f"{folder}/in")
    with U.Rates(spark, folder) as rates:
        U.TokenTable(spark, f"{folder}/table").run(Z.token_stream(spark, f"{folder}/in", "layer int, ngram string", 1), observed=folder).awaitTermination()
    full = rates.table().where("tokens > 0")
    return full.agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).cast("int").alias("batches"), F.min(F.col("tokens_per_second") > 0).alias("timed"))


@query(f"SELECT token, count(*) AS n FROM (SELECT unnest(w) AS token FROM ({words_sql('benchmark', 'item_id')})) GROUP BY token")
def q_consumer_group(spark, sf_dir):
    """Items as messages to two consumers, the first of which never acknowledges; some are sent twice."""
    folder = T.new_path(spark, "group")
    items = T.read(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("message_id"), F.lit("2024-01-01").cast("timestamp").alias("ts"), "text")
    items.repartition(2).write.parquet(f"{folder}/in")
    items.where("item_id < 20").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = lambda: Z.token_stream(spark, f"{folder}/in", "message_id string, ts timestamp, text string", per_trigger=2)
    first = G.ConsumerGroup(spark, f"{folder}/group")
    first.receive(stream(), "first")
    second = G.ConsumerGroup(spark, f"{folder}/group")
    second.work(second.claim("second", idle=0), lambda df: df.select(F.explode(H.words(F.col("text"))).alias("token")))
    return second.results().groupBy("token").agg(F.count(F.lit(1)).alias("n"))


_WEEKS = "tk AS (SELECT date_trunc('week', ts) AS week, CAST(user_id AS VARCHAR) AS token FROM events)"


@query(f"""WITH {_WEEKS}, {O.hash_cte('tk')}, v AS (SELECT week, row_number() OVER (ORDER BY week) - 1 AS version FROM (SELECT DISTINCT week FROM tk)),
lf AS (SELECT DISTINCT version, reg, zeros FROM tk JOIN p USING (token) JOIN v ON tk.week <= v.week WHERE zeros IS NOT NULL), {O.cards_cte('lf', 'version')}
SELECT version, card FROM card""")
def q_time_travel(spark, sf_dir):
    """Users of the events, a week appended at a time; each version as it was."""
    table = V.VersionedTable(spark, T.new_path(spark, "weeks"))
    users = T.read(spark, sf_dir, "events").select(F.date_trunc("week", "ts").alias("week"), F.col("user_id").cast("string").alias("token"))
    weeks = sorted(r[0] for r in T.bounded(users.select("week").distinct(), 1000))
    versions = [table.append(users.where(F.col("week") == w).select("token")) for w in weeks]
    out = None
    for v in versions:
        rows = table.read(v).withColumn("version", F.lit(v).cast("long"))
        out = rows if out is None else out.unionByName(rows)
    return S.cardinality(S.long_form(out, "token", "version"), "version")


@query("SELECT user_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id, (SELECT count(DISTINCT date_trunc('week', ts)) - 1 FROM events)::INT AS removed FROM events GROUP BY user_id")
def q_versioned_upsert(spark, sf_dir):
    """Each user's latest event, a week upserted at a time; then all earlier versions are removed."""
    table = V.VersionedTable(spark, T.new_path(spark, "users"))
    events = T.read(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.struct("ts", "event_id").alias("latest"))
    weeks = sorted(r[0] for r in T.bounded(events.select(F.date_trunc("week", "ts")).distinct(), 1000))
    for w in weeks:
        part = events.where(F.date_trunc("week", "ts") == w).groupBy("user_id").agg(F.max("latest").alias("latest"))
        table.upsert(part, ["user_id"], "latest")
    removed = table.vacuum(keep=1, grace=-60)
    return table.read().select("user_id", "latest.ts", "latest.event_id", F.lit(removed).alias("removed"))
