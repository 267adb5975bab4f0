"""The token table as stream state, rates of batches, consumer groups."""

import datetime

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from sketchloom.operators import tokens as K
from sketchloom.streaming import groups as G
from sketchloom.streaming import session as Z
from sketchloom.streaming import upsert as U

LAYERED = "layer int, ngram string"


def add(spark, folder, text, n=1):
    rows = [(i % 2, w) for i, w in enumerate(text.split())]
    spark.createDataFrame(rows, LAYERED).repartition(n).write.mode("append").parquet(folder)
    return rows


def entries(df):
    return sorted((r["layer"], r["hash"], r["reg"], r["zeros"], tuple(r["ngrams"]), tuple(r["first_tokens"]), r["tf"], r["collisions"]) for r in df.collect())


def test_state_after_two_restarts_and_a_replayed_batch(spark, tmp_path):
    source, table = f"{tmp_path}/in", U.TokenTable(spark, f"{tmp_path}/table")
    stream = lambda: Z.token_stream(spark, source, LAYERED, per_trigger=1)
    rows = add(spark, source, "a b c a b a hot hot hot hot", 3)
    assert table.table().count() == 0
    table.run(stream()).awaitTermination()
    assert entries(table.table()) == entries(K.build_lut(spark.createDataFrame(rows, LAYERED)))
    rows += add(spark, source, "a d d hot e")
    # the batch is written, then the process is lost before Spark notes it: it comes again after the restart
    write, calls = table._write, []

    def dies(df, batch):
        write(df, batch)
        calls.append(batch)
        raise RuntimeError("lost")

    table._write = dies
    with pytest.raises(StreamingQueryException):
        table.run(stream()).awaitTermination()
    table._write = lambda df, batch: (write(df, batch), calls.append(batch))
    table.run(stream()).awaitTermination()
    assert calls[0] == calls[1]
    rows += add(spark, source, "z a z", 2)
    other = U.TokenTable(spark, f"{tmp_path}/table")  # a new process
    other.run(stream()).awaitTermination()
    assert entries(other.table()) == entries(K.build_lut(spark.createDataFrame(rows, LAYERED)))
    assert len(other.batches()) >= 4


def test_rates_of_batches(spark, tmp_path):
    source, table = f"{tmp_path}/in", U.TokenTable(spark, f"{tmp_path}/table")
    rows = add(spark, source, "a b c d e f", 3)
    with U.Rates(spark, "tokens") as rates:
        table.run(Z.token_stream(spark, source, LAYERED, per_trigger=1), observed="tokens").awaitTermination()
    got = rates.table().where("tokens > 0").collect()
    assert sum(r["tokens"] for r in got) == len(rows) and len(got) == 3
    assert all(r["seconds"] > 0 and abs(r["tokens_per_second"] - r["tokens"] / r["seconds"]) < 1e-6 for r in got)
    # what no one listens to is not recorded
    add(spark, source, "x")
    table.run(Z.token_stream(spark, source, LAYERED, per_trigger=1), observed="tokens").awaitTermination()
    assert rates.table().agg(F.sum("tokens")).first()[0] == len(rows)


MESSAGE = "message_id string, ts timestamp, token string"


def send(spark, folder, ids):
    at = datetime.datetime(2024, 1, 1)
    spark.createDataFrame([(f"m{i}", at, f"t{i}") for i in ids], MESSAGE).coalesce(1).write.mode("append").parquet(folder)


def messages(spark, folder):
    return Z.token_stream(spark, folder, MESSAGE, per_trigger=1)


def test_rows_of_a_lost_consumer_appear_once(spark, tmp_path):
    source, group = f"{tmp_path}/in", G.ConsumerGroup(spark, f"{tmp_path}/group")
    send(spark, source, range(4))
    send(spark, source, range(4, 8))
    batches = [b for b in group.receive(messages(spark, source), "first") if group.messages(b).count()]
    assert len(batches) == 2 and {r["consumer"] for r in group.pending().collect()} == {"first"}
    upper = lambda df: df.select("message_id", F.upper("token").alias("token"))
    group.work(batches[:1], upper)

    def half(df):
        # it writes some of the second batch and is lost
        upper(df).limit(1).write.mode("overwrite").parquet(f"{group.folder}/results/batch={batches[1]}")
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        group.work(batches[1:], half)
    assert group.results().count() == 4  # the half that is not acknowledged does not count
    second = G.ConsumerGroup(spark, f"{tmp_path}/group")
    send(spark, source, range(6, 10))  # two messages are sent again
    new = second.receive(messages(spark, source), "second")
    assert second.claim("second", idle=3600) == []
    claimed = second.claim("second", idle=0)
    assert batches[1] in claimed and set(new) <= set(claimed) and group.claim("third", idle=3600) == []
    second.work(claimed, upper)
    assert sorted(r["token"] for r in second.results().collect()) == sorted(f"T{i}" for i in range(10))
    assert second.pending().count() == 0 and not second.acknowledge(batches[1])
    lag = {r["consumer"]: (r["pending"], r["acknowledged"]) for r in second.lag().collect()}
    assert lag["first"][0] == 0 and lag["second"][0] == 0 and lag["second"][1] == len(claimed)


def test_of_two_claims_one_succeeds(spark, tmp_path):
    group = G.ConsumerGroup(spark, f"{tmp_path}/group")
    send(spark, f"{tmp_path}/in", range(3))
    group.receive(messages(spark, f"{tmp_path}/in"), "first")
    owners = group._owners()
    other = G.ConsumerGroup(spark, f"{tmp_path}/group")
    other._owners = lambda: owners  # both looked before either claimed
    assert group.claim("a", 0) and other.claim("b", 0) == []
    assert {r["consumer"] for r in group.pending().collect()} == {"a"} and {r["deliveries"] for r in group.pending().collect()} == {2}
    with pytest.raises(ValueError):
        group.results()
