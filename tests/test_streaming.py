"""Streams against the same rows in one batch."""

from pyspark.sql import functions as F

from sketchloom.functions import hashing as H
from sketchloom.operators import sketch as S
from sketchloom.operators import tokens as K
from sketchloom.streaming import session as Z
from sketchloom.streaming import upsert as U


def test_session_commit_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(0, w) for w in "a b c a".split()] + [(1, "a b")], "layer int, ngram string")
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    session = Z.Session(spark, f"{tmp_path}/session")
    session.run(Z.token_stream(spark, f"{tmp_path}/in", "layer int, ngram string", per_trigger=1)).awaitTermination()
    packed, lut = session.commit()
    assert {r["layer"]: bytes(r["bitmap"]) for r in packed.collect()} == {r["layer"]: bytes(r["bitmap"]) for r in S.build(rows, "ngram", "layer").collect()}
    want = {(r["layer"], r["ngrams"][0]): r["tf"] for r in K.build_lut(rows).collect()}
    assert {(r["layer"], r["ngrams"][0]): r["tf"] for r in lut.collect()} == want
    assert session.stats().where("layer = 0").first()["tokens"] == 4
    # a batch that is delivered again replaces itself
    session._batch(rows.where("ngram = 'a b'"), 0)
    session._batch(rows.where("ngram = 'a b'"), 0)
    assert session.checkpoints().where("batch = 0").count() == 1


def test_candidates_of_a_stream(spark, tmp_path):
    lut = K.build_lut(spark.createDataFrame([(0, "x"), (0, "y")], "layer int, ngram string"))
    spark.createDataFrame([("x",)], "token string").write.parquet(f"{tmp_path}/in")
    out = Z.candidates(Z.token_stream(spark, f"{tmp_path}/in", "token string"), lut, "token")
    q = out.writeStream.format("memory").queryName("cand").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r["ngrams"] for r in spark.table("cand").collect()] == [["x"]]


def test_flux_is_carried_across_batches(spark, tmp_path):
    rows = spark.createDataFrame([("s", str(i), float(i)) for i in range(4)], "stream string, step string, flux double")
    rows.repartitionByRange(2, "step").write.parquet(f"{tmp_path}/in")
    stream = Z.token_stream(spark, f"{tmp_path}/in", "stream string, step string, flux double", per_trigger=1)
    q = Z.flux_states(stream, "step").writeStream.format("memory").queryName("flux").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("flux").agg(F.max("cumulative_flux")).first()[0] == 6.0


def test_counted_rows_of_a_text_stream_equal_exploded_ngrams(spark, tmp_path):
    texts = ["a b  c a b", "\taé b\n", "", None, "x" * 40 + " y", "a b c a b c " * 9]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    docs.repartition(3).write.parquet(f"{tmp_path}/in")
    session = Z.Session(spark, f"{tmp_path}/session")
    session.run(K.text_ngrams(Z.token_stream(spark, f"{tmp_path}/in", "text string", per_trigger=1), "text")).awaitTermination()
    packed, lut = session.commit()
    rows = K.ngram_rows(docs.select(H.words(F.col("text")).alias("w")), "w")
    entries = lambda df: sorted(tuple(r[c] for c in ("layer", "hash", "reg", "zeros", "ngrams", "first_tokens", "tf", "collisions")) for r in df.collect())
    assert entries(lut) == entries(K.build_lut(rows))
    assert {r["layer"]: bytes(r["bitmap"]) for r in packed.collect()} == {r["layer"]: bytes(r["bitmap"]) for r in S.build(rows, "ngram", "layer").collect()}


def test_a_batch_stores_no_more_than_its_own_rows(spark, tmp_path):
    """The cost of a batch does not grow with the table: no state is kept, and rows that came before are not written again."""
    table, source = U.TokenTable(spark, f"{tmp_path}/table"), f"{tmp_path}/in"
    for i in range(3):
        spark.createDataFrame([(0, "hot"), (0, f"w{i}")], "layer int, ngram string").coalesce(1).write.mode("append").parquet(source)
        table.run(Z.token_stream(spark, source, "layer int, ngram string", per_trigger=1)).awaitTermination()
    rows = spark.read.parquet(f"{tmp_path}/table/rows")
    assert {(r["batch"], r["ngram"], r["tf"]) for r in rows.collect()} == {(i, w, 1) for i in range(3) for w in ("hot", f"w{i}")}
    assert not list(tmp_path.rglob("state/*/*")) and {r["ngrams"][0]: r["tf"] for r in table.table().collect()} == {"hot": 3, "w0": 1, "w1": 1, "w2": 1}
