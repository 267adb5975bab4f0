"""Ingest with one commit against batch forms; nested JSON arrays."""

import json

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from sketchloom.functions import nested as N
from sketchloom.operators import sketch as S
from sketchloom.operators import tokens as K
from sketchloom.streaming import ingest as I

TEXT = "doc long, text string"


def texts(spark, *rows):
    return spark.createDataFrame(list(rows), TEXT)


def same(ingest, spark, rows):
    """All four tables equal those that the texts give at once."""
    grams = ingest.ngrams(texts(spark, *rows))
    bits = lambda df, k: {r[k]: bytes(r["bitmap"]) for r in df.collect()}
    assert bits(ingest.universes(), "layer") == bits(S.build(grams, "ngram", "layer"), "layer")
    assert bits(ingest.vectors(), "doc") == bits(S.build(grams, "ngram", "doc"), "doc")
    count = {(r["layer"], r["ngram"]): r["count"] for r in grams.groupBy("layer", "ngram").count().collect()}
    assert {(r["layer"], r["ngram"]): r["tf"] for r in ingest.counts().collect()} == count
    entry = lambda df: sorted((r["layer"], r["hash"], tuple(r["ngrams"]), tuple(r["first_tokens"]), r["tf"], r["collisions"]) for r in df.collect())
    assert entry(ingest.lut()) == entry(K.build_lut(grams))


def test_all_tables_equal_their_batch_forms(spark, tmp_path):
    rows = [(1, "a b c a b"), (2, "b c d"), (3, None), (4, "  "), (1, "e f")]
    source = f"{tmp_path}/in"
    ingest = I.Ingest(spark, f"{tmp_path}/out", "doc")
    stream = lambda: spark.readStream.schema(TEXT).option("maxFilesPerTrigger", 1).parquet(source)
    for part in (rows[:2], rows[2:]):
        texts(spark, *part).coalesce(1).write.mode("append").parquet(source)
        ingest.run(stream()).awaitTermination()
    same(ingest, spark, rows)
    assert ingest.committed() == 1 and ingest.store.history().count() == 2
    # a batch that comes again changes nothing
    assert not ingest.add(texts(spark, (9, "new words")), 1)
    same(ingest, spark, rows)


def test_a_failed_sink_leaves_nothing(spark, tmp_path):
    rows = [(1, "a b c"), (2, "c d")]
    source = f"{tmp_path}/in"
    texts(spark, rows[0]).coalesce(1).write.mode("append").parquet(source)
    ingest = I.Ingest(spark, f"{tmp_path}/out", "doc", markers=None)
    stream = lambda: spark.readStream.schema(TEXT).option("maxFilesPerTrigger", 1).parquet(source)
    ingest.run(stream()).awaitTermination()
    texts(spark, rows[1]).coalesce(1).write.mode("append").parquet(source)
    stage, calls = ingest.store._stage, []

    def third_fails(df):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("no space left")
        return stage(df)

    ingest.store._stage = third_fails
    with pytest.raises(StreamingQueryException):
        ingest.run(stream()).awaitTermination()
    assert ingest.committed() == 0
    same(ingest, spark, rows[:1])
    again = I.Ingest(spark, f"{tmp_path}/out", "doc", markers=None)
    again.run(stream()).awaitTermination()
    same(again, spark, rows)
    assert again.store.vacuum(keep=1, grace=-60) == 2  # what the failed batch had written
    same(again, spark, rows)


CASES = {
    '[["a","b"],["c"]]': [["a", "b"], ["c"]], "[]": [], "": [], "  ": [], '[["a",1,true,null,{"k":1}]]': [["a", "1", "true", None, '{"k":1}']], r'[["a\"b","é"],[]]': [['a"b', "é"], []],
    "garbage": None, "[1,2]": None, '[["a"],3]': None, '[["a"]] x': None, '[["a"]': None, '{"k":1}': None, '[{"k":1}]': None, '[["a"],null]': None, '"s"': None, '[["a"]][["b"]]': None, '["a"]': None, '[["a"]],"x":1': None,
}


def test_nested_arrays_and_malformed_rows(spark):
    df = spark.createDataFrame([(t,) for t in CASES] + [(None,)], "t string").select("t", N.string_arrays(F.col("t")).alias("p")).select("t", "p.*")
    got = {r["t"]: (r["value"], r["bad"]) for r in df.collect()}
    assert got.pop(None) == (None, None)
    assert got == {t: (v, t if v is None else None) for t, v in CASES.items()}
    back = df.where("value IS NOT NULL").select("value", N.to_json_arrays(F.col("value")).alias("j")).collect()
    assert all([[None if x is None else str(x) for x in a] for a in json.loads(r["j"])] == r["value"] for r in back)
