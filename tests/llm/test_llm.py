"""The training-data operators against brute force, round trips and held-out labels."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
import pyarrow as pa
from sketchloom.llm import bpe, components, exact_dedup, licenses, minhash, packing, pii, quality, queries, sharding, topk, toxicity
from sketchloom.llm.textblocks import lowered

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, first=0):
    rows = [(first + i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and clashing extra columns."""
    long = "word " * 30_000
    rows = [(None, "no id", None, None, None), (1, None, None, None, None), (2, "", "", "", 0), (3, long, "en", "s", 1), (3, long, "en", "s", 1), (4, "a b c d e f", "en", "s", 1), (5, "x" * 50_000, "en", "s", 1), (5, "other", "en", "s", 1)]
    df = spark.createDataFrame(rows, DOC)
    for c in ("score", "h", "t", "rep", "comp", "found", "kind", "shard", "slot", "at", "x", "token", "keep_id", "size", "bins"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOC)


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


# 1: top-k ---------------------------------------------------------------


def brute_top_k(rows, queries_, k):
    out = []
    for qi, q in queries_:
        scored = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in rows if i != qi and len(v) == len(q))[:k]
        out += [(qi, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize("sample", [1, 30])
def test_top_k_with_ties_lengths_and_large_values(spark, sample):
    rng = random.Random(3)
    rows = [(i, [rng.randint(-4, 4) for _ in range(20)]) for i in range(400)] + [(1000 + i, [1] * 20) for i in range(50)] + [(2000, [5]), (2001, [7]), (2002, [2**28] * 20)]
    df = spark.createDataFrame(rows, "vec_id long, vec array<long>")
    asked = [r for r in rows if r[0] % 50 == 0]
    got = topk.top_k(df, df.where("vec_id % 50 = 0"), 5, block_bytes=8 * 20 * 40, sample=sample).collect()
    assert sorted(map(tuple, got)) == brute_top_k(rows, asked, 5)


def test_top_k_drops_what_takes_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [nan, 1.0]), (2, [inf, 1.0]), (3, None), (4, [None, 1.0]), (5, []), (None, [1.0, 1.0]), (6, [0.5, -0.001])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("vec_id", topk.quantized(F.col("embedding")).alias("vec"))
    assert {r["vec_id"]: r["vec"] for r in df.where("vec is not null and vec_id is not null").collect()} == {0: [256, 512], 6: [128, -1]}
    assert [tuple(r) for r in topk.top_k(df, df.where("vec_id = 0")).collect()] == [(0, 1, 6, 256 * 128 - 512)]
    assert topk.top_k(df.where("false"), df.where("false")).count() == 0


def test_clustered_vectors_are_pruned():
    """Of 40 groups of similar rows a query scores little more than its own, and the result is that of brute force."""
    rng = np.random.default_rng(4)
    centres = rng.integers(-200, 200, (40, 8)).repeat(8, axis=1)
    x = centres.repeat(200, axis=0) + rng.integers(-20, 20, (8000, 64))
    ids, stats = np.arange(8000), {}
    q = x[::200]
    exact = q @ x.T
    exact[np.arange(40), ids[::200]] = np.iinfo(np.int64).min
    want = [sorted((-s, i) for i, s in enumerate(e))[:5] for e in exact.tolist()]
    least = np.full(40, np.iinfo(np.int64).min)
    at, vec, score = topk.best_of_block(ids[::200], q, least, ids, x, 5, stats)
    assert [[(-s, v) for a, v, s in zip(at, vec, score) if a == i] for i in range(40)] == want
    # with the thresholds that a sample gives
    sampled = np.sort(exact[:, rng.permutation(8000)[:2000]], axis=1)[:, -5]
    stats = {}
    at, vec, score = topk.best_of_block(ids[::200], q, sampled, ids, x, 5, stats)
    assert [[(-s, v) for a, v, s in zip(at, vec, score) if a == i] for i in range(40)] == want
    assert stats["pairs"] == 320_000 and stats["fine"] <= stats["coarse"] < 0.2 * stats["pairs"]


def test_segment_bound_holds():
    rng = np.random.default_rng(0)
    q, x = rng.integers(-300, 300, (30, 37)), rng.integers(-300, 300, (200, 37))
    for n in topk.LEVELS:
        assert (topk.segment_features(q, n) @ topk.segment_features(x, n).T + 1e-6 >= q @ x.T).all()


# 2: exact dedup -----------------------------------------------------------


def test_exact_dedup(spark):
    df = docs_of(spark, ["a", "b", "a", None, "", "a "])
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(df, "largest").collect()}
    assert got == {0: (2, 2, False), 1: (1, 1, True), 2: (2, 2, True), 3: (4, 2, False), 4: (4, 2, True), 5: (5, 1, True)}
    small = {r["doc_id"]: r["keep_id"] for r in exact_dedup.exact_dedup(df).collect()}
    assert small[2] == 0 and small[4] == 3
    assert exact_dedup.exact_dedup(df).where("doc_id = 0").first()["text_sha256"] == hashlib.sha256(b"a").hexdigest()
    assert sorted(r["doc_id"] for r in exact_dedup.distinct_documents(df).collect()) == [0, 1, 3, 5]
    assert exact_dedup.distinct_documents(df).columns == df.columns


def test_exact_dedup_of_a_heavy_group(spark):
    df = docs_of(spark, ["hot"] * 3000 + [f"t{i}" for i in range(2000)])
    got = exact_dedup.exact_dedup(df, "largest")
    assert got.where("kept").count() == 2001 and got.where("keep_id = 2999").count() == 3000
    assert got.where("group_size is null or keep_id is null").count() == 0


def test_exact_dedup_odd_rows(spark, odd, empty):
    got = exact_dedup.exact_dedup(odd, "largest").collect()
    assert len(got) == 8 and all(r["group_size"] >= 1 for r in got)
    assert [r["keep_id"] for r in got if r["doc_id"] is None] == [None]
    assert exact_dedup.exact_dedup(empty).count() == 0
    one = exact_dedup.distinct_documents(odd)
    assert one.count() == 6 and one.columns == odd.columns


# 3 and 4: classifiers ---------------------------------------------------------


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(1)
    plain = ["the", "cat", "sat", "on", "a", "mat", "under", "tree", "with", "green", "leaves", "singing"]
    bad = ["idiot", "worthless", "pathetic"]
    texts, rows = [], []
    for i in range(600):
        w = [rng.choice(plain) + rng.choice(["", "s", "ing"]) for _ in range(60)]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(4):
                w[rng.randrange(60)] = rng.choice(bad)
        texts.append(" ".join(w))
        rows.append((i, 1, int(toxic)))
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs_of(spark, texts), labels_of(spark, rows)).collect()}
    right = [(got[i] >= 0.5) == bool(t) for i, _, t in rows if held(i)]
    assert len(right) > 80 and sum(right) / len(right) > 0.97 and all(0 <= s <= 1 for s in got.values())


def test_toxicity_of_real_labels(spark):
    """The held-out fold of the labelled tables: trained dictionaries find most toxic documents and mark few others."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    rows = docs.join(labels, "doc_id").select("doc_id", "text", "toxic").collect()
    rows = [(r["doc_id"], r["text"] or "", r["toxic"]) for r in sorted(rows, key=lambda r: r["doc_id"]) if r["toxic"] is not None]
    model = toxicity.train([t for i, t, y in rows if not held(i)], [float(y) for i, t, y in rows if not held(i)])
    c = toxicity._compressors(model.toxic, model.ordinary)
    found = {y: [toxicity.score_text(model, c, t) >= 0.5 for i, t, v in rows if held(i) and v == y] for y in (0, 1)}
    assert np.mean(found[1]) > 0.8 and np.mean(found[0]) < 0.02
    assert model.toxic and model.ordinary and model.toxic not in model.ordinary


def test_weaker_marks_count_beside_a_frequent_one():
    rng = random.Random(4)
    plain = ["the", "cat", "sat", "on", "a", "mat", "under", "tree", "with", "green", "leaves", "singing"]
    texts, ys = [], []
    for i in range(1200):
        w = [rng.choice(plain) + rng.choice(["", "s", "ing", "ed"]) for _ in range(rng.randint(30, 60))]
        if i % 4 == 0:
            for _ in range(3):
                w[rng.randrange(30)] = "worthless" if i % 40 == 0 else "idiot"
        texts.append(" ".join(w))
        ys.append(float(i % 4 == 0))
    assert {b"idiot", b"worthless"} <= toxicity.marked_words(texts, ys)
    model = toxicity.train(texts, ys)
    found = [toxicity.score_text(model, toxicity._compressors(model.toxic, model.ordinary), t) >= 0.5 for t in texts if "worthless" in t]
    assert len(found) == 30 and np.mean(found) > 0.9


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, labels).collect()}
    rows = [(r["quality"], got[r["doc_id"]]) for r in labels.collect() if held(r["doc_id"])]
    good, poor = [s for q, s in rows if q], [s for q, s in rows if not q]
    auc = sum((g > p) + 0.5 * (g == p) for g in good for p in poor) / (len(good) * len(poor))
    assert auc > 0.95 and min(got.values()) >= 0 and max(got.values()) <= 1


def test_classifiers_learn_nothing_from_held_out_labels(spark):
    """Turning the held-out labels round changes no score."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r["doc_id"]: r["score"] for r in quality.score_quality(docs, x).collect()} for x in (labels, turned))
    assert a == b


@pytest.mark.parametrize("score", [toxicity.score_toxicity, quality.score_quality])
def test_classifiers_odd_rows(spark, odd, empty, score):
    none = labels_of(spark, [])
    assert score(odd, none).count() == 8 and score(empty, none).count() == 0
    labels = labels_of(spark, [(i, i % 2, i % 2) for i in range(3, 6)] + [(None, 1, 1), (4, None, None)])
    assert all(0 <= r["score"] <= 1 for r in score(odd, labels).collect())
    assert quality.filter_quality(odd, none, 0.6).count() == 0 and quality.filter_quality(odd, none, 0.5).columns == odd.columns


def test_windows_cover_all_words():
    text = "Alpha beta! " * 50 + "x" * 900 + " omega"
    pieces = toxicity.windows(text, 96)
    assert any(b" omega " in p for p in pieces) and sum(p.count(b" alpha ") for p in pieces) >= 50
    assert toxicity.windows("", 96) == []


# 5: licences ----------------------------------------------------------------


def brute_places(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    found = [(i, label) for p, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), sorted(i for i, _ in found), sorted({x for _, x in found})


@pytest.mark.parametrize(
    "text",
    [
        "", "Released under the MIT License.", "CC BY-NC 4.0 cc by nc cc by nc", "under the mit licenses", "é under the MIT\nLicense, Apache License, Version 2.0",
        "under the mit license " * 500, "no licence here 1 2 3", "日本 cc-by-nc",
    ],
)
def test_base_places(text):
    got = licenses.scan(text)
    assert (got["n_words"], got["places"], got["base"]) == brute_places(text)


def test_expressions():
    parse = licenses.parse_expression
    assert parse("MIT OR Apache-2.0 AND BSD-3-Clause") == ["mit", "apache-2.0", "bsd-3-clause", "and", "or"]
    assert parse("(MIT or GPL-3.0-only WITH Classpath-exception-2.0) and ISC */") == ["mit", "gpl-3.0-only", "classpath-exception-2.0", "with", "or", "isc", "and"]
    assert parse("MIT and") == ["mit"] and parse("and MIT") == [] and parse("(MIT") == [] and parse("") == []
    e = parse("MIT OR (GPL-2.0 AND BSD)")
    assert licenses.evaluate(e, {"mit"}) and licenses.evaluate(e, {"gpl-2", "bsd"}) and not licenses.evaluate(e, {"gpl-2"})
    got = licenses.scan("// SPDX-License-Identifier: MIT OR Apache-2.0\nint x;")
    assert got["labels"] == ["apache-2", "mit"] and got["base"] == [] and got["score"] == 0.95 and got["alternatives"] == ["apache-2", "mit"]


def test_labels_of_expressions():
    label = lambda t: licenses.scan(f"SPDX-License-Identifier: {t}\n")["labels"]
    assert label("GPL-2.0-only WITH LGPL-3.0-linking-exception") == ["gpl-2"]
    assert label("mitre-corp") == [] and label("MIT-0") == ["mit"] and label("GPL-2.0+") == ["gpl-2"] and label("BSD") == ["bsd"]
    both = licenses.scan("SPDX-License-Identifier: MIT AND (GPL-3.0 OR unknown-1 OR MPL-2.0)")
    assert both["alternatives"] == ["gpl-3+mit", "mit+mpl"]
    assert licenses.parse_expression("MIT or " * 200_000 + "MIT")[-1] == "or"


@pytest.mark.parametrize("between", [": ", ":", " ", " = ", "\t:\t"])
def test_tagged_expressions_that_begin_with_a_bracket(between):
    got = licenses.scan(f"# SPDX-License-Identifier{between}(MIT OR Apache-2.0) AND GPL-2.0-only\n")
    assert got["labels"] == ["apache-2", "gpl-2", "mit"] and got["expressions"] == [["mit", "apache-2.0", "or", "gpl-2.0-only", "and"]]


def test_license_rows(spark, odd, empty):
    got = licenses.scan_licenses(odd).collect()
    assert len(got) == 8 and all(r["score"] == 0.0 and r["labels"] == "" and r["first_word"] is None for r in got)
    assert licenses.scan_licenses(empty).count() == 0
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in queries.op5_licenses(spark, SF).collect():
        n, places, base = brute_places(text[r["doc_id"]])
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (n, len(places), ",".join(base))
        assert (r["first_word"], r["last_word"]) == ((places[0], places[-1]) if places else (None, None))


# 6: sharding ----------------------------------------------------------------


def test_new_shards_take_rows_only_into_themselves(spark):
    df = spark.range(4000).select(F.col("id").cast("string").alias("k"))
    tree = sharding.HashTree.uniform(2, 2, 2)
    for _ in range(3):
        grown = tree.grown()
        moved = df.select(sharding.shard_of(F.col("k"), tree).alias("a"), sharding.shard_of(F.col("k"), grown).alias("b")).where("a <> b")
        assert {r["b"] for r in moved.select("b").distinct().collect()} == {tree.n_shards()}
        tree = grown


def test_weights_confine_movement_and_set_shares(spark):
    df = spark.range(8000).select(F.col("id").cast("string").alias("k"))
    tree = sharding.HashTree((((1.0, 1.0), (1.0, 1.0)), ((1.0, 1.0), (1.0, 1.0))))
    heavy = sharding.HashTree((((1.0, 3.0), (1.0, 1.0)), ((1.0, 1.0), (1.0, 1.0))))
    both = df.select(sharding.shard_of(F.col("k"), tree).alias("a"), sharding.shard_of(F.col("k"), heavy).alias("b"))
    # no row leaves the region and the rack that gained for another one
    assert both.where("a < 4 and b >= 4").count() == 0 and both.where("a < 2 and b in (2, 3)").count() == 0
    n = {r["b"]: r["count"] for r in both.groupBy("b").count().collect()}
    assert abs(n[1] / 8000 - 0.3) < 0.03 and abs(n[5] / 8000 - 0.1) < 0.02
    with pytest.raises(ValueError):
        sharding.HashTree((((0.0,),),))


def test_sharding_rows(spark, odd, empty):
    got = queries.op6_sharding(spark, SF).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in got:
        data = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 1, zlib.crc32(data), "key")
        assert r["grown_shard"] in (r["shard"], 8)
    for s in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    tree = sharding.HashTree.uniform()
    rows = sharding.shard_documents(odd, tree).collect()
    assert len(rows) == 8 and len({r["shard"] for r in rows if r["doc_id"] == 3}) == 1
    assert sharding.shard_documents(empty, tree).count() == 0


# 7: packing -----------------------------------------------------------------


def check_packing(rows, want_ids):
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    for d, ids in want_ids.items():
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], dtype="<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == 2048 or at & (at - 1) == 0  # full, or a power of two: no padding at all


def reference_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [e.ids + [1] for e in t.encode_batch(texts, add_special_tokens=False)]


def test_packing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = dict(zip([r["doc_id"] for r in docs], reference_ids([r["text"] for r in docs])))
    check_packing(queries.op7_packing(spark, SF).collect(), want)


def test_packing_odd_rows(spark, odd, empty):
    make = packing.json_vocabulary(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    rows = packing.pack_documents(odd, make, 50_257).collect()
    assert sum(r["length"] for r in rows) == sum(len(i) for i in reference_ids([r["text"] or "" for r in odd.collect()]))
    assert packing.pack_documents(empty, make, 50_257).count() == 0


def stats_of(docs, n_terms):
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=n_terms)
    return packing.Statistics(df, len(docs), sum(map(len, docs)) / len(docs))


def test_neighbours_follow_their_seed():
    a, b = np.arange(100, 130, dtype="<u4"), np.arange(500, 530, dtype="<u4")
    docs = [a, b, b[::-1].copy(), a[::-1].copy()]
    assert list(packing.order_documents(docs, 64, stats_of(docs, 1000))) == [0, 3, 1, 2]


def test_neighbours_by_any_term_of_the_seed():
    seed, other = np.arange(100, 140, dtype="<u4"), np.arange(500, 530, dtype="<u4")
    docs = [seed, other, *(np.array([t, 900 + t], dtype="<u4") for t in seed)]
    found = packing.Index(docs, stats_of(docs, 2000)).neighbours(0, np.array([False] + [True] * 41))
    assert sorted(found.tolist()) == list(range(2, 42))


@pytest.mark.parametrize("dense", [0, 4096])
def test_order_of_documents_against_brute_force(monkeypatch, dense):
    monkeypatch.setattr(packing, "DENSE", dense)
    monkeypatch.setattr(packing, "TERMS", 7)
    rng = np.random.default_rng(8)
    docs = [rng.integers(0, 60, rng.integers(1, 90)).astype("<u4") for _ in range(150)]
    stats, window = stats_of(docs[:100], 60), 128  # the corpus' statistics are not the shard's
    counts = [collections.Counter(d.tolist()) for d in docs]

    def score(seed, d):
        weight = lambda t: stats.idf[t] * counts[d][t] * 2.2 / (counts[d][t] + 1.2 * (0.25 + 0.75 * len(docs[d]) / stats.mean))
        return sum(weight(t) for t in counts[seed] if counts[d][t])

    unused, at, seed = set(range(150)), 0, None
    got = list(packing.order_documents(docs, window, stats))
    for d in got:
        if at % window and seed is not None and any(score(seed, u) for u in unused):
            assert score(seed, d) >= max(score(seed, u) for u in unused) - 1e-4
        else:
            assert d == min(unused)
        unused.remove(d)
        if at % window == 0 or at // window != (at + len(docs[d])) // window:
            seed = d
        at += len(docs[d])
    assert sorted(got) == list(range(150))


def test_shards_do_not_depend_on_partitions(spark):
    """Related documents far apart in the table share a shard, however the table is split."""
    rng = random.Random(2)
    common, rare = [f"the{i}" for i in range(30)], [f"zyx{i}qv" for i in range(40)]
    texts = [" ".join([rng.choice(common) for _ in range(60)] + [rare[i % 40]] * 20) for i in range(400)]
    make = packing.json_vocabulary(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    out = []
    for n in (1, 7):
        rows = packing.pack_documents(docs_of(spark, texts).repartition(n), make, 50_257, shard_tokens=20_000).collect()
        check_packing(rows, dict(enumerate(reference_ids(texts))))
        out.append(sorted(tuple(r)[:5] + (r["sequence_id"], r["offset"]) for r in rows))
    assert out[0] == out[1]
    small = [s for s in {r[5] for r in out[0]} if sum(x[2] for x in out[0] if x[5] == s) < 2048]
    assert len({r[5] >> 32 for r in out[0]}) > 3 and len(small) <= 11  # the ends of all shards are joined


@pytest.mark.parametrize("block", [1, 50, 10_000])
def test_keys_against_brute_force(monkeypatch, block):
    monkeypatch.setattr(packing, "BLOCK", block)
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 40, rng.integers(1, 30)).astype("<u2") for _ in range(60)] + [np.array([45, 45], dtype="<u2")]
    stats = stats_of(docs, 50)
    want = []
    for d in docs:
        tf = {t: n for t, n in collections.Counter(d.tolist()).items() if stats.df[t] > 1}
        weight = {t: float(stats.weights(np.array([t]), np.array([n]), len(d))[0]) for t, n in tf.items()}
        want.append(min(weight, key=lambda t: (-weight[t], t)) if weight else -1)
    column = pa.array([d.tobytes() for d in docs], pa.binary())
    assert np.concatenate([stats.keys(b) for b in packing.blocks(column, "<u2")]).tolist() == want
    assert want[-1] == -1
    counted = sum(np.bincount(packing.term_counts(b)[1], minlength=50) for b in packing.blocks(column, "<u2"))
    assert counted.tolist() == stats.df.tolist()


def test_a_key_beyond_a_shard():
    got = packing.lay_out({5: 10, 7: 250, 9: 40, 11: 70}, 100)
    assert got == [(5, 0, 1), (7, 1, 3), (9, 4, 1), (11, 5, 1)]


def test_long_runs_and_added_tokens_in_packing(spark):
    texts = ["a <|endoftext|> b", " " * 1_500_000, "\n" * 1_200_000 + "x", "y" * 1_000_000, "<|endoftext|>"]
    make = packing.json_vocabulary(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    rows = packing.pack_documents(docs_of(spark, texts), make, 50_257).collect()
    for d in (0, 4):
        ids, own = reference_ids([texts[d]])[0], sorted((r for r in rows if r["doc_id"] == d), key=lambda r: r["start"])
        assert [r["ids_crc32"] for r in own] == [zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], dtype="<u4").tobytes()) for r in own]
        assert sum(r["length"] for r in own) == len(ids) == own[0]["doc_tokens"]
    assert {r["doc_id"]: r["doc_tokens"] for r in rows}[1] == 1_500_001


# 8: near dedup ----------------------------------------------------------------


def brute_components(texts, percent=85):
    sets = {}
    for i, t in texts.items():
        w = re.findall(rb"[^\x20\x09-\x0d]+", lowered(t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while True:
        moved = False
        for a, b in links:
            low = min(label[a], label[b])
            moved |= label[a] != label[b]
            label[a] = label[b] = low
        if not moved:
            return {i: (len(sets[i]), label[i], label[i] == i) for i in ids}


def near_corpus(seed, groups=12):
    """Groups of copies with more and more edits, common passages, short texts, exact copies."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    passage = [word() for _ in range(60)]
    out = []
    for g in range(groups):
        base = [word() for _ in range(rng.choice([6, 30, 150, 400]))]
        if g % 3 == 0:
            base = passage + base
        for _ in range(rng.randint(1, 14)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                w[rng.randrange(len(w))] = word()
            out.append(" ".join(w).upper() if rng.random() < 0.2 else "  ".join(w))
    out += ["", None, "   ", "one two", "ONE\ttwo", "one two three four five"]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_near_dedup_against_brute_force(spark, seed):
    texts = dict(enumerate(near_corpus(seed)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_dedup(docs_of(spark, list(texts.values()))).collect()}
    assert got == brute_components(texts)


def test_near_dedup_odd_rows(spark, odd, empty):
    got = minhash.near_dedup(odd).collect()
    assert len(got) == 8 and [(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None] == [(None, False)]
    assert minhash.near_dedup(empty).count() == 0
    stay = minhash.drop_near_duplicates(odd)
    assert stay.columns == odd.columns and stay.where("doc_id is null").count() == 1
    with pytest.raises(ValueError):
        minhash.near_dedup(odd, percent=50)


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    near = collections.defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    want = {}
    for s in sorted(near):
        todo = [s] if s not in want else []
        while todo:
            u = todo.pop()
            if u not in want:
                want[u] = s
                todo += near[u]
    got = {r["id"]: r["comp"] for r in components.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {k: v for k, v in want.items() if near[k] != {k}}


# 9: private data --------------------------------------------------------------


def test_surrogates(spark):
    texts = [
        "Mail Anna.Smith@corp.example.com or ANNA.SMITH@corp.example.com, call +1 (017) 555-7713 or +1 017 555 7713.",
        'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" and again token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"',
        "card 4111111111111111 or 4111 1111 1111 1111, bad 4111111111111112; ip 97.51.17.173.",
        "Mrs. Jane Roe met Mr. John Roe; MR. JOHN ROE left. Frau Müller. Г-жа Иванова.",
        "DE89 3704 0044 0532 0130 00 and 123-45-6789",
        "Version 2.0, section 3.4.5.6.7 and year 2024, nothing private.",
        None,
        "",
    ]
    got = {r["doc_id"]: r["text"] for r in pii.replace_pii(docs_of(spark, texts), "k").collect()}
    a, b = re.findall(r"\S+@corp\S*|\S+@\S+\.example\.com", got[0])[:2]
    assert "smith" not in got[0].lower() and a.lower().strip(",") == b.lower().strip(",") and b.split("@")[0].isupper()
    p1, p2 = re.findall(r"\+1[ ()\d-]+\d", got[0])
    assert re.sub(r"\D", "", p1) == re.sub(r"\D", "", p2) != "10175557713" and re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", p1)
    s1, s2 = re.findall(r'"([0-9a-f]{40})"', got[1])
    assert s1 == s2 != "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    luhn = lambda n: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(n))) % 10
    c1, c2, c3 = re.search(r"card (\d+) or ([\d ]+), bad (\d+);", got[2]).groups()
    assert c1 == c2.replace(" ", "") != "4111111111111111" and luhn(c1) == 0 and c3 != c1
    assert "97.51.17.173" not in got[2] and got[2].endswith(".")
    m = re.fullmatch(r"Mrs\. (\S+) (\S+) met Mr\. (\S+) (\S+); MR\. (\S+) (\S+) left\. Frau (\S+)\. Г-жа (\S+)\.", got[3])
    assert m[1] in pii._FIRST["Latin", "f"].split() and m[3] in pii._FIRST["Latin", "m"].split()
    assert re.fullmatch(r"[а-яА-Я]+", m[8]) and "Müller" not in got[3]
    assert "3704" not in got[4] and "123-45-6789" not in got[4] and re.search(r"\d{3}-\d{2}-\d{4}", got[4])
    assert (got[5], got[6], got[7]) == (texts[5], None, "")


def test_surrogates_stay_distinct(spark):
    """More entities than fit at first: 300 social security numbers, 500 addresses of two letters."""
    texts = [f"{i:03d}-45-6789 x{chr(97 + i % 26)}{chr(97 + i // 26)}@a.example.com" for i in range(300)]
    out = [r["text"] for r in pii.replace_pii(docs_of(spark, texts), "k").collect()]
    for pattern in (r"\d{3}-\d{2}-\d{4}", r"\S+@\S+"):
        before, after = ({x for t in ts for x in re.findall(pattern, t)} for ts in (texts, out))
        assert len(before) == len(after) == 300 and not before & after
    again = [r["text"] for r in pii.replace_pii(docs_of(spark, texts), "k").collect()]
    other = [r["text"] for r in pii.replace_pii(docs_of(spark, texts), "other").collect()]
    assert sorted(out) == sorted(again) and sorted(out) != sorted(other)


def test_surnames_beyond_three_syllables(spark):
    """27,000 surnames of three syllables exist; these are more."""
    names = ["X" + "".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(30_000)]
    texts = [", ".join(f"Mr {n}" for n in names[i : i + 50]) for i in range(0, len(names), 50)]
    out = [r["text"] for r in pii.replace_pii(docs_of(spark, texts), "k").collect()]
    after = {x for t in out for x in re.findall(r"Mr (\w+)", t)}
    assert len(after) == 30_000 and not after & set(names)


def test_surrogates_of_short_forms(spark):
    """One letter, or four digits, of which there are more entities than such forms."""
    texts = [f"{chr(97 + i % 26)}@{chr(97 + i // 26)}.com" for i in range(600)] + [f"+49 {i // 100:02d} {i % 100:02d}" for i in range(6000)]
    out = [r["text"] for r in pii.replace_pii(docs_of(spark, texts), "k").collect()]
    assert len(set(out)) == 6600 and not set(out) & set(texts)
    assert all(re.fullmatch(r"[a-z]+@[a-z]\.com|\+49 \d\d \d\d+", t) for t in out)


def test_surrogates_without_letters_and_digits(spark):
    texts = ["mail: ____@____.com", 'password = "--------"', "password = '________'", 'token = "++++++++"', "--@-.org"]
    got = {r["doc_id"]: r["text"] for r in pii.replace_pii(docs_of(spark, texts), "k").collect()}
    assert all(got[i] != t for i, t in enumerate(texts)) and len(set(got.values())) == 5
    assert re.fullmatch(r"mail: [a-z]{4}@____\.com", got[0]) and re.fullmatch(r'password = "[a-z]{8}"', got[1])


def test_names_stay_one_person(spark):
    text = (
        "Mr. John Smith called. Later John Smith and Mr. Smith left; SMITH, Smithson and blacksmith stayed; John knew. "
        "Dr. Jane Roe and Prof. Dr. Roe; Mrs. Jane Roe came. mail smith@a.com. Г-н Иван Петров, Петров."
    )
    got = {r["doc_id"]: r for r in pii.replace_pii(docs_of(spark, [text, "John Smith stays: no title here. Dr. Roe does not."]), "k").collect()}
    m = re.fullmatch(
        r"Mr\. (\w+) (\w+) called\. Later (\w+) (\w+) and Mr\. (\w+) left; (\w+), Smithson and blacksmith stayed; (\w+) knew\. "
        r"Dr\. (\w+) (\w+) and Prof\. Dr\. (\w+); Mrs\. (\w+) (\w+) came\. mail \w+@\w\.com\. Г-н (\w+) (\w+), (\w+)\.",
        got[0]["text"],
    )
    john, smith, jane, roe = m[1], m[2], m[8], m[9]
    assert not {"John", "Smith", "Jane", "Roe", "Иван", "Петров"} & set(m.groups())
    assert (m[3], m[4], m[5], m[6], m[7]) == (john, smith, smith, smith.upper(), john)
    assert (m[10], m[11], m[12]) == (roe, jane, roe) and len({john, smith, jane, roe}) == 4
    assert jane in pii._FIRST["Latin", "f"].split() and john in pii._FIRST["Latin", "m"].split()
    assert m[14] == m[15] and re.fullmatch("[а-яА-Я]+", m[13] + m[14])
    assert got[0]["pii_entities"] == 7 + 5 and got[1]["text"] == f"John Smith stays: no title here. Dr. {roe} does not."


def test_surrogates_against_brute_force(spark):
    """Each text apart, by a dictionary of the surrogates that single entities got: the same replacements."""
    entities = ["a.b@c.org", "+1 212 555 0100", "10.1.2.3", "4111 1111 1111 1111", "GB82 WEST 1234 5698 7654 32", "123-45-6789", "2001:db8::8a2e:370:7334", "fe80:0:0:0:1:2:3:4"]
    fill = ["time 12:34:56, std::ab::cd", "see 3.4.5.6.7", "page 12-13", ""]
    rng = random.Random(5)
    texts = [" ; ".join(rng.choice(entities + fill) for _ in range(rng.randint(1, 6))) for _ in range(60)]
    out = {r["doc_id"]: r["text"] for r in pii.replace_pii(docs_of(spark, entities + texts), "k").collect()}
    single = {e: out[i] for i, e in enumerate(entities)}
    assert all(a != b and re.sub(r"[0-9A-Za-z]+", "x", a) == re.sub(r"[0-9A-Za-z]+", "x", b) for a, b in single.items())
    for i, t in enumerate(texts, len(entities)):
        assert out[i] == " ; ".join(single.get(x, x) for x in t.split(" ; "))


def test_ibans_keep_right_check_digits(spark):
    def digits(x):
        return int("".join(str(int(c, 36)) for c in x))

    def iban(country, account):
        return f"{country}{98 - digits(account + country + '00') % 97:02d}{account}"

    rng = random.Random(1)
    right = [iban(c, "".join(rng.choice("0123456789") for _ in range(n))) for c, n in (("DE", 18), ("FR", 23), ("ES", 20)) for _ in range(20)]
    right += [iban("GB", "WEST" + "".join(rng.choice("0123456789") for _ in range(14)))]
    wrong = [x[:2] + f"{(int(x[2:4]) + 1) % 97 + 2:02d}" + x[4:] for x in right[:10]]
    out = {r["doc_id"]: r["text"] for r in pii.replace_pii(docs_of(spark, right + wrong), "k").collect()}
    valid = lambda x: digits(x[4:] + x[:4]) % 97 == 1
    assert all(valid(x) for x in right) and all(valid(out[i]) and out[i] != x for i, x in enumerate(right))
    assert not all(valid(out[len(right) + i]) for i in range(len(wrong)))


def test_a_hot_entity_and_clashing_columns(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("write to me@home.org or Mr. Hot Name, Hot Name").alias("text"), F.lit(1).alias("row"), F.lit("x").alias("found"), F.lit("y").alias("d"))
    got = pii.replace_pii(docs, "k")
    assert set(got.columns) == {*docs.columns, "pii_entities"} and got.select("text").distinct().count() == 1
    assert got.agg(F.sum("pii_entities"), F.countDistinct("doc_id")).first()[:] == (1600, 400)


def test_long_texts_of_every_pattern(spark, tmp_path):
    """A megabyte of what each pattern repeats: the matcher of the JVM must not recurse into it."""
    units = ["bb.", "Dr ", "Mr Dr ", "van ", "a@b.", "1.", "abcd:", ":", "0 ", "12-", "+49 ", "AB12 ", "A ", "O’N", "token=", "password: a1", "x" * 7 + "=", "(1) "]
    texts = [u * (1_000_000 // len(u)) for u in units] + [f"a@{'bb.' * 330_000}com", f"Mr {'Dr ' * 330_000}Name", f"Mr {'van ' * 250_000}Name"]
    docs_of(spark, texts).repartition(8).write.parquet(f"{tmp_path}/long")
    got = pii.replace_pii(spark.read.parquet(f"{tmp_path}/long"), "k")
    assert got.select(F.count("*"), F.count_if(F.length("text") > 600_000)).first()[:] == (len(texts), len(texts))


def test_particles_apostrophes_and_bare_credentials(spark):
    texts = ["Mrs. van der Berg and Mr de la Cruz", "Mr O’Neill, O’Neill", "password: hunter2secret99", "token = 'abcd1234!efgh'", "token: everything is fine", "a secret: nothing, Mr. van"]
    out = {r["doc_id"]: r["text"] for r in pii.replace_pii(docs_of(spark, texts), "k").collect()}
    assert re.fullmatch(r"Mrs\. van der (?!Berg)\p{Lu}\w+ and Mr de la (?!Cruz)\w+".replace("\\p{Lu}", "[A-Z]"), out[0])
    a, b = re.fullmatch(r"Mr ([^,]+), (.+)", out[1]).groups()
    assert a == b and "Neill" not in a
    assert out[2].startswith("password: ") and not re.search("hunter|secret99", out[2])
    assert re.fullmatch(r"token = '[a-z]{4}\d{4}![a-z]{4}'", out[3]) and "abcd1234" not in out[3]
    assert out[4] == texts[4] and out[5] == texts[5]


def test_surrogates_odd_rows(spark, odd, empty):
    got = pii.replace_pii(odd, "k")
    assert got.count() == 8 and set(got.columns) == {*odd.columns, "pii_entities"}
    assert pii.replace_pii(empty, "k").count() == 0


# 10: BPE ----------------------------------------------------------------------


def test_bpe_round_trip(spark, odd, empty):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    enc = bpe.encoder(path, public_tokenizers.PATTERN)
    for r in bpe.bpe_round_trip(odd, path, public_tokenizers.PATTERN).collect():
        texts = [x["text"] or "" for x in odd.collect() if x["doc_id"] == r["doc_id"]]
        want = {(len(i), hashlib.sha256(np.array(i, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for t in texts for i in [enc.encode_ordinary(t)]}
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) in want
    assert bpe.bpe_round_trip(empty, path, public_tokenizers.PATTERN).count() == 0 and isinstance(enc, tiktoken.Encoding)


def test_safe_pieces_change_no_id():
    enc = bpe.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    text = "It's  a test'll, 12 34\n\n x " * 400 + "<|endoftext|> ünï " * 50
    pieces = list(bpe.safe_pieces(text, 37))
    assert "".join(pieces) == text and len(pieces) > 100
    assert [i for p in pieces for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


def test_json_vocabulary_gives_the_same_ids():
    enc = bpe.json_encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    texts = ["Hello wörld 　 日本語 <|endoftext|> \x00\x7f 🙂 á", "x" * 300, "", " \n\t "]
    assert [[*bpe.encode(enc, t).tolist(), 1] for t in texts] == reference_ids(texts)


def test_added_tokens_are_found_in_texts(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n\n y", "<|endoftext", "no such token", "word <|endoftext|> " * 12_000]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert want[0] == [64, 220, 50256, 275]
    make = packing.json_vocabulary(path, public_tokenizers.PATTERN)
    assert [bpe.encode(make(), t).tolist() for t in texts] == want
    check_packing(packing.pack_documents(docs_of(spark, texts), make, 50_257).collect(), {i: [*ids, 1] for i, ids in enumerate(want)})


def test_long_blank_runs_beside_special_tokens():
    """Runs around the limit, in short and in long texts, before and after a special token, give the ids of both libraries."""
    import time

    enc = bpe.json_encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    texts = []
    for blank in ("\n", " ", "\r\n", "\u3000"):
        for n in (299, 300, 301, 9_999, 10_000, 10_001):
            for end in ("<|endoftext|>", "x", ""):
                texts += [f"a{blank * n}{end}", f"<|endoftext|>{blank * n}{end} b"]
    texts += ["word " * 25_000 + t for t in texts[::7]]
    want = [enc.encode(t, allowed_special="all") for t in texts]
    assert [bpe.encode(enc, t).tolist() for t in texts] == want
    some = texts[:24:5]
    assert [[*bpe.encode(enc, t).tolist(), 1] for t in some] == reference_ids(some)
    began = time.time()
    bpe.encode(enc, ("x" + " " * 9_999) * 200)
    assert time.time() - began < 3


# the pipeline -------------------------------------------------------------------


def test_pipeline_stages(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at = docs
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, at, SF).cache()
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes), name
        at = out
    ids = {r["doc_id"]: r["text"] for r in at.collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    first = {r["doc_id"]: r["text"] for r in P.keep_quality(spark, docs, SF).collect()}
    assert sum(q == 0 and i not in first for i, q in labels.items()) >= 0.7 * sum(q == 0 for q in labels.values())
    want = brute_components({i: t for i, t in first.items()})
    assert set(ids) == {i for i, (n, c, kept) in want.items() if kept or not n}
    rows = P.run(spark, SF).collect()
    check_packing(rows, dict(zip(ids, reference_ids(list(ids.values())))))


def test_pipeline_stages_on_odd_rows_and_without_labels(spark, odd, empty, tmp_path):
    """Nulls, repeats, long texts and an empty table pass every stage; without labels all documents have the prior's quality."""
    import corpus_pipeline as P

    labels_of(spark, []).write.parquet(f"{tmp_path}/labels.parquet")
    docs = odd.select(*[c.split()[0] for c in DOC.split(", ")])
    for name, stage in P.STAGES[:-1]:
        assert stage(spark, empty, str(tmp_path)).count() == 0, name
        out = stage(spark, docs, str(tmp_path)).cache()
        assert out.columns == docs.columns, name
        if name == "quality":
            assert out.count() == docs.count()
        docs = out
    ids = {r["doc_id"] for r in docs.collect()}
    rows = P.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r["doc_id"] for r in rows} == ids and sum(r["start"] == 0 for r in rows) == docs.count()


def test_long_texts_in_stretches(monkeypatch):
    from sketchloom.llm import textblocks as B

    rng = random.Random(2)
    texts = [" \t".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(n)) for n in (3, 4000, 700)] + ["", "x" * 9000]
    sets = [s.tolist() for s in B.shingle_sets(texts)]
    vectors = quality.index_vectors()
    means = [v.tolist() for v in quality.pooled(texts, vectors)]
    monkeypatch.setattr(B, "LONG_BYTES", 500)
    monkeypatch.setattr(B, "BLOCK_BYTES", 300)
    monkeypatch.setattr(B.stretches, "__defaults__", (300,))
    monkeypatch.setattr(B.blocks, "__defaults__", (300,))
    assert len(list(B.stretches(texts[1].encode()))) > 20
    assert [s.tolist() for s in B.shingle_sets(texts)] == sets
    assert [v.tolist() for v in quality.pooled(texts, vectors)] == means


def test_quality_is_fitted_by_a_task_on_the_rows_of_the_driver(spark):
    """No text of the training sample comes to the driver, and the model's rows and their order stay the same."""
    import os

    from sketchloom.llm import common as C

    sample = spark.createDataFrame([(f"text {i} " * (i % 7), float(i % 2)) for i in range(300)] + [("long " * 900, 1.0)], "text string, y double").repartition(5)
    driver = os.getpid()
    for bound in (10_000_000, 4000):
        pid, *rows = C.fit_bounded(sample, bound, lambda texts, ys: (os.getpid(), texts, ys))
        assert tuple(rows) == C.collect_bounded(sample, bound) and pid != driver
    with pytest.raises(ValueError):
        C.fit_bounded(sample.where("y = 1 AND length(text) > 4000"), 10, lambda *_: 1)
    assert C.fit_bounded(sample.limit(0), 10, lambda texts, ys: (texts, ys)) == ([], [])
