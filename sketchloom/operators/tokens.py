"""Token tables: n-grams, lookups by position, registry of universes, disambiguation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import estimators as E
from ..functions import hashing as H
from . import sketch as S

LAYERS = 3


def ngram_rows(docs: DataFrame, tokens: str, *keys: str, max_n: int = LAYERS) -> DataFrame:
    """(keys..., layer, ngram): all runs of 1 to ``max_n`` tokens of an array column; layer is n - 1."""
    # one flat array is exploded, so that the rows carry the keys only
    def runs(n: int) -> Column:
        return F.transform(H.ngrams(F.col(tokens), n), lambda g: F.struct(F.lit(n - 1).alias("layer"), g.alias("ngram")))

    return docs.select(*keys, F.explode(F.flatten(F.array(*[runs(n) for n in range(1, max_n + 1)]))).alias("x")).select(*keys, "x.layer", "x.ngram")


#: Bytes of text that are taken apart at once (or one longer text), and the n-grams of each length that are hashed at once.
PIECE, STEP = 2_000_000, 1 << 18
_BLANK = np.zeros(256, dtype=bool)
_BLANK[list(b" \t\n\x0b\x0c\r")] = True
_BYTES = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ np.uint64(0xA0761D6478BD642F)


def _pieces(texts: pa.Array):
    """(first row, texts as bytes) of stretches of an Arrow array of strings, each of PIECE bytes or one row."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    total, lo = np.concatenate([[0], np.cumsum(sizes)]), 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + PIECE, side="right")) - 1)
        yield lo, [t or b"" for t in texts.slice(lo, hi - lo).cast(pa.large_binary()).to_pylist()]
        lo = hi


def _grams(texts: list[bytes], max_n: int):
    """(data, row, layer, start, length) of stretches of the texts' n-grams: bytes, text and layer of each, place and length there.

    In ``data`` single spaces stand between the words, so an n-gram is a stretch of it.
    """
    raw = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    blank = _BLANK[raw]
    keep = ~blank
    opens = np.flatnonzero(keep & np.concatenate([[True], blank[:-1]]))
    keep[1:] |= ~blank[:-1]  # one blank behind each word
    data = np.where(blank, np.uint8(32), raw)[keep]
    end = np.flatnonzero(data == 32)
    start = np.concatenate([[0], end[:-1] + 1]) if len(end) else end
    begins = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    row = np.searchsorted(begins, opens, side="right") - 1
    for lo in range(0, len(row), STEP):
        parts = []
        for n in range(1, max_n + 1):
            at = np.arange(lo, max(lo, min(lo + STEP, len(row) - n + 1)))
            at = at[row[at] == row[at + n - 1]]
            parts.append((row[at], np.full(len(at), n - 1), start[at], end[at + n - 1] - start[at]))
        yield data, *map(np.concatenate, zip(*parts))


def text_positions(docs: DataFrame, text: str, key: str | None = None, max_n: int = 1, lower: bool = False, p: int = H.P_BITS) -> DataFrame:
    """(key?, layer, reg, zeros, n): positions of a text column's n-grams and how often each occurs.

    Words, n-grams and hashes are found in one pass over the bytes of each Arrow
    batch, a bounded stretch at a time, and counted there by key, so what leaves
    a batch is bounded by the bits of its keys and no n-gram becomes a row.
    """

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column(0)
            codes = batch.column(1).dictionary_encode() if key else None
            groups = np.array(codes.indices.fill_null(len(codes.dictionary)), dtype=np.int64) if key else np.zeros(batch.num_rows, dtype=np.int64)
            place, count = np.empty(0, np.int64), np.empty(0, np.int64)
            for first, piece in _pieces(texts):
                if lower:
                    piece = [t.decode("utf-8", "surrogatepass").lower().encode("utf-8", "surrogatepass") for t in piece]
                for data, row, layer, start, length in _grams(piece, max_n):
                    reg, zeros = H.positions_numpy(H.murmur64a_spans(data, start, length), p)
                    new = ((groups[first + row] * max_n + layer) << (p + 5)) | (reg.astype(np.int64) << 5) | zeros
                    new, n = np.unique(new[zeros < H.BITS], return_counts=True)
                    place, back = np.unique(np.concatenate([place, new]), return_inverse=True)
                    # whole numbers below 2^53 are exact
                    count = np.bincount(back, weights=np.concatenate([count, n]), minlength=len(place)).astype(np.int64)
            columns = [pa.array((place >> (p + 5)) % max_n, pa.int32()), pa.array((place >> 5) & (2**p - 1), pa.int32()), pa.array(place & 31, pa.int32()), pa.array(count, pa.int64())]
            names = ["layer", "reg", "zeros", "n"]
            if key:
                which = pa.array((place >> (p + 5)) // max_n)
                columns, names = [pa.concat_arrays([codes.dictionary, pa.nulls(1, codes.dictionary.type)]).take(which), *columns], [key, *names]
            yield pa.RecordBatch.from_arrays(columns, names)

    fields = "layer int, reg int, zeros int, n long"
    if key:
        fields = f"{key} {dict(docs.dtypes)[key]}, {fields}"
    rows = docs.select(F.col(text).alias("text"), *([key] if key else [])).mapInArrow(run, fields)
    return rows.groupBy(*([key] if key else []), "layer", "reg", "zeros").agg(F.sum("n").alias("n"))


def text_ngrams(docs: DataFrame, text: str, max_n: int = LAYERS, p: int = H.P_BITS) -> DataFrame:
    """(layer, hash, reg, zeros, ngram, tf): rows of a token table, counted within bounded stretches of a text column.

    An n-gram has as many rows as stretches that hold it; ``merge_rows`` adds
    them up.  Also for streams, since no row needs another.
    """

    def run(batches):
        for batch in batches:
            for _, piece in _pieces(batch.column(0)):
                for data, _, layer, start, length in _grams(piece, max_n):
                    h = H.murmur64a_spans(data, start, length)
                    reg, zeros = H.positions_numpy(h, p)
                    # copies come to stand side by side; where different n-grams of one hash lie between them, there are more rows
                    order = np.argsort(h)
                    order = order[zeros[order] < H.BITS]
                    if not len(order):
                        continue
                    layer, start, length, h, reg, zeros = (x[order] for x in (layer, start, length, h, reg, zeros))
                    same = (layer[1:] == layer[:-1]) & (h[1:] == h[:-1]) & (length[1:] == length[:-1])
                    # bytes decide whether neighbours are copies
                    same[same] = _equal(data, start[:-1][same], start[1:][same], length[1:][same])
                    first = np.flatnonzero(np.concatenate([[True], ~same]))
                    size = length[first]
                    offsets = np.concatenate([[0], np.cumsum(size)])
                    text_ = data[np.arange(offsets[-1]) + np.repeat(start[first] - offsets[:-1], size)]
                    ngram = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(text_)).cast(pa.string())
                    tf = np.diff(np.concatenate([first, [len(order)]]))
                    columns = [pa.array(layer[first], pa.int32()), pa.array(h[first]), pa.array(reg[first]), pa.array(zeros[first]), ngram, pa.array(tf, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["layer", "hash", "reg", "zeros", "ngram", "tf"])

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "layer int, hash long, reg int, zeros int, ngram string, tf long")


def _equal(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the stretches at ``a`` and at ``b`` hold the same bytes."""
    offsets = np.concatenate([[0], np.cumsum(length)])
    at = np.arange(offsets[-1]) - np.repeat(offsets[:-1], length)
    differs = data[at + np.repeat(a, length)] != data[at + np.repeat(b, length)]
    return np.diff(np.concatenate([[0], np.cumsum(differs)])[offsets]) == 0


def _checks(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Second hashes of stretches, 32 bits of a polynomial in their bytes."""
    if not len(start):
        return np.empty(0, np.uint32)
    low = int(start.min())
    data, start = data[low : int((start + length).max())], start - low
    base = 0x9E3779B97F4A7C15
    powers, back = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(data), np.uint64(b))])) for b in (base, pow(base, -1, 2**64)))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTES[data] * powers[:-1])])
    x = (sums[start + length] - sums[start]) * back[start] + length.astype(np.uint64) * np.uint64(base)
    return (((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)).astype(np.uint32)


def _blobs(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """An Arrow array of the bytes of the stretches between ``bounds``."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * values.itemsize).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def text_entries(docs: DataFrame, text: str, max_n: int = LAYERS, p: int = H.P_BITS, per_bucket: int = 4_000_000) -> DataFrame:
    """(layer, hash, reg, zeros, tf, collisions): the token table of a text column without the n-grams themselves.

    Different n-grams of one hash are told apart by a second hash, of some 30
    bits, so that no n-gram passes a shuffle.  Stretches of text are counted by
    themselves, their hashes are dealt into ranges, as many as the bytes of
    text ask for, and each range is added up by itself.
    """
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    bits = min(24, max(1, int(size * max_n // (2 * per_bucket)).bit_length()))  # a word has a byte and a blank at least

    def run(batches):
        for batch in batches:
            for _, piece in _pieces(batch.column(0)):
                for data, _, layer, start, length in _grams(piece, max_n):
                    h = H.murmur64a_spans(data, start, length)
                    check = _checks(data, start, length)
                    check = (check.astype(np.uint64) % np.uint64(2**32 // max_n) * np.uint64(max_n) + layer.astype(np.uint64)).astype(np.uint32)  # the layer is its remainder
                    ok = H.positions_numpy(h, p)[1] < H.BITS
                    h, check = h.view(np.uint64)[ok], check[ok]
                    if not len(h):
                        continue
                    order = np.argsort(h)
                    h, check = h[order], check[order]
                    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (check[1:] != check[:-1])]))
                    n = np.diff(np.concatenate([first, [len(h)]])).astype(np.uint32)
                    h, check = h[first], check[first]
                    bucket = (h >> np.uint64(64 - bits)).astype(np.int64)
                    opens = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
                    bounds = np.concatenate([opens, [len(h)]])
                    yield pa.RecordBatch.from_arrays([pa.array(bucket[opens]), *(_blobs(v, bounds) for v in (h, check, n))], ["bucket", "h", "c", "n"])

    def add(table: pa.Table) -> pa.Table:
        h, c, n = (np.frombuffer(b"".join(table[k].to_pylist()), dtype=kind) for k, kind in (("h", np.int64), ("c", np.uint32), ("n", np.uint32)))
        order = np.argsort(h)
        if ((h[order][1:] == h[order][:-1]) & (c[order][1:] != c[order][:-1])).any():
            order = np.lexsort((c, c % np.uint32(max_n), h))
        h, c, n = h[order], c[order], n[order].astype(np.int64)
        layer = (c % np.uint32(max_n)).astype(np.int32)
        entry = np.concatenate([[True], (h[1:] != h[:-1]) | (layer[1:] != layer[:-1])])
        gram = entry | np.concatenate([[True], c[1:] != c[:-1]])
        first = np.flatnonzero(entry)
        reg, zeros = H.positions_numpy(h[first], p)
        columns = [layer[first], h[first], reg, zeros, np.add.reduceat(n, first), np.add.reduceat(gram, first, dtype=np.int32)]
        return pa.table([pa.array(x) for x in columns], names=["layer", "hash", "reg", "zeros", "tf", "collisions"])

    rows = docs.select(F.col(text).alias("text")).mapInArrow(run, "bucket long, h binary, c binary, n binary")
    return rows.groupBy("bucket").applyInArrow(add, "layer int, hash long, reg int, zeros int, tf long, collisions int")


def build_lut(ngrams: DataFrame, **options) -> DataFrame:
    """The token table: one row for each (layer, hash).

    (layer, hash, reg, zeros, ngrams array, first_tokens array, collisions, tf).
    Copies are counted before anything is hashed, so the hash runs once for each
    distinct n-gram.  Different n-grams with one hash share a row.
    """
    counted = ngrams.groupBy("layer", "ngram").agg(F.count(F.lit(1)).alias("tf"))
    return merge_lut(
        S.positions(counted, "ngram", **options).select(
            "layer", "hash", "reg", "zeros", F.array("ngram").alias("ngrams"), F.array(first_token(F.col("ngram"))).alias("first_tokens"), "tf"
        )
    )


def first_token(ngram: Column) -> Column:
    return F.substring_index(ngram, " ", 1)


def lut_rows(ngrams: DataFrame, **options) -> DataFrame:
    """Rows of a token table, (layer, hash, reg, zeros, ngram, tf), of n-grams (layer, ngram); those of ``text_ngrams`` are rows already."""
    if "tf" in ngrams.columns:
        return ngrams.select("layer", "hash", "reg", "zeros", "ngram", "tf")
    counted = ngrams.groupBy("layer", "ngram").agg(F.count(F.lit(1)).alias("tf"))
    return S.positions(counted, "ngram", **options).select("layer", "hash", "reg", "zeros", "ngram", "tf")


def merge_rows(rows: DataFrame) -> DataFrame:
    """The token table of ``lut_rows``, those of several batches too."""
    merged = rows.groupBy("layer", "hash", "reg", "zeros").agg(F.array_sort(F.collect_set("ngram")).alias("ngrams"), F.sum("tf").alias("tf"))
    first = F.array_sort(F.array_distinct(F.transform("ngrams", first_token)))
    return merged.select("layer", "hash", "reg", "zeros", "ngrams", first.alias("first_tokens"), "tf", F.size("ngrams").alias("collisions"))


def merge_lut(rows: DataFrame) -> DataFrame:
    """Upsert: rows of one hash unite their n-grams and add their counts."""
    return (
        rows.groupBy("layer", "hash", "reg", "zeros")
        .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ngrams")))).alias("ngrams"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("first_tokens")))).alias("first_tokens"), F.sum("tf").alias("tf"))
        .withColumn("collisions", F.size("ngrams"))
    )


def lookup(lut: DataFrame, positions: DataFrame, layer: int | None = None) -> DataFrame:
    """Entries of the table at the given positions.

    A sketch has at most 2^p * 32 positions, so that side may be broadcast.
    """
    entries = lut if layer is None else lut.where(F.col("layer") == layer)
    return entries.join(positions, ["reg", "zeros"])


def has_candidates(lut: DataFrame, positions: DataFrame) -> DataFrame:
    return positions.join(lut, ["reg", "zeros"], "left_semi")


def orphans(lut: DataFrame, positions: DataFrame) -> DataFrame:
    """Positions that no entry explains."""
    return positions.join(lut, ["reg", "zeros"], "left_anti")


def by_hash(lut: DataFrame, hashes: DataFrame) -> DataFrame:
    return lut.join(hashes, "hash", "left_semi")


def by_first_token(lut: DataFrame, token: str) -> DataFrame:
    return lut.where(F.array_contains("first_tokens", token))


def high_collisions(at: DataFrame, least: int, limit: int) -> DataFrame:
    return at.where(F.col("entries") >= least).orderBy(F.desc("entries"), "layer", "reg", "zeros").limit(limit)


def at_positions(lut: DataFrame) -> DataFrame:
    """(layer, reg, zeros, entries): how many entries compete for a position."""
    return lut.groupBy("layer", "reg", "zeros").agg(F.count(F.lit(1)).alias("entries"))


def lut_stats(lut: DataFrame) -> DataFrame:
    at = lut.groupBy("reg", "zeros").agg(F.count(F.lit(1)).alias("n"))
    return at.agg(
        F.sum("n").alias("entries"),
        F.count(F.lit(1)).alias("positions"),
        (F.sum((F.col("n") > 1).cast("long")) / F.count(F.lit(1))).alias("collision_rate"),
        F.max("n").alias("max_depth"),
    )


def registers(lut: DataFrame) -> DataFrame:
    """(reg, token, unigram, first1, first2, after1, survives): what each register's layers offer, one row a token.

    A unigram survives if n-grams of both further layers start with it in the
    same register; a layer without entries there does not filter.  A register
    without tokens has a row with a null one.
    """
    offered = F.when(F.col("layer") == 0, F.col("ngrams")).when(F.col("layer").isin(1, 2), F.col("first_tokens"))
    rows = lut.select("reg", "layer", F.explode_outer(offered).alias("token"))
    has = lambda layer: F.coalesce(F.max((F.col("layer") == layer) & F.col("token").isNotNull()), F.lit(False))
    per = rows.groupBy("reg", "token").agg(has(0).alias("unigram"), has(1).alias("first1"), has(2).alias("first2"))
    layers = per.groupBy("reg").agg(F.max("first1").alias("has1"), F.max("first2").alias("has2"))
    per = per.join(layers, "reg").withColumn("after1", F.col("unigram") & (F.col("first1") | ~F.col("has1")))
    return per.withColumn("survives", F.col("after1") & (F.col("first2") | ~F.col("has2"))).select("reg", "token", "unigram", "first1", "first2", "after1", "survives")


def register_filter(lut: DataFrame) -> DataFrame:
    """(reg, initial, after_layer1, surviving, confidence) of each register's unigrams; only survivors are listed."""
    g = registers(lut).groupBy("reg").agg(
        F.count_if("unigram").cast("int").alias("initial"), F.count_if("after1").cast("int").alias("after_layer1"), F.array_sort(F.collect_list(F.when(F.col("survives"), F.col("token")))).alias("surviving")
    )
    return g.withColumn("confidence", F.when(F.size("surviving") > 0, 1.0 / F.size("surviving")).otherwise(0.0))


def disambiguate(lut: DataFrame, positions: DataFrame) -> DataFrame:
    """(reg, zeros, candidates, confidence, method) for each position of a sketch.

    One candidate is exact.  Among several, the tokens that all layers present
    share are kept (or, if there are none, those of at least half the layers);
    if that narrows them the method is triangulated, and its confidence the
    share of three layers.  Otherwise it is a guess among all.
    """
    found = positions.join(lut.select("reg", "zeros", "layer", "ngrams", "first_tokens"), ["reg", "zeros"], "left")
    tokens = F.when(F.col("layer") == 0, F.col("ngrams")).otherwise(F.col("first_tokens"))
    per = found.select("reg", "zeros", "layer", F.explode_outer("ngrams").alias("ngram"), tokens.alias("tokens"))
    unigrams = per.where("layer IS NOT NULL").select("reg", "zeros", "layer", F.explode("tokens").alias("t")).distinct()
    shared = unigrams.groupBy("reg", "zeros", "t").agg(F.count(F.lit(1)).alias("layers"))
    present = per.groupBy("reg", "zeros").agg(F.countDistinct("layer").alias("n_layers"), F.array_sort(F.collect_set("ngram")).alias("all"))
    votes = shared.groupBy("reg", "zeros").agg(F.array_sort(F.collect_list(F.struct("t", "layers"))).alias("votes"))
    j = present.join(votes, ["reg", "zeros"], "left")
    in_all = F.transform(F.filter("votes", lambda v: v["layers"] == F.col("n_layers")), lambda v: v["t"])
    in_half = F.transform(F.filter("votes", lambda v: v["layers"] * 2 >= F.col("n_layers")), lambda v: v["t"])
    j = j.withColumn("keep", F.when(F.size(in_all) > 0, in_all).otherwise(in_half))
    narrowed = F.filter("all", lambda g: F.exists("keep", lambda t: F.array_contains(F.split(g, " "), t)))
    j = j.withColumn("narrow", F.when(F.col("n_layers") > 1, narrowed))
    several = F.size("all")
    method = F.when(several == 0, "no_candidates").when(several == 1, "exact").when((F.col("n_layers") > 1) & (F.size("narrow") > 0), "triangulated").otherwise("best_guess")
    return j.withColumn("method", method).select(
        "reg", "zeros",
        F.when(F.col("method") == "triangulated", F.col("narrow")).otherwise(F.col("all")).alias("candidates"),
        F.when(F.col("method") == "exact", 1.0).when(F.col("method") == "triangulated", F.col("n_layers") / F.lit(3.0)).when(F.col("method") == "best_guess", 1.0 / several).otherwise(0.0).alias("confidence"),
        "method",
    )


def ranked_tokens(disambiguated: DataFrame, limit: int) -> DataFrame:
    """Candidates by the number of positions they occur at."""
    rows = disambiguated.select(F.explode("candidates").alias("token"), F.col("method"))
    n = rows.groupBy("token").agg(F.count(F.lit(1)).alias("positions"), F.max((F.col("method") == "exact").cast("int")).alias("exact"))
    return n.orderBy(F.desc("positions"), "token").limit(limit)


def registry(ngrams: DataFrame, **options) -> DataFrame:
    """Long form of each layer's universe, (layer, reg, zeros)."""
    return S.long_form(ngrams, "ngram", "layer", **options)


def coverage_novelty(sketches: DataFrame, universe: DataFrame, key: str, p: int = H.P_BITS) -> DataFrame:
    """(key, coverage, novelty) of each sketch against one universe (reg, zeros)."""
    m = 2**p
    marked = sketches.select(key, "reg", "zeros").join(universe.select("reg", "zeros", F.lit(1).alias("inside")), ["reg", "zeros"], "left")
    counts = marked.groupBy(key, "zeros").agg(F.count(F.lit(1)).alias("c"), F.count("inside").alias("c_in"))
    counts = counts.withColumn("c_out", F.col("c") - F.col("c_in"))
    g = counts.groupBy(key).agg(*E.ht_aggregates(m, "c", name="a"), *E.ht_aggregates(m, "c_in", name="i"), *E.ht_aggregates(m, "c_out", name="o"))
    size = S.cardinality(universe, p=p).first()
    total = F.lit(float(size["card"]) if size else 0.0)
    one = F.lit(1.0)
    return g.select(
        key, E.ht_estimate(m, "a").alias("card"),
        F.when(total > 0, F.least(one, E.ht_estimate(m, "i") / total)).otherwise(0.0).alias("coverage"),
        F.when(E.ht_estimate(m, "a") > 0, F.least(one, E.ht_estimate(m, "o") / E.ht_estimate(m, "a"))).otherwise(0.0).alias("novelty"),
    )


def snapshot(packed: DataFrame) -> DataFrame:
    """(snapshot, layers): the address of a registry's layers (layer, bitmap) together."""
    ordered = F.array_sort(F.collect_list(F.struct("layer", F.hex("bitmap").alias("x"))))
    return packed.agg(F.sha1(F.unhex(F.array_join(F.transform(ordered, lambda s: s["x"]), ""))).alias("snapshot"), F.count(F.lit(1)).alias("layers"))


def merge_registries(a: DataFrame, b: DataFrame) -> DataFrame:
    return S.merge(a.select("layer", "bitmap").unionByName(b.select("layer", "bitmap")), "layer")


def staged(lut: DataFrame, positions: DataFrame, stages: list[tuple[str, int | None, Column | None]]) -> DataFrame:
    """(stage, layer, reg, zeros, ngrams): candidates under each stage's layer and condition."""
    out = None
    for name, layer, condition in stages:
        found = lookup(lut, positions, layer)
        found = found if condition is None else found.where(condition)
        one = found.select(F.lit(name).alias("stage"), "layer", "reg", "zeros", "ngrams")
        out = one if out is None else out.unionByName(one)
    return out


def get(lut: DataFrame, keys: DataFrame) -> DataFrame:
    """Entries of the given (layer, hash); absent ones have a row with null tf."""
    return keys.select("layer", "hash").join(lut, ["layer", "hash"], "left")


def increment(lut: DataFrame, more: DataFrame) -> DataFrame:
    """The table with further occurrences (layer, ngram) counted in; new n-grams get entries."""
    return merge_lut(lut.drop("collisions").unionByName(build_lut(more).drop("collisions")))


def top_tokens(disambiguated: DataFrame, limit: int) -> DataFrame:
    """(token, positions, confidence): candidates by positions, each surer the fewer competed with it: 1 / (1 + 0.1 n)."""
    rows = disambiguated.select(F.explode("candidates").alias("token"), F.size("candidates").alias("n"))
    g = rows.groupBy("token").agg(F.count(F.lit(1)).alias("positions"), F.max(1 / (1 + 0.1 * F.col("n"))).alias("confidence"))
    return g.orderBy(F.desc("positions"), F.desc("confidence"), "token").limit(limit)


def survivor_stats(filtered: DataFrame) -> DataFrame:
    """One row on ``register_filter``: registers, unigrams before and after, registers left with one."""
    return filtered.agg(
        F.count(F.lit(1)).alias("registers"), F.sum("initial").alias("initial"), F.sum(F.size("surviving")).alias("surviving"), F.count_if(F.size("surviving") == 1).alias("unique")
    )


def scan_matches(lut: DataFrame, positions: DataFrame, pattern: str, path: str) -> DataFrame:
    """Candidates whose n-gram matches a LIKE pattern, written to a sink and read from it: (layer, reg, zeros, ngram)."""
    found = lookup(lut, positions).select("layer", "reg", "zeros", F.explode("ngrams").alias("ngram")).where(F.col("ngram").like(pattern))
    found.write.mode("errorifexists").parquet(path)
    return lut.sparkSession.read.schema(found.schema).parquet(path)


def sketch_trigrams(lut: DataFrame, sketches: DataFrame, key: str) -> DataFrame:
    """(key, ngram): the table's trigrams at the positions of each sketch of trigrams (key, reg, zeros)."""
    return sketches.join(lut.where("layer = 2").select("reg", "zeros", F.explode("ngrams").alias("ngram")), ["reg", "zeros"]).select(key, "ngram").distinct()


def restore_order(lut: DataFrame, sketches: DataFrame, key: str) -> DataFrame:
    """(key, sequence, is_eulerian): token order out of a sketch of padded trigrams and a token table alone.

    The candidates at the sketch's positions are the edges of a De Bruijn graph,
    tried in the order of their names.
    """
    from .debruijn import restore

    parts = F.split("ngram", " ")
    edges = sketch_trigrams(lut, sketches, key).select(
        key, "ngram", F.concat_ws(" ", parts[0], parts[1]).alias("src"), F.concat_ws(" ", parts[1], parts[2]).alias("dst"), F.lit(1).alias("multiplicity")
    )
    return restore(edges, key, "ngram")
