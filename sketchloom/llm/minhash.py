"""Near-duplicates by a join on MinHash coordinates, confirmed on full shingle sets.

1. Every text gives a set of shingle hashes and a signature of NARROW minima.
   Texts with equal sets become one representative, so exact copies never meet
   again until the end.
2. Of the ``NARROW`` coordinates a pair above the similarity agrees in at
   least ``AGREE`` (but for odds of about one in a million).  Two such
   signatures must share a pair (coordinate, value) among the NARROW - AGREE + 1
   that come first in one global order.  That prefix is posted and the rest
   skipped.  The order puts frequent pairs last, so a passage that thousands of
   texts share is skipped too; frequent pairs are those above a share of 1/1000,
   hence bounded in number.
3. Round one compares each posting list's members with its smallest member only.
   A pair's collisions are counted by merging the two signatures; pairs with
   ``AGREE`` go on.  A second signature, ``BINS`` bins of one permutation,
   estimates their similarity closely (nearly exactly where a text has fewer
   shingles than bins); pairs that may reach the threshold, by six standard
   deviations, are confirmed on their sets, and confirmed links contracted into
   components.
4. Round two takes the posting lists that still hold several components, and
   compares members of different components, in cells of a bounded number of
   rows.  Members that already share the component of the list's first member
   are not compared with each other.  After it every pair that shares a posted
   coordinate is in one component or was compared, so no link is lost.  A group
   whose members mostly link costs about one comparison a member.  Members that
   link with nobody are compared with the whole list, by their signatures; the
   sets are read for pairs that may reach the threshold.  Within a cell, rows
   that links above the threshold by five standard deviations already join are
   not compared further.

A frequent coordinate, a long list's first member and the copies of one text
are split over tasks: by broadcasting the few frequent keys, or by a part number
that the other side is repeated for.

Only representatives that are in some pair have their sets built, from their
texts.  Nothing is collected but the bounded list of frequent pairs and counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_frequent, materialize, text_of
from .components import components
from .textblocks import mix, shingle_sets

NARROW, AGREE = 24, 10
BINS, EMPTY = 512, 255
PREFIX = NARROW - AGREE + 1
FREQUENT = 1000
CELL = 128
#: Pairs of a list's first member that meet its set in one task; parts of any member's pairs in round two.
PART, PARTS = 256, 16


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * NARROW + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:NARROW] | np.uint64(1), seeds[NARROW:]


def signature(shingles: np.ndarray) -> np.ndarray:
    """The upper 32 bits of the smallest value of each of NARROW hash functions."""
    a, b = _coefficients()
    low = np.full(NARROW, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(shingles), 4096):
        part = shingles[i : i + 4096, None] * a + b
        np.minimum(low, (part ^ (part >> np.uint64(29))).min(axis=0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32).view(np.int32)


def bins(shingles: np.ndarray) -> np.ndarray:
    """A byte of the smallest shingle in each bin, the bins being ranges of the (sorted) hashes."""
    out = np.full(BINS, EMPTY, dtype=np.uint8)
    at = (shingles >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    out[at[first]] = (shingles[first] % np.uint64(EMPTY)).astype(np.uint8)
    return out


def may_link(x: np.ndarray, y: np.ndarray, nx, ny, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Whether pairs of bins (rows) may come from sets of at least that similarity, and whether they nearly surely do.

    At the threshold the union has (nx + ny) / (1 + similarity) shingles, of
    which the bins hold a sample without replacement.
    """
    full_x, full_y = x != EMPTY, y != EMPTY
    n = np.maximum((full_x | full_y).sum(axis=-1), 1)
    agree = ((x == y) & full_x).sum(axis=-1)
    union = (nx + ny) / (1 + similarity)
    left_out = np.maximum(union - n, 0) / np.maximum(union - 1, 1)
    sigma = np.sqrt(similarity * (1 - similarity) / n * left_out)
    sizes = np.minimum(nx, ny) >= similarity * np.maximum(nx, ny)
    return sizes & (agree >= n * (similarity - 6 * sigma) - 1.5), sizes & (agree >= n * (similarity + 5 * sigma) + 1.5)


_SIGNED = "doc_id long, n_shingles long, h1 long, h2 long, sig array<int>, bins binary"


def _signatures(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, h1, h2, sigs, held = [], [], [], [], []
            for s in shingle_sets(batch.column(1).to_pylist(), width):
                n.append(len(s))
                h1.append(int(s.sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                h2.append(int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                sigs.append(signature(s))
                held.append(bins(s).tobytes())
            flat = pa.array(np.concatenate(sigs) if sigs else np.empty(0, np.int32))
            at = pa.array(np.arange(len(sigs) + 1, dtype=np.int32) * NARROW)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.ListArray.from_arrays(at, flat), pa.array(held, pa.binary())],
                ["doc_id", "n_shingles", "h1", "h2", "sig", "bins"],
            )

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.view(np.int64) for s in shingle_sets(batch.column(1).to_pylist(), width)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["id", "shingles"])

    return run


def _rows(column, width: int) -> np.ndarray:
    """A binary column of equal lengths as a matrix of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, width)


def _signature_rows(column) -> np.ndarray:
    return np.array(column.flatten()).reshape(-1, NARROW)


def _filter_pairs(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b, part, sx, sy, x, y, nx, ny = batch.columns
                collisions = (_signature_rows(sx) == _signature_rows(sy)).sum(axis=1)
                ok, _ = may_link(_rows(x, BINS), _rows(y, BINS), np.array(nx), np.array(ny), similarity)
                yield batch.select([0, 1, 2]).filter(pa.array(ok & (collisions >= AGREE)))

    return run


def _prefixes(frequent: dict[int, int]):
    """(rep, token, mask): the postings of each representative, and a bit for each coordinate posted."""
    tokens = np.array(sorted(frequent), dtype=np.int64)
    counts = np.array([frequent[t] for t in tokens.tolist()], dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.array(batch.column(1).flatten()).reshape(-1, NARROW)
            token = (np.arange(NARROW, dtype=np.int64) << 32) | (sig.astype(np.int64) & 0xFFFFFFFF)
            often = np.zeros(token.shape, dtype=np.int64)
            if len(tokens):
                at = np.minimum(np.searchsorted(tokens, token), len(tokens) - 1)
                often = np.where(tokens[at] == token, counts[at], 0)
            by_hash = np.argsort(mix(token.view(np.uint64)), axis=1)
            order = np.take_along_axis(by_hash, np.argsort(np.take_along_axis(often, by_hash, 1), axis=1, kind="stable"), 1)[:, :PREFIX]
            posted = np.take_along_axis(token, order, 1)
            mask = (1 << order).sum(axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.array(batch.column(0)), PREFIX)), pa.array(posted.ravel()), pa.array(np.repeat(mask, PREFIX))], ["rep", "token", "mask"]
            )

    return run


def _cells(similarity: float):
    """Pairs of different components in a cell that share enough coordinates and may be similar enough.

    A pair meets in every list that both are posted in; it counts in the one of
    the lowest coordinate.
    """

    def run(t: pa.Table) -> pa.Table:
        out_a, out_b = [], []
        if t.num_rows > 1:
            rep, comp, side, n = (np.array(t[c]) for c in ("rep", "comp", "side", "n_shingles"))
            sig = np.array(t["sig"].combine_chunks().flatten()).reshape(-1, NARROW)
            held = _rows(t["bins"], BINS)
            posted = np.array(t["mask"])[:, None] >> np.arange(NARROW) & 1 == 1
            here = t["token"][0].as_py() >> 32
            right = np.flatnonzero(side != 0)
            comp = comp.copy()
            for i in np.flatnonzero(side != 1):
                other = right[comp[right] != comp[i]]
                same = sig[other] == sig[i]
                first = (same & posted[other] & posted[i]).argmax(axis=1)
                other = other[(same.sum(axis=1) >= AGREE) & (first == here)]
                maybe, surely = may_link(held[other], held[i], n[other], n[i], similarity)
                # one sure pair joins i with a whole component of the cell
                whole, at = np.unique(comp[other[surely]], return_index=True)
                close = np.concatenate([other[surely][at], other[maybe & ~np.isin(comp[other], whole)]])
                comp[np.isin(comp, whole)] = comp[i]
                for j in close:
                    out_a.append(min(rep[i], rep[j]))
                    out_b.append(max(rep[i], rep[j]))
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return run


#: Pairs of one row that are confirmed beside one copy of its set.
PAIRS = 64


def _beside(pairs: DataFrame, key: str, held: DataFrame) -> DataFrame:
    """(key, part, ...) pairs with what ``held`` knows of ``key``; a key in many pairs has a copy for each of their parts."""
    wanted = pairs.select(key, "part").distinct().join(held, key)
    return pairs.join(wanted, [key, "part"])


def _set_copies(pairs: DataFrame, key: str, part: str, sets: DataFrame, name: str) -> DataFrame:
    """(key, part, name): the set of each row of the pairs, a copy for every part of its pairs."""
    return pairs.select(key, part).distinct().join(sets.select(F.col("id").alias(key), F.col("shingles").alias(name)), key)


def _confirm(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b, part) whose full shingle sets are similar enough."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    # one plan at every size: neither side has a bound that a broadcast could rely on
    texts = docs.select("doc_id", text_of().alias("text")).join(ids.hint("merge"), "doc_id", "left_semi")
    sets = materialize(texts.mapInArrow(_sets(width), "id long, shingles array<long>"), "near-sets")
    # a row that is b of many pairs has a copy of its set for every PAIRS of them, dealt by their other rows
    often = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / PAIRS).alias("parts_b")).where("parts_b > 1")
    pairs = pairs.join(often.hint("merge"), "b", "left").withColumn("part_b", F.pmod(F.xxhash64("a"), F.coalesce("parts_b", F.lit(1)))).drop("parts_b")
    both = (
        pairs.join(_set_copies(pairs, "b", "part_b", sets, "sb"), ["b", "part_b"])
        .join(_set_copies(pairs, "a", "part", sets, "sa"), ["a", "part"])
        .withColumn("common", F.size(F.array_intersect("sa", "sb")))
        .where(100 * F.col("common") >= percent * (F.size("sa") + F.size("sb") - F.col("common")))
    )
    return materialize(both.select("a", "b"), "near-links")


def near_dedup(docs: DataFrame, percent: int = 85, width: int = 5) -> DataFrame:
    """Return (doc_id, n_shingles, component_id, kept), one row per row of ``docs``.

    Texts are lower-cased in A-Z and split at ASCII white space; their sets hold
    the distinct shingles of ``width`` words (all words as one, if fewer).  Texts
    with 100 * common >= percent * union are linked, and component_id is the
    smallest doc_id reachable.  A text without words has n_shingles 0 and is
    linked with nothing; a null text counts as empty.  A row without a doc_id
    has component_id null and is not kept.  Rows that repeat an id are one node.
    Other columns are ignored; an empty table gives an empty result.
    """
    if not 80 <= percent <= 100:
        raise ValueError("percent is 80 to 100; the signatures' thresholds assume that")
    ids = docs.select("doc_id", text_of().alias("text"))
    signed = materialize(ids.mapInArrow(_signatures(width), _SIGNED), "near-signed")
    reps = materialize(
        signed.where("n_shingles > 0 and doc_id is not null")
        .groupBy("n_shingles", "h1", "h2", "sig", "bins")
        .agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")),
        "near-reps",
    )
    similarity = percent / 100
    least = max(64, reps.count() // FREQUENT)
    token = F.posexplode(F.slice("sig", 1, NARROW)).alias("p", "v")
    frequent = (
        reps.select(token)
        .select(F.shiftleft(F.col("p").cast("long"), 32).bitwiseOR(F.col("v").cast("long").bitwiseAND(0xFFFFFFFF)).alias("token"))
        .groupBy("token")
        .count()
        .where(F.col("count") >= least)
        .limit(NARROW * FREQUENT)  # no more can have that share: it never cuts
        .collect()
    )
    posts = materialize(
        reps.select("rep", "sig").mapInArrow(_prefixes({r["token"]: r["count"] for r in frequent}), "rep long, token long, mask int"),
        "near-posts",
    )
    lists = materialize(
        posts.groupBy("token").agg(F.min("rep").alias("lead"), F.count(F.lit(1)).alias("size")).where("size > 1"), "near-lists"
    )
    posts = materialize(join_frequent(posts, lists, "token", "size", least), "near-shared")
    part = F.pmod(F.xxhash64("rep"), F.ceil(F.col("size") / PART)).cast("int")
    stars = posts.where("lead <> rep").groupBy(F.col("lead").alias("a"), F.col("rep").alias("b")).agg(F.min(part).alias("part"))
    of = lambda id_, *names: reps.select(F.col("rep").alias(id_), *[F.col(c).alias(n) for c, n in zip(("sig", "bins", "n_shingles"), names)])
    stars = _beside(stars.join(of("b", "sy", "y", "ny"), "b"), "a", of("a", "sx", "x", "nx"))
    first = materialize(stars.select("a", "b", "part", "sx", "sy", "x", "y", "nx", "ny").mapInArrow(_filter_pairs(similarity), "a long, b long, part int"), "near-stars")
    links = _confirm(first, docs, width, percent)
    comp = components(links, "a", "b")

    # round two: lists with several components
    member = posts.join(comp.select(F.col("id").alias("rep"), "comp"), "rep", "left").withColumn(
        "comp", F.coalesce("comp", "rep")
    )
    member = materialize(member, "near-members")
    per_comp = member.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("rep") == F.col("lead")).alias("leads"))
    open_lists = materialize(
        per_comp.groupBy("token")
        .agg(
            F.sum("n").alias("all"),
            F.sum(F.when(~F.col("leads"), F.col("n")).otherwise(0)).alias("n_rest"),
            F.max(F.when(F.col("leads"), F.col("comp"))).alias("main"),
        )
        .where("n_rest > 0"),
        "near-open",
    )
    member = join_frequent(member, open_lists, "token", "all", least).withColumn("is_main", F.col("comp") == F.col("main"))
    member = materialize(member.select("token", "rep", "mask", "comp", "is_main", "all", "n_rest"), "near-open-members")
    member = member.join(reps.select("rep", "n_shingles", "sig", "bins"), "rep")
    rest_cells = F.ceil(F.col("n_rest") / CELL).cast("int")
    main_cells = F.ceil((F.col("all") - F.col("n_rest")) / CELL).cast("int")
    spot = F.xxhash64("rep")
    own = F.pmod(spot, F.when(F.col("is_main"), main_cells).otherwise(rest_cells)).cast("int")
    # side 0: compared with side 1; side 2: both, within a cell
    as_main = F.transform(F.sequence(F.lit(0), rest_cells - 1), lambda r: F.struct(r.alias("x"), (-1 - F.col("own")).alias("y"), F.lit(1).alias("side")))
    as_rest = F.concat(
        F.transform(
            F.sequence(F.lit(0), rest_cells - 1),
            lambda r: F.struct(
                F.least(r, F.col("own")).alias("x"),
                F.greatest(r, F.col("own")).alias("y"),
                F.when(r == F.col("own"), 2).when(F.col("own") < r, 0).otherwise(1).alias("side"),
            ),
        ),
        F.when(main_cells > 0, F.transform(F.sequence(F.lit(0), F.greatest(main_cells - 1, F.lit(0))), lambda m: F.struct(F.col("own").alias("x"), (-1 - m).alias("y"), F.lit(0).alias("side")))).otherwise(
            F.array().cast("array<struct<x:int,y:int,side:int>>")
        ),
    )
    cells = (
        member.withColumn("own", own)
        .select("token", "rep", "mask", "comp", "n_shingles", "sig", "bins", F.explode(F.when(F.col("is_main"), as_main).otherwise(as_rest)).alias("c"))
        .select("token", "rep", "mask", "comp", "n_shingles", "sig", "bins", "c.x", "c.y", "c.side")
    )
    found = cells.groupBy("token", "x", "y").applyInArrow(_cells(similarity), "a long, b long").distinct()
    second = materialize(found.join(first, ["a", "b"], "left_anti"), "near-pairs")
    more = _confirm(second.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(PARTS)).cast("int")), docs, width, percent)
    comp = components(links.unionByName(more), "a", "b")

    keys = ["n_shingles", "h1", "h2"]
    is_node = F.coalesce((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.lit(False))
    # texts with equal sets: a third of the rows may have one
    least = max(64, signed.count() // FREQUENT)
    node = join_frequent(signed.where(is_node).select("doc_id", *keys), reps.select(*keys, "rep", "copies"), keys, "copies", least)
    node = materialize(node.select("doc_id", "n_shingles", "rep"), "near-nodes")
    top = materialize(reps.groupBy("rep").agg(F.sum("copies").alias("copies")).join(comp.select(F.col("id").alias("rep"), "comp"), "rep", "left"), "near-top")
    node = join_frequent(node, top, "rep", "copies", least).select("doc_id", "n_shingles", F.coalesce("comp", "rep").alias("comp"))
    label = node.unionByName(signed.where(~is_node).select("doc_id", "n_shingles", F.lit(None).cast("long").alias("comp")))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id"))
    return label.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept")
    )


def drop_near_duplicates(docs: DataFrame, percent: int = 85, width: int = 5) -> DataFrame:
    """``docs`` without the rows whose near-duplicate group has a smaller id.

    Rows without words, and rows without an id, all stay.
    """
    gone = near_dedup(docs, percent, width).where(F.col("doc_id").isNotNull() & ~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
