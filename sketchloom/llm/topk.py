"""Exact top-k inner products by multi-resolution segment statistics.

A vector is cut into segments at several resolutions, and each segment is kept
as its mean and deviation.  For two vectors, segment by segment,
L * ((m - m')^2 + (s - s')^2) is a lower bound of the squared distance, and as
the squared norms are known it gives an upper bound of the inner product.

1. Every query meets a block of sampled rows exactly; the k-th best score there
   is its threshold, which it carries into every cell.
2. In a cell, a (query, row) pair whose bound at the coarsest resolution is below
   the query's threshold is dropped; the survivors get the finer bound, and what
   survives that its exact integer score.  Rows are taken in the order of their
   coarse bounds, best first, so thresholds rise early.  Where few pairs of a
   tile survive they are scored singly, where many do the tile's surviving rows
   are scored by one matrix product; either way the result is exact.

Queries and rows are packed into blocks of a bounded number of bytes, one Arrow
row each.  A cell is a pair of blocks; cells meet in a cogroup, so memory is
bounded by two blocks and a tile of scores, and neither side is broadcast.  Each
cell returns at most k rows a query, and a window keeps the best k of those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

_NAMES = ["dim", "block", "n", "wide", "ids", "vecs", "least"]
LEVELS = (4, 16)
QUERY_TILE, ROW_TILE = 256, 4096
#: Bytes of a block's vectors, and rows of the sample that gives the first thresholds.
BLOCK_BYTES, SAMPLE = 32_000_000, 2048
#: Share of a tile's pairs up to which survivors are scored singly; a matrix product costs less beyond.
SINGLY = 0.02
_BLOCK = "dim int, block int, n int, wide boolean, ids binary, vecs binary, least binary"


def quantized(vec: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component; null for a vector that takes no part."""
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = F.transform(vec, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    return F.when(vec.isNotNull() & (F.size(vec) > 0) & fine, whole)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of a partition as one block for each length of vector, sorted by id; components of 32 bits where they fit."""
    ids: dict[int, list] = {}
    vecs: dict[int, list] = {}
    least: dict[int, list] = {}
    for batch in batches:
        lists = batch.column(1)
        lengths = np.diff(np.array(lists.offsets))
        flat, at, own, low = np.array(lists.flatten()), np.array(lists.offsets) - lists.offsets[0].as_py(), np.array(batch.column(0)), np.array(batch.column(2))
        for dim in np.unique(lengths).tolist():
            rows = np.flatnonzero(lengths == dim)
            ids.setdefault(dim, []).append(own[rows])
            vecs.setdefault(dim, []).append(flat[at[rows][:, None] + np.arange(dim)])
            least.setdefault(dim, []).append(low[rows])
    block = TaskContext.get().partitionId()
    for dim in sorted(ids):
        i, v, t = (np.concatenate(x[dim]) for x in (ids, vecs, least))
        order = np.argsort(i, kind="stable")
        wide = bool(np.abs(v).max(initial=0) >= 2**31)
        row = {"dim": dim, "block": block, "n": len(i), "wide": wide, "ids": i[order].astype("<i8").tobytes(), "vecs": v[order].astype("<i8" if wide else "<i4").tobytes(), "least": t[order].astype("<i8").tobytes()}
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_pylist([row], schema=pa.schema(list(zip(row, kinds))))


def _unpack(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    row = t.slice(0, 1).to_pylist()[0]
    vecs = np.frombuffer(row["vecs"], "<i8" if row["wide"] else "<i4").reshape(row["n"], row["dim"])
    return np.frombuffer(row["ids"], "<i8"), vecs.astype(np.int64), np.frombuffer(row["least"], "<i8")


def segment_features(v: np.ndarray, segments: int) -> np.ndarray:
    """sqrt(L) * mean and sqrt(L) * deviation of each segment; their inner product is the bound."""
    parts = np.array_split(np.arange(v.shape[1]), min(segments, v.shape[1]))
    out = []
    for p in parts:
        x = v[:, p].astype(np.float64)
        out += [x.mean(axis=1) * len(p) ** 0.5, x.std(axis=1) * len(p) ** 0.5]
    return np.stack(out, axis=1)


def best_of_block(qid, q, least, xid, x, k, stats: dict | None = None):
    """(query position, vec_id, score) of the k best rows a query that reach its threshold; rows come sorted by id.

    ``stats`` counts pairs: all, those that survive each resolution, and those scored exactly.
    """
    safe = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1] < 2**52
    kind = np.float64 if safe else np.int64
    low = -np.inf if safe else np.iinfo(np.int64).min
    coarse, fine = [[segment_features(v, n) for v in (q, x)] for n in LEVELS]
    norm_q, norm_x = (np.sqrt((v.astype(np.float64) ** 2).sum(axis=1)) for v in (q, x))
    qn, xn = q.astype(kind), x.astype(kind)
    found, seen = [], np.zeros(4, dtype=np.int64)
    for a in range(0, len(q), QUERY_TILE):
        qs = np.arange(a, min(a + QUERY_TILE, len(q)))
        best, place = np.full((len(qs), k), low, dtype=kind), np.full((len(qs), k), -1, dtype=np.int64)
        # rounding of the bounds is far below this
        slack = 1e-9 * norm_q[qs].max(initial=0) * norm_x.max(initial=0) + 1e-6
        top = np.concatenate([(coarse[0][qs] @ coarse[1][b : b + ROW_TILE].T).max(axis=0) for b in range(0, len(x), ROW_TILE)]) if len(x) else np.empty(0)
        by_bound = np.argsort(-top, kind="stable")
        for b in range(0, len(x), ROW_TILE):
            cols = by_bound[b : b + ROW_TILE]
            worst = np.maximum(best[:, -1].astype(np.float64), least[qs].astype(np.float64)) - slack
            alive = coarse[0][qs] @ coarse[1][cols].T >= worst[:, None]
            seen[:2] += alive.size, alive.sum()
            keep = alive.any(axis=0)
            cols, alive = cols[keep], alive[:, keep]
            if len(cols):
                alive &= fine[0][qs] @ fine[1][cols].T >= worst[:, None]
                keep = alive.any(axis=0)
                cols, alive = cols[keep], alive[:, keep]
            if not len(cols):
                continue
            cols, alive = np.sort(cols), alive[:, np.argsort(cols)]
            seen[2] += alive.sum()
            r, c = np.nonzero(alive & (qid[qs][:, None] != xid[cols][None, :]))
            if alive.mean() <= SINGLY:
                value = np.einsum("ij,ij->i", qn[qs[r]], xn[cols[c]])
                seen[3] += alive.sum()
            else:
                value = (qn[qs] @ xn[cols].T)[r, c]
                seen[3] += alive.size
            reached = value >= np.maximum(best[r, -1], least[qs[r]])
            held_r, held_c = np.nonzero(place >= 0)
            row = np.concatenate([held_r, r[reached]])
            at = np.concatenate([place[held_r, held_c], cols[c[reached]]])
            value = np.concatenate([best[held_r, held_c], value[reached]])
            order = np.lexsort((at, -value, row))
            row, at, value = row[order], at[order], value[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            row, at, value, rank = (z[rank < k] for z in (row, at, value, rank))
            best, place = np.full((len(qs), k), low, dtype=kind), np.full((len(qs), k), -1, dtype=np.int64)
            best[row, rank], place[row, rank] = value, at
        r, c = np.nonzero(place >= 0)
        found.append((r + a, xid[place[r, c]], best[r, c].astype(np.int64)))
    if stats is not None:
        for name, n in zip(("pairs", "coarse", "fine", "scored"), seen.tolist()):
            stats[name] = stats.get(name, 0) + n
    return [np.concatenate(z) for z in zip(*found)] if found else [np.empty(0, np.int64)] * 3


def _cell(k: int):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        at, vec, score, block = [np.empty(0, np.int64)] * 3 + [0]
        qid = np.empty(0, np.int64)
        if left.num_rows and right.num_rows:
            (qid, q, least), (xid, x, _) = _unpack(left), _unpack(right)
            block = left["block"][0].as_py()
            at, vec, score = best_of_block(qid, q, least, xid, x, k)
        return pa.table(
            {"query_id": pa.array(qid[at], pa.int64()), "query_row": pa.array((block << 32) + at, pa.int64()), "vec_id": pa.array(vec, pa.int64()), "score": pa.array(score, pa.int64())}
        )

    return run


def _first_thresholds(queries: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """The query block with each query's k-th best score among the sampled rows (the least number, if fewer)."""
    row = queries.slice(0, 1).to_pylist()[0]
    least = np.full(row["n"], np.iinfo(np.int64).min)
    if rows.num_rows:
        (qid, q, _), (xid, x, _) = _unpack(queries), _unpack(rows)
        at, _, score = best_of_block(qid, q, least, xid, x, k)
        full = np.flatnonzero(np.bincount(at, minlength=len(q)) == k)
        worst = np.full(len(q), np.iinfo(np.int64).max)
        np.minimum.at(worst, at, score)
        least[full] = worst[full]
    return pa.Table.from_pylist([row | {"least": least.astype("<i8").tobytes()}], schema=queries.schema)


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, block_bytes: int = BLOCK_BYTES, sample: int = SAMPLE) -> DataFrame:
    """Return (query_id, rank, vec_id, score): each query's k largest inner products.

    Both inputs are (vec_id long, vec array<long>).  Rows with a null id or
    vector, a null component or no components take no part.  A query meets the
    rows of its own length but those that have its id; ties go to the smaller
    vec_id.  A query with fewer rows gets all of them.  Rows that repeat an id
    count singly, on either side.  An empty side gives an empty result.

    Blocks hold about ``block_bytes`` bytes; ``sample`` rows, those of the
    smallest hashes, give the first thresholds and change no result.
    """

    def usable(df):
        whole = F.col("vec").isNotNull() & (F.size("vec") > 0) & F.forall("vec", lambda x: x.isNotNull())
        none = F.lit(-(2**63)).cast("long").alias("least")
        return df.select("vec_id", "vec", none).where(F.col("vec_id").isNotNull() & whole)

    rows, queries = usable(rows), usable(queries)
    size = F.coalesce(F.max(F.size("vec")), F.lit(0)).alias("dim")
    (n_rows, dim), (n_queries, _) = (df.agg(F.count(F.lit(1)).alias("n"), size).first() for df in (rows, queries))
    # at least 32 blocks of rows where there are enough for them, and no more of queries than their bytes need
    fit = max(1, min(65_536, block_bytes // (8 * max(1, dim))))
    row_blocks = max(1, -(-n_rows // max(1, min(fit, max(1024, n_rows // 32)))))
    query_blocks = max(1, -(-n_queries // min(fit, 4096)))
    x = rows.repartition(row_blocks).mapInArrow(_pack, _BLOCK).withColumn("i", F.col("block")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    q = queries.repartition(query_blocks).mapInArrow(_pack, _BLOCK)
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(sample, fit)).repartition(1).mapInArrow(_pack, _BLOCK)
    drawn = drawn.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    seeded = q.withColumn("j", F.col("block")).groupBy("dim", "j").cogroup(drawn.groupBy("dim", "j")).applyInArrow(
        lambda key, a, b: _first_thresholds(a.select(_NAMES), b.select(_NAMES), k) if a.num_rows else a.select(_NAMES), _BLOCK
    )
    seeded = seeded.withColumn("j", F.col("block")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))))
    found = seeded.groupBy("dim", "i", "j").cogroup(x.groupBy("dim", "i", "j")).applyInArrow(
        _cell(k), "query_id long, query_row long, vec_id long, score long"
    )
    best = W.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
