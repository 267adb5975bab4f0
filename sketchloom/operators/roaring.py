"""Sketches as Roaring bitmaps: one binary column, worked on in Arrow batches.

The set operations read and write containers; no sketch is spread out.  Merging
unites the rows of a key within each task first, so a key of many rows sends no
more than one bitmap a task and key to its final group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import estimators as E
from ..functions import hashing as H
from ..functions import roaring as R

#: Keys whose unions a task holds before it hands them on.
HELD = 20_000


def _scalar(f: Callable, kind: str, arrow: pa.DataType):
    """A function of one or two bitmaps, null where one of them is null."""

    @F.arrow_udf(kind)
    def one(a: pa.Array) -> pa.Array:
        return pa.array([None if x is None else f(x) for x in a.to_pylist()], arrow)

    return one


def _binary(f: Callable, kind: str, arrow: pa.DataType):
    @F.arrow_udf(kind)
    def two(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([None if x is None or y is None else f(R.loads(x), R.loads(y)) for x, y in zip(a.to_pylist(), b.to_pylist())], arrow)

    return two


def compressed(bitmap: Column) -> Column:
    """A packed sketch as a Roaring bitmap."""
    return _scalar(lambda x: R.dumps(R.from_dense(x)), "binary", pa.binary())(bitmap)


def dense(roaring: Column, p: int = H.P_BITS) -> Column:
    """The packed sketch of precision ``p``; a position beyond its registers is an error."""
    size = 2**p * H.BITS // 8
    return _scalar(lambda x: R.to_dense(R.loads(x), size), "binary", pa.binary())(roaring)


def union(a: Column, b: Column) -> Column:
    return _binary(lambda x, y: R.dumps(R.union(x, y)), "binary", pa.binary())(a, b)


def intersection(a: Column, b: Column) -> Column:
    return _binary(lambda x, y: R.dumps(R.intersection(x, y)), "binary", pa.binary())(a, b)


def difference(a: Column, b: Column) -> Column:
    return _binary(lambda x, y: R.dumps(R.difference(x, y)), "binary", pa.binary())(a, b)


def symmetric_difference(a: Column, b: Column) -> Column:
    return _binary(lambda x, y: R.dumps(R.symmetric_difference(x, y)), "binary", pa.binary())(a, b)


def count(roaring: Column) -> Column:
    """How many positions a bitmap holds."""
    return _scalar(lambda x: R.count(R.loads(x)), "long", pa.int64())(roaring)


def shared(a: Column, b: Column) -> Column:
    """How many positions two bitmaps share."""
    return _binary(R.shared, "long", pa.int64())(a, b)


def containers(roaring: Column) -> Column:
    """An array of (key, form, size) of a bitmap's containers."""
    kind = pa.list_(pa.struct([("key", pa.int32()), ("form", pa.string()), ("size", pa.int32())]))
    describe = lambda x: [{"key": k, "form": c[0], "size": R.size_of(c)} for k, c in sorted(R.loads(x).items())]
    return _scalar(describe, "array<struct<key:int,form:string,size:int>>", kind)(roaring)


def zeros_counts(roaring: Column) -> Column:
    """How many registers hold each of the 32 bits, as an array."""
    return _scalar(lambda x: R.zeros_counts(R.loads(x)).tolist(), "array<long>", pa.list_(pa.int64()))(roaring)


def from_long(long: DataFrame, *keys: str) -> DataFrame:
    """(keys..., roaring) of a long form of any precision.

    Containers are made by Spark's bitmap aggregate, half a container at a time,
    and put together for each key: at most 2^p / 1024 halves.
    """
    at = (F.col("reg") * H.BITS + F.col("zeros")).cast("long")
    halves = long.groupBy(*keys, F.floor(at / 32768).cast("int").alias("_half")).agg(F.bitmap_construct_agg(at % 32768).alias("_bits"))
    held = halves.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_half", "_bits"))).alias("_halves"))

    @F.arrow_udf("binary")
    def joined(rows: pa.Array) -> pa.Array:
        out = []
        for halves in rows.to_pylist():
            r: R.Roaring = {}
            for h in halves:
                empty = bytes(R.BITMAP_BYTES // 2)
                part = R.from_dense(h["_bits"] + empty if h["_half"] % 2 == 0 else empty + h["_bits"])
                r = R.union(r, {h["_half"] // 2: c for c in part.values()})
            out.append(R.dumps(r))
        return pa.array(out, pa.binary())

    return held.select(*keys, joined("_halves").alias("roaring"))


def to_long(df: DataFrame, *keys: str) -> DataFrame:
    """The long form of (keys..., roaring)."""
    at = _scalar(lambda x: R.positions(R.loads(x)).tolist(), "array<long>", pa.list_(pa.int64()))(F.col("roaring"))
    pos = df.select(*keys, F.explode(at).alias("_at"))
    return pos.select(*keys, F.floor(F.col("_at") / H.BITS).cast("int").alias("reg"), F.pmod("_at", F.lit(H.BITS)).cast("int").alias("zeros"))


def _combined(keys: list[str], schema: pa.Schema, op: Callable):
    """Rows of one key within a task or a group to one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, R.Roaring] = {}

        def rows() -> pa.RecordBatch:
            columns = [[k[i] for k in held] for i in range(len(keys))] + [[R.dumps(r) for r in held.values()]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for batch in batches:
            for *key, x in zip(*(batch[c].to_pylist() for c in [*keys, "roaring"])):
                if x is not None:
                    r, key = R.loads(x), tuple(key)
                    held[key] = op(held[key], r) if key in held else r
            if len(held) > HELD:
                yield rows()
                held.clear()
        if held:
            yield rows()

    return run


def _reduce(df: DataFrame, keys: tuple[str, ...], op: Callable) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    df = df.select(*keys, "roaring")
    schema = to_arrow_schema(df.schema)
    run = _combined(list(keys), schema, op)
    part = df.mapInArrow(run, df.schema)

    def last(t: pa.Table) -> pa.Table:
        return pa.Table.from_batches(run(t.cast(schema).to_batches()), schema)

    return part.groupBy(*keys).applyInArrow(last, df.schema)


def merge(df: DataFrame, *keys: str) -> DataFrame:
    """Union of all bitmaps of a key; null ones take no part."""
    return _reduce(df, keys, R.union)


def meet_all(df: DataFrame, *keys: str) -> DataFrame:
    """Intersection of all bitmaps of a key; null ones take no part."""
    return _reduce(df, keys, R.intersection)


def cardinality(df: DataFrame, *keys: str, p: int = H.P_BITS) -> DataFrame:
    """(keys..., card): estimates from the bit counts, one bitmap a key."""
    m = 2**p
    counts = df.select(*keys, F.posexplode(zeros_counts(F.col("roaring"))).alias("zeros", "c")).where("c > 0")
    return counts.groupBy(*keys).agg(*E.ht_aggregates(m)).select(*keys, E.ht_estimate(m).alias("card"))


def sizes(df: DataFrame, *keys: str, p: int = H.P_BITS) -> DataFrame:
    """(keys..., bits, dense_bytes, roaring_bytes, arrays, bitmaps, runs) of each bitmap."""
    c = df.select(*keys, F.octet_length("roaring").alias("roaring_bytes"), containers(F.col("roaring")).alias("_c"))
    of = lambda form: F.size(F.filter("_c", lambda x: x["form"] == form))
    bits = F.aggregate("_c", F.lit(0).cast("long"), lambda a, x: a + x["size"])
    dense_bytes = F.lit(2**p * H.BITS // 8).alias("dense_bytes")
    return c.select(*keys, bits.alias("bits"), dense_bytes, "roaring_bytes", of(R.ARRAY).alias("arrays"), of(R.BITMAP).alias("bitmaps"), of(R.RUNS).alias("runs"))
