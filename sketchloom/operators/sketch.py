"""Building, unpacking and measuring sketches.

Two forms.  Long: rows (key..., reg, zeros), distinct.  Packed: one bitmap of
2^p * 32 bits a key, the little-endian array of 32-bit registers.  Both are made
by aggregations that combine before the shuffle; a packed sketch at p = 10 is
4 KB however many tokens it saw.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import estimators as E
from ..functions import hashing as H


def positions(tokens: DataFrame, token: str, p: int = H.P_BITS, seed: int = H.SEED, hashed: bool = False, backend: str = "arrow") -> DataFrame:
    """``tokens`` with hash, reg and zeros; tokens that set no bit are dropped.

    ``hashed`` says that the token column already holds 64-bit hashes.
    """
    h = F.col(token) if hashed else H.murmur64a(F.col(token), seed, backend)
    return (
        tokens.where(F.col(token).isNotNull()).withColumn("hash", h)
        .withColumn("reg", H.reg_of(F.col("hash"), p)).withColumn("zeros", H.zeros_of(F.col("hash"), p)).where("zeros IS NOT NULL")
    )


def long_form(tokens: DataFrame, token: str, *keys: str, **options) -> DataFrame:
    """The sketches of all keys: distinct (key..., reg, zeros)."""
    return positions(tokens.select(*keys, token), token, **options).select(*keys, "reg", "zeros").distinct()


def _bit(p: int) -> Column:
    return (F.col("reg") * H.BITS + F.col("zeros")).cast("long")


def pack(long: DataFrame, *keys: str, p: int = H.P_BITS) -> DataFrame:
    """One bitmap a key, ``4 * 2^p`` bytes; for p above 10 the pieces are joined in order."""
    size = 2**p * H.BITS
    if p <= 10:
        bits = long.groupBy(*keys).agg(F.bitmap_construct_agg(_bit(p)).alias("bitmap"))
        return bits.withColumn("bitmap", F.substring("bitmap", 1, size // 8)) if p < 10 else bits
    bucket, chunks = (_bit(p) / 32768).cast("long"), size // 32768
    # every piece is needed, also one without bits
    empty = F.unhex(F.repeat(F.lit("00"), 4096))
    pieces = long.groupBy(*keys, bucket.alias("b")).agg(F.bitmap_construct_agg(_bit(p) % 32768).alias("x"))
    held = pieces.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("b", "x"))).alias("m"))
    return held.select(*keys, F.concat(*[F.coalesce(F.col("m")[F.lit(i).cast("long")], empty) for i in range(chunks)]).alias("bitmap"))


def build(tokens: DataFrame, token: str, *keys: str, p: int = H.P_BITS, **options) -> DataFrame:
    """Packed sketch of each key's tokens.

    The bitmap aggregate sorts its input, so the bits are made distinct before:
    that is a hash aggregation, combined before the shuffle, which leaves at
    most 2^p * 32 rows a key however many tokens there are.
    """
    return pack(long_form(tokens, token, *keys, p=p, **options), *keys, p=p)


def unpack(packed: DataFrame, *keys: str) -> DataFrame:
    """The long form of packed sketches."""
    hexed = packed.select(*keys, F.hex("bitmap").alias("x")).where(F.length("x") > 0)
    byte = F.explode(F.sequence(F.lit(0), F.expr("length(x) div 2 - 1"))).alias("i")
    values = hexed.select(*keys, "x", byte).select(*keys, "i", F.conv(F.substr("x", F.col("i") * 2 + 1, F.lit(2)), 16, 10).cast("int").alias("v")).where("v > 0")
    bits = values.select(*keys, "i", F.explode(F.filter(F.sequence(F.lit(0), F.lit(7)), lambda b: F.pmod(F.floor(F.col("v") / F.pow(F.lit(2.0), b)), F.lit(2)) == 1)).alias("b"))
    pos = F.col("i") * 8 + F.col("b")
    return bits.select(*keys, F.floor(pos / H.BITS).cast("int").alias("reg"), F.pmod(pos, F.lit(H.BITS)).cast("int").alias("zeros"))


def name(packed: DataFrame) -> DataFrame:
    """Add the content address of each sketch."""
    return packed.withColumn("name", F.sha1("bitmap"))


def _of_one_precision(packed: DataFrame, keys: tuple, aggregate: Column) -> DataFrame:
    """An aggregate of bitmaps; sketches of different precision under one key are an error."""
    n = F.octet_length("bitmap")
    g = packed.groupBy(*keys).agg(aggregate.alias("bitmap"), F.min(n).alias("_low"), F.max(n).alias("_high"))
    mixed = F.raise_error(F.lit("sketches of different precision cannot be combined")).cast("binary")
    return g.select(*keys, F.when(F.col("_low") == F.col("_high"), F.expr("substring(bitmap, 1, _low)")).otherwise(mixed).alias("bitmap"))


def merge(packed: DataFrame, *keys: str) -> DataFrame:
    """Union of all sketches of a key."""
    return _of_one_precision(packed, keys, F.bitmap_or_agg("bitmap"))


def meet_all(packed: DataFrame, *keys: str) -> DataFrame:
    """Intersection of all sketches of a key."""
    return _of_one_precision(packed, keys, F.bitmap_and_agg("bitmap"))


def precision(packed: DataFrame) -> DataFrame:
    """Add p, from the length of each bitmap."""
    return packed.withColumn("p", F.round(F.log2(F.octet_length("bitmap") * 8 / H.BITS)).cast("int"))


def xor_all(long: DataFrame, *keys: str) -> DataFrame:
    """Positions that an odd number of rows hold."""
    return long.groupBy(*keys, "reg", "zeros").count().where("count % 2 = 1").drop("count")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, a.columns, "left_semi")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, a.columns, "left_anti")


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return xor_all(a.unionByName(b), *[c for c in a.columns if c not in ("reg", "zeros")])


def complement(long: DataFrame, p: int = H.P_BITS) -> DataFrame:
    """All positions that one sketch (reg, zeros) does not hold."""
    every = long.sparkSession.range(2**p * H.BITS).select((F.col("id") / H.BITS).cast("int").alias("reg"), (F.col("id") % H.BITS).cast("int").alias("zeros"))
    return every.join(long, ["reg", "zeros"], "left_anti")


def is_subset(a: DataFrame, b: DataFrame) -> bool:
    return difference(a, b).limit(1).count() == 0


def bit_counts(long: DataFrame, *keys: str) -> DataFrame:
    """Registers that hold each bit: (key..., zeros, c)."""
    return long.groupBy(*keys, "zeros").agg(F.count(F.lit(1)).alias("c"))


def cardinality(long: DataFrame, *keys: str, p: int = H.P_BITS) -> DataFrame:
    """Estimated number of distinct tokens of each key: (key..., card)."""
    m = 2**p
    return bit_counts(long, *keys).groupBy(*keys).agg(*E.ht_aggregates(m)).select(*keys, E.ht_estimate(m).alias("card"))


def cardinality_hll(long: DataFrame, *keys: str, p: int = H.P_BITS) -> DataFrame:
    """HyperLogLog estimate: (key..., card_hll), the bias taken from ``bias_table``."""
    m = 2**p
    top = long.groupBy(*keys, "reg").agg((F.max("zeros") + 1).alias("top"))
    raw = (
        top.groupBy(*keys).agg(F.sum(F.pow(F.lit(2.0), -F.col("top"))).alias("s"), F.count(F.lit(1)).alias("used"))
        .select(*keys, (m - F.col("used")).alias("empty"), (E.alpha(m) * m * m / (F.col("s") + (m - F.col("used")))).alias("raw"))
    )
    table = E.bias_table(p)
    rows = [(x1, x2, y1, y2) for (x1, y1), (x2, y2) in zip(table, table[1:])]
    steps = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(r, ("x1", "x2", "y1", "y2"))]) for r in rows])
    at = F.element_at(F.filter(steps, lambda s: (s["x1"] < F.col("raw")) & (F.col("raw") <= s["x2"])), 1)
    bias = F.when(F.col("raw") <= table[0][0], table[0][1]).when(F.col("raw") > table[-1][0], 0.0).otherwise(
        F.col("at.y1") + (F.col("raw") - F.col("at.x1")) / (F.col("at.x2") - F.col("at.x1")) * (F.col("at.y2") - F.col("at.y1"))
    )
    found = raw.withColumn("at", F.when((F.col("raw") > table[0][0]) & (F.col("raw") <= table[-1][0]), at))
    return found.select(*keys, E.hll_estimate(F.col("raw"), F.col("empty"), bias, m).alias("card_hll"))


def popcount(long: DataFrame, *keys: str) -> DataFrame:
    return long.groupBy(*keys).agg(F.count(F.lit(1)).alias("popcount"))


def max_zeros(long: DataFrame, *keys: str) -> DataFrame:
    """Bit length of each register in use."""
    return long.groupBy(*keys, "reg").agg((F.max("zeros") + 1).alias("bit_length"))


def register(long: DataFrame, reg: int) -> DataFrame:
    return long.where(F.col("reg") == reg)


def bits_held(long: DataFrame, bits: DataFrame) -> DataFrame:
    """(reg, zeros, held): which of the given positions a sketch holds."""
    return bits.select("reg", "zeros").join(long.select("reg", "zeros", F.lit(True).alias("held")).distinct(), ["reg", "zeros"], "left").fillna(False, ["held"])


def has_bit(long: DataFrame, reg: int, zeros: int) -> bool:
    return long.where((F.col("reg") == reg) & (F.col("zeros") == zeros)).limit(1).count() == 1


def inscribe(long: DataFrame, bits: DataFrame) -> DataFrame:
    """Set bits; with ``difference`` they are cleared."""
    return union(long, bits)


def info(long: DataFrame, *keys: str, p: int = H.P_BITS) -> DataFrame:
    """Registers in use, bits, and sizes of the dense and the sparse form in bytes."""
    return long.groupBy(*keys).agg(
        F.countDistinct("reg").alias("registers"),
        F.count(F.lit(1)).alias("bits"),
        F.lit(4 * 2**p).alias("dense_bytes"),
        (F.count(F.lit(1)) * 4).alias("sparse_bytes"),
    )


def first_seen(long: DataFrame, time: str) -> DataFrame:
    """(reg, zeros, seen): when each position first appears; cumulative states are filters on it."""
    return long.groupBy("reg", "zeros").agg(F.min(time).alias("seen"))


def rolled_up(tokens: DataFrame, token: str, dims: list[str], cube: bool = False, **options) -> DataFrame:
    """Distinct tokens of every grouping of ``dims`` in ROLLUP (or CUBE): (dims..., level, card).

    The tokens are read once, into the sketches of the finest grouping; the
    coarser ones come from those bits, which are bounded per group.  ``level``
    has a bit for each dimension that is summed over, the first one highest.
    """
    long = long_form(tokens, token, *dims, **options)
    types = dict(long.dtypes)
    n = len(dims)
    kept = [[d for i, d in enumerate(dims) if not level >> (n - 1 - i) & 1] for level in range(2**n)]
    levels = range(2**n) if cube else [2**i - 1 for i in range(n + 1)]
    sets = F.array(*[F.struct(F.lit(x).cast("long").alias("level"), *[(F.col(d) if d in kept[x] else F.lit(None).cast(types[d])).alias(d) for d in dims]) for x in levels])
    spread = long.select(F.explode(sets).alias("s"), "reg", "zeros").select("s.*", "reg", "zeros").distinct()
    return cardinality(spread, *dims, "level")


def sparse_form(long: DataFrame, *keys: str) -> DataFrame:
    """(keys..., places): sorted distances between neighbouring positions, from the first one; small for sparse sketches."""
    at = F.array_sort(F.collect_list(_bit(0)))
    held = long.groupBy(*keys).agg(at.alias("at"))
    gaps = F.transform("at", lambda x, i: F.when(i == 0, x).otherwise(x - F.element_at("at", F.greatest(i, F.lit(1)))))
    return held.select(*keys, gaps.alias("places"))


def from_sparse(sparse: DataFrame, *keys: str) -> DataFrame:
    """The long form of ``sparse_form``."""
    at = F.transform("places", lambda x, i: F.aggregate(F.slice("places", 1, i + 1), F.lit(0).cast("long"), lambda a, y: a + y))
    pos = sparse.select(*keys, F.explode(at).alias("at"))
    return pos.select(*keys, F.floor(F.col("at") / H.BITS).cast("int").alias("reg"), F.pmod("at", F.lit(H.BITS)).cast("int").alias("zeros"))
