"""Token hashing: MurmurHash64A, and positions (reg, zeros) from a 64-bit hash.

``murmur64a`` has two backends with equal results.  "arrow" hashes whole Arrow
batches with numpy's wrapping 64-bit arithmetic, several tokens a microsecond;
"native" is a Column expression in 16-bit limbs, since a product of two bigints
overflows under ANSI rules.  The expression costs a few microseconds a token in
the JVM, so Arrow is the default.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the published hash function.
M = 0xC6A4A7935BD1E995
SHIFT = 47
SEED = 42
P_BITS = 10
#: A register has 32 bits; rarer events are not recorded.
BITS = 32


def murmur64a_spans(data: np.ndarray, start: np.ndarray, n: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Signed 64-bit hashes of the stretches of ``data`` (bytes) of the given starts and lengths."""
    m, r, eight = np.uint64(M), np.uint64(SHIFT), np.uint64(8)
    n = n.astype(np.int64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))  # the eight bytes from each place on
    h = np.uint64(seed) ^ (n.astype(np.uint64) * m)
    blocks = n >> 3
    rows, block = np.flatnonzero(blocks > 0), 0
    while len(rows):
        k = words[start[rows] + 8 * block] * m
        h[rows] = (h[rows] ^ ((k ^ (k >> r)) * m)) * m
        block += 1
        rows = rows[blocks[rows] > block]
    rows = np.flatnonzero(n & 7)
    rest = (n[rows] & 7).astype(np.uint64)
    h[rows] = (h[rows] ^ (words[start[rows] + 8 * blocks[rows]] & ((np.uint64(1) << (rest * eight)) - np.uint64(1)))) * m
    h = (h ^ (h >> r)) * m
    return (h ^ (h >> r)).view(np.int64)


def murmur64a_numpy(tokens: pa.Array, seed: int = SEED) -> np.ndarray:
    """Signed 64-bit hashes of an Arrow array of strings; nulls hash as empty."""
    tokens = tokens.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(tokens.buffers()[1], dtype=np.int64)[tokens.offset : tokens.offset + len(tokens) + 1]
    data = np.frombuffer(tokens.buffers()[2] or b"", dtype=np.uint8)
    return murmur64a_spans(data, offsets[:-1], np.diff(offsets), seed)


def positions_numpy(h: np.ndarray, p: int = P_BITS) -> tuple[np.ndarray, np.ndarray]:
    """reg and zeros of signed hashes; zeros is BITS where no bit is recorded."""
    u = h.view(np.uint64)
    rest = u >> np.uint64(p)
    lowest = rest & (~rest + np.uint64(1))
    zeros = np.bitwise_count(lowest - np.uint64(1))  # 64 for a rest of 0
    return (u & np.uint64(2**p - 1)).astype(np.int32), np.minimum(zeros, BITS).astype(np.int32)


def _arrow_udf(seed: int):
    @F.arrow_udf("long")
    def murmur(tokens: pa.Array) -> pa.Array:
        return pa.array(murmur64a_numpy(tokens, seed), pa.int64(), mask=np.array(tokens.is_null()))

    return murmur


def _times_m(x: Column) -> Column:
    """x * M modulo 2**64 without a signed overflow."""
    ml, mh = M & 0xFFFFFFFF, M >> 32
    a0, a1 = x.bitwiseAND(0xFFFF), F.shiftrightunsigned(x, 16).bitwiseAND(0xFFFF)
    h0, h1 = F.shiftrightunsigned(x, 32).bitwiseAND(0xFFFF), F.shiftrightunsigned(x, 48)
    low = a0 * ml + F.shiftleft((a1 * ml).bitwiseAND(0xFFFF), 16)
    high = (
        F.shiftrightunsigned(low, 32)
        + F.shiftrightunsigned(a1 * ml, 16)
        + a0 * mh
        + F.shiftleft((a1 * mh).bitwiseAND(0xFFFF), 16)
        + h0 * ml
        + F.shiftleft((h1 * ml).bitwiseAND(0xFFFF), 16)
    )
    return F.shiftleft(high.bitwiseAND(0xFFFFFFFF), 32).bitwiseOR(low.bitwiseAND(0xFFFFFFFF))


def _let(value: Column, body) -> Column:
    """Bind a value once; Catalyst has no let."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _xor_shift(x: Column) -> Column:
    return x.bitwiseXOR(F.shiftrightunsigned(x, SHIFT))


def _little_endian(hexed: Column, at: Column) -> Column:
    """The signed long of 16 hexadecimal digits that stand lowest byte first."""
    parts = [F.substr(hexed, at + 2 * i, F.lit(2)) for i in range(7, -1, -1)]
    high = F.conv(F.concat(*parts[:4]), 16, 10).cast("long")
    low = F.conv(F.concat(*parts[4:]), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low)


def murmur64a_native(token: Column, seed: int = SEED) -> Column:
    def finish(h: Column) -> Column:
        return _let(_times_m(_xor_shift(h)), _xor_shift)

    def whole(hexed: Column) -> Column:
        n = (F.length(hexed) / 2).cast("long")
        blocks = F.floor(n / 8).cast("int")
        start = F.lit(seed).cast("long").bitwiseXOR(_times_m(n))

        def block(acc, i):
            k = _let(_times_m(_little_endian(hexed, i * 16 + 1)), lambda k: _times_m(_xor_shift(k)))
            return _let(acc.bitwiseXOR(k), _times_m)

        steps = F.when(blocks > 0, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array().cast("array<int>"))
        body = F.aggregate(steps, start, block)
        rest = F.rpad(F.substr(hexed, blocks * 16 + 1, F.lit(16)), 16, "0")
        tail = _let(body.bitwiseXOR(_little_endian(rest, F.lit(1))), _times_m)
        return _let(F.when(n % 8 > 0, tail).otherwise(body), finish)

    return F.when(token.isNotNull(), _let(F.hex(F.encode(token, "UTF-8")), whole))


def murmur64a(token: Column, seed: int = SEED, backend: str = "arrow") -> Column:
    """The signed bits of MurmurHash64A of a string's UTF-8 bytes; null for null."""
    if backend == "native":
        return murmur64a_native(token, seed)
    if backend != "arrow":
        raise ValueError("backend is 'arrow' or 'native'")
    return _arrow_udf(seed)(token)


def hash_content(text: Column, kind: str = "murmur", seed: int = SEED, seeded: bool = False) -> Column:
    """``murmur``, or the first 8 hexadecimal digits of ``sha1`` or ``sha256`` as a number.

    ``seeded`` puts "seed:" before the text for the SHA kinds.
    """
    if kind == "murmur":
        return murmur64a(text, seed)
    if seeded:
        text = F.concat_ws(":", F.lit(str(seed)), text)
    digest = {"sha1": lambda t: F.sha1(t), "sha256": lambda t: F.sha2(t, 256)}[kind](text)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def trailing_zeros(x: Column) -> Column:
    """Number of zero bits below the lowest set bit, 64 for 0."""
    lowest = x.bitwiseAND(F.bitwise_not(x) + 1)
    return F.when(x == 0, 64).when(x == F.lit(-(2**63)), 63).otherwise(F.bit_count(lowest - 1)).cast("int")


def highest_set_bit(x: Column) -> Column:
    """Place of the highest set bit, counted from 1; 0 for 0."""
    return F.when(x == 0, 0).otherwise(F.length(F.bin(x))).cast("int")


def reg_of(h: Column, p: int = P_BITS) -> Column:
    return h.bitwiseAND(2**p - 1).cast("int")


def zeros_of(h: Column, p: int = P_BITS) -> Column:
    """Trailing zeros above the register bits; null where no bit is recorded."""
    z = trailing_zeros(F.shiftrightunsigned(h, p))
    return F.when(z < BITS, z)


def content_key(tokens: Column, prefix: str = "set:") -> Column:
    """Address of a token set: a prefix and the hash of its sorted distinct tokens."""
    return F.concat(F.lit(prefix), F.sha1(F.array_join(F.array_sort(F.array_distinct(tokens)), "\u0000")))


def ngrams(tokens: Column, n: int) -> Column:
    """All runs of n tokens, each joined by single spaces."""
    return F.when(
        F.size(tokens) >= n,
        F.transform(F.sequence(F.lit(0), F.size(tokens) - n), lambda i: F.array_join(F.slice(tokens, i + 1, F.lit(n)), " ")),
    ).otherwise(F.array().cast("array<string>"))


def words(text: Column, lower: bool = False) -> Column:
    """Runs of characters that are not white space."""
    flat = F.lower(text) if lower else text
    return F.filter(F.split(flat, r"\s+"), lambda w: w != "")


def padded(tokens: Column, n: int, start: str = "<S>", end: str = "</S>") -> Column:
    """Boundary markers: one before, n - 1 behind."""
    return F.concat(F.array(F.lit(start)), tokens, F.array_repeat(F.lit(end), max(1, n - 1)))
