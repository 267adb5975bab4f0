"""Roaring bitmaps of sketch positions: containers, and the portable byte format.

A position is reg * 32 + zeros.  Positions that share their upper 16 bits form a
container, which is held in the smallest of three forms: a sorted array of lower
halves, a bitmap of 8,192 bytes, or runs of successive values.  The bytes follow
the published portable format, so other Roaring libraries read them.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

ARRAY, BITMAP, RUNS = "array", "bitmap", "runs"
#: Fixed values of the portable format.
COOKIE, COOKIE_RUNS = 12346, 12347
ARRAY_MOST = 4096
BITMAP_BYTES = 8192
OFFSETS_FROM = 4

#: A container is its form and its values: uint16 values, uint64 words, or uint16 pairs (first value, length - 1).
Container = tuple[str, np.ndarray]
#: Containers by the upper half of their values.
Roaring = dict[int, Container]


def _runs(values: np.ndarray) -> np.ndarray:
    """(first, length - 1) of each run of successive values."""
    if not len(values):
        return np.empty((0, 2), dtype="<u2")
    first = np.flatnonzero(np.diff(values.astype(np.int64), prepend=-2) != 1)
    last = np.append(first[1:], len(values)) - 1
    return np.stack([values[first], values[last] - values[first]], axis=1).astype("<u2")


def values_of(c: Container) -> np.ndarray:
    """The lower halves that a container holds, sorted."""
    kind, data = c
    if kind == ARRAY:
        return data
    if kind == BITMAP:
        return np.flatnonzero(np.unpackbits(data.view(np.uint8), bitorder="little")).astype("<u2")
    length = data[:, 1].astype(np.int64) + 1
    within = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    return (np.repeat(data[:, 0].astype(np.int64), length) + within).astype("<u2")


def words_of(c: Container) -> np.ndarray:
    """The container as 1,024 words."""
    kind, data = c
    if kind == BITMAP:
        return data
    bits = np.zeros(1 << 16, dtype=np.uint8)
    if kind == ARRAY:
        bits[data] = 1
    else:
        for first, more in data.tolist():
            bits[first : first + more + 1] = 1
    return np.packbits(bits, bitorder="little").view("<u8")


def size_of(c: Container) -> int:
    """How many values a container holds."""
    kind, data = c
    if kind == ARRAY:
        return len(data)
    return int(np.bitwise_count(data).sum()) if kind == BITMAP else int(data[:, 1].astype(np.int64).sum()) + len(data)


def smallest(c: Container) -> Container | None:
    """The container in the form of the fewest bytes, an array or a bitmap rather than equally many bytes of runs; None if empty."""
    n = size_of(c)
    if not n:
        return None
    if c[0] == BITMAP and n > ARRAY_MOST:
        # runs begin where a bit is set and the one before is not
        words = c[1]
        before = (words << np.uint64(1)) | np.concatenate([[np.uint64(0)], words[:-1] >> np.uint64(63)])
        if 2 + 4 * int(np.bitwise_count(words & ~before).sum()) >= BITMAP_BYTES:
            return c
    values = values_of(c)
    runs = _runs(values)
    if 2 + 4 * len(runs) < (2 * n if n <= ARRAY_MOST else BITMAP_BYTES):
        return RUNS, runs
    return (ARRAY, values) if n <= ARRAY_MOST else (BITMAP, words_of(c))


def from_positions(at: np.ndarray) -> Roaring:
    """Of sorted distinct positions."""
    at = np.asarray(at, dtype=np.uint32)
    key = at >> np.uint32(16)
    low = (at & np.uint32(0xFFFF)).astype("<u2")
    starts = np.flatnonzero(np.diff(key, prepend=np.uint32(0xFFFFFFFF)))
    return {int(key[i]): smallest((ARRAY, part)) for i, part in zip(starts, np.split(low, starts[1:]) if len(starts) else [])}


def positions(r: Roaring) -> np.ndarray:
    """Sorted positions."""
    parts = [(np.uint32(k) << np.uint32(16)) + values_of(c).astype(np.uint32) for k, c in sorted(r.items())]
    return np.concatenate(parts) if parts else np.empty(0, dtype=np.uint32)


def from_dense(bitmap: bytes) -> Roaring:
    """Of a packed sketch."""
    words = np.frombuffer(bitmap + bytes(-len(bitmap) % BITMAP_BYTES), dtype="<u8").reshape(-1, BITMAP_BYTES // 8)
    return {k: c for k, w in enumerate(words) if (c := smallest((BITMAP, w)))}


def to_dense(r: Roaring, size: int) -> bytes:
    """The packed sketch of ``size`` bytes; a position beyond them is an error."""
    if r and int(positions({max(r): r[max(r)]})[-1]) >= 8 * size:
        raise ValueError("a position lies beyond the sketch's registers")
    parts = [words_of(r[k]).tobytes() if k in r else bytes(BITMAP_BYTES) for k in range(-(-size // BITMAP_BYTES))]
    return b"".join(parts)[:size]


def dumps(r: Roaring) -> bytes:
    """The portable format."""
    keys = sorted(r)
    n = len(keys)
    runs = [r[k][0] == RUNS for k in keys]
    if any(runs):
        head = struct.pack("<I", COOKIE_RUNS | (n - 1) << 16) + np.packbits(runs, bitorder="little").tobytes()
    else:
        head = struct.pack("<II", COOKIE, n)
    head += b"".join(struct.pack("<HH", k, size_of(r[k]) - 1) for k in keys)
    bodies = [(struct.pack("<H", len(r[k][1])) if is_runs else b"") + np.ascontiguousarray(r[k][1]).tobytes() for k, is_runs in zip(keys, runs)]
    if not any(runs) or n >= OFFSETS_FROM:
        at = len(head) + 4 * n
        for body in bodies:
            head += struct.pack("<I", at)
            at += len(body)
    return head + b"".join(bodies)


def loads(data: bytes) -> Roaring:
    """Containers of the portable format; other bytes are an error."""
    if len(data) < 4:
        raise ValueError("too short for a Roaring bitmap")
    (cookie,) = struct.unpack_from("<I", data)
    if cookie & 0xFFFF == COOKIE_RUNS:
        n, at = (cookie >> 16) + 1, 4
        flags = np.unpackbits(np.frombuffer(data, np.uint8, (n + 7) // 8, at), bitorder="little")[:n].astype(bool).tolist()
        at += (n + 7) // 8
    elif cookie == COOKIE:
        (n,), at = struct.unpack_from("<I", data, 4), 8
        flags = [False] * n
    else:
        raise ValueError("not a Roaring bitmap of the portable format")
    heads = np.frombuffer(data, "<u2", 2 * n, at).reshape(n, 2).tolist()
    at += 4 * n
    if cookie == COOKIE or n >= OFFSETS_FROM:
        at += 4 * n
    out: Roaring = {}
    for (key, less), is_runs in zip(heads, flags):
        if is_runs:
            (count,) = struct.unpack_from("<H", data, at)
            out[key] = RUNS, np.frombuffer(data, "<u2", 2 * count, at + 2).reshape(count, 2)
            at += 2 + 4 * count
        elif less < ARRAY_MOST:
            out[key] = ARRAY, np.frombuffer(data, "<u2", less + 1, at)
            at += 2 * (less + 1)
        else:
            out[key] = BITMAP, np.frombuffer(data, "<u8", BITMAP_BYTES // 8, at)
            at += BITMAP_BYTES
    if at != len(data):
        raise ValueError("a Roaring bitmap of another length than its containers have")
    return out


def _held(values: np.ndarray, c: Container) -> np.ndarray:
    """Which of the values a container holds."""
    kind, data = c
    if kind == ARRAY:
        return np.isin(values, data, assume_unique=True)
    if kind == BITMAP:
        return (data[values >> 6] >> (values & 63).astype(np.uint64)) & np.uint64(1) == 1
    run = np.searchsorted(data[:, 0], values, side="right") - 1
    return (run >= 0) & (values.astype(np.int64) - data[run, 0] <= data[run, 1])


def _meet(a: Container, b: Container) -> Container:
    if a[0] == ARRAY:
        return ARRAY, a[1][_held(a[1], b)]
    if b[0] == ARRAY:
        return _meet(b, a)
    return BITMAP, words_of(a) & words_of(b)


def _join(a: Container, b: Container) -> Container:
    if a[0] == b[0] == ARRAY and len(a[1]) + len(b[1]) <= ARRAY_MOST:
        return ARRAY, np.union1d(a[1], b[1])
    return BITMAP, words_of(a) | words_of(b)


def _less(a: Container, b: Container) -> Container:
    return (ARRAY, a[1][~_held(a[1], b)]) if a[0] == ARRAY else (BITMAP, words_of(a) & ~words_of(b))


def _differ(a: Container, b: Container) -> Container:
    return (ARRAY, np.setxor1d(a[1], b[1], assume_unique=True)) if a[0] == b[0] == ARRAY and len(a[1]) + len(b[1]) <= ARRAY_MOST else (BITMAP, words_of(a) ^ words_of(b))


def _kept(pairs: Iterator[tuple[int, Container]]) -> Roaring:
    return {k: s for k, c in pairs if (s := smallest(c))}


def intersection(a: Roaring, b: Roaring) -> Roaring:
    return _kept((k, _meet(c, b[k])) for k, c in a.items() if k in b)


def union(a: Roaring, b: Roaring) -> Roaring:
    return a | b | _kept((k, _join(c, b[k])) for k, c in a.items() if k in b)


def difference(a: Roaring, b: Roaring) -> Roaring:
    return {k: c for k, c in a.items() if k not in b} | _kept((k, _less(c, b[k])) for k, c in a.items() if k in b)


def symmetric_difference(a: Roaring, b: Roaring) -> Roaring:
    return {k: c for x, y in ((a, b), (b, a)) for k, c in x.items() if k not in y} | _kept((k, _differ(c, b[k])) for k, c in a.items() if k in b)


def count(r: Roaring) -> int:
    return sum(map(size_of, r.values()))


def shared(a: Roaring, b: Roaring) -> int:
    """The size of the intersection, which is not built."""
    return sum(size_of(_meet(c, b[k])) for k, c in a.items() if k in b)


def zeros_counts(r: Roaring) -> np.ndarray:
    """How many registers have each of the 32 bits."""
    out = np.zeros(32, dtype=np.int64)
    for kind, data in r.values():
        if kind == BITMAP:
            out += np.unpackbits(data.view(np.uint8), bitorder="little").reshape(-1, 32).sum(axis=0, dtype=np.int64)
        else:
            out += np.bincount(values_of((kind, data)) & 31, minlength=32)
    return out
