"""Best-fit-decreasing packing of whole documents into sequences.

1. Every text is encoded once; only the places, lengths and checksums of its
   pieces are kept, not the ids.
2. The pieces are counted by length.  There are no more lengths than tokens in a
   sequence, so the counts have a fixed bound whatever the corpus is.
3. The plan of the packing comes from the counts.  Lengths come in decreasing
   order; a segment tree over remaining capacities finds the tightest open
   sequence in logarithmic time.  Sequences of equal capacity that were filled
   alike form a range, and as many pieces of one length are placed in a range as
   it holds, which is what best fit does with them one by one.
4. Pieces are numbered within their length by ranges, and each looks up its
   sequence by (length, number).

The result is that of best-fit decreasing over the whole corpus, not of shards.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encode
from .common import materialize, text_of
from .sharding import number_slots

_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PLACED = f"{_PIECE}, sequence_id long, offset long"
#: Rows of a result batch.
ROWS = 50_000


class Capacities:
    """A segment tree over remaining capacities 1 to ``top``: which of them open sequences have."""

    def __init__(self, top: int):
        self.leaves = 1 << top.bit_length()
        self.any = [False] * (2 * self.leaves)
        self.ranges: list[list[tuple[int, int]]] = [[] for _ in range(top + 1)]

    def _mark(self, capacity: int, held: bool) -> None:
        i = self.leaves + capacity
        while i and self.any[i] != held:
            self.any[i] = held
            i //= 2
            held = self.any[2 * i] or self.any[2 * i + 1] if i else held

    def push(self, capacity: int, first: int, n: int) -> None:
        """``n`` sequences from ``first`` on have this much room; full ones are closed."""
        if n and capacity:
            self.ranges[capacity].append((first, n))
            self._mark(capacity, True)

    def pop(self, capacity: int) -> tuple[int, int]:
        found = self.ranges[capacity].pop()
        if not self.ranges[capacity]:
            self._mark(capacity, False)
        return found

    def tightest(self, length: int) -> int | None:
        """The smallest capacity of ``length`` or more that an open sequence has."""
        i = self.leaves + length
        if not self.any[i]:
            # up to the first subtree on the right that holds something, then down on its left
            while i > 1 and (i % 2 or not self.any[i + 1]):
                i //= 2
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.any[2 * i] else 2 * i + 1
        return i - self.leaves


class Plan:
    """Where the pieces of each length go; ``sequences`` is how many there are.

    A step places pieces of one length, from number ``first`` on, into successive
    sequences from ``sequence`` on, ``per`` in each, the first of them at
    ``offset``.  A step ends with its length or with a range of sequences.  The
    end of a length adds two ranges at most, and a sequence takes pieces of fewer
    than sqrt(2 * window) lengths, so there are no more than
    2 * window * sqrt(2 * window) steps: 262,144 of 40 bytes for 2,048 tokens.
    """

    def __init__(self, counts: dict[int, int], window: int):
        open_, steps, self.sequences = Capacities(window), [], 0
        for length in sorted(counts, reverse=True):
            placed, n = 0, counts[length]
            while placed < n:
                room = open_.tightest(length)
                if room is None:
                    room, first, held = window, self.sequences, -(-(n - placed) // (window // length))
                    self.sequences += held
                else:
                    first, held = open_.pop(room)
                per = room // length
                take = min(n - placed, held * per)
                full, part = divmod(take, per)
                steps.append((length, placed, first, per, window - room))
                open_.push(room, first + full + (part > 0), held - full - (part > 0))
                open_.push(room - per * length, first, full)
                open_.push(room - part * length, first + full, part > 0)
                placed += take
        steps = np.array(steps, dtype=np.int64).reshape(-1, 5)
        order = np.lexsort((steps[:, 1], steps[:, 0]))
        self.length, self.first, self.sequence, self.per, self.offset = steps[order].T
        self.key = (self.length << 48) + self.first

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of the pieces of these lengths and numbers."""
        step = np.searchsorted(self.key, (length << 48) + number, side="right") - 1
        nth = number - self.first[step]
        return self.sequence[step] + nth // self.per[step], self.offset[step] + nth % self.per[step] * length


def cut(tokens: int, window: int) -> Iterator[tuple[int, int, int]]:
    """(piece, start, length): pieces of ``window`` tokens, the first one shorter where they do not come out even."""
    start, length = 0, tokens % window or window
    for piece in range(-(-tokens // window)):
        yield piece, start, length
        start, length = start + length, window


def _pieces(make_encoder: Callable, end_id: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, names = make_encoder(), [x.split()[0] for x in _PIECE.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(enc, text.as_py()), end_id).astype("<u4")
                for piece, start, length in cut(len(ids), window):
                    rows.append((doc_id, piece, start, length, zlib.crc32(ids[start : start + length].tobytes())))
                    if len(rows) == ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return run


def _placed(plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = plan.value.place(batch["length"].to_numpy(), batch["number"].to_numpy())
            kept = batch.select([x.split()[0] for x in _PIECE.split(", ")])
            yield kept.append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    return run


def best_fit(docs: DataFrame, make_encoder: Callable, end_id: int = 0, window: int = 2048) -> DataFrame:
    """Return the pieces (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    Each document is its ids and ``end_id``; one of more than ``window`` tokens is
    cut into pieces of ``window``, the first of which may be shorter.  Sequences
    are numbered from 0 without gaps and hold at most ``window`` tokens; a piece's
    offset is the number of tokens before it there.  The number of sequences is
    that of best-fit decreasing over all pieces.

    A null or empty text is the end id alone.  Rows that repeat are packed singly;
    pieces of one length are numbered by (doc_id, piece, checksum), so the result
    does not depend on files or partitions.  A null doc_id stays null; other
    columns are ignored; an empty table gives no pieces.  The driver gets one
    count for each length; the plan it broadcasts has a fixed bound (``Plan``).
    """
    pieces = materialize(docs.select("doc_id", text_of().alias("text")).mapInArrow(_pieces(make_encoder, end_id, window), _PIECE), "fit-pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan = docs.sparkSession.sparkContext.broadcast(Plan(counts, window))
    # rows that are alike in all columns differ in ``row``, so that ranges can split them
    rows = pieces.withColumn("row", F.monotonically_increasing_id())
    numbered = number_slots(rows, "length", ["length", "doc_id", "piece", "ids_crc32", "row"], "number")
    return numbered.mapInArrow(_placed(plan), _PLACED)
