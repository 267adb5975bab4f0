"""Spelling variants: words one edit apart, each led to the frequent form near it.

1. Words are counted per batch of texts, then over the corpus.
2. Each length of words has a blocked Bloom filter, of blocks of 64 bits, built
   by Spark in segments.  The filters of some lengths at a time, FILTER_BYTES at
   most, are broadcast; a length of more words than that is split by hash.
3. Every word generates its deletions and its replacements by later letters; an
   insertion is another word's deletion, and a replacement by an earlier letter
   another word's replacement.  The edits' hashes follow from the word's own
   without spelling them out.  Only edits that a filter holds are spelled and
   shuffled to a join with the vocabulary, which removes what the filters hold
   in error.
4. Forms are followed to their roots by doubling.  Each form occurs twice as
   often as its word at least, so chains are short and have no cycles.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_salted, materialize, text_of
from .textblocks import lowered, mix

#: Letters of the contract, after A-Z are in lower case.
LETTERS = [*map(chr, range(ord("a"), ord("z") + 1)), *map(chr, range(0xC0, 0x100))]
RUN = re.compile("[a-zÀ-ÿ]+")
BREAK = re.compile("[^a-zÀ-ÿ]")
#: Long texts are searched in stretches of so many characters.
STRETCH = 1_000_000
#: Distinct words after which a task hands its counts on.
HELD = 200_000
DROP_EVERY = 97
#: Bytes of the filters that are broadcast together, and bits a word.
FILTER_BYTES, BITS = 32 << 20, 32
#: Blocks of a filter that are built in one group: about 16,000 words.
SEGMENT = 8192
#: Edits that are hashed at once.
EDITS = 1 << 20
_B = 0x9E3779B97F4A7C15 | 1
_VALUE = np.zeros(0x100, dtype=np.uint64)
_VALUE[[ord(c) for c in LETTERS]] = mix(np.arange(1, len(LETTERS) + 1, dtype=np.uint64) * np.uint64(_B))
_CODES = np.array([ord(c) for c in LETTERS], dtype=np.uint32)


def stretches(text: str) -> Iterator[str]:
    """The text in parts of about STRETCH characters that cut no run."""
    start = 0
    while len(text) - start > STRETCH:
        found = BREAK.search(text, start + STRETCH)
        if not found:
            break
        yield text[start : found.start()]
        start = found.end()
    yield text[start:]


def misspelt(doc_id, run: str) -> str:
    """The run, without one of its letters where a checksum says so."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % DROP_EVERY:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counted(min_length: int):
    def table(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for part in stretches(lowered(text.as_py()).decode("utf-8", "surrogatepass")):
                    for found, n in Counter(RUN.findall(part)).items():
                        word = misspelt(doc_id, found)
                        if len(word) >= min_length:
                            held[word] += n
                    if len(held) >= HELD:
                        yield table(held)
                        held = Counter()
        if held:
            yield table(held)

    return run


def vocabulary(docs: DataFrame, min_length: int = 5, min_count: int = 3) -> DataFrame:
    """(word, n): the words of all texts, after the contract's deletions."""
    counted = docs.select("doc_id", text_of().alias("text")).mapInArrow(_counted(min_length), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in the list, code points as a matrix) of the words of each length."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        step = max(1, EDITS // n)
        for i in range(0, len(at), step):
            some = at[i : i + step]
            joined = "".join(words[j] for j in some.tolist()).encode("utf-32-le")
            yield some, np.frombuffer(joined, dtype="<u4").reshape(len(some), n)


def powers(n: int) -> np.ndarray:
    """Weights of the places 0 to n - 1, modulo 2 ** 64."""
    return np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, _B, dtype=np.uint64)])) if n > 1 else np.ones(n, dtype=np.uint64)


def sums(codes: np.ndarray) -> np.ndarray:
    """A linear hash of each row of code points; ``mix`` makes it one to draw bits from."""
    return (_VALUE[codes] * powers(codes.shape[1])).sum(axis=1, dtype=np.uint64)


def bits_of(h: np.ndarray) -> np.ndarray:
    """Five of a block's 64 bits."""
    out = np.zeros(len(h), dtype=np.uint64)
    for i in range(5):
        out |= np.uint64(1) << ((h >> np.uint64(6 * i)) & np.uint64(63))
    return out


def block_of(h: np.ndarray, blocks: int) -> np.ndarray:
    return (((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)).astype(np.int64)


class Layout:
    """How many parts the filter of each length has, and how many blocks a part."""

    def __init__(self, words: dict[int, int], filter_bytes: int):
        self.parts = {n: max(1, -(-k * BITS // (8 * filter_bytes))) for n, k in words.items()}
        self.blocks = {n: max(1, -(-k * BITS // (64 * self.parts[n]))) for n, k in words.items()}

    def part_of(self, h: np.ndarray, length: int) -> np.ndarray:
        return (mix(h) % np.uint64(self.parts[length])).astype(np.int64)

    def passes(self, filter_bytes: int) -> Iterator[set[tuple[int, int]]]:
        """(length, part) of the filters that are broadcast together."""
        some, held = set(), 0
        for n in sorted(self.parts):
            for part in range(self.parts[n]):
                if some and held + 8 * self.blocks[n] > filter_bytes:
                    yield some
                    some, held = set(), 0
                some.add((n, part))
                held += 8 * self.blocks[n]
        if some:
            yield some


def _bits(layout: Layout, wanted: set[tuple[int, int]]):
    """The bits of the words whose filters are wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, codes in by_length(batch.column(0).to_pylist()):
                n = codes.shape[1]
                h = mix(sums(codes))
                part = layout.part_of(h, n)
                for p in np.unique(part).tolist():
                    if (n, p) in wanted:
                        own = h[part == p]
                        block = block_of(own, layout.blocks[n])
                        columns = [np.full(len(own), n), np.full(len(own), p), block // SEGMENT, block % SEGMENT, bits_of(own).view(np.int64)]
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["length", "part", "segment", "at", "bits"])

    return run


def _segment(t: pa.Table) -> pa.Table:
    out = np.zeros(SEGMENT, dtype=np.uint64)
    np.bitwise_or.at(out, t["at"].to_numpy(), t["bits"].to_numpy().view(np.uint64))
    return pa.table({"length": t["length"][:1], "part": t["part"][:1], "segment": t["segment"][:1], "filter": pa.array([out.tobytes()], pa.binary())})


def build_filters(words: DataFrame, layout: Layout, wanted: set[tuple[int, int]]) -> dict[tuple[int, int], np.ndarray]:
    """The filters, fetched by segments; together they have the size that ``passes`` allows."""
    filters = {(n, p): np.zeros(layout.blocks[n], dtype=np.uint64) for n, p in wanted}
    segments = (
        words.select("word").mapInArrow(_bits(layout, wanted), "length long, part long, segment long, at long, bits long")
        .groupBy("length", "part", "segment").applyInArrow(_segment, "length long, part long, segment long, filter binary")
    )
    for r in segments.toLocalIterator():
        own = filters[r["length"], r["part"]]
        first = r["segment"] * SEGMENT
        own[first : first + SEGMENT] = np.frombuffer(r["filter"], dtype=np.uint64)[: len(own) - first]
    return filters


def deletions(codes: np.ndarray, i: int, prefix: np.ndarray, shifted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, linear hash) of the words without the letter at ``i``; of a run of equal letters only the first is deleted."""
    rows = np.arange(len(codes)) if i == 0 else np.flatnonzero(codes[:, i] != codes[:, i - 1])
    return rows, prefix[rows, i] + shifted[rows, -1] - shifted[rows, i]


def edits(codes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray | None]]:
    """(length, place, rows, linear hashes, letters) of the edits at each place; letters are null for deletions."""
    k, n = codes.shape
    value, weight = _VALUE[codes], powers(n)
    terms = value * weight
    whole = terms.sum(axis=1, dtype=np.uint64)
    if n > 1:
        prefix = np.zeros((k, n + 1), dtype=np.uint64)
        np.cumsum(terms, axis=1, out=prefix[:, 1:])
        shifted = np.cumsum(value * np.concatenate([[np.uint64(0)], weight[:-1]]), axis=1, dtype=np.uint64)
        for i in range(n):
            rows, h = deletions(codes, i, prefix, shifted)
            yield n - 1, i, rows, h, None
    for i in range(n):
        rows, letter = np.nonzero(_CODES[None, :] > codes[:, i, None])
        yield n, i, rows, whole[rows] + (_VALUE[_CODES[letter]] - value[rows, i]) * weight[i], letter


def _probe(layout: Layout, filters):
    """(word, n, candidate): edits that the broadcast filters hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = filters.value
        lengths = {n for n, _ in held}
        for batch in batches:
            words, counts = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for at, codes in by_length(words):
                if codes.shape[1] not in lengths and codes.shape[1] - 1 not in lengths:
                    continue
                step = max(1, EDITS // len(LETTERS))
                for i in range(0, len(at), step):
                    source, candidates = [], []
                    for length, place, rows, h, letter in edits(codes[i : i + step]):
                        if length not in lengths or not len(rows):
                            continue
                        h = mix(h)
                        yes = np.zeros(len(h), dtype=bool)
                        part = layout.part_of(h, length) if layout.parts[length] > 1 else np.zeros(len(h), dtype=np.int64)
                        bits = bits_of(h)
                        for p in range(layout.parts[length]):
                            if (length, p) in held:
                                block = held[length, p][block_of(h, layout.blocks[length])]
                                yes |= (part == p) & (block & bits == bits)
                        for j in np.flatnonzero(yes).tolist():
                            w = at[i + rows[j]]
                            word = words[w]
                            source.append(w)
                            candidates.append(word[:place] + ("" if letter is None else LETTERS[letter[j]]) + word[place + 1 :])
                    if source:
                        yield pa.RecordBatch.from_arrays([pa.array([words[w] for w in source], pa.string()), pa.array(counts[source], pa.int64()), pa.array(candidates, pa.string())], ["word", "n", "candidate"])

    return run


def near_pairs(words: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """(a, n_a, b, n_b): every pair of words one edit apart, once."""
    spark = words.sparkSession
    layout = Layout({r[0]: r[1] for r in words.groupBy(F.length("word")).count().collect()}, filter_bytes)
    out = None
    for wanted in layout.passes(filter_bytes):
        filters = spark.sparkContext.broadcast(build_filters(words, layout, wanted))
        positive = words.select("word", "n").mapInArrow(_probe(layout, filters), "word string, n long, candidate string")
        known = words.select(F.col("word").alias("candidate"), F.col("n").alias("n_b"))
        pairs = materialize(positive.join(known.hint("merge"), "candidate").select(F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("candidate").alias("b"), "n_b"), "spelling-pairs")
        filters.unpersist()
        out = pairs if out is None else out.unionByName(pairs)
    return out if out is not None else words.select(F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("word").alias("b"), F.col("n").alias("n_b"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of each word with a form: the last word on the way over forms."""
    up = materialize(forms.select("word", F.col("form").alias("root")), "spelling-up")
    while True:
        above = up.select(F.col("word").alias("root"), F.col("root").alias("further"))
        jumped = materialize(join_salted(up, above, "root", "word", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-up")
        up = jumped.select("word", "root")
        if not jumped.where("moved").limit(1).count():
            return up


def spelling_variants(docs: DataFrame, min_length: int = 5, min_count: int = 3, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """Return (word, form, root, n, n_near, form_n), one row per word.

    Words are the runs of letters of all texts, A-Z in lower case, some without
    a letter by a checksum of doc_id and run, of ``min_length`` letters and
    ``min_count`` occurrences at least.  Near words are one insertion, deletion
    or replacement apart.  A word's form is its near word of the largest count
    (of equals the first in code-point order), if that is twice its own at
    least; its root is the last word on the way over forms.

    A null text has no words; a null doc_id counts as an empty string in the
    checksum; rows that repeat count each; other columns are ignored; an empty
    table gives an empty result.  Texts are searched in stretches, so that
    memory does not hold all the runs of a long one; a word's edits are hashed
    a place at a time.  A word has at most 180 near words a letter, so no key of
    the joins is hot, but for roots, whose join is salted.
    """
    words = materialize(vocabulary(docs, min_length, min_count), "spelling-words")
    pairs = near_pairs(words, filter_bytes)
    both = pairs.select(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("near"), F.col("n_b").alias("near_n")).union(pairs.select("b", "n_b", "a", "n_a"))
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near"))).alias("best")
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    led = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.col("best.near").alias("near"), (-F.col("best.minus")).alias("near_n"))
    has = F.col("near_n") >= 2 * F.col("n")
    led = materialize(led.select("word", F.when(has, F.col("near")).alias("form"), "n", "n_near", F.when(has, F.col("near_n")).alias("form_n")), "spelling-forms")
    ends = roots(led.where("form IS NOT NULL"))
    return led.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
