"""Packing documents into training sequences by lexical retrieval.

1. Every text is encoded once, and the ids are written.
2. Document frequencies, the number of documents and their mean length are
   counted over the whole corpus.
3. A document's key is the term of its greatest BM25 weight among those that
   another document has.  Keys, of which there are no more than terms, are laid
   out in shards of about ``shard_tokens`` tokens, so documents about the same
   rare term share a shard; a key with more tokens than that gets several shards.
4. A shard has a BM25 inverted index over its documents, weighted by the corpus'
   statistics.  A window starts with a seed document; the index ranks the
   shard's other documents by all of the seed's terms, and the best unused ones
   follow until the window is full.  The document that crosses the border is cut
   there, and the rest of it is the next window's seed.
5. What is left at the ends of shards is joined over many shards into further
   sequences; the last of those are cut into powers of two, so nothing is padded.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encode, json_encoder
from .common import materialize, text_of

K1, B = 1.2, 0.75
SHARD_TOKENS = 1_000_000
#: Shards whose ends are joined; they hold fewer than a window of tokens each.
ENDS_OF = 500
#: Up to so many documents in a shard all scores come from matrix products over TERMS terms at a time, beyond
#: (documents are short then) from the postings of each seed's terms; the scores are the same.
DENSE, TERMS = 4096, 2048
#: Ids whose terms are counted at once.
BLOCK = 200_000
_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = [x.split()[0] for x in _PIECE.split(", ")]


class Statistics:
    """Of all documents: how many have each term, their number and mean length."""

    def __init__(self, df: np.ndarray, n: int, mean: float):
        self.df, self.mean = df, max(mean, 1.0)
        self.idf = np.log1p((n - df + 0.5) / (df + 0.5))

    def weights(self, term: np.ndarray, tf: np.ndarray, length) -> np.ndarray:
        """BM25 weights of terms that occur ``tf`` times in documents of ``length`` terms."""
        return self.idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / self.mean))

    def keys(self, docs: list[np.ndarray]) -> np.ndarray:
        """Each document's term of the greatest weight that another document has, the smallest of equals; -1 if there is none."""
        lengths = np.array([len(d) for d in docs], dtype=np.int64)
        doc, term, tf = term_counts(docs)
        shared = self.df[term] > 1
        doc, term, tf = doc[shared], term[shared], tf[shared]
        keys = np.full(len(docs), -1, dtype=np.int64)
        if len(doc):
            weight = self.weights(term, tf, lengths[doc])
            at = np.flatnonzero(np.diff(doc, prepend=-1))
            best = np.flatnonzero(weight == np.repeat(np.maximum.reduceat(weight, at), np.diff(at, append=len(doc))))
            found, first = np.unique(doc[best], return_index=True)
            keys[found] = term[best[first]]
        return keys


def term_counts(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the document, term, occurrences) of each document's distinct terms, in this order."""
    lengths = np.array([len(d) for d in docs], dtype=np.int64)
    both = np.repeat(np.arange(len(docs), dtype=np.int64) << 32, lengths) + np.concatenate(docs)
    both.sort()
    at = np.flatnonzero(np.diff(both, prepend=-1))
    return both[at] >> 32, both[at] & 0xFFFFFFFF, np.diff(at, append=len(both))


def blocks(column: pa.Array, kind: str) -> Iterator[list[np.ndarray]]:
    """The documents' ids, whole documents together until they have BLOCK ids."""
    block, held = [], 0
    for x in column:
        block.append(np.frombuffer(x.as_py(), kind))
        held += len(block[-1])
        if held >= BLOCK:
            yield block
            block, held = [], 0
    if block:
        yield block


class Index:
    """A BM25 inverted index of one shard; a query is all of a document's terms."""

    def __init__(self, docs: list[np.ndarray], stats: Statistics):
        n, n_terms = len(docs), len(stats.df)
        lengths = np.array([len(d) for d in docs], dtype=np.int64)
        terms = np.concatenate(docs).astype(np.int64)
        key, tf = np.unique(np.repeat(np.arange(n, dtype=np.int64), lengths) * n_terms + terms, return_counts=True)
        doc, term = key // n_terms, key % n_terms
        weight = stats.weights(term, tf, lengths[doc]).astype(np.float32)
        self.n, self.df = n, np.bincount(term, minlength=n_terms)
        self.doc_at = np.searchsorted(doc, np.arange(n + 1))
        self.term = term
        order = np.argsort(term, kind="stable")
        self.post_doc, self.post_weight = doc[order], weight[order]
        self.post_at = np.concatenate([[0], np.cumsum(self.df)])

        self.every = self._all_scores() if 1 < n <= DENSE else None

    def _all_scores(self) -> np.ndarray:
        """Scores of all documents (columns) for each document's terms (rows), by products over stretches of terms."""
        out = np.zeros((self.n, self.n), dtype=np.float32)
        shared = np.flatnonzero(self.df > 1)
        place = np.full(len(self.df), -1)
        term_of = np.repeat(np.arange(len(self.df)), self.df)
        for i in range(0, len(shared), TERMS):
            some = shared[i : i + TERMS]
            place[some] = np.arange(len(some))
            posts = slice(self.post_at[some[0]], self.post_at[some[-1] + 1])
            column = place[term_of[posts]]
            held = np.zeros((self.n, len(some)), dtype=np.float32)
            held[self.post_doc[posts][column >= 0], column[column >= 0]] = self.post_weight[posts][column >= 0]
            out += (held != 0).astype(np.float32) @ held.T
            place[some] = -1
        return out

    def scores(self, d: int) -> np.ndarray:
        if self.every is not None:
            return self.every[d].copy()
        score = np.zeros(self.n, dtype=np.float32)
        term = self.term[self.doc_at[d] : self.doc_at[d + 1]]
        for t in term[self.df[term] > 1].tolist():
            p = slice(self.post_at[t], self.post_at[t + 1])
            score[self.post_doc[p]] += self.post_weight[p]
        return score

    def neighbours(self, d: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents that share a term with ``d``, best first."""
        score = self.scores(d)
        score[~unused] = 0
        found = np.flatnonzero(score)
        return found[np.argsort(-score[found], kind="stable")]


def order_documents(docs: list[np.ndarray], window: int, stats: Statistics) -> Iterator[int]:
    """The order in which seeds and their neighbours fill the windows."""
    if len(docs) < 3:
        yield from range(len(docs))
        return
    index = Index(docs, stats)
    unused = np.ones(len(docs), dtype=bool)
    free, at, seed, ranked, k = 0, 0, None, None, 0
    for _ in docs:
        d = None
        if at % window and seed is not None:
            if ranked is None:
                ranked, k = index.neighbours(seed, unused), 0
            while k < len(ranked) and not unused[ranked[k]]:
                k += 1
            d = int(ranked[k]) if k < len(ranked) else None
        if d is None:
            while not unused[free]:
                free += 1
            d = free
        unused[d] = False
        yield d
        if at % window == 0 or at // window != (at + len(docs[d])) // window:
            seed, ranked = d, None
        at += len(docs[d])


def cut(lengths: list[int], window: int, powers: bool) -> Iterator[tuple[int, int, int, int, int]]:
    """(place in the list, start, length, sequence, offset) of each piece of stretches that follow one another.

    The last window, if not full, is cut into powers of two if ``powers``, else
    it is one sequence.
    """
    total = sum(lengths)
    ends = [*range(window, total + 1, window)]
    end = ends[-1] if ends else 0
    for bit in range((total - end).bit_length() - 1, -1, -1) if powers else []:
        if (total - end) >> bit & 1:
            ends.append(end := end + (1 << bit))
    if end < total:
        ends.append(total)
    at = s = begin = 0
    for i, n in enumerate(lengths):
        start = 0
        while start < n:
            length = min(n - start, ends[s] - at)
            yield i, start, length, s, at - begin
            start, at = start + length, at + length
            if at == ends[s]:
                begin, s = at, s + 1


def pack_shard(docs: list[np.ndarray], window: int, stats: Statistics) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece of a shard; the last sequence may not be full."""
    order = list(order_documents(docs, window, stats))
    for i, *piece in cut([len(docs[d]) for d in order], window, False):
        yield order[i], *piece


def _encoded(make_encoder: Callable, end_id: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = make_encoder()
        for batch in batches:
            ids = [np.append(encode(enc, t.as_py()), np.uint32(end_id)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype(kind).tobytes() for x in ids], pa.binary())], ["doc_id", "tokens", "ids"]
            )

    return run


def _document_frequencies(n_terms: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms, dtype=np.int64)
        for batch in batches:
            for block in blocks(batch.column(0), kind):
                df += np.bincount(term_counts(block)[1], minlength=n_terms)
        term = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(term, pa.int32()), pa.array(df[term])], ["term", "n"])

    return run


def _keys(stats: Statistics, kind: str, carry: bool):
    """Rows (doc_id, tokens, ids, row) with their key; without ``carry`` the tokens of each key of a batch only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = pa.array(np.concatenate([np.empty(0, np.int64), *(stats.keys(block) for block in blocks(batch["ids"], kind))]), pa.int64()).cast(pa.int32())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["ids"], batch["row"], keys] if carry else [keys, batch["tokens"]], ["doc_id", "ids", "row", "key"] if carry else ["key", "tokens"])

    return run


def lay_out(tokens: dict[int, int], shard_tokens: int) -> list[tuple[int, int, int]]:
    """(key, first shard, number of shards): keys in order, as many in a shard as fit; a large one has shards of its own."""
    out, shard, held = [], 0, 0
    for key, n in sorted(tokens.items()):
        if held and held + n > shard_tokens:
            shard, held = shard + 1, 0
        out.append((key, shard, max(1, -(-n // shard_tokens))))
        held += n
        if n > shard_tokens:
            shard, held = shard + out[-1][2], 0
    return out


def _table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [()] * 8
    arrays = [pa.array(c, pa.int64()) for c in columns[:7]] + [pa.array(columns[7], pa.binary())]
    return pa.Table.from_arrays(arrays, [*_NAMES, "rest"])


def _pack(stats: Statistics, window: int, kind: str):
    """Pieces of a shard; those of a last sequence that is not full carry their ids along."""

    def run(t: pa.Table) -> pa.Table:
        shard = t["shard"][0].as_py()
        data = t["ids"].to_pylist()
        doc_ids = t["doc_id"].to_pylist()
        order = sorted(range(len(data)), key=lambda i: (doc_ids[i] is None, doc_ids[i] or 0, data[i]))
        docs = [np.frombuffer(data[i], kind).astype("<u4") for i in order]
        pieces, filled = list(pack_shard(docs, window, stats)), {}
        for _, _, length, s, _ in pieces:
            filled[s] = filled.get(s, 0) + length
        rows = []
        for d, start, length, s, offset in pieces:
            part = docs[d][start : start + length].tobytes()
            rows.append((doc_ids[order[d]], start, length, zlib.crc32(part), len(docs[d]), (shard << 32) + s, offset, part if filled[s] < window else None))
        return _table(rows)

    return run


def _pack_ends(window: int):
    """Sequences of what was left at the ends of shards."""

    def run(t: pa.Table) -> pa.Table:
        rest = sorted(t.drop_columns(["part"]).to_pylist(), key=lambda r: (r["sequence_id"], r["offset"]))
        first = (1 << 62) + (t["part"][0].as_py() << 32)
        rows = []
        for i, start, length, s, offset in cut([r["length"] for r in rest], window, True):
            r = rest[i]
            rows.append((r["doc_id"], r["start"] + start, length, zlib.crc32(r["rest"][4 * start : 4 * (start + length)]), r["doc_tokens"], first + s, offset, None))
        return _table(rows)

    return run


def pack_documents(docs: DataFrame, make_encoder: Callable, n_terms: int, end_id: int = 1, window: int = 2048, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Return the pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    ``window`` is a power of two.  Each document is its ids and ``end_id``; every
    id lies in exactly one piece.  A null or empty text is the end id alone.
    Rows that repeat are packed singly; a null doc_id stays null; other columns
    are ignored; an empty table gives no pieces.  sequence_id holds the shard in
    its upper bits, so it is unique but not gapless.

    A shard holds about ``shard_tokens`` tokens or one longer document.  What the
    driver fetches is bounded by ``n_terms``: frequencies, and tokens by key.
    """
    kind = "<u2" if n_terms <= 1 << 16 else "<u4"
    ids = docs.select("doc_id", text_of().alias("text")).mapInArrow(_encoded(make_encoder, end_id, kind), "doc_id long, tokens long, ids binary")
    ids = materialize(ids, "pack-ids")
    n, total = ids.agg(F.count(F.lit(1)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    df = np.zeros(n_terms, dtype=np.int64)
    for term, count in ids.select("ids").mapInArrow(_document_frequencies(n_terms, kind), "term int, n long").groupBy("term").agg(F.sum("n")).collect():
        df[term] = count
    stats = Statistics(df, n, total / max(n, 1))
    # keys are found twice: once for the layout, once on the way to the shards, so that ids are written only once
    sums = ids.select("ids", "tokens", F.lit(0).alias("doc_id"), F.lit(0).alias("row")).mapInArrow(_keys(stats, kind, False), "key int, tokens long")
    places = lay_out({r[0]: r[1] for r in sums.groupBy("key").agg(F.sum("tokens")).collect()}, shard_tokens)
    # a row for each key, hence no more than terms
    places = F.broadcast(docs.sparkSession.createDataFrame(places, "key int, first long, n int"))
    keyed = ids.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_keys(stats, kind, True), "doc_id long, ids binary, row long, key int")
    shard = F.col("first") + F.pmod(F.xxhash64("doc_id", "row"), F.col("n"))
    packed = keyed.join(places, "key").select("doc_id", "ids", shard.alias("shard")).groupBy("shard").applyInArrow(_pack(stats, window, kind), f"{_PIECE}, rest binary")
    packed = materialize(packed, "pack-shards")
    ends = packed.where("rest IS NOT NULL").withColumn("part", F.floor(F.shiftright("sequence_id", 32) / ENDS_OF))
    ends = ends.groupBy("part").applyInArrow(_pack_ends(window), f"{_PIECE}, rest binary")
    return packed.where("rest IS NULL").unionByName(ends).select(*_NAMES)


def json_vocabulary(path: str, pattern: str) -> Callable:
    """For ``pack_documents``: the encoder of a JSON description, made once a worker."""
    return lambda: json_encoder(path, pattern)
