"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text,
and a window of a text is compressed with each.  Where the toxic dictionary
saves bytes over the ordinary one, the window is suspicious.

A toxic document is ordinary in most of its windows, so a dictionary of whole
documents learns ordinary text.  The toxic samples are therefore what is left of
a toxic document when only words with evidence (a log-likelihood ratio) stay;
the ordinary samples are windows of ordinary documents, and, in a second round,
those of them that the first round's dictionaries take for toxic.  Both
compressors hold the ordinary content at the same place, so what both know
saves nothing.

A document's features are the numbers and the shares of its windows, of two
sizes, whose gain reaches each of several thresholds; a logistic map calibrated
on labelled documents that trained no dictionary makes them a probability.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import collect_bounded, labelled_sample, text_of

WINDOWS, LONGEST = (24, 96), 160
#: Bytes of gain a window of either size may reach.
THRESHOLDS = (1, 2, 3, 4, 5, 6, 8)
#: Log-likelihood that chance reaches for about one word in 100,000.
EVIDENCE = 10.0
TOXIC_BYTES, ORDINARY_BYTES, HARD_BYTES = 4096, 8192, 8192
#: Windows of each ordinary document that train the ordinary dictionary, evenly over its length.
ORDINARY_WINDOWS, ORDINARY_SIZE = 6, 48
MAX_ROWS, MAX_BYTES = 6000, 64_000_000
_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")
_KEEP = bytes(c if 0x61 <= c <= 0x7A or 0x30 <= c <= 0x39 or c >= 0x80 else 0x20 for c in range(256))


def windows(text: str, size: int) -> list[bytes]:
    """Lower-cased words in windows of ``size`` bytes or a little more, cut between words.

    A run without a break is cut LONGEST bytes after, the next window beginning
    ``size`` bytes earlier so that nothing is missed at the cut.
    """
    words = text.encode("utf-8", "surrogatepass").lower().translate(_KEEP).split()
    if not words:
        return []
    flat = b" " + b" ".join(words) + b" "
    out, at, end = [], 0, len(flat)
    while at + 1 < end:
        stop = flat.find(b" ", min(at + size, end - 1), at + size + LONGEST)
        if stop < 0:
            stop = min(at + size + LONGEST, end - 1)
            out.append(flat[at : stop + 1])
            at = max(at + 1, stop - size) if stop < end - 1 else stop
        else:
            out.append(flat[at : stop + 1])
            at = stop
    return out


@dataclass(frozen=True)
class Model:
    """What scoring needs; ``toxic`` is empty if there was nothing to learn from."""

    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]
    prior: float


def _compressors(toxic: bytes, ordinary: bytes):
    """Compressors of windows without and with the toxic content, the ordinary one at the same distance."""
    import zstandard as zstd

    out = []
    # in place of the toxic content the ordinary compressor has bytes that no window holds
    for content in (bytes(1 + i % 8 for i in range(len(toxic))) + ordinary, toxic + ordinary):
        # matches as long as the training's; the tables hold the whole dictionary, so that
        # words which begin alike hide none of it
        params = zstd.ZstdCompressionParameters(
            strategy=zstd.STRATEGY_LAZY2, min_match=6, window_log=17, hash_log=15, chain_log=16, search_log=6, target_length=32,
            write_content_size=False, write_checksum=False, write_dict_id=False,
        )
        d = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=params)
        out.append(zstd.ZstdCompressor(dict_data=d, compression_params=params))
    return out


def gains(compressors, pieces: list[bytes]) -> np.ndarray:
    """Bytes that the toxic dictionary saves over the ordinary one, per window."""
    ordinary, toxic = (c.compress for c in compressors)
    return np.fromiter((len(ordinary(w)) - len(toxic(w)) for w in pieces), dtype=np.int64, count=len(pieces))


def features(gain: np.ndarray) -> np.ndarray:
    """Of a document's windows of one size: logs of the numbers at each threshold, their shares, all windows, mean gain."""
    n = max(1, len(gain))
    high = np.array([(gain >= t).sum() for t in THRESHOLDS])
    return np.concatenate([np.log1p(high), np.minimum(1.0, 5 * high / n), [np.log1p(n), gain.sum() / n]])


def document_features(compressors, text: str) -> np.ndarray:
    return np.concatenate([*(features(gains(compressors, windows(text, size))) for size in WINDOWS), [1.0]])


def marked_words(texts: list[str], ys: list[float], least: int = 4) -> set[bytes]:
    """Words that toxic text uses more than chance allows.

    A word counts once a document and once for each pair of neighbours it first
    stands between, so neither a long document nor copies of one make its words
    look frequent.  A marked word's log-likelihood ratio is at least EVIDENCE.
    """
    around: list[dict] = [defaultdict(set), defaultdict(set)]
    for text, y in zip(texts, ys):
        w = _WORD.findall(text.encode("utf-8", "surrogatepass").lower())
        first = {b: (a, c) for a, b, c in reversed(list(zip([b"", *w], w, [*w[1:], b""])))}
        for word, beside in first.items():
            around[int(y)][word].add(beside)
    share = np.clip(np.mean(ys), 1e-3, 1 - 1e-3)
    found = set()
    for word, beside in around[1].items():
        seen, other = len(beside), len(around[0].get(word, ()))
        rate = seen / (seen + other)
        if seen >= least and len(word) >= 3 and rate > 3 * share / (1 + 2 * share):
            g = seen * np.log(rate / share) + (other * np.log((1 - rate) / (1 - share)) if other else 0.0)
            if g >= EVIDENCE:
                found.add(word)
    return found


def trained(samples: list[bytes], size: int, segment: int) -> bytes:
    """A dictionary trained by zstandard on the samples; all of them, where they are too few to train on."""
    import zstandard as zstd

    samples = [x for x in samples if len(x) >= 8]
    try:
        return zstd.train_dictionary(size, samples, k=segment, d=6).as_bytes()
    except zstd.ZstdError:
        return b"".join(samples)[-size:]


def train_dictionaries(texts: list[str], ys: list[float]) -> tuple[bytes, bytes]:
    """(toxic, ordinary) dictionaries; empty ones if no word is marked."""
    marked = marked_words(texts, ys)
    if not marked:
        return b"", b""
    toxic, every, spread = [], [], []
    for text, y in zip(texts, ys):
        if y:
            w = [x for x in text.encode("utf-8", "surrogatepass").lower().translate(_KEEP).split() if x in marked]
            toxic += [b" %b " % b" ".join(w[i : i + 8]) for i in range(0, len(w), 8)]
        else:
            own = windows(text, ORDINARY_SIZE)
            every += own
            spread += own[:: max(1, len(own) // ORDINARY_WINDOWS)]
    first, base = trained(toxic, TOXIC_BYTES, 24), trained(spread, ORDINARY_BYTES, 32)
    gain = gains(_compressors(first, base), every)
    hard = [w for w, g in zip(every, gain) if g >= 2]
    return first, (trained(hard, HARD_BYTES, 24) if hard else b"") + base


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    penalty = np.diag([l2 * len(y) / 100] * (x.shape[1] - 1) + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(w)), x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(texts: list[str], ys: list[float]) -> Model:
    """Dictionaries from about two thirds of the texts, the map to probabilities from the rest."""
    prior = float(np.mean(ys)) if ys else 0.0
    if len(set(ys)) < 2:
        return Model(b"", b"", (), prior)
    # by the text, so that exact copies fall on the same side
    rest = [int(hashlib.md5(t.encode("utf-8", "surrogatepass")).hexdigest()[:8], 16) % 3 == 0 for t in texts]
    own = [(t, y) for t, y, r in zip(texts, ys, rest) if not r]
    toxic, ordinary = train_dictionaries(*map(list, zip(*own))) if own else (b"", b"")
    y = np.array([v for v, r in zip(ys, rest) if r])
    if not toxic or len(set(y.tolist())) < 2:
        return Model(b"", b"", (), prior)
    c = _compressors(toxic, ordinary)
    x = np.stack([document_features(c, t) for t, r in zip(texts, rest) if r])
    return Model(toxic, ordinary, tuple(_logistic(x, y).tolist()), prior)


def score_text(model: Model, compressors, text: str) -> float:
    x = document_features(compressors, text)
    return float(1 / (1 + np.exp(-np.clip(x @ np.array(model.weights), -30, 30))))


def score_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Return (doc_id, score), one row per document, the whole text being scored.

    The dictionaries are trained on a sample of at most ``max_rows`` labelled
    documents and ``max_bytes`` of text outside the held-out fold.  Null and
    empty texts have no window and get the score of a text without suspicious
    windows.  Without labels of both kinds every score is the share of toxic
    labels (0 if there are none).  Rows that repeat give repeated rows; a null
    doc_id stays null; other columns are ignored.
    """
    model = train(*collect_bounded(labelled_sample(docs, labels, "toxic", max_rows), max_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _compressors(model.toxic, model.ordinary) if model.toxic else None
        for batch in batches:
            scores = [score_text(model, c, t.as_py()) if c else model.prior for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, score double")
