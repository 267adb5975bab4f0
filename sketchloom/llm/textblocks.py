"""Words and shingles of many texts at once, as numpy arrays of 64-bit hashes.

Texts are joined into blocks of a few megabytes.  A word's hash mixes its bytes
eight at a time, for all words of a block together, so no Python code runs per
word; only words of more than LONG_WORD bytes are hashed one by one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

BLOCK_BYTES = 1_000_000
#: Longer texts are taken in stretches, so that memory stays a few times the text's size.
LONG_BYTES = 4_000_000
LONG_WORD = 256
_R = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that all its bits depend on all of its input's."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each span of bytes, by its length and its bytes alone.

    Every eight bytes pass through ``mix`` together with what came before, so no
    algebra over the bytes makes two spans equal.
    """
    import xxhash

    length = end - start
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    h = mix(length.astype(np.uint64) * _R)
    left = np.flatnonzero(length <= LONG_WORD)
    at = 0
    while len(left):
        take = np.minimum(length[left] - at, 8)
        h[left] = mix(h[left] * _R ^ (eight[start[left] + at] & _KEEP[take]))
        at += 8
        left = left[length[left] > at]
    for i in np.flatnonzero(length > LONG_WORD).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes(), seed=length[i].item())
    return h


def blocks(texts: Iterable[bytes], size: int = BLOCK_BYTES) -> Iterator[list[bytes]]:
    """Successive texts in lists of about ``size`` bytes; a longer text stands alone."""
    held, n = [], 0
    for t in texts:
        if held and n + len(t) > size:
            yield held
            held, n = [], 0
        held.append(t)
        n += len(t)
    if held:
        yield held


def _separators(extra: bytes) -> np.ndarray:
    lut = np.zeros(256, dtype=bool)
    lut[np.frombuffer(extra, dtype=np.uint8)] = True
    return lut


WHITE = _separators(b" \t\n\x0b\x0c\r")


class Words:
    """Words of a block: hashes, places, and the range of words of each text."""

    def __init__(self, texts: list[bytes], separators: np.ndarray = WHITE):
        joined = b" ".join(texts) + b" "
        self.bytes = np.frombuffer(joined, dtype=np.uint8)
        gap = separators[self.bytes]
        lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        text_end = np.cumsum(lengths)
        gap[text_end - 1] = True
        edge = np.diff(gap.astype(np.int8), prepend=np.int8(1))
        self.start = np.flatnonzero(edge == -1)
        self.end = np.flatnonzero(edge == 1)
        if len(self.end) > len(self.start):  # the block begins with a separator
            self.end = self.end[len(self.end) - len(self.start) :]
        self.hash = hash_spans(self.bytes, self.start, self.end)
        self.first = np.searchsorted(self.start, text_end - lengths)
        self.last = np.searchsorted(self.start, text_end)


def stretches(text: bytes, size: int = BLOCK_BYTES) -> Iterator[bytes]:
    """A long text in stretches of about ``size`` bytes, cut at white space."""
    start = 0
    while len(text) - start > size:
        cut = min((at for c in b" \t\n\x0b\x0c\r" if (at := text.find(c, start + size)) >= 0), default=-1)
        if cut < 0:
            break
        yield text[start:cut]
        start = cut
    yield text[start:]


def word_arrays(block: list[bytes], arrays) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """``arrays(Words)`` of a block, and the range of words of each text.

    A block of one long text is taken in stretches: what ``arrays`` makes of a
    word depends on that word alone.
    """
    if len(block) == 1 and len(block[0]) > LONG_BYTES:
        parts = [arrays(Words([x])) for x in stretches(block[0])]
        whole = [np.concatenate(p) for p in zip(*parts)]
        return whole, np.array([0]), np.array([len(whole[0])])
    w = Words(block)
    return list(arrays(w)), w.first, w.last


def lowered(text: str) -> bytes:
    """UTF-8 with A-Z in lower case and nothing else changed."""
    return text.encode("utf-8", "surrogatepass").lower()


def shingle_sets(texts: list[str], width: int = 5) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's shingles of ``width`` words.

    A text of fewer words has one shingle, all of its words; one without words
    has none.
    """
    factor = np.uint64(0xD6E8FEB86659FD93)
    for block in blocks(map(lowered, texts)):
        (hashes,), first, last = word_arrays(block, lambda w: (w.hash,))
        acc = np.zeros(max(0, len(hashes) - width + 1), dtype=np.uint64)
        for i in range(width):
            acc = acc * factor + hashes[i : i + len(acc)]
        acc = mix(acc)
        for a, b in zip(first.tolist(), last.tolist()):
            if b - a >= width:
                yield np.unique(acc[a : b - width + 1])
            elif b > a:
                short = np.uint64(b - a)
                for h in hashes[a:b]:
                    with np.errstate(over="ignore"):
                        short = short * factor + h
                yield mix(mix(np.array([short])))
            else:
                yield np.empty(0, dtype=np.uint64)
