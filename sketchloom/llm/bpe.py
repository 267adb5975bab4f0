"""Byte-level BPE: encoding with tiktoken and a local rank file, decoding from raw bytes."""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_of

#: A single space between two characters that are not white space: the
#: splitting pattern always starts a match there, so cutting changes no id.
SAFE = re.compile(r"(?<=\S) (?=\S)")
PIECE = 100_000
#: The white space of the splitting pattern, in runs that its look-ahead should not walk.
BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{300,}")


@lru_cache(maxsize=4)
def encoder(rank_file: str, pattern: str):
    """A tiktoken encoding from a file of base64 tokens and ranks."""
    import tiktoken

    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def json_encoder(vocab_file: str, pattern: str):
    """The same encoding, read from a tokenizer description in JSON.

    Its vocabulary spells bytes as printable characters: those that print stand
    for themselves, the others for 256 and up, in order.  Its added tokens are the
    encoding's special tokens.
    """
    import tiktoken

    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spelled = {chr(b): b for b in kept}
    spelled |= {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(kept))}
    with open(vocab_file, encoding="utf-8") as f:
        described = json.load(f)
    added = {x["content"]: x["id"] for x in described.get("added_tokens", [])}
    ranks = {bytes(map(spelled.__getitem__, t)): i for t, i in described["model"]["vocab"].items() if t not in added}
    return tiktoken.Encoding("local-json", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)


def safe_pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """Cut a long text at safe boundaries into pieces of about ``size`` characters."""
    start = 0
    while len(text) - start > size:
        found = SAFE.search(text, start + size)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def _ordinary(enc, text: str) -> Iterator[np.ndarray]:
    """Ids of a text that is not searched for special tokens.

    A long run of white space is one match of the splitting pattern, but for its
    last character where something follows; such runs go to the encoder of
    single pieces, since matching them takes time in proportion to their square.
    """
    start = 0
    for run in BLANKS.finditer(text):
        end = run.end() - (run.end() < len(text))
        yield from (enc.encode_to_numpy(x, disallowed_special=()) for x in safe_pieces(text[start : run.start()]))
        yield enc._encode_single_piece(text[run.start() : end])
        start = end
    yield from (enc.encode_to_numpy(x, disallowed_special=()) for x in safe_pieces(text[start:]))


def encode(enc, text: str) -> np.ndarray:
    """Ids of the whole text; the special tokens of the encoding, if it has any, are found in it.

    What stands between special tokens is a text of its own to the splitting
    pattern, so a long text is cut there first.
    """
    if len(text) <= PIECE and not BLANKS.search(text):
        return enc.encode_to_numpy(text, allowed_special="all")
    special = re.compile("|".join(map(re.escape, sorted(enc.special_tokens_set, key=len, reverse=True))) or r"(?!)")
    out, start = [], 0
    for found in special.finditer(text):
        out += [*_ordinary(enc, text[start : found.start()]), [enc.encode_single_token(found.group())]]
        start = found.end()
    out += _ordinary(enc, text[start:])
    return np.concatenate([np.asarray(x, dtype="<u4") for x in out])


def decode(enc, ids: np.ndarray) -> bytes:
    """The raw bytes of the ids; they need not be whole characters."""
    return enc.decode_bytes(ids.tolist())


def bpe_round_trip(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """Return (doc_id, n_tokens, ids_sha256, decoded_sha256), one row per document.

    A null text counts as empty and has no ids.  Rows stay as they come: repeats
    give repeated rows, a null doc_id stays null, other columns are ignored.
    There is no shuffle; memory holds one Arrow batch and the ids of one text.
    ``rank_file`` is the vocabulary's path on every machine.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(rank_file, pattern)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for text in batch.column(1):
                ids = encode(enc, text.as_py())
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(ids.tobytes()).hexdigest())
                text_sha.append(hashlib.sha256(decode(enc, ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
