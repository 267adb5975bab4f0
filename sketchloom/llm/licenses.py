"""Licence scan: Aho-Corasick over notices and tags, and a parser of licence expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_of

#: The phrases of the base search, as words, and their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Further notices that the method knows.
NOTICES = {
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "licensed under the apache license": "apache-2",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "this is free and unencumbered software": "unlicense",
}
TAG = "spdx license identifier"
#: Families of identifiers in expressions, and the labels they get.
FAMILIES = {
    "mit": "mit",
    "apache-2": "apache-2",
    "cc-by-nc": "cc-by-nc",
    "cc-by-sa": "cc-by-sa",
    "gpl-2": "gpl-2",
    "gpl-3": "gpl-3",
    "lgpl": "lgpl",
    "agpl": "agpl",
    "mpl": "mpl",
    "bsd": "bsd",
    "isc": "isc",
    "unlicense": "unlicense",
}
_BREAKS = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_WORDS = bytes.maketrans(_BREAKS, b" " * len(_BREAKS))
_AFTER_TAG = re.compile(r"SPDX-License-Identifier[^\w(]{0,3}[ \t]*([^\r\n]*)", re.IGNORECASE)
_TOKEN = re.compile(r"\s*(\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*)")
_RANK = {"or": 1, "and": 2, "with": 3}


def words_of(text: str) -> list[bytes]:
    """Runs of digits, letters and characters beyond ASCII, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().translate(_WORDS).split()


def to_postfix(tokens: list[str]) -> list[str] | None:
    """Dijkstra's shunting-yard; None unless all the tokens are one expression."""
    out, ops, operand = [], [], True
    for t in tokens:
        low = t.lower()
        if low in _RANK and not operand:
            while ops and ops[-1] != "(" and _RANK[ops[-1]] >= _RANK[low]:
                out.append(ops.pop())
            ops.append(low)
            operand = True
        elif t == "(" and operand:
            ops.append(t)
        elif t == ")" and not operand:
            while ops and ops[-1] != "(":
                out.append(ops.pop())
            if not ops:
                return None
            ops.pop()
        elif operand and low not in _RANK and t not in "()":
            out.append(low)
            operand = False
        else:
            return None
    if operand or "(" in ops:
        return None
    return out + ops[::-1]


def evaluate(postfix: list[str], allowed: set[str]) -> bool:
    """Whether the labels in ``allowed`` satisfy the expression; exceptions only add rights."""
    return any(x <= allowed for x in alternatives(postfix))


def alternatives(postfix: list[str]) -> list[frozenset[str]]:
    """The smallest sets of labels that satisfy the expression, none of them within another.

    An identifier without a label is satisfied by no set.
    """
    stack: list[set[frozenset[str]]] = []
    for t in postfix:
        if t not in _RANK:
            label = label_of(t)
            stack.append({frozenset([label])} if label else set())
            continue
        b, a = stack.pop(), stack.pop()
        found = {"or": a | b, "and": {x | y for x in a for y in b}, "with": a}[t]
        stack.append({x for x in found if not any(y < x for y in found)})
    return sorted(stack[0], key=sorted) if stack else []


def labels_of(postfix: list[str]) -> set[str]:
    """Labels of all licences of the expression; what stands after ``with`` is an exception, not a licence."""
    stack: list[set[str]] = []
    for t in postfix:
        if t in _RANK:
            b, a = stack.pop(), stack.pop()
            stack.append(a if t == "with" else a | b)
        else:
            stack.append({label_of(t)} - {None})
    return stack[0] if stack else set()


def parse_expression(text: str) -> list[str]:
    """Postfix form of the longest and/or/with expression ``text`` begins with, [] if none."""
    tokens, at, depth, end, operand = [], 0, 0, 0, True
    while m := _TOKEN.match(text, at):
        t = m[1]
        if operand and t == "(":
            depth += 1
        elif operand and t != ")" and t.lower() not in _RANK:
            operand = False
        elif not operand and t.lower() in _RANK:
            operand = True
        elif not operand and t == ")" and depth:
            depth -= 1
        else:
            break
        tokens.append(t)
        at = m.end()
        if not operand and not depth:
            end = len(tokens)
    return to_postfix(tokens[:end]) or []


def label_of(identifier: str) -> str | None:
    """The label of a licence identifier in lower case: a family's name, alone or before "-", "." or "+"."""
    return next((v for k, v in FAMILIES.items() if identifier.startswith(k) and identifier[len(k) : len(k) + 1] in ("", "-", ".", "+")), None)


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for phrase, label in BASE.items():
        a.add_word(f" {phrase} ", ("base", label, len(phrase)))
    for phrase, label in NOTICES.items():
        if f" {phrase} " not in a:
            a.add_word(f" {phrase} ", ("notice", label, len(phrase)))
    a.add_word(f" {TAG} ", ("tag", "", len(TAG)))
    a.make_automaton()
    return a


def scan(text: str) -> dict:
    """Everything found in one text: places, labels, expressions, score."""
    words = words_of(text)
    # Latin-1 gives one character a byte, so places are those of the bytes
    joined = f" {b' '.join(words).decode('latin-1')} "
    places, base, more, tagged, notices, read_to, seen = [], set(), set(), False, 0, 0, 0
    for end, (kind, label, length) in _automaton().iter(joined):
        start = end - length  # of the phrase's first character
        if kind == "base":
            if start >= read_to:
                seen += joined.count(" ", read_to, start)
                read_to = start
                places.append(seen - 1)
            else:
                places.append(joined.count(" ", 0, start) - 1)
            base.add(label)
        elif kind == "notice":
            more.add(label)
            notices += 1
        else:
            tagged = True
    expressions = []
    if tagged:
        expressions = [e for m in _AFTER_TAG.finditer(text) if (e := parse_expression(m[1]))]
    choices = [alternatives(e) for e in expressions]
    for e in expressions:
        more |= labels_of(e)
    # independent pieces of evidence, each with a chance to be wrong
    doubt = 0.1 ** len(places) * 0.3**notices
    for c in choices:
        doubt *= 0.05 if c else 0.5
    return {
        "n_words": len(words), "places": sorted(places), "base": sorted(base), "labels": sorted(base | more), "expressions": expressions,
        "alternatives": sorted({"+".join(sorted(x)) for c in choices for x in c}), "score": 1.0 - doubt,
    }


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Return (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, expressions, alternatives, score).

    One row per document, in no shuffle.  A null or empty text has no words, no
    labels ("") and score 0; first_word and last_word are null without a base
    place.  Rows that repeat give repeated rows; a null doc_id stays null; other
    columns are ignored.  ``expressions`` lists the tagged licence expressions
    in postfix order, ``alternatives`` the smallest sets of labels (joined by +)
    that satisfy one of them; ``evaluate`` tells whether given labels do.  The
    score is 1 less the product of the doubts that places, notices and
    expressions leave.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([x["n_words"] for x in found], pa.int64()),
                    pa.array([len(x["places"]) for x in found], pa.int64()),
                    pa.array([x["places"][0] if x["places"] else None for x in found], pa.int64()),
                    pa.array([x["places"][-1] if x["places"] else None for x in found], pa.int64()),
                    pa.array([",".join(x["base"]) for x in found], pa.string()),
                    pa.array([",".join(x["labels"]) for x in found], pa.string()),
                    pa.array([[" ".join(e) for e in x["expressions"]] for x in found], pa.list_(pa.string())),
                    pa.array([x["alternatives"] for x in found], pa.list_(pa.string())),
                    pa.array([x["score"] for x in found], pa.float64()),
                ],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "expressions", "alternatives", "score"],
            )

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(
        run,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, expressions array<string>, alternatives array<string>, score double",
    )
