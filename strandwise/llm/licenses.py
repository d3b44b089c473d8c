"""Licence scans: Aho-Corasick over the words of whole texts, and a shunting-yard parser for licence expressions.

A word is a maximal run of bytes other than 0x00-0x2F, 0x3A-0x60 and 0x7B-0x7F, after A-Z are lower-cased. Phrases
match whole consecutive words. After an identifier tag and its colon (`SPDX-License-Identifier:`) the rest of the line is
read as an expression of licence names with `and`, `or`, `with` and brackets, as far as it goes: it ends with a name that
a full stop follows, before a name that follows a name, and where a bracket closes that was open before the tag. Its names
become labels.

score is how freely the evidence lets a text be used: each notice and each expression has a rating from 0 to 1, an
`or` takes the better and an `and` the worse of its sides, `with` takes its licence's rating halfway to 1, and a text
takes the worst of its evidence; 0 without any.

Defined results: a null or empty text has no words, no labels (an empty string) and score 0; a malformed expression
gives the label `malformed` and rating 0; repeated rows are scanned alike; a null doc_id is kept; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import pieces, runs, text_buffers

_FOLD = np.full(256, 32, np.uint8)
for _a in (range(0x30, 0x3A), range(0x61, 0x7B), range(0x80, 0x100)):
    _FOLD[list(_a)] = list(_a)
_FOLD[65:91] = np.arange(97, 123)

#: phrase: (label, base, rating)
PHRASES = {
    "cc by": ("cc-by", True, 0.7),
    "general public license": ("gpl", True, 0.3),
    "all rights reserved": ("reserved", True, 0.0),
    "mit license": ("mit", False, 1.0),
    "permission is hereby granted free of charge": ("mit", False, 1.0),
    "apache license": ("apache", False, 1.0),
    "bsd license": ("bsd", False, 1.0),
    "redistribution and use in source and binary forms": ("bsd", False, 1.0),
    "lesser general public license": ("lgpl", False, 0.5),
    "affero general public license": ("agpl", False, 0.2),
    "mozilla public license": ("mpl", False, 0.6),
    "eclipse public license": ("epl", False, 0.6),
    "isc license": ("isc", False, 1.0),
    "cc0": ("cc0", False, 1.0),
    "public domain": ("public-domain", False, 1.0),
    "cc by nc": ("cc-by-nc", False, 0.2),
    "cc by sa": ("cc-by-sa", False, 0.5),
    "cc by nd": ("cc-by-nd", False, 0.2),
    "creative commons attribution": ("cc", False, 0.7),
}
TAG = "spdx license identifier"
#: rating of a licence name by its prefix; the longest one counts
RATINGS = {
    "mit": 1.0, "apache": 1.0, "bsd": 1.0, "isc": 1.0, "cc0": 1.0, "unlicense": 1.0, "zlib": 1.0, "0bsd": 1.0, "bsl": 1.0,
    "lgpl": 0.5, "gpl": 0.3, "agpl": 0.2, "mpl": 0.6, "epl": 0.6, "cddl": 0.6,
    "cc-by": 0.7, "cc-by-sa": 0.5, "cc-by-nc": 0.2, "cc-by-nd": 0.2,
}
_TOKEN = re.compile(r"\(|\)|[a-z0-9][a-z0-9.:+-]*", re.I)
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}


def rating(name: str) -> float:
    best = max((p for p in RATINGS if name == p or name.startswith((p + "-", p + "+"))), key=len, default=None)
    return 0.5 if best is None else RATINGS[best]


def to_postfix(expression: str) -> list[str]:
    """Shunting-yard: the expression's names and operators in postfix order; ValueError if it is malformed."""
    out, ops, operand = [], [], False
    for token in _TOKEN.findall(expression):
        word = token.lower().rstrip(".:-") or token
        if word in _PRECEDENCE:
            if not operand:
                raise ValueError("an operator without a left side")
            while ops and ops[-1] != "(" and _PRECEDENCE[ops[-1]] >= _PRECEDENCE[word]:
                out.append(ops.pop())
            ops.append(word)
            operand = False
        elif word == "(":
            if operand:
                raise ValueError("a bracket after a name")
            ops.append(word)
        elif word == ")":
            if not operand:
                raise ValueError("an empty bracket")
            while ops and ops[-1] != "(":
                out.append(ops.pop())
            if not ops:
                raise ValueError("a closing bracket too many")
            ops.pop()
        else:
            if operand:
                break  # prose after the expression
            out.append(word)
            operand = True
            if token.endswith(".") and "(" not in ops:
                break
    if not operand or "(" in ops:
        raise ValueError("an unfinished expression")
    return out + ops[::-1]


def evaluate(expression: str) -> tuple[list[str], float]:
    """(licence names, rating) of an expression."""
    stack: list[tuple[list[str], float]] = []
    for token in to_postfix(expression):
        if token in _PRECEDENCE:
            b, a = stack.pop(), stack.pop()
            if token == "with":
                stack.append((a[0], (a[1] + 1) / 2))
            else:
                stack.append((a[0] + b[0], (max if token == "or" else min)(a[1], b[1])))
        else:
            stack.append(([token], rating(token)))
    return stack[0]


def inner(line: bytes, opened: int) -> bytes:
    """The line up to the bracket that closes one of those opened before."""
    depth = 0
    for i, c in enumerate(line if opened > 0 else b""):
        depth += (c == 0x28) - (c == 0x29)
        if depth < 0:
            return line[:i]
    return line


def build_automaton(phrases=PHRASES, tag: str = TAG) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase, (label, base, rate) in phrases.items():
        found.add_word(f" {phrase} ", (len(phrase) + 1, label, base, rate))
    if tag:
        found.add_word(f" {tag} ", (len(tag) + 1, None, False, 0.0))
    found.make_automaton()
    return found


def scan_texts(column: pa.Array, automaton: ahocorasick.Automaton) -> dict[str, list]:
    """Per text: n_words, places of base phrases, base labels, labels and rating."""
    data, offsets = text_buffers(column)
    n = len(offsets) - 1
    folded = _FOLD[data]
    starts, ends, first = runs(folded != 32, offsets)
    # words joined by one blank, a blank before the first word of each text
    lengths = ends - starts
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths + 1, out=at[1:])
    at += 1
    doc = np.searchsorted(offsets, starts, "right") - 1
    at[:-1] += 2 * doc  # "\n " between texts
    joined = np.full(int(at[-1]) + 2 * n + 2, 32, np.uint8)
    inside = folded != 32
    joined[np.repeat(at[:-1] - starts, lengths) + np.flatnonzero(inside)] = folded[inside]
    edges = np.flatnonzero(np.diff(first) > 0)
    joined[at[first[edges]] - 2] = 10
    out = {"n_words": np.diff(first), "n_base": np.zeros(n, np.int64), "first": [None] * n, "last": [None] * n, "base": [None] * n, "labels": [None] * n, "rate": [None] * n}
    for end, (back, label, base, rate) in automaton.iter(joined.tobytes().decode("latin-1")):
        w = int(np.searchsorted(at[:-1], end - back, "left"))
        d = int(doc[w])
        if label is None:
            stop = int(offsets[d + 1])
            line = bytes(data[ends[w + 2] : stop]).split(b"\n", 1)[0].lstrip(b" \t")
            if not line.startswith(b":"):  # the words, but not the tag
                continue
            try:
                ahead = bytes(data[offsets[d] : starts[w]]).rpartition(b"\n")[2]
                names, rate = evaluate(inner(line, ahead.count(b"(") - ahead.count(b")")).decode("utf-8", "replace"))
            except ValueError:
                names, rate = ["malformed"], 0.0
        else:
            names = [label]
        if out["labels"][d] is None:
            out["labels"][d], out["base"][d], out["rate"][d] = set(), set(), 1.0
        out["labels"][d] |= {x.replace(",", "") for x in names}
        out["rate"][d] = min(out["rate"][d], rate)
        if base:
            place = w - int(first[d])
            out["n_base"][d] += 1
            out["base"][d].add(label)
            out["first"][d] = place if out["first"][d] is None else min(place, out["first"][d])
            out["last"][d] = place if out["last"][d] is None else max(place, out["last"][d])
    return out


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"

    def run(batches):
        automaton = build_automaton()
        for batch in pieces(batches):
            r = scan_texts(batch.column("text"), automaton)
            join = lambda sets: pa.array([",".join(sorted(x)) if x else "" for x in sets], pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(r["n_words"], pa.int64()), pa.array(r["n_base"], pa.int64()), pa.array(r["first"], pa.int64()), pa.array(r["last"], pa.int64()), join(r["base"]), join(r["labels"]), pa.array([0.0 if x is None else x for x in r["rate"]], pa.float64())],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
