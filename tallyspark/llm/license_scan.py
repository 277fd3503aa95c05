"""Licence scan: an Aho-Corasick automaton finds identifier tags and notice phrases; a shunting-yard parser evaluates the licence expressions behind the tags.

A scan is a map over documents: no shuffle, and a task holds one Arrow batch and one document's words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# The base phrases and their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Further notice phrases, as words, and the licence each one announces.
NOTICE_PHRASES = {
    "apache license": "apache-2.0",
    "mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license": "mpl-2.0",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "eclipse public license": "epl-2.0",
    "creative commons": "cc",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0-1.0",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "public domain": "public-domain",
    "no rights reserved": "public-domain",
    "copyright": "copyright",
}
TAG_PHRASE = "spdx license identifier"

# How far a licence family restricts reuse, from 0 (free) to 1 (none allowed).
RESTRICTION = {
    "public-domain": 0.0, "cc0": 0.0, "unlicense": 0.0, "0bsd": 0.05, "mit": 0.1, "bsd": 0.1, "isc": 0.1, "zlib": 0.1, "apache": 0.1,
    "cc-by": 0.2, "cc": 0.3, "mpl": 0.4, "epl": 0.4, "lgpl": 0.5, "cc-by-sa": 0.5, "gpl": 0.7, "agpl": 0.8, "cc-by-nd": 0.9, "cc-by-nc": 0.9, "copyright": 0.9, "reserved": 1.0,
}
UNKNOWN_RESTRICTION = 0.6

_SEPARATORS = bytes(range(0x30)) + bytes(range(0x3A, 0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x80))
#: A-Z become a-z, and every byte that isn't part of a word becomes a blank; bytes of other scripts stay.
_TO_WORDS = bytes.maketrans(bytes(range(0x41, 0x5B)) + _SEPARATORS, bytes(range(0x61, 0x7B)) + b" " * len(_SEPARATORS))
_TAG = re.compile(r"SPDX-License-Identifier\s*:\s*([^\r\n]*)", re.IGNORECASE)
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9][A-Za-z0-9.+-]*")
_RANK = {"or": 1, "and": 2, "with": 3}

SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, expressions array<string>, score double"


def restriction(licence: str) -> float:
    """Of one licence identifier: that of its longest known family name."""
    name = licence.lower().rstrip("+")
    known = [k for k in RESTRICTION if name == k or name.startswith(k + "-")]
    return RESTRICTION[max(known, key=len)] if known else UNKNOWN_RESTRICTION


def parse_expression(text: str) -> list[str] | None:
    """The expression at the start of ``text`` in postfix order (shunting yard), or None if there is none.

    ``with`` binds closest, then ``and``, then ``or``; the expression ends where an operand or operator is out of place, as in prose
    that follows a tag. An unclosed bracket is closed at the end, a stray closing one ends the expression.
    """
    out: list[str] = []
    held: list[str] = []
    operand_next, good = True, 0
    for token in _TOKEN.findall(text):
        word = token.lower()
        if token == "(":
            if not operand_next:
                break
            held.append(token)
        elif token == ")":
            if operand_next or "(" not in held:
                break
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
        elif word in _RANK:
            if operand_next:
                break
            while held and held[-1] != "(" and _RANK[held[-1]] >= _RANK[word]:
                out.append(held.pop())
            held.append(word)
            operand_next = True
        else:
            if not operand_next:
                break
            out.append(word.rstrip("."))
            operand_next = False
            good += 1
    if not good:
        return None
    if operand_next:  # an operator without its right side
        while held and held[-1] == "(":
            held.pop()
        if held:
            held.pop()
    while held:
        if (top := held.pop()) != "(":
            out.append(top)
    return out


def evaluate(postfix: list[str]) -> tuple[float, list[str]]:
    """Restriction and licences of a postfix expression: ``or`` leaves the freer choice, ``and`` binds to both, an exception halves what it modifies."""
    stack: list[tuple[float, list[str]]] = []
    for token in postfix:
        if token in _RANK and len(stack) >= 2:
            (b, right), (a, left) = stack.pop(), stack.pop()
            stack.append((min(a, b), left + right) if token == "or" else (max(a, b), left + right) if token == "and" else (a / 2, [f"{left[-1]} with {right[0]}"]))
        elif token not in _RANK:
            stack.append((restriction(token), [token]))
    return (max(x for x, _ in stack), [y for _, names in stack for y in names]) if stack else (0.0, [])


def automaton() -> ahocorasick.Automaton:
    """Over words that stand between single blanks."""
    found: dict[str, list] = {}
    for phrase, label in BASE_PHRASES.items():
        found.setdefault(phrase, []).append(("base", label))
    for phrase, label in NOTICE_PHRASES.items():
        found.setdefault(phrase, []).append(("notice", label))
    found.setdefault(TAG_PHRASE, []).append(("tag", ""))
    machine = ahocorasick.Automaton()
    for phrase, kinds in found.items():
        machine.add_word(f" {phrase} ", (len(phrase) + 1, kinds))
    machine.make_automaton()
    return machine


def scan_text(raw: bytes, machine: ahocorasick.Automaton) -> tuple:
    """One document's row of SCHEMA."""
    words = raw.translate(_TO_WORDS).split()
    base: set[str] = set()
    labels: set[str] = set()
    expressions: list[str] = []
    n_base, first, last, tagged = 0, None, None, False
    at = seen = 0
    line = f" {b' '.join(words).decode('utf-8', 'replace')} " if words else ""
    for end, (back, kinds) in machine.iter(line):
        start = end - back
        if start >= at:
            seen, at = seen + line.count(" ", at, start), start
        # a longer phrase that began earlier may end later
        place = seen if start == at else seen - line.count(" ", start, at)
        for kind, label in kinds:
            if kind == "base":
                n_base += 1
                first = place if first is None else min(first, place)
                last = place if last is None else max(last, place)
                base.add(label)
            elif kind == "notice":
                labels.add(label)
            else:
                tagged = True
    score = max((restriction(x) for x in base | labels), default=0.0)
    if tagged:
        for rest in _TAG.findall(raw.decode("utf-8", "replace")):
            if postfix := parse_expression(rest):
                cost, names = evaluate(postfix)
                score = max(score, cost)
                labels.update(names)
                expressions.append(" ".join(postfix))
    return len(words), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(base | labels)), expressions, score


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Licence findings of every document.

    Returns the columns named in ``keep`` (all but the text where it is None; a name that SCHEMA also has is then left out) and SCHEMA: numbers
    of words and of base phrases with their first and last word, base and all labels, the parsed expressions in postfix order and the
    restriction score. A null or empty text has no words, no labels and score 0; repeated rows each get their row; an empty table gives none.
    Overlapping phrases all count.
    """
    own = {x.split()[0] for x in SCHEMA.split(", ")}
    kept = [c for c in docs.columns if c != text and c not in own] if keep is None else keep
    # the kept columns travel as one, so their names can't clash with any other
    source = docs.select(F.struct(*kept).alias("row") if kept else F.lit(None).alias("row"), docs[text].cast("binary").alias("text"))
    kind = source.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        for batch in batches:
            row, raw = batch.columns
            rows = [scan_text(x.as_py() or b"", machine) for x in raw]
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.list_(pa.string()), pa.float64()]
            cols = [pa.array(x, t) for x, t in zip(zip(*rows), types, strict=True)] if rows else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([row, *cols], names=["row", *(x.split()[0] for x in SCHEMA.split(", "))])

    found = source.mapInArrow(run, f"row {kind}, {SCHEMA}")
    return found.select(*[F.col("row")[c].alias(c) for c in kept], *(x.split()[0] for x in SCHEMA.split(", ")))
