"""Licence notices in documents: one Aho-Corasick pass for tags and phrases, and a
shunting-yard parser for the expressions that identifier tags carry."""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import partial

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from parecer.llm.storage import small_batches
from parecer.llm.words import PLAIN_WORDS, batches_of

#: Phrases, as words with one blank between, and the label each one gives.
BASE_PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
NOTICE_PHRASES = {
    "apache license version 2 0": "apache-2.0",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "isc license": "isc",
    "mozilla public license": "mpl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "cc0": "cc0",
    "public domain": "public-domain",
    "do not distribute": "restricted",
}
TAG = "spdx license identifier"
#: How freely a text under a label may be used, from 0 to 1. Identifiers are looked up by
#: their longest listed beginning.
FREEDOM = {
    "0bsd": 1.0, "agpl": 0.3, "apache": 0.9, "bsd": 0.9, "cc-by": 0.8, "cc-by-nc": 0.2,
    "cc-by-nd": 0.2, "cc-by-sa": 0.5, "cc0": 1.0, "gpl": 0.4, "isc": 0.9, "lgpl": 0.5,
    "mit": 0.9, "mpl": 0.6, "public-domain": 1.0, "reserved": 0.0, "restricted": 0.0,
    "unlicense": 1.0,
}
#: Of a text without a notice, and of a label that is not listed.
UNKNOWN = 0.5
#: Binding strength of the operators of a licence expression.
STRENGTH = {"or": 1, "and": 2, "with": 3}

_EXPRESSION = re.compile(r"spdx-license-identifier:[ \t]*([^\r\n]*)")
_TOKEN = re.compile(r"[()]|[a-z0-9.+:-]+")
_PLAIN = bytes(
    (c + 32 if 65 <= c <= 90 else c) if PLAIN_WORDS[c + 32 if 65 <= c <= 90 else c] else 32
    for c in range(256)
)


def to_postfix(expression: str) -> list[str]:
    """The expression's identifiers and operators in the order of evaluation.

    What is left of a broken expression is read as far as it goes: unmatched parentheses are
    ignored, and so are words after a complete expression that no operator joins to it.
    """
    out: list[str] = []
    stack: list[str] = []
    after_operand = False
    for token in _TOKEN.findall(expression.lower()):
        if token in STRENGTH:
            if not after_operand:
                continue
            while stack and stack[-1] != "(" and STRENGTH[stack[-1]] >= STRENGTH[token]:
                out.append(stack.pop())
            stack.append(token)
            after_operand = False
        elif token == "(":
            if after_operand:
                break
            stack.append(token)
        elif token == ")":
            if "(" in stack and after_operand:
                while stack[-1] != "(":
                    out.append(stack.pop())
                stack.pop()
        else:
            if after_operand:
                break
            out.append(token)
            after_operand = True
    if not after_operand and stack and stack[-1] in STRENGTH:
        stack.pop()
    out += [t for t in reversed(stack) if t != "("]
    return out


def freedom(label: str, known: Mapping[str, float] = FREEDOM) -> float:
    best = max((k for k in known if label.startswith(k)), key=len, default=None)
    return known[best] if best else UNKNOWN


def evaluate(postfix: list[str]) -> float:
    """A choice is as free as its freest licence, a conjunction as its strictest; an
    exception adds some freedom to its licence."""
    stack: list[float] = []
    for token in postfix:
        if token in STRENGTH and len(stack) < 2:
            continue
        if token == "or":
            b, a = stack.pop(), stack.pop()
            stack.append(max(a, b))
        elif token == "and":
            b, a = stack.pop(), stack.pop()
            stack.append(min(a, b))
        elif token == "with":
            stack.pop()
            stack.append(min(1.0, stack.pop() + 0.1))
        else:
            stack.append(freedom(token))
    return stack[-1] if stack else UNKNOWN


def automaton(phrases: Mapping[str, str]) -> ahocorasick.Automaton:
    """Finds phrases in words joined by blanks; a blank at either end keeps words whole."""
    out = ahocorasick.Automaton()
    for phrase, label in phrases.items():
        out.add_word(f" {phrase} ", (phrase, label))
    out.make_automaton()
    return out


def scan_text(data: bytes, finder, base: Mapping[str, str]) -> tuple:
    words = data.translate(_PLAIN).split()
    text = f" {b' '.join(words).decode('latin-1')} "
    starts, base_labels, labels, values = [], set(), set(), []
    at = seen = 0
    tagged = False
    # Matches come by their ends; their starts are as good as sorted, so blanks are counted on.
    for start, phrase, label in sorted(
        (end - len(phrase) - 1, phrase, label) for end, (phrase, label) in finder.iter(text)
    ):
        seen += text.count(" ", at, start)
        at = start
        if phrase in base:
            starts.append(seen)
            base_labels.add(label)
        tagged |= phrase == TAG
        if phrase != TAG:
            labels.add(label)
    expressions = []
    if tagged:
        for found in _EXPRESSION.findall(data.decode("utf-8", "replace").lower()):
            postfix = to_postfix(found)
            if postfix:
                expressions.append(" ".join(postfix))
                labels.update(t for t in postfix if t not in STRENGTH)
                values.append(evaluate(postfix))
    if not values:
        values = [freedom(x) for x in labels]
    return (
        len(words), len(starts), min(starts, default=None), max(starts, default=None),
        ",".join(sorted(base_labels)), ",".join(sorted(labels)),
        min(values, default=UNKNOWN), expressions,
    )


_TYPES = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.string())]
_NAMES = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score",
          "expressions"]


def _scan(batches, base: Mapping[str, str], phrases: Mapping[str, str]):
    finder = automaton(phrases)
    for batch in batches:
        raw, at = batches_of(batch)
        rows = [
            scan_text(raw[at[t]:at[t + 1]].tobytes(), finder, base) for t in range(len(at) - 1)
        ]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), _TYPES))]
            if rows else [batch.column(0), *(pa.array([], k) for k in _TYPES)],
            names=["doc_id", *_NAMES],
        )


def licenses(
    documents: DataFrame,
    base: Mapping[str, str] = BASE_PHRASES,
    notices: Mapping[str, str] = NOTICE_PHRASES,
) -> DataFrame:
    """One row per row of ``documents``: doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score, expressions.

    ``score`` is how freely the text may be used: that of the strictest expression of an
    identifier tag, else of the strictest label, else ``UNKNOWN``. ``expressions`` are in
    postfix order. Phrases match whole words wherever they stand, overlaps included. Empty
    and null texts have no words, no labels and the unknown score; first and last word are
    null without a base phrase. Repeated rows give repeated results, doc_id may be null, and
    no other column is read. An empty table gives none. Nothing is shuffled.
    """
    small_batches(documents.sparkSession)
    kind = documents.schema["doc_id"].dataType.simpleString()
    phrases = {**notices, **base, TAG: TAG}
    return documents.select("doc_id", "text").mapInArrow(
        partial(_scan, base=dict(base), phrases=phrases),
        f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, "
        "base_labels string, labels string, score double, expressions array<string>",
    )
