"""Licence scan: an Aho-Corasick automaton finds identifier tags and notice phrases, a shunting-yard parser reads the
expression after a tag.

A text is lower-cased (A-Z) and cut into words of digits, letters and characters beyond ASCII. Notice phrases are matched
as consecutive words, all places, overlapping ones too. A tag is looked for in the lower-cased text itself; the
rest of its line, up to the next tag, is parsed as an expression of identifiers, ``and``, ``or``, ``with`` and parentheses,
where ``with`` binds tighter than ``and`` and ``and`` tighter than ``or``. The parsed expression is evaluated to its identifiers and to
whether it can be met with permissive licences alone (``or``: one side suffices; ``and``: both are needed; an exception
only ever adds permissions).

Defined cases: NULL is the empty text (no words, score 0); an expression that cannot be parsed adds the score of its tag
but no label; repeated rows give repeated results; other columns are ignored. Nothing is shuffled, one text at a time is held.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import LOWER, LOWER_WORDS

# The base phrases with their labels, further notices, tags and licence families.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
NOTICES = {
    "gnu general public license version 3": "gpl-3",
    "gnu general public license version 2": "gpl-2",
    "gnu lesser general public license": "lgpl",
    "mozilla public license version 2": "mpl-2",
    "creative commons attribution sharealike": "cc-by-sa",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
}
TAGS = ("spdx-license-identifier:", "license-expression:")
PERMISSIVE = ("mit", "apache-2", "apache-2.0", "bsd", "bsd-2-clause", "bsd-3-clause", "isc", "zlib", "0bsd", "unlicense", "cc0-1.0", "cc-by-4.0")

PRECEDENCE = {"or": 1, "and": 2, "with": 3}
TOKEN = re.compile(rb"\(|\)|[a-z0-9][a-z0-9.+-]*")
RESULT = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
          "score double, permissive boolean")


def shunt(tokens: Iterable[str]) -> list[str] | None:
    """Reverse Polish form of the longest well-formed expression at the start; None if there is none."""
    out: list[str] = []
    held: list[str] = []
    operand = True
    best: tuple[int, list[str]] | None = None
    for token in tokens:
        if operand and token == "(":
            held.append(token)
        elif operand and token not in PRECEDENCE and token != ")":
            out.append(token)
            operand = False
        elif not operand and token in PRECEDENCE:
            while held and held[-1] != "(" and PRECEDENCE[held[-1]] >= PRECEDENCE[token]:
                out.append(held.pop())
            held.append(token)
            operand = True
        elif not operand and token == ")" and "(" in held:
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
        else:
            break
        if not operand and "(" not in held:
            # Without parentheses at most one operator of each precedence is held.
            best = len(out), held[::-1]
    return out[:best[0]] + best[1] if best else None


def evaluate(polish: list[str]) -> tuple[set[str], bool]:
    """(identifiers, whether permissive licences alone can meet it) of a reverse Polish expression."""
    stack: list[tuple[set[str], bool]] = []
    for token in polish:
        if token not in PRECEDENCE:
            stack.append(({token}, token in PERMISSIVE))
            continue
        (right, r), (left, v) = stack.pop(), stack.pop()
        if token == "with":
            stack.append((left, v))
        else:
            if len(left) < len(right):
                left, right = right, left
            left |= right
            stack.append((left, (v or r) if token == "or" else (v and r)))
    return stack[0]


def automaton(phrases) -> ahocorasick.Automaton:
    """Over bytes read as Latin-1: patterns are ASCII, so each byte of the text is one character."""
    made = ahocorasick.Automaton()
    for phrase in phrases:
        made.add_word(phrase, phrase)
    made.make_automaton()
    return made


def scan_text(text: bytes, notices: ahocorasick.Automaton, tags: ahocorasick.Automaton) -> tuple:
    words = text.translate(LOWER).translate(LOWER_WORDS).split()
    line = (b" " + b" ".join(words) + b" ").decode("latin-1")
    places: list[int] = []
    base: set[str] = set()
    labels: set[str] = set()
    score = 0.0
    verdicts: list[bool] = []
    hits = [(end - len(phrase) + 1, phrase.strip()) for end, phrase in notices.iter(line)]
    if hits:
        blanks = [i for i, c in enumerate(line) if c == " "]
        for start, phrase in hits:
            if phrase in BASE:
                places.append(bisect_right(blanks, start) - 1)
                base.add(BASE[phrase])
            labels.add(BASE.get(phrase) or NOTICES[phrase])
        score = 1 - 0.5 / len(hits)
        verdicts += [x in PERMISSIVE for x in sorted(labels)]
    low = text.translate(LOWER)
    tagged = [(end - len(tag) + 1, end + 1) for end, tag in tags.iter(low.decode("latin-1"))]
    for (_, begin), (stop, _) in zip(tagged, [*tagged[1:], (len(low), 0)]):
        line_end = low.find(b"\n", begin, stop)
        polish = shunt(m[0].decode() for m in TOKEN.finditer(low, begin, stop if line_end < 0 else line_end))
        score = max(score, 0.5)
        if polish:
            found, free = evaluate(polish)
            labels |= found
            verdicts.append(free)
            score = 1.0
    join = lambda x: ",".join(sorted(x))
    return (len(words), len(places), min(places, default=None), max(places, default=None), join(base), join(labels | base),
            score, all(verdicts) if verdicts else None)


def scan(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts and places of base phrases, all labels, a confidence, and whether everything found
    can be met with permissive licences (NULL if nothing was found)."""
    names = [c.split()[0] for c in RESULT.split(", ")]
    kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        notices, tags = automaton(f" {p} " for p in (*BASE, *NOTICES)), automaton(TAGS)
        for batch in batches:
            rows = [scan_text(t.as_py(), notices, tags) for t in batch.column(1)]
            columns = list(zip(*rows)) or [()] * 8
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds[1:])]], names=names)

    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, RESULT)
