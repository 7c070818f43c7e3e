"""License scans 7: notices and identifier tags by Aho-Corasick, expressions by shunting-yard.

One automaton holds the notice phrases and the identifier tag, over words with A-Z
lower-cased.  Behind a tag that is written as one (``SPDX-License-Identifier:``, any case)
the rest of the line is read as a licence expression; a shunting-yard parser brings
``or``, ``and`` and ``with`` into postfix order and evaluates it.  The phrases are a short
fixed list, so the automaton is built in each worker and nothing is broadcast.

A name counts if it has the shape of an identifier: a known short name (``MIT``), a name
with a version or number of clauses behind a hyphen (``GPL-2.0-only``, ``BSD-3-Clause``), or
``LicenseRef-`` and a name.  The expression must reach the end of the line, but for a sign
that closes a comment; else there is no label, since that line is prose.

``score`` tells how freely the text may be used, by ``FREEDOM``: ``and`` takes the
lowest, ``or`` the highest, ``with`` adds half of what is missing, several notices
count as ``and``; 0 if nothing was found.

Defined cases: a null text is empty; a malformed expression (unbalanced, an operator
without operands, an exception that isn't one name) gives no label; unknown names of the
right shape become labels in lower case with freedom 0.5; ties can't arise, labels are
sorted; repeated rows are scanned one by one; a very long text is scanned in one piece, in
memory in proportion to it; other columns are ignored, whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import text as t
from .decontamination import normal

#: The base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Further notices of this method.
NOTICES = {
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license version 2 1": "lgpl-2.1",
    "gnu lesser general public license version 3": "lgpl-3",
    "gnu affero general public license version 3": "agpl-3",
    "mozilla public license version 2": "mpl-2",
    "redistribution and use in source and binary forms": "bsd",
    "permission to use copy modify and or distribute this software": "isc",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "the mit license": "mit",
    "apache license 2": "apache-2",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by 4": "cc-by",
    "cc0 1": "cc0",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "released into the public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}
TAG = "spdx license identifier"

#: How freely text under a label may be used, 0 to 1.
FREEDOM = {
    "mit": 1.0, "bsd": 1.0, "isc": 1.0, "cc0": 1.0, "public-domain": 1.0, "apache-2": 0.95, "cc-by": 0.9, "mpl-2": 0.7,
    "cc-by-sa": 0.6, "lgpl-2.1": 0.6, "lgpl-3": 0.6, "gpl-2": 0.4, "gpl-3": 0.4, "agpl-3": 0.3, "cc-by-nd": 0.3,
    "cc-by-nc": 0.2, "all-rights-reserved": 0.05,
}

SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, expressions array<string>"
)

_TOKEN = re.compile(r"[ \t]*([()]|[A-Za-z0-9.+\-]+)")
_TAG = re.compile(r"spdx-license-identifier[ \t]*:", re.I)
#: What may stand behind an expression: signs that close a comment.
_END = re.compile(r"[ \t\r]*(?:\*+/|--+>|\*\)|#\}|%>|[\"'`]+[,;]?)?[ \t\r]*\Z")
_SHAPE = re.compile(r"LicenseRef-[A-Za-z0-9.\-]+|[A-Za-z][A-Za-z0-9.]*(?:-[A-Za-z0-9.]+)*-v?[0-9][A-Za-z0-9.]*(?:-[A-Za-z0-9.]+)*\+?", re.I)
#: Identifiers without a number.
SHORT = {"mit", "mit-0", "isc", "0bsd", "zlib", "unlicense", "wtfpl", "postgresql", "ncsa", "x11", "curl", "json", "ruby", "vim", "beerware", "openssl", "cc0", "none", "noassertion"}
_BINDS = {"or": 1, "and": 2, "with": 3}


def label(name: str) -> str:
    """Short label of a licence identifier."""
    name = re.sub(r"(-only|-or-later|\+)$", "", name.lower())
    if name.startswith("cc-by") or name.startswith(("bsd-", "cc0")):
        return re.sub(r"^(bsd|cc0|cc-by(?:-nc|-sa|-nd)*).*$", r"\1", name)
    return re.sub(r"-(\d+)\.0$", r"-\1", name)


def expression_tokens(line: str) -> list[str] | None:
    """Tokens of a line that is an expression and nothing else, None of any other line."""
    out: list[str] = []
    depth, at, operand = 0, 0, True
    while m := _TOKEN.match(line, at):
        token, low = m[1], m[1].lower()
        if operand and low not in _BINDS and token != ")":
            # an exception is one name, so no bracket opens behind ``with``
            if token == "(" and out and out[-1] == "with":
                return None
            if token != "(" and not (low in SHORT or _SHAPE.fullmatch(token) or (out and out[-1] == "with")):
                return None
            depth += token == "("
            operand = token == "("
        elif not operand and (low in _BINDS or token == ")" and depth):
            depth -= token == ")"
            operand = token != ")"
        else:
            break
        out.append(low if low in _BINDS else token)
        at = m.end()
    return out if out and not operand and not depth and _END.match(line, at) else None


def postfix(tokens: list[str]) -> list[str] | None:
    """Shunting-yard: postfix order of an expression, None if it is malformed."""
    out: list[str] = []
    held: list[str] = []
    for x in tokens:
        if x in _BINDS:
            while held and held[-1] != "(" and _BINDS[held[-1]] >= _BINDS[x]:
                out.append(held.pop())
            held.append(x)
        elif x == "(":
            held.append(x)
        elif x == ")":
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                return None
            held.pop()
        else:
            out.append(x)
    while held:
        if held[-1] == "(":
            return None
        out.append(held.pop())
    return out


def evaluate(tokens: list[str]) -> tuple[set[str], float] | None:
    """Labels and freedom of an expression, None if it is malformed or empty."""
    stack: list[tuple[set[str], float, str | None]] = []
    for x in postfix(tokens) or []:
        if x not in _BINDS:
            name = label(x)
            stack.append(({name}, FREEDOM.get(name, 0.5), name))
            continue
        if len(stack) < 2:
            return None
        (b, fb, one), (a, fa, _) = stack.pop(), stack.pop()
        if x == "with":
            if one is None:
                return None
            stack.append((a, fa + (1 - fa) / 2, None))
        else:
            stack.append((a | b, min(fa, fb) if x == "and" else max(fa, fb), None))
    return stack[0][:2] if len(stack) == 1 else None


def _automaton():
    import ahocorasick

    out = ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES, TAG}:
        out.add_word(f" {phrase} ", phrase)
    out.make_automaton()
    return out


def scan(text: str | None) -> tuple:
    """One row of the result, without the id."""
    machine = t.held("notices", _automaton)
    words = normal(text)
    joined = f" {b' '.join(words).decode('latin-1')} "
    found = list(machine.iter(joined))
    if not found:
        return len(words), 0, None, None, "", "", 0.0, []
    ends = np.cumsum([len(w) + 1 for w in words])
    base, base_labels, freedoms, names, tags = [], set(), [], set(), []
    for at, phrase in found:
        last = int(np.searchsorted(ends, at)) + 1
        if phrase in BASE:
            base.append(last - phrase.count(" ") - 1)
            base_labels.add(BASE[phrase])
        if phrase == TAG:
            tags.append(last)
        else:
            names.add(name := BASE.get(phrase) or NOTICES[phrase])
            freedoms.append(FREEDOM[name])
    expressions = []
    if tags:
        spans = t.Tokens(pa.array([text]), lower=True, spaced=False)
        raw = text.encode(errors="surrogatepass")
        for last in tags:
            begin = int(spans.start[last - 3])
            end = raw.find(b"\n", begin)
            line = raw[begin : end if end >= 0 else len(raw)].decode(errors="ignore")
            tag = _TAG.match(line)
            tokens = expression_tokens(line[tag.end() :]) if tag else None
            if tokens and (value := evaluate(tokens)):
                names |= value[0]
                freedoms.append(value[1])
                expressions.append(" ".join(tokens))
    return (
        len(words), len(base), min(base, default=None), max(base, default=None), ",".join(sorted(base_labels)),
        ",".join(sorted(names)), float(min(freedoms, default=0.0)), expressions,
    )


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.string())]
    for part in t.pieces(batches):
        cols = list(zip(*map(scan, part.column(1).to_pylist()), strict=True))
        yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with places, labels and evaluated expressions; no shuffle."""
    return t.text_frame(docs, id_col, text_col).mapInArrow(t.holding(_scan), SCHEMA)


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("expressions")
