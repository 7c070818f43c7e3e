"""Secret scans 11: assignments, access keys, hex runs, and windows of high entropy.

The base rules are patterns.  The method adds spans of its own: for each character class
(``CLASSES``) the maximal runs of its characters are candidate strings; a window slides
over each, its character counts change by one in and one out, and the sum of c log2 c is
kept in whole numbers, so the entropy of every window costs constant time and has no
rounding drift.  Windows of at least the class's bits that hold letters and digits are
joined to spans.  Spans that match the allow list (public things: links, mail addresses,
digests, UUIDs, paths, placeholders, alphabets) are suppressed, and so are spans inside a
base span or a span of an earlier class, which say nothing new.

Letters of any case in an assignment's name are ASCII letters.  Spans are of whole matches
(an assignment with its name and opening quote), in code points of the text.

Defined cases: a null text is empty and has no spans; spans that start together are
ordered by kind, as listed in ``KINDS``; repeated rows are scanned one by one; a very long
text is scanned whole, in memory in proportion to it; other columns are ignored, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import text as t

#: The base patterns with the least length of what they find.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
HEX = b"0123456789abcdef"
#: What any assignment holds, in lower case: texts without them aren't read by the pattern.
NAMES = (b"passw", b"secret", b"token", b"api")

WINDOW = 20


class CharClass(NamedTuple):
    kind: str
    characters: bytes
    bits: float


_LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_DIGITS = b"0123456789"
#: Bits that a window of random characters nearly always has and one of words or numbers doesn't.
CLASSES = (
    CharClass("entropy_hex", _DIGITS + b"ABCDEFabcdef", 2.9),
    CharClass("entropy_base64", _DIGITS + _LETTERS + b"+/=", 3.75),
    CharClass("entropy_token", _DIGITS + _LETTERS + b"_-", 3.75),
)
KINDS = ("assign", "access", "hex", *(c.kind for c in CLASSES))
_RANK = {kind: i for i, kind in enumerate(KINDS)}

#: What makes a span public: the 24 characters before it, a part of it, or the whole run that it lies in.
ALLOW_BEFORE = (r"://\S*$", r"\bwww\.\S*$", r"@[\w.-]*$", r"(?i)\b(?:sha-?(?:1|256|384|512)|md5|commit|digest|checksum|etag|revision)\W{0,3}$", r"(?i)\bdata:\w+/[\w+.-]+;base64,$")
ALLOW_FOUND = (r"(?i)example|sample|dummy|placeholder|changeme|redacted|your[_-]?(?:key|token|secret|password)", r"(.)\1{5}", r"(?i)abcdefgh|01234567|12345678")
ALLOW_RUN = (r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", r"(?:[A-Za-z]+[_-])+[A-Za-z]*\d{0,4}", r"/?(?:[a-z0-9_-]+/){2,}[a-z0-9_-]*")
#: Letters and digits that a window needs.
LEAST_LETTERS = LEAST_DIGITS = 2
CONTEXT = 24

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long"
_SCALE = 1 << 32
_HAS_DIGIT, _HAS_LETTER = np.zeros(256, bool), np.zeros(256, bool)
_HAS_DIGIT[list(_DIGITS)] = _HAS_LETTER[list(_LETTERS)] = True


def _member(characters: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters)] = True
    return out


_HEX, _CLASS = _member(HEX), [_member(c.characters) for c in CLASSES]


def entropy_spans(run: bytes, bits: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """Union of the windows with enough letters and digits and at least so many bits a character."""
    weight = [0, *(round(n * math.log2(n) * _SCALE) for n in range(1, window + 1))]
    most = round(window * (math.log2(window) - bits) * _SCALE)
    counts, total, digits, letters = [0] * 256, 0, 0, 0
    out: list[tuple[int, int]] = []
    for i, c in enumerate(run):
        if i >= window:
            old = run[i - window]
            n = counts[old]
            total += weight[n - 1] - weight[n]
            counts[old] = n - 1
            digits -= int(_HAS_DIGIT[old])
            letters -= int(_HAS_LETTER[old])
        n = counts[c]
        total += weight[n + 1] - weight[n]
        counts[c] = n + 1
        digits += int(_HAS_DIGIT[c])
        letters += int(_HAS_LETTER[c])
        at = i + 1 - window
        if at >= 0 and total <= most and digits >= LEAST_DIGITS and letters >= LEAST_LETTERS:
            if out and at <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((at, i + 1))
    return out


class Scanner:
    """The rules with an allow list."""

    def __init__(self, before: tuple[str, ...] = ALLOW_BEFORE, found: tuple[str, ...] = ALLOW_FOUND, run: tuple[str, ...] = ALLOW_RUN) -> None:
        self.before, self.found, self.run = ([re.compile(x.encode()) for x in patterns] for patterns in (before, found, run))

    def spans(self, raw: bytes, row: int, start: int, end: int, bits: float) -> Iterator[tuple[int, int]]:
        """Spans of one run that aren't public; only its own row is looked at."""
        run = raw[start:end]
        found = entropy_spans(run, bits)
        if not found or any(x.fullmatch(run) for x in self.run):
            return
        for a, b in found:
            before = raw[max(row, start + a - CONTEXT) : start + a]
            if not any(x.search(before) for x in self.before) and not any(x.search(run, a, b) for x in self.found):
                yield start + a, start + b

    def entropy(self, raw: bytes, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, str]]:
        """row, byte span and kind of what the method finds."""
        out = []
        digits = np.r_[0, np.cumsum(_HAS_DIGIT[data])]
        for kind, member in zip(CLASSES, _CLASS, strict=True):
            starts, ends = t.runs(member, data, offsets, WINDOW)
            some = digits[ends] - digits[starts] >= LEAST_DIGITS
            rows = np.searchsorted(offsets, starts, "right") - 1
            for a, b, row in zip(starts[some].tolist(), ends[some].tolist(), rows[some].tolist(), strict=True):
                out += [(row, x, y, kind.kind) for x, y in self.spans(raw, int(offsets[row]), a, b, kind.bits)]
        return out

    def scan(self, column: pa.Array) -> dict[str, list]:
        """The figures of every row of a text column."""
        data, offsets = t.string_buffers(column)
        rows = len(offsets) - 1
        raw, low = data.tobytes(), t.LOWER[data].tobytes()
        place = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
        base: dict[int, list[tuple[int, int, str]]] = {}
        for row in _holding(low, offsets, NAMES) | _holding(raw, offsets, (b"AKIA",)):
            text = raw[offsets[row] : offsets[row + 1]].decode(errors="surrogatepass")
            found = [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
            found += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
            if found:
                base[row] = found
        starts, ends = t.runs(_HEX, data, offsets, MIN_HEX)
        for a, b, row in zip(starts, ends, np.searchsorted(offsets, starts, "right") - 1, strict=True):
            first = place[offsets[row]]
            base.setdefault(int(row), []).append((int(place[a] - first), int(place[b] - first), "hex"))
        more: dict[int, list[tuple[int, int, str]]] = {}
        for row, a, b, kind in self.entropy(raw, data, offsets):
            first = place[offsets[row]]
            more.setdefault(row, []).append((int(place[a] - first), int(place[b] - first), kind))
        nothing = hashlib.sha256(b"").hexdigest()
        out = {"n_assign": [0] * rows, "n_access": [0] * rows, "n_hex": [0] * rows, "base_sha256": [nothing] * rows, "spans": [""] * rows, "n_entropy": [0] * rows}
        for row in base.keys() | more.keys():
            found = sorted(base.get(row, ()), key=_order)
            new = _outside(more.get(row, ()), found)
            for kind in ("assign", "access", "hex"):
                out[f"n_{kind}"][row] = sum(x[2] == kind for x in found)
            out["base_sha256"][row] = hashlib.sha256(_joined(found).encode()).hexdigest()
            out["spans"][row] = _joined(sorted([*found, *new], key=_order))
            out["n_entropy"][row] = len(new)
        return out


def _order(span: tuple[int, int, str]) -> tuple[int, int, int]:
    return span[0], _RANK[span[2]], span[1]


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def _outside(spans: list[tuple[int, int, str]], base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans that lie in no base span and in no span of an earlier class.

    Both lists are swept by start; the furthest end so far tells whether a span is inside.
    """
    out = []
    swept = sorted([(a, -b, -1, None) for a, b, _ in base] + [(a, -b, _RANK[kind], kind) for a, b, kind in spans])
    reach = -1
    for a, minus_b, _, kind in swept:
        if kind is not None and -minus_b > reach:
            out.append((a, -minus_b, kind))
        reach = max(reach, -minus_b)
    return out


def _holding(raw: bytes, offsets: np.ndarray, needles: tuple[bytes, ...]) -> set[int]:
    """Rows that hold one of the needles."""
    out: set[int] = set()
    for needle in needles:
        at = raw.find(needle)
        while at >= 0:
            row = int(np.searchsorted(offsets, at, "right")) - 1
            if at + len(needle) <= offsets[row + 1]:
                out.add(row)
                at = raw.find(needle, int(offsets[row + 1]))
            else:
                at = raw.find(needle, at + 1)
    return out


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allow: tuple[tuple[str, ...], ...] = (ALLOW_BEFORE, ALLOW_FOUND, ALLOW_RUN)) -> DataFrame:
    """One row per document with its secrets; no shuffle.

    The allow lists are patterns for the text before a span, for a part of it, and for the whole run of characters.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(*allow)
        for part in t.pieces(batches):
            out = scanner.scan(part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, out.values())], ["doc_id", *out])

    return t.text_frame(docs, id_col, text_col).mapInArrow(t.task(run), SCHEMA)


def redacted(docs: DataFrame, mask: str = "[secret]", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with every found span replaced; overlapping spans become one mask.  All columns stay."""
    at = docs.schema.fieldNames().index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for part in t.pieces(batches, text_col):
            column = part.column(at)
            spans = scanner.scan(column)["spans"]
            texts = [_masked(x, s, mask) if s else x for x, s in zip(column.to_pylist(), spans, strict=True)]
            yield part.set_column(at, part.schema.field(at), pa.array(texts, column.type))

    return docs.mapInArrow(t.task(run), docs.schema)


def _masked(text: str, spans: str, mask: str) -> str:
    out, done = [], 0
    for span in spans.split(","):
        _, a, b = span.split(":")
        if int(a) >= done:
            out += [text[done : int(a)], mask]
        done = max(done, int(b))
    return "".join([*out, text[done:]])


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
