"""Benchmark decontamination 3: one Aho-Corasick automaton over benchmark passages.

Test items are normalised (A-Z lower-cased, words joined by one space).  A document is
normalised the same way and scanned once; a match is mapped back to words and to
character offsets of the original text.

A window is ten words.  The automaton holds every fifth run of ``SEED`` words of an item:
each window has one of these whole inside it.  Where one is met, it is grown to both
sides as long as document and item agree, and counts if that gives a whole window.
Keeping all windows themselves would take some ten times the memory.  An item of fewer
words is one key of its own.

The automaton is built in blocks of at most ``BLOCK_BYTES`` of benchmark text (about
fifty times that in memory), each one pass over the documents with one broadcast; with
more than one block the state between two passes is written, so a worker never holds
two automata.  A usual benchmark is one block.

Defined cases: null and empty texts have no words; an item without words gives no
window; an item without an id still marks words but isn't counted; repeated items count
by distinct id; ties can't arise; a very long text is scanned in one piece, in memory in
proportion to it; other columns are ignored by ``decontaminate`` and kept by
``drop_contaminated``, whatever their names; empty tables on either side give zero hits.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as t
from .overlap import kept_in

WINDOW = 10
#: Words of a key, and the step between two of them: a window of ten holds one whole.
SEED, STEP = 6, 5
#: Bytes of benchmark text that one automaton may hold.
BLOCK_BYTES = 1_000_000

_TABLE = bytes(c + 0x20 if 0x41 <= c <= 0x5A else c if t._ALNUM_WORD[c] else 0x20 for c in range(256))
SCHEMA = (
    "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
    "spans array<struct<start:long,end:long>>"
)


def normal(text: str | None) -> list[bytes]:
    """Words of a text after lower-casing."""
    return (text or "").encode(errors="surrogatepass").translate(_TABLE).split()


class Passages:
    """The automaton of some items; a key's value tells where it stands: (item, place, words to agree)."""

    def __init__(self, items: list[tuple[str | None, str | None]], size: int = WINDOW) -> None:
        import ahocorasick

        same: dict[bytes, bytes] = {}
        step = min(STEP, max(1, size - SEED + 1))
        seed = min(SEED, size)
        self.items = [(item, [same.setdefault(w, w) for w in words]) for item, text in dict.fromkeys(items) if (words := normal(text))]
        keys: dict[bytes, list[tuple[int, int, int]]] = {}
        for k, (_, words) in enumerate(self.items):
            if len(words) < size:
                keys.setdefault(b" ".join(words), []).append((k, 0, len(words)))
                continue
            for at in range(0, len(words) - seed + 1, step):
                keys.setdefault(b" ".join(words[at : at + seed]), []).append((k, at, size))
        self.machine = ahocorasick.Automaton()
        for key, value in keys.items():
            self.machine.add_word(f" {key.decode('latin-1')} ", (key.count(b" ") + 1, value))
        if keys:
            self.machine.make_automaton()

    def scan(self, text: str | None) -> tuple[int, np.ndarray, set]:
        """Words of a text, which of them are hit, and the items found, in one scan."""
        words = normal(text)
        hit, found = np.zeros(len(words), bool), set()
        if not words or not len(self.machine):
            return len(words), hit, found
        matches = list(self.machine.iter(f" {b' '.join(words).decode('latin-1')} "))
        if not matches:
            return len(words), hit, found
        ends = np.cumsum([len(w) + 1 for w in words])  # place of the space behind each word
        last = np.searchsorted(ends, np.array([e for e, _ in matches])) + 1
        grown: dict[tuple[int, int], int] = {}  # (item, shift between the two texts) -> end of what is compared
        for stop, (_, (n, places)) in zip(last.tolist(), matches, strict=True):
            for k, at, size in places:
                begin = stop - n
                if grown.get((k, begin - at), 0) >= stop:
                    continue
                name, own = self.items[k]
                end, a, b = stop, at, at + n
                while end < len(words) and b < len(own) and words[end] == own[b]:
                    end, b = end + 1, b + 1
                while begin and a and words[begin - 1] == own[a - 1]:
                    begin, a = begin - 1, a - 1
                grown[k, begin - a] = end
                if end - begin >= size:
                    hit[begin:end] = True
                    found.add(name)
        return len(words), hit, found


def _spans(text: str, hit: np.ndarray) -> list[dict]:
    """Runs of hit words as character offsets of the original text."""
    words = t.Tokens(pa.array([text]), lower=True, spaced=False)
    edge = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
    chars = np.r_[0, np.cumsum((words.data & 0xC0) != 0x80)]
    return [{"start": int(chars[words.start[a]]), "end": int(chars[words.end[b - 1]])} for a, b in zip(edge[::2], edge[1::2], strict=True)]


def _passages(block, key: str, size: int) -> Passages:
    return t.held(key, lambda: Passages(block.value, size))


def _scan_block(block, key: str, last: bool, size: int):
    """One block's pass.  ``state`` carries the hit words and items of earlier blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _passages(block, key, size)
        for part in t.pieces(batches):
            ids, texts = part.column(0), part.column(1).to_pylist()
            before = part.column(2).to_pylist() if part.num_columns > 2 else [None] * len(texts)
            rows = []
            for text, old in zip(texts, before, strict=True):
                n, hit, items = machine.scan(text)
                if old:
                    hit |= np.unpackbits(np.frombuffer(old["hit"], np.uint8), count=n).astype(bool)
                    items |= set(old["items"])
                rows.append((n, hit, items, text))
            if not last:
                state = [{"hit": np.packbits(h).tobytes(), "items": sorted(i, key=str)} for _, h, i, _ in rows]
                kind = pa.struct([("hit", pa.binary()), ("items", pa.list_(pa.string()))])
                yield pa.RecordBatch.from_arrays([ids, part.column(1), pa.array(state, kind)], ["doc_id", "text", "state"])
                continue
            out = []
            for n, hit, items, text in rows:
                named = sorted(x for x in items if x is not None)
                n_hit = int(hit.sum())
                out.append((n, n_hit, len(named), hashlib.sha256(",".join(named).encode()).hexdigest(), n_hit > 0, _spans(text, hit) if n_hit else []))
            cols = list(zip(*out, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"])

    return t.holding(run)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document: words, hit words, items found, and hit spans of the original."""
    state = "doc_id long, text string, state struct<hit:binary,items:array<string>>"

    def one(rows: DataFrame, block, key: str, last: bool) -> DataFrame:
        return rows.mapInArrow(_scan_block(block, key, last, window), SCHEMA if last else state)

    return _block_by_block(t.text_frame(docs, id_col, text_col), benchmark, item_col, item_text_col, block_bytes, one)


def _block_by_block(docs: DataFrame, benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int, one: Callable) -> DataFrame:
    """``one`` (rows, block, key, last) for each block of the benchmark; what stands between two blocks is written."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // block_bytes))
    for k in range(n):
        rows = items.filter(F.pmod(F.xxhash64("text"), F.lit(n)) == k) if n > 1 else items
        block = benchmark.sparkSession.sparkContext.broadcast([tuple(r) for r in rows.collect()])
        docs = one(docs, block, uuid.uuid4().hex, k == n - 1)
        if k < n - 1:
            docs = kept_in(docs.sparkSession, docs, "scanned")
            block.unpersist()
    return docs


def _clean(block, key: str, size: int, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _passages(block, key, size)
        for part in t.pieces(batches, text):
            texts = part.column(part.schema.get_field_index(text)).to_pylist()
            yield part.filter(pa.array([not machine.scan(x)[1].any() for x in texts], pa.bool_()))

    return t.holding(run)


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The documents without any benchmark window, all their columns unchanged."""

    def one(rows: DataFrame, block, key: str, last: bool) -> DataFrame:
        return rows.mapInArrow(_clean(block, key, window, text_col), rows.schema)

    return _block_by_block(docs, benchmark, item_col, item_text_col, block_bytes, one)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("spans")


_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE = {
    "op3_decontamination": f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '{_WORDS}') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '{_WORDS}') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), {WINDOW}) AS n, array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - {WINDOW - 1}, 1))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT dw.doc_id, dw.i, dw.n, bw.item FROM dw JOIN bw USING (n, win)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM m)) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m WHERE item IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN it ON d.doc_id = it.doc_id"""
}
