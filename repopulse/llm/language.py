"""Language identification 9: cross-parsing against suffix automata.

For each language a bounded sample of labelled text becomes a suffix automaton.  A text
is parsed greedily: the longest match in the sample is one phrase, the next phrase
starts where it broke off; a symbol that the sample lacks is a phrase of its own.  The
fewer phrases a language needs, relative to what its sample size allows, the better it
explains the text; the language with the fewest normalised phrases wins.

In numpy, stretches of ``STRETCH`` symbols of all texts of a slice are parsed side by side
for all languages.  A stretch begins as if a phrase did; where the stretch before it ends
inside a phrase, its beginning is parsed again from there, until both parses break at the
same place.  The result is the greedy parse of the whole text.

The sample: for each language the different texts with the smallest hash, those of at most
``LONG_BYTES`` first, until they are ``SAMPLE_ROWS`` or their bytes reach the language's
share of ``SAMPLE_BYTES``.  Texts are taken whole, so the last one may exceed the share.

Defined cases: ``und`` with score 0 for a null text or one without a letter, or if there
is nothing to learn from; ties go to the language that sorts first; rows with a null
lang are predicted but not learned; copies are learned once; repeated rows get equal
results; a very long text is parsed in one piece, in memory in proportion to it; other
columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import text as t

SAMPLE_ROWS = 48
SAMPLE_BYTES = 160_000
LONG_BYTES = 10_000
STRETCH = 512


def symbols(data: np.ndarray) -> np.ndarray:
    """Bytes as letters: A-Z lower-cased, every other ASCII byte a blank."""
    out = t.LOWER[data]
    return np.where((out >= 0x61) & (out <= 0x7A) | (out >= 0x80), out, np.uint8(0x20))


def suffix_automaton(word: bytes) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a text; state 0 is the start."""
    nexts: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in word:
        new = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = new
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return nexts


class Model:
    """Automata of all languages in one transition table.

    ``table[state * width + symbol]`` is the next state, times ``width``; where a match
    breaks off it is the state after the symbol from the start.  Where a symbol starts a
    phrase, the lowest bit tells (widths are even, so that bit is free).
    """

    def __init__(self, samples: dict[str, bytes]) -> None:
        self.langs = sorted(samples)
        texts = {k: symbols(np.frombuffer(v, np.uint8)) for k, v in samples.items()}
        kept = np.flatnonzero(np.bincount(np.concatenate([*texts.values(), np.zeros(1, np.uint8)]), minlength=256))
        self.code = np.full(256, len(kept), np.int64)  # the last code: never seen
        self.code[kept] = np.arange(len(kept))
        self.width = width = len(kept) + 1 + (len(kept) + 1) % 2
        tables, self.start, base = [], [], 0
        for lang in self.langs:
            nexts = suffix_automaton(self.code[texts[lang]].astype(np.uint8).tobytes())
            n = len(nexts)
            table = np.full((n, width), -1, np.int64)
            state = np.repeat(np.arange(n), [len(x) for x in nexts])
            table[state, [c for x in nexts for c in x]] = [s for x in nexts for s in x.values()]
            again = np.where(table[0] >= 0, table[0], 0)
            table = np.where(table >= 0, (table + base) * width, ((again + base) * width)[None] | 1)
            table[0] |= 1
            tables.append(table.astype(np.int32))
            self.start.append(base * width)
            base += n
        self.table = np.concatenate(tables).ravel()
        self.size = np.array([max(len(texts[k]), 2) for k in self.langs])

    def phrases(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Phrases of each row (offsets) for each language."""
        rows, langs = len(offsets) - 1, len(self.langs)
        n = np.diff(offsets)
        pieces = -(-n // STRETCH)
        row = np.repeat(np.arange(rows), pieces)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = offsets[:-1][row] + nth * STRETCH
        size = np.minimum(STRETCH, offsets[1:][row] - begin)
        by = np.argsort(-size, kind="stable")
        row, begin, size = row[by], begin[by], size[by]
        code = np.r_[self.code[symbols(data)], np.zeros(1, np.int64)].astype(np.int32)
        state = np.repeat(np.array(self.start, np.int32)[:, None], len(row), 1)
        count = np.zeros((langs, len(row)), np.int64)
        for k in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size, -k, "left"))  # stretches longer than k
            step = self.table[state[:, :live] + code[begin[:live] + k]]
            count[:, :live] += step & 1
            state[:, :live] = step & -2
        self._join(by, row, begin, size, code, state, count)
        out = np.zeros((rows, langs), np.int64)
        for i in range(langs):
            out[:, i] = np.bincount(row, count[i], rows)
        return out

    def _join(self, by: np.ndarray, row: np.ndarray, begin: np.ndarray, size: np.ndarray, code: np.ndarray, state: np.ndarray, count: np.ndarray) -> None:
        """Corrects the counts of stretches that begin inside a phrase of the one before.  by: text order of the stretches."""
        langs, n = state.shape
        place = np.empty(n, np.int64)
        place[by] = np.arange(n)  # where the stretches of a text stand, in text order
        after = np.full(n, -1)
        if n > 1:
            same = row[place[1:]] == row[place[:-1]]
            after[place[:-1][same]] = place[1:][same]
        entry = np.repeat(np.array(self.start, np.int32)[:, None], n, 1)
        lang, one = np.divmod(np.arange(langs * n), max(n, 1))
        while True:
            nxt = after[one]
            ok = nxt >= 0
            lang, one, nxt = lang[ok], one[ok], nxt[ok]
            new = state[lang, one]
            ok = new != entry[lang, nxt]
            lang, one, new = lang[ok], nxt[ok], new[ok]
            if not len(one):
                return
            was, entry[lang, one] = entry[lang, one], new
            live, k, changed = np.arange(len(one)), 0, []
            while len(live):
                at = code[begin[one[live]] + k]
                a, b = self.table[was[live] + at], self.table[new[live] + at]
                np.add.at(count, (lang[live], one[live]), (b & 1) - (a & 1))
                was[live], new[live] = a & -2, b & -2
                k += 1
                apart = was[live] != new[live]
                end = apart & (size[one[live]] == k)
                changed.append(live[end])
                live = live[apart & ~end]
            found = np.concatenate(changed)
            lang, one = lang[found], one[found]
            state[lang, one] = new[found]

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        data, offsets = t.string_buffers(column)
        low = t.LOWER[data]
        ascii_letters = np.r_[0, np.cumsum((low >= 0x61) & (low <= 0x7A))]
        has = ascii_letters[offsets[1:]] > ascii_letters[offsets[:-1]]
        for i in np.flatnonzero(~has & (np.diff(offsets) > 0)):
            has[i] = any(c.isalpha() for c in column[int(i)].as_py())
        cost = self.phrases(data, offsets) * np.log2(self.size)
        best = cost.argmin(1)
        first = cost[np.arange(len(best)), best]
        rest = cost.copy()
        rest[np.arange(len(best)), best] = np.inf
        second = rest.min(1)
        score = np.where(np.isinf(second), 1.0, second / np.maximum(first + second, 1e-9))
        return [self.langs[b] if h else "und" for b, h in zip(best, has, strict=True)], np.where(has, score, 0.0)


def learn(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> dict[str, bytes]:
    """Bounded training text for each language; ``labelled`` has the columns text and lang.

    Hashes are aggregated and cut first; texts are then read for the chosen hashes only.
    """
    rows = labelled.filter("lang IS NOT NULL AND length(text) > 0").select("lang", "text", F.xxhash64("text").alias("h"))
    once = rows.groupBy("lang", "h").agg(F.min(F.octet_length("text") > LONG_BYTES).alias("long"))
    # row_number below a constant is cut before the shuffle, so a hot language costs no more than the bound
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("long", "h"))
    chosen = once.withColumn("nth", nth).filter(F.col("nth") <= sample_rows).select("lang", "h", "nth")
    texts = rows.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "nth").agg(F.min("text").alias("text"))
    found: dict[str, list[bytes]] = {}
    for lang, text in texts.orderBy("lang", "nth").select("lang", "text").toLocalIterator():
        found.setdefault(lang, []).append(text.encode(errors="replace"))
    share = sample_bytes // max(len(found), 1)
    out = {}
    for lang, own in found.items():
        before = np.cumsum([0, *map(len, own)])[:-1]
        out[lang] = b" ".join(x for x, n in zip(own, before, strict=True) if n < share)
    return out


def _predict(samples, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = t.held(key, lambda: Model(samples.value) if samples.value else None)
        for part in t.pieces(batches):
            n = part.num_rows
            langs, score = model.predict(part.column(1)) if model else (["und"] * n, np.zeros(n))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return t.holding(run)


def identify_languages(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with the predicted language and a score from 0 to 1."""
    samples = docs.sparkSession.sparkContext.broadcast(learn(labelled))
    return t.text_frame(docs, id_col, text_col).mapInArrow(_predict(samples, uuid.uuid4().hex), "doc_id long, lang_pred string, score double")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    labelled = docs.filter(~held).select("text", "lang")
    return identify_languages(docs, labelled).select("doc_id", held.alias("held_out"), "lang_pred", "score")
