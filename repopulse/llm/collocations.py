"""Phrase collocation mining 13: exact n-gram counts in counting quotient filters.

1. Texts of a language are cut into slices of words; each slice is written as its distinct
   words with counts, and codes of its words in order.
2. Words that occur ``LEAST`` times in a language get numbers without gaps.  Each slice
   receives the numbers of its own words by a join, so nobody holds the vocabulary.
3. For n = 2, 3, 4: every task packs the n-grams of its slices, permutes them and counts them in sorted
   filters, one for each shard (``counting_filter``); shards are merged by a shuffle and
   keep what occurs ``LEAST`` times.  An n-gram can only be that frequent if both its
   (n-1)-grams are, so those are looked up in a bit mask of at most ``MASK_BITS`` bits:
   false hits cost counters, never a count.
4. Candidates, cuts and the search for longer phrases are joins on word numbers.

Numbers of words differ from language to language, so an n-gram says its language.

Defined cases: a null text is empty, a null language is ``und``; words are cut by
spaces and tabs only, pieces at sentence signs and line ends; repeated rows count again;
ties in rank go by count, then by phrase in byte order; an empty table gives an empty
result; a very long text is one slice, in memory in proportion to it; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import numbered, written
from . import counting_filter as cf
from . import text as t

LEAST = 30
LONGEST = 4
TOP = 2000
SLICE_BYTES = 2_000_000
#: Entries that a task gathers before it writes filters, and about how many n-grams a shard has.
GATHER = 1_000_000
SHARD = 1_000_000
MASK_BITS = 1 << 27
_CHUNK_BITS = 1 << 19
#: Buckets in which the phrases of a language are ranked first.
BUCKETS = 64

#: The signs between words and between pieces.
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_WORD, _BREAK = np.ones(256, bool), np.zeros(256, bool)
_WORD[list(b" \t" + _BREAKS)] = False
_BREAK[list(_BREAKS)] = True

SLICES = "slice long, lang string, words array<string>, counts array<long>, codes binary, starts binary, n long"


def _slice(column: pa.Array) -> tuple[pa.Array, np.ndarray, bytes, bytes, int] | None:
    """Distinct words, their counts, the code of each word, and which words start a piece."""
    data, offsets = t.string_buffers(column)
    low = t.LOWER[data]
    start, end = t.runs(_WORD, low, offsets)
    if not len(start):
        return None
    lengths = np.r_[0, np.cumsum(end - start)]
    words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(lengths.astype(np.int64).tobytes()), pa.py_buffer(low[_WORD[low]].tobytes()))
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.uint32)
    breaks = np.r_[0, np.cumsum(_BREAK[low])][start]
    fresh = np.ones(len(start), bool)
    np.not_equal(breaks[1:], breaks[:-1], out=fresh[1:])
    first = np.searchsorted(start, offsets[:-1])
    fresh[first[first < len(start)]] = True
    narrow = codes.astype("<u2") if len(coded.dictionary) <= 1 << 16 else codes.astype("<u4")
    return coded.dictionary.cast(pa.string()), np.bincount(codes, minlength=len(coded.dictionary)), narrow.tobytes(), np.packbits(fresh).tobytes(), len(codes)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    names = [c.split()[0] for c in SLICES.split(", ")]
    for batch in batches:
        langs = batch.column(0).fill_null("und")
        for lang in langs.unique().to_pylist():
            own = batch.filter(pc.equal(langs, lang))
            for part in t.pieces(iter([own]), limit=SLICE_BYTES):
                if (found := _slice(part.column(1))) is None:
                    continue
                words, counts, codes, starts, n = found
                whole = [0, len(words)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number]), pa.array([lang]), pa.ListArray.from_arrays(whole, words), pa.ListArray.from_arrays(whole, pa.array(counts)), pa.array([codes], pa.binary()), pa.array([starts], pa.binary()), pa.array([n])],
                    names,
                )
                number += 1


def _translate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers of a slice's words in order; 0 for rarer words and between pieces, never twice in a row."""
    for batch in batches:
        out, n = [], []
        for i in range(batch.num_rows):
            size = batch.column(1)[i].as_py()
            known = batch.column(4).slice(i, 1).flatten()
            table = np.zeros(size, np.uint32)
            table[known.field("pos").to_numpy()] = known.field("id").to_numpy().astype(np.uint32)
            raw, count = batch.column(2)[i].as_py(), batch.column(5)[i].as_py()
            ids = table[np.frombuffer(raw, "<u2" if size <= 1 << 16 else "<u4")]
            fresh = np.unpackbits(np.frombuffer(batch.column(3)[i].as_py(), np.uint8), count=count).astype(bool)
            ids = np.insert(ids, np.flatnonzero(fresh), 0)
            keep = ids != 0
            keep[1:] |= ids[:-1] != 0
            ids = ids[keep]
            out.append(ids.astype("<u4").tobytes())
            n.append(int(np.count_nonzero(ids)))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(n)], ["ids", "n"])


def gram_hash(words: cf.Words) -> np.ndarray:
    h = np.zeros(len(words[0]), np.uint64)
    for w in words:
        h = t.mixed((h ^ w.astype(np.uint64)) + np.uint64(0x9E3779B97F4A7C15))
    return h


class Mask:
    """Which hashes of frequent (n-1)-grams occur: no misses, some false hits."""

    def __init__(self, data: bytes) -> None:
        self.bits = np.frombuffer(data, np.uint8)
        self.most = np.uint64(8 * len(self.bits) - 1)

    def has(self, words: cf.Words) -> np.ndarray:
        at = (gram_hash(words) & self.most).astype(np.int64)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 != 0


def grams(ids: np.ndarray, size: int, mask: Mask | None) -> cf.Words:
    """The n-grams of some word numbers, as a column for each place; without those that can't be frequent."""
    views = tuple(ids[i : len(ids) - size + 1 + i] for i in range(size))
    if len(ids) < size:
        return tuple(np.zeros(0, np.uint32) for _ in range(size))
    good = np.all([v != 0 for v in views], axis=0)
    if mask is not None:
        inner = tuple(ids[i : len(ids) - size + 2 + i] for i in range(size - 1))
        known = mask.has(inner)
        good &= known[:-1] & known[1:]
    at = np.flatnonzero(good)
    return tuple(v[at] for v in views)


def _counter(layout: cf.Layout, mask):
    """A task that counts n-grams in filters: shard, filter."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = None if mask is None else Mask(mask.value)
        parts: list[cf.Entries] = []

        def flushed(whole: cf.Entries) -> pa.RecordBatch:
            filters = [(s, cf.encode(e, *layout.widths)) for s, e in cf.shards(whole, layout)]
            return pa.RecordBatch.from_arrays([pa.array([s for s, _ in filters], pa.int64()), pa.array([f for _, f in filters], pa.binary())], ["shard", "filter"])

        for batch in batches:
            for raw in batch.column(0):
                found = grams(np.frombuffer(raw.as_buffer(), "<u4"), layout.size, lookup)
                if not len(found[0]):
                    continue
                parts.append(cf.summed(*cf.keys(found, layout)))
                if sum(len(p.top) for p in parts) > GATHER:
                    parts = [cf.merged(parts)]
                    if len(parts[0].top) > GATHER // 2:
                        yield flushed(parts[0])
                        parts = []
        if parts:
            yield flushed(cf.merged(parts))

    return run


def _merger(layout: cf.Layout, least: int):
    """A task that merges the filters of each shard and keeps frequent n-grams."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts = None, []

        def frequent() -> pa.RecordBatch:
            e = cf.merged(parts)
            keep = e.counts >= least
            e = cf.Entries(e.top[keep], None if e.low is None else e.low[keep], e.counts[keep])
            ids = np.stack(cf.words(shard, e, layout), 1).astype(np.int64)
            g = pa.ListArray.from_arrays(pa.array(np.arange(0, ids.size + 1, layout.size), pa.int32()), pa.array(ids.reshape(-1)))
            return pa.RecordBatch.from_arrays([g, pa.array(e.counts, pa.int64())], ["g", "a"])

        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if name != shard and parts:
                    yield frequent()
                    parts = []
                shard = name
                parts.append(cf.decode(data.as_buffer().to_pybytes()))
                if len(parts) > 1 and sum(len(p.top) for p in parts[1:]) > max(GATHER, len(parts[0].top)):
                    parts = [cf.merged(parts)]
        if parts:
            yield frequent()

    return run


def _bits(most: int):
    """A task that sets the bits of its n-grams, by chunks of the mask."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: dict[int, np.ndarray] = {}
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy()
            if not batch.num_rows:
                continue
            words = flat.reshape(batch.num_rows, -1).T
            at = (gram_hash(tuple(words)) & np.uint64(most)).astype(np.int64)
            for chunk in np.unique(at // _CHUNK_BITS).tolist():
                bits = chunks.setdefault(chunk, np.zeros(_CHUNK_BITS // 8, np.uint8))
                inside = at[at // _CHUNK_BITS == chunk] % _CHUNK_BITS
                np.bitwise_or.at(bits, inside >> 3, np.left_shift(1, inside & 7).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array(list(chunks), pa.int64()), pa.array([c.tobytes() for c in chunks.values()], pa.binary())], ["chunk", "bits"])

    return run


def _either(rows: pd.DataFrame) -> pd.DataFrame:
    bits = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in rows["bits"]])
    return pd.DataFrame({"chunk": rows["chunk"].iloc[:1].to_numpy(), "bits": [bits.tobytes()]})


def mask_of(frequent: DataFrame, n: int) -> bytes:
    """The mask of n n-grams: 16 bits for each, up to ``MASK_BITS``, so the driver gets at most 16 MB."""
    size = min(MASK_BITS, max(_CHUNK_BITS, 1 << (16 * n).bit_length()))
    schema = "chunk long, bits binary"
    chunks = frequent.select("g").mapInArrow(t.task(_bits(size - 1)), schema).groupBy("chunk").applyInPandas(_either, schema)
    out = bytearray(size // 8)
    for chunk, bits in chunks.collect():
        out[chunk * _CHUNK_BITS // 8 : (chunk + 1) * _CHUNK_BITS // 8] = bits
    return bytes(out)


def frequent_grams(ids: DataFrame, size: int, bits: int, occurrences: int, mask: bytes | None, least: int) -> DataFrame:
    """n-grams of the slices that occur often enough, with their counts: g array<long>, a long."""
    spark = ids.sparkSession
    shard_bits = min((occurrences // SHARD).bit_length(), 20, size * bits // 2)
    layout = cf.Layout(size, bits, shard_bits)
    shared = None if mask is None else spark.sparkContext.broadcast(mask)
    filters = ids.select("ids").mapInArrow(t.task(_counter(layout, shared)), "shard long, filter binary")
    sorted_filters = filters.repartition(max(1 << shard_bits, 2), "shard").sortWithinPartitions("shard")
    return written(sorted_filters.mapInArrow(t.task(_merger(layout, least)), "g array<long>, a long"), f"grams-{size}")


def counted_grams(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frequent phrases of one to ``longest`` words by numbers (g, a), the numbers' words (id, lang, word), and words a language (lang, n)."""
    texts = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    slices = written(texts.mapInArrow(t.task(_slices), SLICES), "slices")
    totals = slices.groupBy("lang").agg(F.sum("n").alias("n"))
    each = slices.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).select("lang", F.col("w.words").alias("word"), F.col("w.counts").alias("c"))
    common = each.groupBy("lang", "word").agg(F.sum("c").alias("a")).filter(F.col("a") >= least)
    vocabulary = written(numbered(common, "lang", "word", name="id", first=1), "vocabulary")
    size = vocabulary.count()
    bits = size.bit_length() + size.bit_length() % 2
    if bits > 32:
        raise ValueError("word numbers have more than 32 bits")
    own = slices.select("slice", "lang", F.posexplode("words").alias("pos", "word")).join(vocabulary.select("lang", "word", "id"), ["lang", "word"])
    known = own.groupBy("slice").agg(F.collect_list(F.struct("pos", "id")).alias("known"))
    coded = slices.select("slice", F.size("words").alias("size"), "codes", "starts", "n").join(known, "slice")
    ids = written(coded.select("slice", "size", "codes", "starts", "known", "n").mapInArrow(t.task(_translate), "ids binary, n long"), "word-numbers")
    occurrences = ids.agg(F.sum("n")).first()[0] or 0
    found, mask = [vocabulary.select(F.array("id").alias("g"), "a")], None
    for n in range(2, longest + 1):
        level = frequent_grams(ids, n, bits, occurrences, mask, least)
        rows, occurrences = level.agg(F.count(F.lit(1)), F.coalesce(F.sum("a"), F.lit(0))).first()
        found.append(level)
        if n < longest:
            mask = mask_of(level, rows)
    out = found[0]
    for level in found[1:]:
        out = out.unionByName(level)
    return out, vocabulary, totals


def _floor_score(a: str, l: str, r: str):
    """floor(2,000,000 a / (l + r)) in exact numbers of up to 38 digits."""
    return F.expr(f"CAST(CAST(2000000 AS DECIMAL(7,0)) * CAST({a} AS DECIMAL(19,0)) AS DECIMAL(27,0)) DIV (CAST({l} AS DECIMAL(19,0)) + CAST({r} AS DECIMAL(19,0)))")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    counts, vocabulary, totals = counted_grams(docs, least, longest, text_col, lang_col)
    phrases = counts.filter(F.size("g") > 1)
    cuts = phrases.select("g", "a", F.explode(F.sequence(F.lit(1), F.size("g") - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.slice("g", F.lit(1), F.col("k")), "right": F.slice("g", F.col("k") + 1, F.size("g") - F.col("k"))})
    part = lambda side, name: counts.select(F.col("g").alias(side), F.col("a").alias(name))
    cuts = cuts.join(part("left", "l"), "left").join(part("right", "r"), "right").withColumn("score", _floor_score("a", "l", "r"))
    scored = cuts.groupBy("g", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = F.expr("flatten(transform(sequence(2, size(g) - 1), m -> transform(sequence(1, size(g) - m + 1), i -> slice(g, i, m))))")
    longer = phrases.filter(F.size("g") > 2).select(F.explode(inner).alias("g"), "a").groupBy("g").agg(F.max("a").alias("longer"))
    kept = scored.join(longer, "g", "left").filter(F.expr("longer IS NULL OR CAST(100 AS DECIMAL(3,0)) * CAST(longer AS DECIMAL(19,0)) < CAST(80 AS DECIMAL(2,0)) * CAST(a AS DECIMAL(19,0))"))
    kept = written(kept.select("g", "a", "cut.score", "cut.l", "cut.r"), "collocations")
    named = kept.select("g", F.posexplode("g").alias("pos", "id")).join(vocabulary.select("id", "lang", "word"), "id")
    named = named.groupBy("g").agg(F.first("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("pos", "word"))).alias("w"))
    rows = kept.join(named, "g").withColumn("phrase", F.concat_ws(" ", F.transform("w", lambda w: w["word"]))).drop("w")
    best = [F.desc("score"), F.desc("a"), F.col("phrase")]
    bucket = F.pmod(F.xxhash64("g"), F.lit(BUCKETS))
    first = rows.withColumn("bucket", bucket).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(*best))).filter(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORACLE = {
    "op13_collocations": f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
words AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
each AS (SELECT lang, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS phrase FROM words, (SELECT unnest([1, 2, 3, 4]) AS n) WHERE len(w) >= n),
grams AS (SELECT lang, n AS size, phrase, count(*)::HUGEINT AS f FROM each GROUP BY 1, 2, 3 HAVING count(*) >= 30),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY 1),
cuts AS (
  SELECT lang, phrase, f, size, k, string_split(phrase, ' ') AS w FROM (SELECT *, unnest(range(1, size)) AS k FROM grams WHERE size > 1)),
scored AS (
  SELECT c.lang, c.phrase, c.f, c.size, list_sort(list({{'score': 2000000 * c.f // (x.f + y.f), 'k': c.k, 'l': x.f, 'r': y.f}}))[1] AS cut
  FROM cuts c JOIN grams x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[:c.k], ' ') JOIN grams y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:], ' ')
  GROUP BY 1, 2, 3, 4),
inner_phrases AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(f) AS longer
  FROM (SELECT *, unnest(range(1, size - m + 2)) AS i FROM (SELECT lang, f, size, string_split(phrase, ' ') AS w, unnest(range(2, size)) AS m FROM grams WHERE size > 2)) GROUP BY 1, 2),
kept AS (
  SELECT s.lang, s.phrase, s.f AS a, s.cut.score AS score, s.cut.l AS l, s.cut.r AS r FROM scored s LEFT JOIN inner_phrases i ON i.lang = s.lang AND i.phrase = s.phrase
  WHERE i.longer IS NULL OR 100 * i.longer < 80 * s.f),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT k.lang, k.rank::BIGINT AS rank, k.phrase, k.a::BIGINT AS a, k.l::BIGINT AS l, k.r::BIGINT AS r, t.n, k.score::BIGINT AS score FROM ranked k JOIN totals t ON t.lang = k.lang WHERE k.rank <= 2000"""
}
