from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from repopulse.llm import collocations as c
from repopulse.llm import counting_filter as cf

rng = random.Random(13)
WORDS = ["New", "york", "é", "The", "of", "x\x0by", "漢字", "a-b", "q", "city", "state", "'s", "\x00z", "#", "very"]


def text(seed):
    r, out = random.Random(seed), []
    for _ in range(r.randint(0, 60)):
        out.append(r.choice(["new york city", "New York", "the state of", "of the", r.choice(WORDS), r.choice(WORDS)]))
        out.append(r.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", " \n ", "!?", ";", ":", "\r\n"]))
    return "".join(out)


DOCS = [(i, text(i), rng.choice(["en", "en", "en", "de", None])) for i in range(150)] + [(200, None, "en"), (201, "", "de"), (202, " \t.", "fr"), (203, "one two", "fr"), (3, text(3), "en"), (204, "a b " * 4000, "long")]
UPPER = {i: i + 32 for i in range(65, 91)}


def brute(docs, least, top):
    total, counts = Counter(), {}
    for _, body, lang in docs:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (body or "").translate(UPPER)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            total[lang] += len(words)
            own = counts.setdefault(lang, Counter())
            for n in range(1, 5):
                own.update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, own in counts.items():
        candidates = {g: a for g, a in own.items() if len(g) > 1 and a >= least}
        rows = []
        for g, a in candidates.items():
            score, k = min((2000000 * a // (own[g[:k]] + own[g[k:]]), k) for k in range(1, len(g)))
            within = [f for h, f in candidates.items() if len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1))]
            if not any(100 * f >= 80 * a for f in within):
                rows.append((-score, -a, " ".join(g).encode(), own[g[:k]], own[g[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])]
    return sorted(out)


@pytest.mark.parametrize(("size", "bits", "shard_bits"), [(2, 2, 0), (2, 18, 3), (2, 32, 5), (3, 6, 2), (3, 22, 0), (4, 4, 1), (4, 16, 2), (4, 18, 4), (4, 32, 3)])
def test_filters_lose_nothing(size, bits, shard_bits):
    r = np.random.default_rng(size * bits)
    most = min(1 << bits, 9)
    words = tuple((r.integers(1, most, 3000) + (0 if bits < 32 else (1 << 32) - 9)).astype(np.uint32) for _ in range(size))
    layout = cf.Layout(size, bits, shard_bits)
    high, low = cf.pack(words, bits)
    assert all((a == b).all() for a, b in zip(cf.unpack(high, low, size, bits), words))
    again = cf.restored(*cf.permuted(high, low, layout.half), layout.half)
    assert (again[0] == high).all() and (again[1] == low).all()
    parts = [cf.summed(*cf.keys(tuple(w[i::3] for w in words), layout)) for i in range(3)]
    got = Counter()
    by_shard: dict[int, list[cf.Entries]] = {}
    for part in parts:
        for shard, e in cf.shards(part, layout):
            by_shard.setdefault(shard, []).append(cf.decode(cf.encode(e, *layout.widths)))
    for shard, filters in by_shard.items():
        e = cf.merged(filters)
        assert len(filters) == 1 or all(len(set(zip(e.top.tolist(), [0] * len(e.top) if e.low is None else e.low.tolist()))) == len(e.top) for _ in [0])
        got.update({tuple(int(w[i]) for w in cf.words(shard, e, layout)): int(n) for i, n in enumerate(e.counts)})
    assert got == Counter(zip(*(w.tolist() for w in words)))


def test_large_counters_and_empty_filters():
    e = cf.Entries(np.array([1, 5, 9], np.uint64), None, np.array([255, 256, 10**12]))
    assert [x.tolist() for x in (cf.decode(cf.encode(e, 36, 0)).top, cf.decode(cf.encode(e, 36, 0)).counts)] == [[1, 5, 9], [255, 256, 10**12]]
    none = cf.Entries(np.zeros(0, np.uint64), None, np.zeros(0, np.int64))
    assert not len(cf.decode(cf.encode(none, 36, 0)).top)


def test_counting_in_many_flushes(monkeypatch):
    monkeypatch.setattr(c, "GATHER", 40)
    r = np.random.default_rng(5)
    slices = [r.integers(0, 12, 200).astype("<u4") for _ in range(30)]
    layout = cf.Layout(3, 4, 3)
    filters = [x for b in c._counter(layout, None)(iter([pa.RecordBatch.from_arrays([pa.array([s.tobytes() for s in slices], pa.binary())], ["ids"])])) for x in b.to_pylist()]
    filters.sort(key=lambda x: x["shard"])
    batches = [pa.RecordBatch.from_pylist(filters[i : i + 7], pa.schema([("shard", pa.int64()), ("filter", pa.binary())])) for i in range(0, len(filters), 7)]
    got = {tuple(x["g"]): x["a"] for b in c._merger(layout, 3)(iter(batches)) for x in b.to_pylist()}
    want = Counter(tuple(s[i : i + 3].tolist()) for s in slices for i in range(198))
    assert got == {g: n for g, n in want.items() if n >= 3 and 0 not in g} and len(filters) > 30


def test_phrases_equal_brute_force(spark):
    docs = spark.createDataFrame([(*d, "x", 1) for d in DOCS], "doc_id long, text string, lang string, phrase string, a long").repartition(3)
    for least, top in ((3, 2000), (6, 7)):
        out = c.collocations(docs, least=least, top=top)
        assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, out.collect())) == brute(DOCS, least, top)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert c.collocations(docs).count() == 0
    assert c.collocations(spark.createDataFrame([(1, None, None)], docs.schema).withColumn("n", F.lit(1))).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    big = [(4_000_000_000_000_001, 4_000_000_000_000_003, 4_000_000_000_000_007), (30, 31, 10**15), (9 * 10**15, 9 * 10**15, 9 * 10**15)]
    got = [r.s for r in spark.createDataFrame(big, "a long, l long, r long").select(c._floor_score("a", "l", "r").alias("s")).collect()]
    assert got == [2000000 * a // (x + y) for a, x, y in big]
