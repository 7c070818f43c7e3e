from __future__ import annotations

import html as html_module
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from repopulse.llm import (
    decontamination, extraction, html_blocks, language, licenses, near_duplicates, overlap, packing, repetition, substring_dedup, suffix_dedup, toxicity,
)
from repopulse.llm.components import components
from repopulse.llm.suffix import lcp_array, maximal_repeats, previous_factors, suffix_array

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
rng = random.Random(3)
VOCABULARY = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(60)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def near(text, seed, edits):
    r, words = random.Random(seed), text.split(" ")
    for _ in range(edits):
        words[r.randrange(len(words))] = "changed"
    return " ".join(words)


BASE = prose(120, 1)
LINE = prose(12, 77)
#: Null and empty texts, white space, copies, near copies, repeats inside, very long texts, repeated rows, missing ids.
ROWS = [
    (0, BASE), (1, None), (2, ""), (3, " \n\t "), (4, BASE), (5, near(BASE, 5, 2)), (6, near(BASE, 6, 3)), (7, prose(200, 7)), (8, prose(60, 8) + " " + BASE + " " + prose(40, 9)),
    (9, "one two"), (10, "One two!"), (11, (prose(30, 11) + "\n") * 8), (12, "x " * 400), (13, prose(6000, 13)), (7, prose(200, 7)), (None, BASE), (14, "é" * 500), (15, "é" * 450),
    (16, LINE + "\n" + prose(70, 16)), (17, LINE + "\n" + prose(70, 17)), (18, LINE + "\n" + prose(70, 18)), (19, "　漢字 #$ %&<> tab\tword"),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", None) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    """Rows with a clashing extra column."""
    return frame(spark, ROWS).withColumn("hash", F.lit("clash")).withColumn("score", F.lit(1)).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def tuples(rows, *columns):
    return sorted(([r[c] for c in columns] for r in rows.collect()), key=str)


# suffix structures

@pytest.mark.parametrize("seed", range(6))
def test_suffix_structures(seed):
    r = np.random.default_rng(seed)
    names = r.integers(0, [2, 3, 8][seed % 3], 80)
    order, place, levels = suffix_array(names)
    text = names.tolist()
    assert order.tolist() == sorted(range(80), key=lambda i: text[i:])
    lcp = lcp_array(order, levels)
    common = lambda a, b: next((k for k in range(81) if a + k >= 80 or b + k >= 80 or text[a + k] != text[b + k]), 0)
    assert lcp[1:80].tolist() == [common(a, b) for a, b in zip(order[:-1], order[1:])]
    earlier, later = previous_factors(order, levels)
    assert earlier.tolist() == [max((common(i, j) for j in range(i)), default=0) for i in range(80)]
    assert later.tolist() == [max((common(i, j) for j in range(i + 1, 80)), default=0) for i in range(80)]
    left = np.r_[-1, names[:-1]]
    found = {tuple(text[order[a] : order[a] + n]): b - a + 1 for a, b, n in maximal_repeats(order, lcp, left, 2)}
    subs = {tuple(text[i:j]) for i in range(80) for j in range(i + 2, 81)}
    want = {}
    for s in subs:
        at = [i for i in range(81 - len(s)) if tuple(text[i : i + len(s)]) == s]
        if len(at) > 1 and len({text[i - 1] if i else -1 for i in at}) > 1 and len({text[i + len(s)] if i + len(s) < 80 else -1 - i for i in at}) > 1:
            want[s] = len(at)
    assert found == want


# 1

def test_repetition_verdicts_equal_brute_force():
    r = random.Random(8)
    texts = [x for _, x in ROWS if x is None or len(x) < 3000]
    for i in range(40):
        words = prose(r.randint(20, 150), 300 + i).split(" ")
        for _ in range(r.randint(0, 3)):
            a, n = r.randrange(len(words)), r.randint(5, 40)
            words += words[a : a + n]
        texts.append(" ".join(words))
    got = repetition.repetition_rows(pa.array(texts))
    for i, text in enumerate(texts):
        longest, share = brute.repeats(text)
        assert (got["longest_repeat"][i], round(got["covered_fraction"][i], 12)) == (longest, round(share, 12))
        n = len(brute.spaced(text))
        too_much = share > repetition.MAX_COVERED or (longest >= repetition.MIN_LONGEST and longest > repetition.MAX_LONGEST * n)
        assert got["kept"][i] == (not brute.repetition(text)[-1] and not too_much)


def test_repetition(docs, empty):
    got = {}
    for r in repetition.repetition_quality(docs).collect():
        got.setdefault(r["doc_id"], []).append(tuple(r)[1:7] + (r["kept"],))
    for doc_id, text in ROWS:
        for row in got[doc_id]:
            assert row[:6] == brute.repetition(text) or doc_id is None
            assert not (row[5] and row[6])
    assert repetition.repetition_quality(empty).count() == 0
    kept = {k: v[0][-1] for k, v in got.items()}
    assert kept[7] and kept[13] and not kept[11] and not kept[12]


# 2

def test_packing_round_trip(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    unique = docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    pieces = packing.pack_documents(unique, group_docs=8).toPandas()
    for doc_id, text in {i: x for i, x in ROWS if i is not None}.items():
        ids = np.array(tok.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        own = pieces[pieces.doc_id == doc_id].sort_values("start")
        assert own.start.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() == len(ids) and set(own.doc_tokens) == {len(ids)}
        assert own.ids_crc32.tolist() == [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(own.start, own.length)]
    for _, seq in pieces.sort_values("offset").groupby("sequence_id"):
        assert seq.offset.tolist() == [0, *seq.length.cumsum().tolist()[:-1]] and seq.length.sum() <= 1024
    assert packing.pack_documents(empty).count() == 0
    assert packing.pack_documents(docs).agg(F.count_distinct("doc_id")).first()[0] == len({i for i, _ in ROWS if i is not None})


@pytest.mark.parametrize("text", ["a  b", " lead", "trail ", "it's 12 km\n\n x", "é ü 漢字   z", "<|endoftext|> in text", "tabs\t and   spaces", "a b c d don't 3.5%", "\x1c x"])
def test_encoder_equals_library(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    want = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing.encoder(path)(text), "<u4").tolist() == want


def test_first_fit_decreasing():
    r = random.Random(1)
    sizes = [r.randint(1, 100) for _ in range(200)]
    placed = packing.first_fit_decreasing(sizes, 100)
    bins = []
    for i in sorted(range(200), key=lambda i: -sizes[i]):
        k = next((k for k, b in enumerate(bins) if b + sizes[i] <= 100), len(bins))
        if k == len(bins):
            bins.append(0)
        assert placed[i] == (k, bins[k])
        bins[k] += sizes[i]
    assert packing.first_fit_decreasing([], 100) == []


# 3

ITEMS = [("a", " ".join(BASE.split(" ")[20:45])), ("b", "one TWO"), ("c", None), ("d", "?!"), (None, " ".join(prose(200, 7).split(" ")[50:61])), ("a", "one two")]


@pytest.mark.parametrize("block", [10**6, 80])
def test_decontamination(spark, docs, empty, block):
    bench = spark.createDataFrame(ITEMS, "item_id string, text string")
    got = tuples(decontamination.decontaminate(docs, bench, block_bytes=block), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == sorted(([i, *brute.decontamination(x, ITEMS)] for i, x in ROWS), key=str)
    spans = {r["doc_id"]: r["spans"] for r in decontamination.decontaminate(docs, bench, block_bytes=block).collect()}
    assert ROWS[10][1][spans[10][0]["start"] : spans[10][0]["end"]] == "One two"
    kept = decontamination.drop_contaminated(docs, bench, block_bytes=block)
    assert kept.columns == docs.columns and kept.count() == sum(not brute.decontamination(x, ITEMS)[-1] for _, x in ROWS)
    assert decontamination.decontaminate(empty, bench).count() == 0
    assert decontamination.decontaminate(docs, bench.limit(0)).filter("contaminated").count() == 0


def test_automaton_memory_is_in_proportion_to_its_block():
    r = random.Random(4)
    items = [(str(i), " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 8))) for _ in range(50))) for i in range(300)]
    size = decontamination.Passages(items).machine.get_stats()["total_size"]
    assert size < 80 * sum(len(x) for _, x in items)


def test_passages_equal_brute_force():
    r = random.Random(2)
    for _ in range(150):
        items = [(str(i), " ".join(r.choice("abc") for _ in range(r.randint(0, 25)))) for i in range(4)]
        text = " ".join(r.choice("abc") for _ in range(r.randint(0, 60))) + " " + " ".join(items[1][1].split()[3:17])
        n, hit, found = decontamination.Passages(items).scan(text)
        assert (n, int(hit.sum()), len(found)) == brute.decontamination(text, items)[:3]


def test_workers_hold_one_thing():
    t = overlap.t
    assert t.held("a", lambda: [1]) is t.held("a", lambda: [2])
    t.held("b", lambda: [3])
    assert list(t._held) == ["b"]
    assert list(t.task(lambda batches: iter([1, 2]))(iter([]))) == [1, 2] and not t._held
    t.held("c", lambda: [4])
    assert list(t.holding(lambda batches: iter([1]))(iter([]))) == [1] and list(t._held) == ["c"]


# 4

def test_kernel_equals_definition():
    words = ["idiot", "idxiot", "moron", "banana", "abcabcabc"]
    marks = toxicity.Landmarks([w.encode() for w in words])
    got = marks.kernel([w.encode() for w in words])
    assert np.allclose(got, [[brute.kernel(a, b, toxicity.DECAY, toxicity.REACH) for b in words] for a in words], atol=1e-5)
    assert toxicity.units("I.d-i*o't! m o r o n x") == [b"idiot", b"moronx"]


def test_toxicity_learns(spark, empty):
    r = random.Random(5)
    insults = ["idiot", "moron", "clown", "scum"]
    rows = []
    for i in range(400):
        words = prose(40, 1000 + i).split(" ")
        if i % 5 == 0:
            for _ in range(4):
                words.insert(r.randrange(len(words)), r.choice(insults))
        rows.append((i, " ".join(words)))
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)] + [(None, 1), (3, None), (999, 1)], "doc_id long, toxic int")
    test = frame(spark, [(0, prose(30, 1) + " what an id-iot and a mooron " + prose(10, 2) + " such a clown"), (1, prose(50, 3)), (2, None), (3, ""), (4, "s c u m and i d i o t you clown")])
    got = {x["doc_id"]: x for x in toxicity.toxicity_scores(test, docs, labels).collect()}
    assert [got[i]["predicted"] for i in range(5)] == [1, 0, 0, 0, 1] and all(0 <= x["score"] <= 1 for x in got.values())
    assert toxicity.drop_toxic(test, docs, labels).count() == 3
    assert toxicity.toxicity_scores(test, docs, labels.filter("toxic = 0")).agg(F.max("score")).first()[0] == 0
    assert toxicity.toxicity_scores(test, empty, labels.limit(0)).count() == 5 and toxicity.toxicity_scores(empty, docs, labels).count() == 0


def test_toxicity_with_few_labels(spark):
    bad, good = ["you idiot", "such a idiot here", "an idiot wrote this", "idiot and idiot"], ["nice day", "a walk in town", "the sun and the sea", "bread with butter"]
    docs = frame(spark, list(enumerate(bad + good)))
    labels = spark.createDataFrame([(i, int(i < 4)) for i in range(8)], "doc_id long, toxic int")
    # clashing extra columns, ties, a very long text
    test = frame(spark, [(0, "you idiot"), (1, "nice day"), (2, "nice day"), (3, "bread and sea " * 20_000), (4, "the id-iot")]).withColumn("h", F.lit("x")).withColumn("predicted", F.lit("y"))
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(test, docs, labels).collect()}
    assert got[0] > 2 * got[1] and got[4] > got[1] and got[1] == got[2] and got[3] < got[0]
    assert toxicity.drop_toxic(test, docs, labels).columns == test.columns


def test_toxicity_trains_on_whole_texts_once(spark):
    rows = [(i, "copy of a text") for i in range(50)] + [(60, "x" * 30_000 + " end"), (61, "y" * 300_000)] + [(70 + i, f"other {i}") for i in range(9)]
    labels = spark.createDataFrame([(i, int(i == 60)) for i, _ in rows] + [(60, 0)], "doc_id long, toxic int")
    got, share = toxicity.training_rows(overlap.t.text_frame(frame(spark, rows), "doc_id", "text"), labels)
    assert ("x" * 30_000 + " end", 1) in got and len(got) == 11 and share == 1 / 12
    assert len(toxicity.training_rows(overlap.t.text_frame(frame(spark, rows), "doc_id", "text"), labels, rows=2)[0]) == 3


def test_toxicity_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = toxicity.op4_toxicity(spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    found = {(r["toxic"], r["predicted"]): r["count"] for r in got.groupBy("toxic", "predicted").count().collect()}
    assert found[1, 1] >= 0.9 * (found[1, 1] + found.get((1, 0), 0)) and found.get((0, 1), 0) <= 0.02 * found[0, 0]


# 5

def test_near_duplicates_recall(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = tuples(near_duplicates.op5_jaccard_join(spark, "/root/testdata/sf0.01"), "doc_id", "class_id", "n_links")
    want = sorted(map(list, brute.near_duplicates([(r["doc_id"], r["text"]) for r in docs.collect()])), key=str)
    assert sum(r[2] for r in got) >= 0.99 * sum(r[2] for r in want) and sum(a != b for a, b in zip(got, want)) <= 5


@pytest.mark.parametrize("block", [near_duplicates.BLOCK, 2])
def test_near_duplicates(docs, empty, monkeypatch, block):
    monkeypatch.setattr(near_duplicates, "BLOCK", block)
    got = tuples(near_duplicates.near_duplicates(docs), "doc_id", "class_id", "n_links")
    assert got == sorted(map(list, brute.near_duplicates(ROWS)), key=str)
    assert near_duplicates.near_duplicates(empty).count() == 0
    kept = near_duplicates.drop_near_duplicates(docs)
    classes = {c for _, c, n in brute.near_duplicates(ROWS)}
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {None if c == 0 else c for c in classes}  # a row without an id is first of its class
    assert kept.count() == len(classes)


@pytest.mark.parametrize("block", [4, 16])
def test_near_duplicates_of_large_groups(spark, monkeypatch, block):
    monkeypatch.setattr(near_duplicates, "BLOCK", block)
    base, other = prose(400, 700), prose(300, 701)
    rows = [(i, near(base, i, i % 5)) for i in range(40)] + [(40 + i, near(base, 40 + i, 9)) for i in range(12)] + [(60 + i, near(other, i, 6)) for i in range(10)] + [(80, base), (81, base)]
    got = tuples(near_duplicates.near_duplicates(frame(spark, rows)), "doc_id", "class_id", "n_links")
    assert got == sorted(map(list, brute.near_duplicates(rows)), key=str)


def test_prefix_length():
    assert near_duplicates.prefix_length(0.8) == 4 and near_duplicates.prefix_length(0.99) == 8
    with pytest.raises(ValueError):
        near_duplicates.prefix_length(0.05)


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 6 and 8

@pytest.mark.parametrize("hot", [overlap.HOT, 1])
def test_substring_dedup(docs, empty, monkeypatch, hot):
    monkeypatch.setattr(overlap, "HOT", hot)
    got = tuples(substring_dedup.substring_duplicates(docs), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(map(list, brute.substring_dedup(ROWS)), key=str)
    assert substring_dedup.substring_duplicates(empty).count() == 0
    kept = substring_dedup.drop_duplicate_passages(docs)
    assert kept.columns == docs.columns and kept.count() == len(ROWS)
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert texts[0] == BASE and texts[4] == "" and texts[1] is None and texts[3] == ROWS[3][1]


@pytest.mark.parametrize("hot", [overlap.HOT, 1, 0])
def test_substring_dedup_of_repeats_in_a_document(spark, monkeypatch, hot):
    monkeypatch.setattr(overlap, "HOT", hot)
    passage, before, after = prose(60, 201), prose(50, 202), prose(50, 203)
    own = f"{before} {passage} {after}"
    rows = [
        (1, f"{prose(30, 204)} {passage} {prose(30, 205)}"),
        (2, f"{own} {prose(20, 206)} {own}"),  # twice in one row
        (3, f"{prose(30, 207)} {own} {own} {prose(5, 208)} {own}"),
        (4, f"{prose(40, 209)} {passage} {prose(45, 210)}"), (4, f"{prose(33, 211)} {prose(40, 209)} {passage} {prose(45, 210)}"),  # an id repeated
        (5, own[: len(own) // 2]), (5, own[: len(own) // 2]),
    ]
    got = tuples(substring_dedup.substring_duplicates(frame(spark, rows)), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(map(list, brute.substring_dedup(rows)), key=str)
    assert dict((r[0], r[2]) for r in got)[2] == 120


@pytest.mark.parametrize(("hot", "keep_first"), [(overlap.HOT, False), (1, False), (1, True)])
def test_suffix_dedup(docs, empty, monkeypatch, hot, keep_first):
    monkeypatch.setattr(overlap, "HOT", hot)
    rows = suffix_dedup.suffix_duplicates(docs, keep_first)
    if not keep_first:
        got = tuples(rows, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
        assert got == sorted(map(list, brute.suffix_dedup(ROWS)), key=str)
    else:
        unique = [(i, x) for i, x in ROWS if i is not None and i != 7]
        got = tuples(suffix_dedup.suffix_duplicates(docs.filter("doc_id IS NOT NULL AND doc_id <> 7"), True), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
        assert got == sorted(map(list, brute.suffix_dedup(unique, keep_first=True)), key=str)
    assert suffix_dedup.suffix_duplicates(empty).count() == 0


# 7

@pytest.mark.parametrize(("text", "want"), [
    (None, (0, 0, None, None, "", "", 0.0)), ("Under the MIT License, under the mit license", (8, 2, 0, 4, "mit", "mit", 1.0)),
    ("Apache License, Version 2.0 or CC BY-NC", (9, 2, 0, 6, "apache-2,cc-by-nc", "apache-2,cc-by-nc", 0.2)), ("# SPDX-License-Identifier: (MIT OR GPL-3.0-only) AND ISC\n", (11, 0, None, None, "", "gpl-3,isc,mit", 1.0)),
    ("SPDX-License-Identifier: MIT and this file is part of foo", (11, 0, None, None, "", "", 0.0)), ("SPDX-License-Identifier: MIT or later versions", (7, 0, None, None, "", "", 0.0)),
    ("The word spdx license identifier is explained here", (8, 0, None, None, "", "", 0.0)), ("SPDX-License-Identifier: MIT WITH (foo)", (6, 0, None, None, "", "", 0.0)),
    ("/* SPDX-License-Identifier: BSD-3-Clause OR LicenseRef-own */\nint x;", (11, 0, None, None, "", "bsd,licenseref-own", 1.0)), ("SPDX-License-Identifier: GPL-2.0-or-later and Linux", (10, 0, None, None, "", "", 0.0)),
    ("spdx license identifier: MIT", (4, 0, None, None, "", "", 0.0)), ("<!-- SPDX-License-Identifier: ISC -->", (4, 0, None, None, "", "isc", 1.0)),
    ("SPDX-License-Identifier: (MIT", (4, 0, None, None, "", "", 0.0)), ("SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0", (12, 0, None, None, "", "gpl-2", 0.7)), ("the smith license", (3, 0, None, None, "", "", 0.0)),
])
def test_license_scan(text, want):
    got = licenses.scan(text)
    assert got[:7] == want or (got[:6], round(got[6], 9)) == (want[:6], want[6])


def test_license_rows(docs, empty):
    many = [*ROWS, (50, "under the mit license, " * 3000 + "CC-BY NC"), (51, "x under the MIT license under the mit license"), (51, "apache license version 2"), (52, "under the mit licenses")]
    got = tuples(licenses.license_scan(frame(docs.sparkSession, many).withColumn("labels", F.lit("clash"))), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert got == sorted(([i, *brute.license_places(x)] for i, x in many), key=str)
    assert licenses.license_scan(docs).count() == len(ROWS) and licenses.license_scan(empty).count() == 0


@pytest.mark.parametrize("tokens", [["A", "or", "B", "and", "C"], ["(", "A", "or", "B", ")", "and", "C"], ["A", "with", "E", "or", "B"]])
def test_expressions(tokens):
    free = {"a": 0.2, "b": 0.9, "c": 0.4}
    licenses.FREEDOM.update(free)
    want = {3: max(0.2 + 0.8 / 2, 0.9)}.get(len([t for t in tokens if t == "with"]) * 3, max(0.2, min(0.9, 0.4)) if tokens[0] == "A" else min(max(0.2, 0.9), 0.4))
    assert licenses.evaluate(tokens)[1] == want
    for k in free:
        del licenses.FREEDOM[k]


# 9

@pytest.mark.parametrize("stretch", [language.STRETCH, 7, 2])
def test_cross_parsing_equals_greedy_parse(monkeypatch, stretch):
    monkeypatch.setattr(language, "STRETCH", stretch)
    r = random.Random(stretch)
    samples = {"a": b"banana bandana cabana" * 3, "b": "the quick brown fox jumps ßç".encode(), "c": "".join(r.choice("abn ") for _ in range(500)).encode()}
    model = language.Model(samples)
    texts = ["banana fox", "QUICK bandana!", "zzz", "", "x" * 40, "banana bandana cabana" * 9, "".join(r.choice("abndcß fx") for _ in range(900)), "ç" * 30]
    data, off = overlap.t.string_buffers(pa.array(texts))
    got = model.phrases(data, off)
    for i, text in enumerate(texts):
        for k, lang in enumerate(model.langs):
            assert got[i, k] == brute.phrases(language.symbols(np.frombuffer(text.encode(), np.uint8)).tobytes(), samples[lang])


def test_language_sample_is_whole_texts_once(spark):
    rows = [("same text in all rows", "x")] * 60 + [(f"other words {i} " + "é" * 50, "x") for i in range(3)] + [("y" * 3000, "y"), (None, "y"), ("z", None)]
    got = language.learn(spark.createDataFrame(rows, "text string, lang string"))
    assert got["y"] == b"y" * 3000 and got["x"].count(b"same text") == 1 and got["x"].count(b"other words") == 3
    bounded = language.learn(spark.createDataFrame(rows, "text string, lang string"), sample_bytes=10)
    assert bounded["y"] == b"y" * 3000 and bounded["x"] in {x.encode() for x, _ in rows if x}


def test_language_of_held_out_rows(spark):
    got = language.op9_language(spark, "/root/testdata/sf0.01").filter("held_out").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id").filter("lang IS NOT NULL")
    assert got.filter("lang_pred = lang").count() >= 0.97 * got.count()


def test_language(spark, empty):
    r = random.Random(9)
    words = {"x": ["alpha", "beta", "gamma", "delta"], "y": ["uno", "dos", "tres", "quatro"], "z": ["één", "twéé", "drïe"]}
    rows = [(i, " ".join(r.choice(words[lang]) for _ in range(30)), lang) for i, lang in enumerate(["x", "y", "z"] * 30)]
    ties = spark.createDataFrame([(i, "same words", lang) for i, lang in enumerate(["q", "p"])], "doc_id long, text string, lang string")
    one = frame(spark, [(0, "same words")]).withColumn("h", F.lit("clash")).withColumn("nth", F.lit(1))
    assert language.identify_languages(one, ties).first()["lang_pred"] == "p"
    train = spark.createDataFrame([*rows, (900, "alpha", None), (901, None, "x")], "doc_id long, text string, lang string")
    test = frame(spark, [(0, "gamma alpha delta"), (1, "TRES DOS UNO!"), (2, "drïe één"), (3, None), (4, "123 ... !"), (5, ""), (6, "uno dos " * 5000)])
    got = {x["doc_id"]: (x["lang_pred"], x["score"]) for x in language.identify_languages(test, train).collect()}
    assert [got[i][0] for i in range(7)] == ["x", "y", "z", "und", "und", "und", "y"] and all(0 <= s <= 1 for _, s in got.values())
    assert {x["lang_pred"] for x in language.identify_languages(test, train.limit(0)).collect()} == {"und"}
    assert language.identify_languages(empty, train).count() == 0


# 10

@pytest.fixture(scope="module")
def field():
    return extraction.Field(extraction.labelled_pages())


def test_viterbi_finds_the_best_path(field):
    page = extraction.labelled_pages(3, seed=50)[0][0][:9]

    def score(path):
        s = sum(field.rows[i][y] for ids, y in zip(page, path) for i in ids)
        return s + sum(field.move[a][b] for a, b in zip(path, path[1:]))

    best = max(([int(b) for b in f"{k:0{len(page)}b}"] for k in range(2 ** len(page))), key=score)
    assert field.decode(page) == best


@pytest.mark.parametrize(("strange", "least"), [(0.0, 0.97), (1.0, 0.95)])
def test_held_out_pages(field, strange, least):
    pages = extraction.labelled_pages(150, 99, strange)
    right = sum(a == b for found, y in pages for a, b in zip(field.decode(found), y))
    assert right / sum(len(y) for _, y in pages) > least


def test_blocks():
    page = '<p>one&amp;two <b>three<br>four<p>five<script>if (a < b) "</p>"</script><ul><li>six<li>seven</ul><!-- no --><div hidden>x</div>eight'
    assert [b.text for b in html_blocks.blocks(page)] == ["one&two three four", "five", "six", "seven", "eight"]
    assert html_blocks.blocks(None) == [] and html_blocks.blocks("<p") != None  # noqa: E711
    assert [b.text for b in html_blocks.blocks("a < b and <i>c</i> &lt;d&gt;")] == ["a < b and c <d>"]
    assert [b.text for b in html_blocks.blocks("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds<object>seen</object></p>")] == ["so x=2 holdsseen"]
    html_blocks.blocks("<div " * 20_000)


@pytest.mark.parametrize(("attributes", "shown"), [
    ('class="overflow-hidden"', True), ("href='/hidden-valley'", True), ('title="Hidden gems"', True), ('aria-hidden="false"', True), ('data-hidden="1" data-style="display:none"', True),
    ('title="a hidden b" class=hidden', True), ('style="--display:nonesuch"', True), ('aria-hidden="not true"', True), ("hidden", False), ('class="x" HIDDEN=""', False), ("hidden/", False),
    ('style="color: red; display : none"', False), ("style=display:none", False), ("aria-hidden=true", False), ("id='x'aria-hidden = 'TRUE'", False),
])
def test_hidden_attributes(attributes, shown):
    for tag in ("div", "a"):
        assert [b.text for b in html_blocks.blocks(f"<p>one</p><{tag} {attributes}>two</{tag}><p>three")] == (["one", "two", "three"] if shown else ["one", "three"])


@pytest.mark.parametrize(("markup", "left"), [
    ('<svg width="1" />', []), ("<math/>", []), ("<svg/><p>kept</p><svg><text>gone</text></svg>", ["kept"]), ("<template/>", []), ("<canvas>", []), ("<object data=x>", []), ("<noscript>", []),
    ("<svg width=10/><text>gone</text></svg>", []), ("<svg><title/><path d='M0'/></svg>", []), ("<script src=x /></script>", []),
])
def test_elements_without_an_end_tag(markup, left):
    assert [b.text for b in html_blocks.blocks(f"<p>one</p>{markup}<p>two</p>")] == ["one", *left, "two"]
    assert len(html_blocks.blocks("<p>x</p><svg>" * 20_000)) == 20_000


def test_extraction(spark, field):
    nav = "<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>About</a></li></ul></nav>"
    body = "<h1>A title</h1><p>First paragraph of some length, with  a\n few words &eacute;.</p><p>Second one.</p>"
    page = f"<html><body>{nav}<div class='ad'>Buy this now and save.</div><article>{body}</article><section class='comments'><p>Nice post, thanks a lot.</p></section><footer>&copy; me</footer></body></html>"
    rows = spark.createDataFrame([(1, "u", page, "x"), (2, None, None, "x"), (3, "u", "", "x"), (1, "u", page, "x")], "page_id long, url string, html string, text string")
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in extraction.extract_pages(rows).orderBy("page_id").collect()]
    want = "A title\n\nFirst paragraph of some length, with a few words é.\n\nSecond one."
    assert got == [(1, want, len(want)), (1, want, len(want)), (2, "", 0), (3, "", 0)]
    assert extraction.extract_pages(rows.limit(0)).count() == 0


def test_extraction_of_test_pages(spark, field):
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        parts = [re.sub(r"<[^>]*>", lambda m: " " if m[0] == "<br>" else "", s) for s in re.split(r"</?(?:p|h1)\b[^>]*>", inner)]
        want = "\n\n".join(x for x in (" ".join(html_module.unescape(s).split()) for s in parts) if x)
        assert extraction.extract(field, r["html"]) == want
