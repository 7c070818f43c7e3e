"""Texts that once were misread: structured words, odd markup, labels that teach nothing."""

from __future__ import annotations

import random
import time

import numpy as np
import pyarrow as pa
import pytest

from repopulse.llm import html_blocks, repetition, substring_dedup, toxicity
from repopulse.llm import text as t


def thue_morse(n, a="a", b="b"):
    return "".join((a, b)[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("n", [1024, 2048, 8192])
def test_words_of_any_structure_have_their_own_hash(n):
    one, two = thue_morse(n), thue_morse(n, "b", "a")
    hashes = t.Tokens(pa.array([f"{one} {two} {one}", two])).hash
    assert hashes[0] != hashes[1] and hashes[0] == hashes[2] and hashes[1] == hashes[3]


def test_hashes_do_not_depend_on_how_spans_are_cut_up(monkeypatch):
    r = np.random.default_rng(3)
    data = r.integers(97, 100, 5000).astype(np.uint8)
    start = np.sort(r.choice(4900, 300, replace=False))
    end = start + r.integers(1, 100, 300)
    whole = t.piece_hash(data, start, end)
    monkeypatch.setattr(t, "SLICE_BYTES", 64)
    assert (t.piece_hash(data, start, end) == whole).all()
    by = {}
    for h, a, b in zip(whole.tolist(), start, end):
        assert by.setdefault(h, data[a:b].tobytes()) == data[a:b].tobytes()
    assert len(by) == len({data[a:b].tobytes() for a, b in zip(start, end)})


def test_lines_of_any_structure_are_no_duplicates():
    got = repetition.repetition_rows(pa.array([f"{thue_morse(2048)}\n{thue_morse(2048, 'b', 'a')}\n{thue_morse(2048)}"]))
    assert got["n_dup_lines"].tolist() == [1]


def test_passages_that_differ_in_one_long_word_stay(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join([*words[:30], thue_morse(1024), *words[30:]])), (2, " ".join([*words[:30], thue_morse(1024, "b", "a"), *words[30:]]))]
    out = substring_dedup.drop_duplicate_passages(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.text for r in out.collect()} == dict(rows)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p title='it's'>Hello there don't worry.</p><p>More</p>", ["Hello there don't worry.", "More"]),
        ("<p>One</p><!--><p>Two</p>", ["One", "Two"]), ("<p>One</p><!---><p>Two</p>", ["One", "Two"]), ("<p>One</p><!-- a --!><p>Two</p>", ["One", "Two"]),
        ("<p>One</p><![CDATA[ x ><p>Two</p>", ["One", "Two"]), ("<p>One</p><!-- never closed <p>Two</p>", ["One"]), ("<p>One <!-- open", ["One"]),
        ("<p a=\"x>y\">One</p><p b='>' c=d>Two</p>", ["One", "Two"]), ("<p>1 < 2 and 3 > 2</p>", ["1 < 2 and 3 > 2"]), ("<p>a</><b>b</b></p>", ["ab"]),
        ("<p a=\"never closed>One</p>", ["One"]), ("<p>One</p> tail <b", ["One", "tail <b"]),
    ],
)
def test_odd_markup(page, want):
    assert [b.text for b in html_blocks.blocks(page)] == want


@pytest.mark.parametrize("page", ["<p a x<" * 150_000, "<p a x<" * 150_000 + ">", "<p a=\">" + "<p x" * 250_000 + "\"", "<" * 1_000_000, "<!--" * 250_000, "<a b='" * 150_001])
def test_a_megabyte_of_open_tags_takes_no_time(page):
    start = time.time()
    html_blocks.blocks(page)
    assert time.time() - start < 3


@pytest.mark.parametrize("clean", [0, 1])
def test_without_a_machine_nothing_is_rejected(spark, clean):
    rows = [(i, f"you are a fool number {i}") for i in range(20)] + [(100 + i, f"you are a fool number {i}") for i in range(20 * clean)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in rows], "doc_id long, toxic int")
    assert toxicity.drop_toxic(docs, docs, labels).count() == len(rows)
    assert not toxicity.toxicity_scores(docs, docs, labels).filter("predicted = 1 OR score >= 0.3").count()


def taught(insults, seed):
    """A machine trained on 100 toxic and 200 clean invented texts, and a maker of clean sentences."""
    r = random.Random(seed)
    words = ["".join(r.choice("aeioubdfglmnprst") for _ in range(r.randint(3, 8))) for _ in range(300)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n)) + ". "
    rows = [(f"{prose(12)}{r.choice(insults)}. {prose(10)}", 1) for _ in range(100)] + [(prose(30), 0) for _ in range(200)]
    return toxicity.Model(rows), prose


@pytest.mark.parametrize(
    ("insults", "texts"),
    [
        (["you are such a pathetic idiot"], ["you idiot", "so pathetic", "you are such a pathetic idiot", "an id.iot", "you idiiot"]),
        (["you are such a pathetic idiot", "what a moron", "stupid clown you are", "shut up you idiot moron"], ["you idiot", "so pathetic", "what a moron", "that clown", "stupid thing"]),
        (["go and cut your wrists", "you are such a pathetic idiot"], ["go and cut your wrists", "you are pathetic"]),
    ],
)
def test_every_insult_of_labelled_sentences_is_learned(insults, texts):
    model, prose = taught(insults, 5)
    assert (model.score(pa.array(texts)) >= toxicity.THRESHOLD).all()
    assert (model.score(pa.array([prose(25) for _ in range(60)] + ["a nice day", None, ""])) < toxicity.THRESHOLD).all()
