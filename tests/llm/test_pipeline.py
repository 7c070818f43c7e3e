"""Each stage of the pipeline against brute force on its own input."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from repopulse.llm.overlap import kept_in

from . import brute

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = kept_in(spark, stage(spark, docs, SF), name)
        out.append(docs)
    return out


def texts(frame):
    return [(r["doc_id"], r["text"]) for r in frame.orderBy("doc_id").collect()]


def test_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "jaccard_join", "substring_dedup", "decontamination", "packing"]
    for frame in steps[1:-1]:
        assert frame.columns == steps[0].columns and frame.dtypes == steps[0].dtypes


def test_toxicity_keeps_clean_documents(spark, steps):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before, after = dict(texts(steps[0])), dict(texts(steps[1]))
    assert all(before[i] == x for i, x in after.items())
    clean = [i for i in before if labels.get(i) == 0]
    assert sum(i in after for i in clean) >= 0.9 * len(clean)


def test_jaccard_join_keeps_one_of_each_class(steps):
    rows = texts(steps[1])
    want = {c for _, c, _ in brute.near_duplicates(rows)}
    assert [i for i, _ in texts(steps[2])] == sorted(want)


def test_substring_dedup(steps):
    gone = {i: n for i, _, n, _ in brute.substring_dedup(texts(steps[2]))}
    before, after = dict(texts(steps[2])), dict(texts(steps[3]))
    assert before.keys() == after.keys()
    for i, x in after.items():
        assert x == before[i] if not gone[i] else len(x.split()) == len(brute.spaced(before[i])) - gone[i]
    assert all(r["n_chars"] == len(r["text"]) for r in steps[3].collect())


def test_decontamination(spark, steps):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    windows = {tuple(w[i : i + min(10, len(w))]) for _, x in items for w in [brute.alnum(x)] for i in range(max(len(w) - 9, 1)) if w}
    sizes = {len(w) for w in windows}
    clean = [i for i, x in texts(steps[3]) for w in [brute.alnum(x)] if not any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))]
    assert [i for i, _ in texts(steps[4])] == clean


def test_packing(steps):
    pieces = steps[5].toPandas()
    assert set(pieces.doc_id) == {i for i, _ in texts(steps[4])}
    assert (pieces.groupby("doc_id").length.sum() == pieces.groupby("doc_id").doc_tokens.first()).all() and pieces.groupby("sequence_id").length.sum().max() <= 1024


def test_run_gives_the_last_stage(spark, steps):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == steps[5].columns
    key = ["doc_id", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got.select(key).collect())) == sorted(map(tuple, steps[5].select(key).collect()))
    assert "corpus_pipeline" in sys.modules


def test_defined_cases_of_each_stage(spark, tmp_path):
    from .test_operators import BASE, ROWS, SCHEMA, prose

    insult = prose(30, 400) + " you idiot, what a moron and clown " + prose(10, 401)
    rows = [*[(i, x) for i, x in ROWS if i != 13], (30, insult), (31, prose(70_000, 402)), (32, None), (32, "")]
    train = [(100 + i, prose(40, 500 + i) + (" idiot moron clown" if i % 4 == 0 else "")) for i in range(80)]
    docs = spark.createDataFrame([(i, x, None, None, None) for i, x in rows + train], SCHEMA).withColumn("tag", F.lit("clash"))
    spark.createDataFrame([(100 + i, None, int(i % 4 == 0)) for i in range(80)] + [(None, 1, 1), (101, 0, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("a", " ".join(prose(200, 7).split(" ")[3:20])), ("b", None), (None, "")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = kept_in(spark, stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == [*SCHEMA.replace(",", "").split(" ")[::2], "tag"]
        kept[name] = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert 30 not in dict(kept["toxicity"]) and 31 in dict(kept["toxicity"])
    near = kept["jaccard_join"]
    assert [x for i, x in near if i == 32] in ([None, ""], ["", None]) and sum(i == 7 for i, _ in near) == 1 and sum(x == BASE for _, x in near) == 1
    assert 7 not in dict(kept["decontamination"]) and 31 in dict(kept["decontamination"])
    last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).toPandas()
    assert (last.groupby("sequence_id").length.sum() <= 1024).all() and set(last.doc_id.dropna().astype(int)) == {i for i, _ in kept["decontamination"] if i is not None}
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
