"""The registered queries: oracle SQL, columns and folds."""

from __future__ import annotations

import zlib
from pathlib import Path

import duckdb
import pytest

from repopulse.llm import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")

COLUMNS = {
    "op1_repetition": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op2_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op3_decontamination": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op4_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op5_jaccard_join": ["doc_id", "class_id", "n_links"],
    "op6_substring_dedup": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op7_licenses": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
    "op8_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op9_language": ["doc_id", "held_out", "lang_pred", "score"],
    "op10_extraction": ["page_id", "url", "text", "n_chars"],
    "op12_conversation_repair": ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"],
    "op13_collocations": ["lang", "rank", "phrase", "a", "l", "r", "n", "score"],
    "op11_secrets": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
}


@pytest.fixture(scope="module")
def results(spark):
    return {name: query(spark, SF).toPandas() for name, query in registry.QUERIES.items()}


def test_columns_and_rows(spark, results):
    docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name, columns in COLUMNS.items():
        assert set(columns) <= set(results[name].columns)
        if name not in ("op2_packing", "op10_extraction", "op12_conversation_repair", "op13_collocations"):
            assert len(results[name]) == docs
    assert len(results["op10_extraction"]) == spark.read.parquet(f"{SF}/pages.parquet").count()


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_oracle(results, name):
    c = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    want, got = c.execute(registry.ORACLE_SQL[name]).df(), results[name]
    assert sorted(want.columns) == sorted(got.columns)
    assert sorted(map(tuple, want[sorted(want.columns)].values.tolist()), key=str) == sorted(map(tuple, got[sorted(got.columns)].values.tolist()), key=str)


@pytest.mark.parametrize(("name", "folds", "held"), [("op4_toxicity", 4, 2), ("op9_language", 3, 1)])
def test_folds(results, name, folds, held):
    got = results[name]
    assert (got.held_out == [zlib.crc32(str(i).encode()) % folds == held for i in got.doc_id]).all() and got.score.between(0, 1).all()
    if name == "op4_toxicity":
        assert (got.predicted == (got.score >= 0.3)).all()


def test_packing_is_tight(results):
    got = results["op2_packing"]
    used = got.groupby("sequence_id").length.sum()
    assert used.max() <= 1024 and used.sum() >= 0.95 * 1024 * (len(used) - 1)
