from __future__ import annotations

import hashlib
import math
import random
import re
import string

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from repopulse.llm import secrets

rng = random.Random(11)


def key(n, letters=string.ascii_letters + string.digits):
    return "".join(rng.choice(letters) for _ in range(n))


LONG = " ".join(f"wörd{i % 7}" for i in range(40_000)) + f" token={key(20)} " + "x" * 3000 + key(9000) + "0" * 50
TEXTS = [
    None, "", " \n", "no secrets at all", "password = abcde", "password: \"abcdef\" PASSWD='xyz123'", f"key AKIA{key(16, string.ascii_uppercase)} x", "AKIA12345",
    f"a {key(30, '0123456789abcdef')} b", "deadbeef" * 3, f"see https://host.example/{key(30)}", f"sha256: {key(64, '0123456789abcdef')}", "0" * 60 + "a1b2",
    "id 123e4567-e89b-12d3-a456-426614174000", f"ghp_{key(36)} and ghp_{key(36)}", "api-key=abcdefgh apikey : 12345678 kſecret: 123456 ſecret=1234567 Toĸen:1234567",
    "é" * 5 + key(40) + "é " + key(40), f"secret=secret=secret=abcdef token token:{key(30)}", "tokentoken==abcdef api_key'  = 'a.b.c.d-e", f"AKIAAKIA{key(20, string.digits)}", LONG,
]


def brute_base(text):
    text, found = text or "", []
    i = 0
    while i < len(text):  # the pattern at each place, left to right
        m = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)""").match(text, i)
        if m:
            if len(m[1]) >= 6:
                found.append((i, 0, m.end(), "assign"))
            i = m.end()
        else:
            i += 1
    for rank, kind, pattern, least in ((1, "access", "AKIA[A-Z0-9]+", 20), (2, "hex", "[0-9a-f]+", 24)):
        found += [(m.start(), rank, m.end(), kind) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return sorted(found)


@pytest.fixture(scope="module")
def got():
    return secrets.Scanner().scan(pa.array(TEXTS))


def test_base_equals_brute_force(got):
    for i, text in enumerate(TEXTS):
        want = brute_base(text)
        joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
        assert got["base_sha256"][i] == hashlib.sha256(joined.encode()).hexdigest(), text
        assert [got[f"n_{k}"][i] for k in ("assign", "access", "hex")] == [sum(x[3] == k for x in want) for k in ("assign", "access", "hex")]
        assert set(joined.split(",")) - {""} <= set(got["spans"][i].split(","))


@pytest.mark.parametrize("seed", range(8))
def test_windows_have_the_entropy_of_a_recount(seed):
    r = random.Random(seed)
    run = "".join(r.choice(["0123456789abcdef", "aab1", string.ascii_letters + string.digits][r.randrange(3)]) for _ in range(r.randint(15, 90))) + "0" * r.randrange(40)
    for bits in (2.0, 2.9, 3.75):
        marked = set()
        for i in range(len(run) - secrets.WINDOW + 1):
            w = run[i : i + secrets.WINDOW]
            h = -sum(w.count(c) / len(w) * math.log2(w.count(c) / len(w)) for c in set(w))
            if h >= bits + 1e-9 and sum(c.isdigit() for c in w) >= 2 and sum(c.isalpha() for c in w) >= 2:
                marked |= set(range(i, i + secrets.WINDOW))
        spans = secrets.entropy_spans(run.encode(), bits)
        assert {i for a, b in spans for i in range(a, b)} == marked and all(b < c for (_, b), (c, _) in zip(spans, spans[1:]))


def test_the_method_finds_keys_and_leaves_public_things(got):
    kinds = [{s.split(":")[0] for s in x.split(",")} - {"", "assign", "access", "hex"} for x in got["spans"]]
    at = {i for i, k in enumerate(kinds) if k}
    assert 14 in at and 16 in at and not at & {0, 1, 2, 3, 4, 5, 9, 10, 11, 12, 13}
    assert got["spans"][16].split(",")[0] == "entropy_base64:5:45"
    assert got["n_entropy"][14] == 2


def test_random_keys_are_found_and_words_are_not():
    keys = [f"{a} {key(n)} {b}" for n in (24, 32, 40, 64) for a, b in (("the", "end"), ("x=", ";"), ('"', '"')) for _ in range(20)]
    found = secrets.Scanner().scan(pa.array(keys))["spans"]
    assert sum(map(bool, found)) >= 0.95 * len(keys)
    words = [" ".join("".join(rng.choice(["an", "er", "the", "in", "keit", "ung"]) for _ in range(12)) + rng.choice(["", "7", "_2", "-2024"]) for _ in range(30)) for _ in range(50)]
    assert not any(secrets.Scanner().scan(pa.array(words))["spans"])


def test_cases_on_spark(spark, got):
    rows = spark.createDataFrame([(i, x, "a", "b") for i, x in enumerate(TEXTS)] + [(14, TEXTS[14], "a", "b"), (None, TEXTS[5], "a", "b")], "doc_id long, text string, spans string, row string").repartition(3)
    out = secrets.scan_secrets(rows)
    assert out.columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy"]
    by = {}
    for r in out.collect():
        by.setdefault(r.doc_id, []).append(r.spans)
    assert len(by[14]) == 2 and by[14][0] == by[14][1] and by[None] == [got["spans"][5]]
    assert [by[i][0] for i in range(len(TEXTS))] == got["spans"]
    assert secrets.scan_secrets(rows.limit(0)).count() == 0
    assert not secrets.scan_secrets(rows.withColumn("text", F.lit(None))).filter("spans <> ''").count()


def test_redacted_texts_have_no_secrets(spark):
    rows = spark.createDataFrame([(i, x, i) for i, x in enumerate(TEXTS)], "doc_id long, text string, spans long")
    out = {r.doc_id: r.text for r in secrets.redacted(rows).collect()}
    assert out[5] == "[secret]\" [secret]'" and out[0] is None and out[3] == TEXTS[3]
    assert not any(secrets.Scanner().scan(pa.array(list(out.values()), pa.string()))["n_hex"])
