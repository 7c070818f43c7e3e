"""The columns of operators 1, 7 and 11 that SQL can express, as queries of their own with their SQL.

They are the operators' own results without what their methods add.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import licenses, repetition, secrets


def base_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.op1_repetition(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def base_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.op7_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def base_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.op11_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


QUERIES = {"base_repetition": base_repetition, "base_licenses": base_licenses, "base_secrets": base_secrets}

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_DOCS = "d AS (SELECT row_number() OVER () AS u, doc_id, coalesce(text, '') AS text FROM documents)"


def _any_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(_any_case(w).replace("_", "_?") for w in ("password", "passwd", "secret", "token", "api_key"))
_BEFORE = f"""(?:{_NAMES})["'']?\\x20*[:=]\\x20*["'']?"""
_ASSIGN = f"{_BEFORE}[A-Za-z0-9+/_.=-]+"


def _places(kind: str, rank: int, pattern: str, good: str) -> str:
    """Matches of a pattern with their start, from the lengths of what is before them."""
    return f"""SELECT u, '{kind}' AS kind, {rank} AS rank, m, CAST(list_sum(list_transform(parts[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a
    FROM (SELECT u, found, parts, i, found[i] AS m FROM (SELECT u, regexp_extract_all(text, '{pattern}') AS found, string_split_regex(text, '{pattern}') AS parts, unnest(range(1, len(regexp_extract_all(text, '{pattern}')) + 1)) AS i FROM d)) WHERE {good}"""


ORACLE = {
    "base_repetition": f"""
WITH {_DOCS}, w AS (SELECT u, doc_id, text, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM d),
wins AS (SELECT u, i, array_to_string(words[i:i + 7], ' ') AS win FROM (SELECT u, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
again AS (SELECT u, i FROM (SELECT u, i, count(*) OVER (PARTITION BY u, win) AS n FROM wins) WHERE n > 1),
hit AS (SELECT u, count(DISTINCT w) AS n FROM (SELECT u, unnest(range(i, i + 8)) AS w FROM again) GROUP BY 1),
lines AS (SELECT u, count(*) - count(DISTINCT line) AS n FROM (SELECT u, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY 1)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  coalesce(lines.n, 0) AS n_dup_lines, coalesce(hit.n, 0) AS n_repeat_words, len(words) < 20 OR 100 * coalesce(hit.n, 0) > 30 * len(words) AS base_failed
FROM w LEFT JOIN hit ON hit.u = w.u LEFT JOIN lines ON lines.u = w.u""",
    "base_licenses": f"""
WITH {_DOCS}, w AS (SELECT u, doc_id, list_filter(string_split_regex(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS words FROM d),
p(phrase, size, label) AS (VALUES {", ".join(f"('{k}', {k.count(' ') + 1}, '{v}')" for k, v in licenses.BASE.items())}),
places AS (SELECT u, label, i FROM (SELECT u, words, label, phrase, size, unnest(range(1, len(words) - size + 2)) AS i FROM w, p WHERE len(words) >= size) WHERE array_to_string(words[i:i + size - 1], ' ') = phrase),
s AS (SELECT u, count(*) AS n, min(i) - 1 AS a, max(i) - 1 AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY 1)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, a AS first_word, b AS last_word, coalesce(labels, '') AS base_labels FROM w LEFT JOIN s ON s.u = w.u""",
    "base_secrets": f"""
WITH {_DOCS}, m AS (
  {_places("assign", 0, _ASSIGN, f"length(regexp_extract(m, '^{_BEFORE}([A-Za-z0-9+/_.=-]+)$', 1)) >= 6")}
  UNION ALL {_places("access", 1, "AKIA[A-Z0-9]+", "length(m) >= 20")}
  UNION ALL {_places("hex", 2, "[0-9a-f]+", "length(m) >= 24")}),
s AS (SELECT u, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
  string_agg(kind || ':' || a || ':' || (a + length(m)), ',' ORDER BY a, rank) AS joined FROM m GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(joined, '')) AS base_sha256 FROM d LEFT JOIN s ON s.u = d.u""",
}
