"""Packing 2: documents into fixed-length token sequences by first-fit decreasing.

Each document is tokenised and closed with id 0.  Whole runs of ``capacity`` ids fill
a sequence alone; what is left of each document goes, longest first, into the first
sequence with room.  A tournament tree over the free capacities finds that sequence in
logarithmic time.  Documents are dealt at random into groups of bounded size and each
group is packed by itself, so groups run in parallel and no task sees the corpus.

Defined cases: a null text is empty and holds the closing id only; equal rows and rows
without an id are packed like any other (equal rows are spread over groups); ties in
length go by id, tokens and a hash; a very long text is tokenised whole, in memory in
proportion to it; an empty table gives an empty result; other columns are ignored, whatever
their names.  Ids of a special token's string inside a text are what the tokenizer library
gives by default.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as t

CAPACITY = 1024
GROUP_DOCS = 4096
END_ID = 0
#: Words kept with their ids by each worker; beyond it the cache starts again.
CACHE_WORDS = 150_000

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)
TOKENISED = "doc_id long, doc_tokens long, crcs array<long>, deal long"
_TIGHT = re.compile(r" \s|\s |\A |\s\Z| \Z")


class Encoder:
    """Ids of a text as little-endian 32-bit bytes.

    A byte-level tokenizer of this family never joins characters over a single space
    between two words, so a text is cut there and each distinct word is tokenised once
    per worker.  Texts with other white space around spaces are tokenised whole.  The
    vocabulary's special tokens stand by themselves, as in its file.
    """

    def __init__(self, path: str) -> None:
        import base64

        import tiktoken
        from public_tokenizers import PATTERN

        ranks = Path(path).with_suffix(".tiktoken")
        self.ids = {x["content"]: x["id"] for x in json.loads(Path(path).read_text())["added_tokens"]}
        longest = sorted(self.ids, key=lambda x: (-len(x), x))
        self.special = re.compile(f"({'|'.join(map(re.escape, longest))})") if longest else None
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.open("rb"))}
        self.fast = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})
        encode = self.fast.encode_ordinary

        class Words(dict):
            def __missing__(self, word: str) -> bytes:
                if len(self) >= CACHE_WORDS:
                    self.clear()
                self[word] = ids = np.array(encode(f" {word}"), "<u4").tobytes()
                return ids

        self.words = Words()

    def __call__(self, text: str) -> bytes:
        if self.special is None:
            return self.ordinary(text)
        # the parts around special tokens are tokenised by themselves
        return b"".join(np.array([self.ids[x]], "<u4").tobytes() if x in self.ids else self.ordinary(x) for x in self.special.split(text) if x)

    def ordinary(self, text: str) -> bytes:
        if _TIGHT.search(text):
            return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()
        first, *rest = text.split(" ")
        head = np.array(self.fast.encode_ordinary(first), "<u4").tobytes()
        return head + b"".join(map(self.words.__getitem__, rest))


def encoder(path: str) -> Encoder:
    """One encoder for each worker process."""
    return t.held(f"encoder {path}", lambda: Encoder(path))


def _tokenise(path: str, capacity: int):
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, width, seen = encoder(path), 4 * capacity, {}
        for part in t.pieces(batches):
            ids, crcs, tokens, deal = part.column(0).to_pylist(), [], [], []
            for doc_id, text in zip(ids, part.column(1).to_pylist(), strict=True):
                data = (encode(text) if text else b"") + end
                tokens.append(len(data) // 4)
                crcs.append([zlib.crc32(data[i : i + width]) for i in range(0, len(data), width)])
                key = zlib.crc32(data, (doc_id or 0) & 0xFFFFFFFF)
                seen[key] = again = seen.get(key, -1) + 1
                deal.append(zlib.crc32(b"%d %d %d" % (key, doc_id or 0, again)))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(tokens, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(deal, pa.int64())],
                ["doc_id", "doc_tokens", "crcs", "deal"],
            )

    return run


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each size; each goes, longest first, to the first bin with room.

    Leaves of the tournament tree hold the free capacity of a bin, inner nodes the
    larger one of their two children; walking left while the left child is large enough
    finds the first bin.
    """
    leaves = 1 << max(len(sizes) - 1, 0).bit_length()
    tree = [capacity] * (2 * leaves)
    out: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        node, size = 1, sizes[i]
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        out[i] = node - leaves, capacity - tree[node]
        tree[node] -= size
        while node > 1:
            node //= 2
            tree[node] = max(tree[2 * node], tree[2 * node + 1])
    return out


def _pack(capacity: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "doc_tokens", "deal"], kind="stable")
        base = int(group["bucket"].iloc[0]) << 32
        tokens = group["doc_tokens"].to_numpy(np.int64)
        full, rest = tokens // capacity, tokens % capacity
        crcs = group["crcs"].tolist()
        has = np.flatnonzero(rest)
        place = first_fit_decreasing(rest[has].tolist(), capacity)
        bins = 1 + max((b for b, _ in place), default=-1)
        doc = np.r_[np.repeat(np.arange(len(group)), full), has]
        nth = np.r_[np.arange(full.sum()) - np.repeat(np.cumsum(full) - full, full), full[has]]
        return pd.DataFrame({
            "doc_id": group["doc_id"].array[doc],
            "start": nth * capacity,
            "length": np.r_[np.full(full.sum(), capacity), rest[has]],
            "ids_crc32": np.fromiter((crcs[d][k] for d, k in zip(doc.tolist(), nth.tolist(), strict=True)), np.int64, len(doc)),
            "doc_tokens": tokens[doc],
            "sequence_id": base + np.r_[bins + np.arange(full.sum()), np.array([b for b, _ in place], np.int64)],
            "offset": np.r_[np.zeros(full.sum(), np.int64), np.array([o for _, o in place], np.int64)],
        })

    return run


def pack_documents(
    docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, group_docs: int = GROUP_DOCS,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per piece: which ids of which document stand where in which sequence.

    ``tokenizer``: path of the tokenizer file, the ranks file of the same vocabulary
    beside it.  The shuffle moves lengths and checksums only.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    groups = max(1, -(-docs.count() // group_docs))
    tokens = t.text_frame(docs, id_col, text_col).mapInArrow(t.holding(_tokenise(tokenizer, capacity)), TOKENISED)
    return tokens.withColumn("bucket", F.col("deal") % groups).groupBy("bucket").applyInPandas(_pack(capacity), PIECES)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
