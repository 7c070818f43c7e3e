"""N-gram Jaccard join 5: MinHash LSH forest with exact verification.

Texts are sets of five-word shingles (A-Z lower-cased; a text of fewer words is one
shingle).  Texts with equal sets are copies and make one node.  Each node has a
signature of ``TREES`` x ``DEPTH`` minima; every tree is a prefix trie over its part of
the signature, kept sorted: the first ``least`` minima name a subtrie (one bucket), the
rest is the path below it.  Each subtrie is walked from its longest prefixes up.  Nodes
that share a prefix are compared by their signatures, and the prefix is shortened, minimum
by minimum, while nodes of the subtrie aren't linked with one another yet.  ``least`` is
where a pair at the threshold has met in some tree with the target recall.

A popular subtrie is worked on in blocks of bounded size, and a block gives one row for
each member, never its pairs: a forest of links between signatures that look alike.  The
components of these links are the groups to verify.  Each group's shingle sets are then
compared exactly, again in blocks, which gives the number of links of each member and a
forest of true links, whose components are the classes.  In a large group members are
measured against a pivot first; those near to it are linked with one another for certain,
and only the others are compared with all.

``n_links`` counts the other documents at or above the threshold, copies included.
``class_id`` is the smallest id of a document's class.

Defined cases: texts that are null or have no word have no shingles and so no links, and
are classes of their own; rows without an id take part and get the class of their text;
repeated rows are copies; ties (a pair right at the threshold) are links; a very long text
has one row of its shingles, in memory in proportion to it; other columns are ignored by
``near_duplicates`` and kept by ``drop_near_duplicates``, whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import overlap as o
from . import text as t
from .components import components

SHINGLE = 5
THRESHOLD = 0.8
TREES = 16
DEPTH = 8
#: Bits of a minimum in a path; a path is one number.
STEP = 8
RECALL = 0.9997
#: Members of a block, and their shingles; a block compares all its members.
BLOCK = 256
BLOCK_SHINGLES = 500_000
#: Signatures that agree in this share belong to one group to verify: five standard
#: deviations below the threshold.
LOOKS_ALIKE = 0.62

_rng = np.random.default_rng(5_05_2025)
_MULTIPLY = _rng.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64)


def prefix_length(threshold: float, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix with which a pair at the threshold meets in some tree with the target recall."""
    for length in range(depth, 0, -1):
        if 1 - (1 - threshold**length) ** trees >= recall:
            return length
    raise ValueError(f"{trees} trees can't reach a recall of {recall} at {threshold}")


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows, row by row and sorted, and the offsets of the rows."""
    words = t.Tokens(column, lower=True, spaced=False)
    prefix = t.prefix_hash(words.hash)
    long = words.counts >= size
    n = np.where(long, words.counts - size + 1, np.minimum(words.counts, 1))
    row = np.repeat(np.arange(len(n)), n)
    start = words.row_off[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    end = start + np.where(long, size, words.counts)[row]
    found = t.span_hash(prefix, start, end)
    by = np.lexsort((found, row))
    row, found = row[by], found[by]
    new = np.r_[True, (found[1:] != found[:-1]) | (row[1:] != row[:-1])] if len(row) else np.zeros(0, bool)
    row, found = row[new], found[new]
    return found, np.searchsorted(row, np.arange(len(n) + 1))


def _sketch(least: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in t.pieces(batches):
            found, off = shingle_sets(part.column(1), size)
            n = np.diff(off)
            has = np.flatnonzero(n)
            start = off[:-1][has]
            sums = np.add.reduceat(t.mixed(found), start) if len(has) else np.zeros(0, np.uint64)
            node = t.mixed(sums + n[has].astype(np.uint64))
            sign = np.empty((len(has), TREES * DEPTH), np.uint32)
            for k in range(TREES * DEPTH if len(has) else 0):
                sign[:, k] = np.minimum.reduceat(((found * _MULTIPLY[k] + _ADD[k]) >> np.uint64(32)).astype(np.uint32), start)
            roots = np.repeat(np.arange(TREES, dtype=np.uint64)[None], len(has), 0)
            for d in range(least):
                roots = t.mixed(roots * np.uint64(0x9E3779B97F4A7C15) + sign[:, d::DEPTH])
            paths = np.zeros((len(has), TREES), np.uint64)
            for d in range(least, DEPTH):  # STEP bits of each further minimum, the first one highest
                paths = paths << np.uint64(STEP) | t.mixed(sign[:, d::DEPTH].astype(np.uint64)) >> np.uint64(64 - STEP)
            short = (t.mixed(sign.astype(np.uint64)) & np.uint64(0xFF)).astype(np.uint8)
            at = np.full(len(n), -1)
            at[has] = np.arange(len(has))
            pick = pa.array(at, mask=at < 0)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array(node.view(np.int64)).take(pick), pa.array(n[has]).take(pick), pa.array([x.tobytes() for x in short], pa.binary()).take(pick),
                 *(pa.array(list(x.view(np.int64)), pa.list_(pa.int64())).take(pick) for x in (roots, paths))],
                ["doc_id", "tag", "node", "n", "sign", "roots", "paths"],
            )

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of sorted batches, group by group; groups are blocks, so they are small."""
    held: list[dict] = []
    last = None
    for batch in batches:
        for row in batch.to_pylist():
            key = row["bucket"], row["i"], row["j"]
            if key != last and held:
                yield held
                held = []
            last = key
            held.append(row)
    if held:
        yield held


def dealt(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows with their part of the bucket (``own``) and the parts to compare it with.  sizes: bucket, parts."""
    rows = rows.join(sizes.select("bucket", "parts"), "bucket")
    own = F.pmod(F.xxhash64("node", "bucket"), F.col("parts").cast("long")).cast("int")
    return rows.withColumn("own", own).withColumn("others", F.sequence(F.lit(0), F.col("parts") - 1)).drop("parts")


def blocks(rows: DataFrame, compare: Callable[[list[dict], np.ndarray], np.ndarray], schema: str, emit, order: str = "node") -> DataFrame:
    """Compares the members of each bucket with each other, block by block.

    rows: bucket, node, data, own and others.  A bucket is cut into parts by hash, and each
    pair of parts that is asked for is a block.  ``compare`` gives which members of a block
    are linked (a square matrix), where it is asked for (another one), ``emit`` the rows of
    a block, whose members are in ``order``.
    """
    rows = rows.withColumn("other", F.explode("others")).drop("others")
    rows = rows.select("*", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).drop("other")
    rows = rows.repartition(o.partitions(rows), "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for group in _groups(batches):
            if len(group) < 2:
                continue
            part = np.array([r["own"] for r in group])
            asked = part[:, None] != part[None] if group[0]["i"] != group[0]["j"] else ~np.eye(len(group), dtype=bool)
            out += emit(group, compare(group, asked))
            if len(out) > 20_000:
                yield _batch(out, schema)
                out = []
        if out:
            yield _batch(out, schema)

    return rows.mapInArrow(t.task(run), schema)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], [x.split()[0] for x in schema.split(", ")])


def roots(linked: np.ndarray) -> np.ndarray:
    """Smallest member that each member of a block is connected to."""
    label = np.arange(len(linked))
    while True:
        near = np.where(linked, label[None], len(label)).min(1)
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _alike(sign: np.ndarray) -> np.ndarray:
    """Which signatures look like the shingle sets are similar."""
    n, width = sign.shape
    if n <= 32:
        same = (sign[:, None] == sign[None]).sum(2)
    else:
        same = np.zeros((n, n), np.int32)
        for k in range(width):
            same += sign[:, k][:, None] == sign[:, k][None]
    chance = 1 / 256
    return (same / width - chance) / (1 - chance) >= LOOKS_ALIKE


def _climb(least: int):
    """Links inside a subtrie whose members are sorted by path."""

    def compare(group: list[dict], asked: np.ndarray) -> np.ndarray:
        sign = np.frombuffer(b"".join(r["data"] for r in group), np.uint8).reshape(len(group), -1)
        path = np.array([r["path"] for r in group], np.int64).view(np.uint64)
        linked = np.zeros(asked.shape, bool)
        tree = np.arange(len(group))
        for gone in range(DEPTH - least + 1):  # minima that the prefix has been shortened by
            head = path >> np.uint64(STEP * gone)
            first = np.flatnonzero(np.r_[True, head[1:] != head[:-1]])
            met = False
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(group)], strict=True):
                if b - a > 1 and (tree[a:b] != tree[a]).any():  # not all linked by longer prefixes
                    now = _alike(sign[a:b]) & asked[a:b, a:b]
                    met |= bool(now.any())
                    linked[a:b, a:b] |= now
            if met:
                tree = roots(linked)
        return linked

    return compare


def _verified(threshold: float):
    def compare(group: list[dict], asked: np.ndarray) -> np.ndarray:
        sets = [np.frombuffer(r["data"], np.uint64) for r in group]
        size = np.array([len(x) for x in sets])
        common = np.zeros((len(sets), len(sets)), np.int64)
        row = np.repeat(np.arange(len(sets)), size)
        _, name, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        twice = times > 1
        column = np.cumsum(twice) - 1
        keep = twice[name]
        row, name = row[keep], column[name[keep]]
        by = np.argsort(name, kind="stable")
        row, name = row[by], name[by]
        for a in range(0, int(twice.sum()), 8192):
            x = np.zeros((len(sets), 8192), np.float32)
            lo, hi = np.searchsorted(name, [a, a + 8192])
            x[row[lo:hi], name[lo:hi] - a] = 1
            common += (x @ x.T).astype(np.int64)
        union = size[:, None] + size[None] - common
        return (common >= threshold * union - 1e-9) & asked

    return compare


def _forest(group: list[dict], linked: np.ndarray) -> list[tuple]:
    root = roots(linked)
    return [(r["node"], group[k]["node"]) for r, k in zip(group, root.tolist(), strict=True) if r["node"] != group[k]["node"]]


def _counts(group: list[dict], linked: np.ndarray) -> list[tuple]:
    links = linked @ np.array([r["times"] for r in group], np.int64)
    root = roots(linked)
    return [(r["node"], group[k]["node"], n) for r, k, n in zip(group, root.tolist(), links.tolist(), strict=True) if n]


def _near_pivot(threshold: float):
    """Whether a set is so near to its group's pivot that it is linked with all others that are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                core = []
                for data, pivot in zip(part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True):
                    a, b = np.frombuffer(data, np.uint64), np.frombuffer(pivot, np.uint64)
                    common = len(np.intersect1d(a, b, assume_unique=True))
                    core.append(2 * common >= (1 + threshold) * (len(a) + len(b) - common) + 1e-9 or data == pivot)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(4)), pa.array(core)], ["node", "bucket", "times", "data", "core"])

    return run


def large_groups(sets: DataFrame, groups: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Links of large groups that follow from the distances to a pivot, and the members dealt to blocks for the rest.

    One minus the Jaccard similarity is a metric: two sets that are both within half the
    allowed distance of the pivot are near copies.  These, the core, need no comparison
    with each other, so a group of close copies costs one comparison a member.  groups:
    bucket, pivot (the member with most copies).
    """
    spark = sets.sparkSession
    rows = sets.join(groups.select("bucket", "pivot"), "bucket")
    pivots = o.kept_in(spark, rows.filter("node = pivot").select("bucket", F.col("data").alias("pivot_data")), "pivots")
    measured = rows.join(pivots, "bucket").select("node", "bucket", "times", "data", "pivot_data")
    found = o.kept_in(spark, measured.mapInArrow(t.task(_near_pivot(threshold)), "node long, bucket long, times long, data binary, core boolean"), "measured")

    def parts(of):
        n, size = F.count_if(of), F.coalesce(F.sum(F.when(of, F.octet_length("data"))), F.lit(0))
        return F.ceil(F.greatest(n / BLOCK, size / (8 * BLOCK_SHINGLES))).cast("int")

    core = F.col("core")
    tally = found.groupBy("bucket").agg(parts(core).alias("cores"), parts(~core).alias("rest"), F.sum(F.when(core, F.col("times"))).alias("documents"))
    found = found.join(o.kept_in(spark, tally.join(groups.select("bucket", "pivot"), "bucket"), "tally"), "bucket")
    links = found.filter(core & (F.col("documents") > F.col("times"))).select(F.col("node").alias("a"), F.col("pivot").alias("b"), (F.col("documents") - F.col("times")).alias("links"))
    deal = F.xxhash64("node", "bucket")
    own = F.when(core, F.pmod(deal, F.col("cores"))).otherwise(F.col("cores") + F.pmod(deal, F.greatest("rest", F.lit(1)))).cast("int")
    first = F.when(core, F.col("cores")).otherwise(0)
    members = found.filter("rest > 0").withColumn("own", own).withColumn("others", F.sequence(first, F.col("cores") + F.col("rest") - 1))
    return links, members.select("node", "bucket", "times", "data", "own", "others")


def near_duplicate_rows(docs: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """Per row (doc_id, tag, node), and per node its class, links, copies, first row and class id.

    docs: doc_id, text, tag.
    """
    spark = docs.sparkSession
    least = prefix_length(threshold)
    sketch = "doc_id long, tag long, node long, n long, sign binary, roots array<long>, paths array<long>"
    rows = o.kept_in(spark, docs.select("doc_id", "text", "tag").mapInArrow(t.task(_sketch(least, size)), sketch), "sketches")
    nodes = o.kept_in(
        spark,
        rows.filter("node IS NOT NULL").groupBy("node").agg(
            F.count(F.lit(1)).alias("times"), F.min(F.struct("doc_id", "tag")).alias("first"), F.min("doc_id").alias("least_id"),
            F.first("n").alias("n"), F.first("sign").alias("sign"), F.first("roots").alias("roots"), F.first("paths").alias("paths"),
        ),
        "nodes",
    )
    keyed = nodes.select("node", F.explode(F.arrays_zip("roots", "paths")).alias("at")).select("node", F.col("at.roots").alias("bucket"), F.col("at.paths").alias("path"))
    sizes = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("bucket", F.ceil(F.col("size") / BLOCK).cast("int").alias("parts"))
    sizes = o.kept_in(spark, sizes, "sizes")
    signs = nodes.select("node", F.col("sign").alias("data"))
    met = keyed.join(sizes.select("bucket"), "bucket", "left_semi").join(signs, "node")
    groups = components(blocks(dealt(met, sizes), _climb(least), "a long, b long", _forest, "path"))
    groups = o.kept_in(spark, groups.join(nodes.select("node", "times", "n", "first"), "node"), "groups")
    parts = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int")
    members = groups.groupBy(F.col("component").alias("bucket")).agg(parts.alias("parts"), F.max_by("node", F.struct("times", "node")).alias("pivot"))
    members = o.kept_in(spark, members, "members")
    wanted = groups.select("node", "component", "times", "first.doc_id", "first.tag")
    # sorted and merged at every size, so that what is shuffled grows with the input and not by steps
    texts = docs.alias("d").join(wanted.alias("w").hint("merge"), o.same_row("d", "w")).select("d.text", "w.node", "w.component", "w.times").dropDuplicates(["node"])

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in t.pieces(batches):
            found, off = shingle_sets(part.column(0), size)
            data = [found[a:b].tobytes() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), part.column(3), pa.array(data, pa.binary())], ["node", "bucket", "times", "data"])

    sets = texts.mapInArrow(t.task(shingled), "node long, bucket long, times long, data binary")
    counted = "a long, b long, links long"
    large = members.filter("parts > 1")
    if large.take(1):
        sets = o.kept_in(spark, sets, "sets")
        known, rest = large_groups(sets, large, threshold)
        todo = dealt(sets, members.filter("parts = 1")).select("node", "bucket", "times", "data", "own", "others").unionByName(rest)
        links = known.unionByName(blocks(todo, _verified(threshold), counted, _counts))
    else:
        links = blocks(dealt(sets, members), _verified(threshold), counted, _counts)
    links = o.kept_in(spark, links, "links")
    classes = components(links.select("a", "b"))
    counts = links.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    per_node = (
        nodes.select("node", "times", "first", "least_id").join(classes, "node", "left").join(counts, "node", "left")
        .select("node", "times", "first", "least_id", F.coalesce("component", "node").alias("class"), F.coalesce("links", F.lit(0)).alias("links"))
    )
    # written first, so that the join back to it has a shuffle of its own and a large class can be split
    per_node = o.kept_in(spark, per_node, "classes")
    ids = o.kept_in(spark, per_node.groupBy("class").agg(F.min("least_id").alias("class_id"), F.min("first").alias("stays")), "ids")
    return rows.select("doc_id", "tag", "node"), per_node.join(ids, "class")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: class, links to other documents, documents with the same shingles."""
    rows, nodes = near_duplicate_rows(o.tagged(t.text_frame(docs, id_col, text_col)), threshold, size)
    out = rows.join(nodes, "node", "left")
    return out.select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce(F.col("links") + F.col("times") - 1, F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("times", F.lit(1)).cast("long").alias("n_copies"),
    )


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with one of each class: the first by id, then by text hash.  Rows
    without shingles all stay."""
    base = o.tagged(t.text_frame(docs, id_col, text_col))
    rows, nodes = near_duplicate_rows(base, threshold, size)
    stay = nodes.select("stays.doc_id", "stays.tag").distinct().withColumn("one", F.lit(True))
    bare = rows.filter("node IS NULL").select("doc_id", "tag").distinct().withColumn("one", F.lit(False))
    tag = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    row = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("doc_id"), tag.alias("tag"))
    found = row.alias("d").join(stay.union(bare).alias("s"), o.same_row("d", "s"))
    kept = found.filter("one").select("d.row", "d.doc_id", "d.tag").dropDuplicates(["doc_id", "tag"]).select("row.*")
    return kept.unionByName(found.filter("NOT one").select("d.row.*"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: All pairs that share a shingle, and what can be reached over links.
ORACLE = {
    "op5_jaccard_join": f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS u, doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}') AS text FROM documents),
w AS (SELECT u, list_filter(string_split_regex(text, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS words FROM d),
sh AS (SELECT DISTINCT u, array_to_string(words[i:i + 4], ' ') AS s FROM (SELECT u, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT u, count(*) AS n FROM sh GROUP BY 1),
common AS (SELECT a.u AS a, b.u AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.u <> b.u GROUP BY 1, 2),
links AS (SELECT a, b, c = x.n AND c = y.n AS same FROM common JOIN n x ON x.u = a JOIN n y ON y.u = b WHERE 5 * c >= 4 * (x.n + y.n - c)),
reach AS (SELECT u, u AS v FROM d UNION SELECT r.u, l.b FROM reach r JOIN links l ON r.v = l.a),
class AS (SELECT r.u, min(o.doc_id) AS class_id FROM reach r JOIN d o ON o.u = r.v GROUP BY 1),
own AS (SELECT a AS u, count(*) AS n_links, count(*) FILTER (WHERE same) AS copies FROM links GROUP BY 1)
SELECT d.doc_id, class_id, coalesce(n_links, 0) AS n_links, coalesce(copies, 0) + 1 AS n_copies FROM d JOIN class ON class.u = d.u LEFT JOIN own ON own.u = d.u"""
}
