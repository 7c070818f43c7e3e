"""Conversation structure repair 12: cheapest edits to a legal turn order, by iterative-deepening A*.

A legal conversation is ``(s?(ua)+)?`` by role initials.  Edits in ASCII order: Delete (3),
Insert an empty turn (2), Keep (0), Rerole (2); a truncated row that stays costs 1 more; a
blank or duplicate row must go.  ``search`` goes depth first in that order under a rising
cost bound, with a table of states that are known to fail within what is left; the first
accepting path under the first bound that has one is the cheapest and ASCII-least.  The
bound below the cost of a suffix is what its forced edits cost, and one for each illegal
neighbourhood that forced deletions leave: other edits cost two or more and mend at most two.

Scale: rows are ranged over tasks by conversation and place, and numbered there, so a huge
conversation is spread.  Its rows are searched in segments of ``SEGMENT``: costs from
each entry to each exit state in parallel, chained once over segments (one small row a
segment) to the cost behind each segment, and then the paths for each entry in parallel.  Since a path
spells which state it ends in, choosing segment by segment from the front gives the
ASCII-least whole.  Texts are then streamed in order past one SHA-256, which can't be split;
a task holds the edits of one conversation, which is a cell of the result, and no texts.

Defined cases: a null role or text is one space; a null ``conv_id`` is a conversation, and
reads as one space where ids are hashed; null turns come first; rows of equal turn go by role,
then text, in byte order; repeated rows are duplicates of the first; an initial other than s, u
and a (an empty role too) is legal nowhere; conversations without rows, and those that lost all
of them, give zeros and an empty audit; an empty table gives an empty result; very long
texts are hashed whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import written
from . import text as t

SEGMENT_BITS = 7
SEGMENT = 1 << SEGMENT_BITS

#: White space of the contract, and the ends of a whole sentence.
SPACE = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")

#: Where a path stands: nothing yet, behind a system turn, behind a user turn, behind an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
FREE, TRUNCATED, FORCED = range(3)
#: Class of a role's initial (0: any other) and the state that keeping it leads to.
_CLASS = {"s": 1, "u": 2, "a": 3}
_KEEP = {(START, 1): SYSTEM, (START, 2): USER, (SYSTEM, 2): USER, (ASSISTANT, 2): USER, (USER, 3): ASSISTANT}
_TURN = (USER, USER, ASSISTANT, USER)  # the turn that a state asks for
_LEGAL = {(1, 2), (2, 3), (3, 2)}
#: Cost of ending in a state: inserts behind the last row.
ACCEPT = (0, 4, 2, 0)
NEVER = 1 << 60

ROWS = "conv string, p long, turn long, role string, text string, fault int"
RESULT = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with the damage that a hash of conversation and turn deals out: conv_id, turn, role, text."""
    given = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    name = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(name[0], F.lit(":"), name[1])) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(kind == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return given.filter(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def _conv(column: str = "conv_id"):
    """A conversation's id as text behind a sign, so that a null one and an empty one differ."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("")).alias("conv")


def placed(rows: DataFrame) -> DataFrame:
    """Rows in order, with a number ``p`` that grows with their place and their own fault.

    Ranges of (conversation, turn, role, text) are sorted by themselves; ``p`` has the range's number
    in its upper bits.  Written, so that the numbers stand.
    """
    keys = ["conv", "turn", "role", "text"]
    blank = F.expr(f"rtrim('{SPACE}', text)")
    named = rows.select(_conv(), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    ordered = named.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("p", F.monotonically_increasing_id())
    fault = F.when(blank == "", FORCED).when(~F.right(blank, F.lit(1)).isin(*ENDS), TRUNCATED).otherwise(FREE)
    out = ordered.select("conv", "p", "turn", "role", "text", fault.cast("int").alias("own"), (blank == "").alias("is_blank"))
    return written(out, "conversation-rows")


def with_faults(rows: DataFrame) -> DataFrame:
    """Adds ``is_first``: no earlier row of the conversation has the same role and text."""
    content = F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256)
    first = rows.groupBy("conv", content.alias("content")).agg(F.min("p").alias("p")).select("p", F.lit(True).alias("is_first"))
    fault = F.when(F.col("is_first").isNull(), FORCED).otherwise(F.col("own")).cast("int")
    return rows.join(first, "p", "left").withColumn("fault", fault)


def suffix_bounds(codes: bytes, end: int = 0) -> list[int]:
    """Below the cost of each suffix: forced edits, and one for each illegal pair of neighbours that stay."""
    out, after = [end] * (len(codes) + 1), None
    for i in range(len(codes) - 1, -1, -1):
        kind, fault = codes[i] & 3, codes[i] >> 2
        out[i] = out[i + 1] + (3 if fault == FORCED else fault)
        if fault != FORCED:
            out[i] += after is not None and (kind, after) not in _LEGAL
            after = kind
    return out


def search(codes: bytes, entry: int, terminal: tuple[int, ...], failed: list[int] | None = None) -> tuple[int, str, int]:
    """Cheapest, ASCII-least edits of some rows from a state, with what each exit state costs further on.

    codes: a row's role class, and four times its fault.  failed: the transposition table,
    the most that was left when a state failed; it may be shared by searches that
    differ in ``entry`` only.
    """
    n, least = len(codes), min(terminal)
    below = suffix_bounds(codes, least)
    failed = [-1] * (4 * n + 4) if failed is None else failed
    path: list[str] = []

    def descend(i: int, q: int, left: int) -> int:
        """The exit state of the first path that is accepted within ``left``, or -1."""
        if i == n:
            return q if terminal[q] <= left else -1
        if below[i] > left or failed[4 * i + q] >= left:
            return -1
        kind, fault = codes[i] & 3, codes[i] >> 2
        turn = _TURN[q]
        steps = [("D", i + 1, q, 3), ("I", i, turn, 2)]
        if fault != FORCED:
            if (kept := _KEEP.get((q, kind))) is not None:
                steps.append(("K", i + 1, kept, fault))
            steps.append(("R", i + 1, turn, 2 + fault))
        for edit, at, state, cost in steps:
            if cost <= left and (out := descend(at, state, left - cost)) >= 0:
                path.append(edit)
                return out
        failed[4 * i + q] = left
        return -1

    bound = below[0]
    while (out := descend(0, entry, bound)) < 0:
        bound += 1
    return bound, "".join(reversed(path)), out


def crossing_costs(codes: bytes) -> list[int]:
    """Least cost from each entry state to each exit state of a segment, row by row; ``NEVER`` where there is no way.

    The first two states are left only by deletions, which need no search.
    """
    n = len(codes)
    out = [NEVER] * 16
    out[0] = out[5] = 3 * n
    systems = [c >> 2 for c in codes if c & 3 == 1 and c >> 2 != FORCED]
    if systems:
        out[1] = 3 * (n - 1) + min(systems)
    for leave in (USER, ASSISTANT):
        terminal = tuple(0 if q == leave else NEVER for q in range(4))
        failed = [-1] * (4 * n + 4)
        for entry in range(4):
            out[4 * entry + leave] = search(codes, entry, terminal, failed)[0]
    return out


def _cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        costs = [crossing_costs(bytes(c)) for c in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(costs, pa.list_(pa.int64()))], ["conv", "segment", "costs"])


def _chain(rows: pd.DataFrame) -> pd.DataFrame:
    """What each exit state of each segment costs to the end of the conversation."""
    rows = rows.sort_values("segment", ascending=False)
    behind = np.array(ACCEPT, np.int64)
    out = []
    for costs in rows["costs"]:
        out.append(behind.tolist())
        behind = np.minimum((np.array(costs, np.int64).reshape(4, 4) + behind).min(1), NEVER)
    return pd.DataFrame({"conv": rows["conv"].to_numpy(), "segment": rows["segment"].to_numpy(), "behind": out})


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits of each segment for each entry state that can occur, and the state behind them."""
    for batch in batches:
        paths, exits = [], []
        for codes, is_first, is_last, behind in zip(*(batch.column(i).to_pylist() for i in range(3, 7)), strict=True):
            codes, terminal = bytes(codes), tuple(behind or ACCEPT)
            failed = [-1] * (4 * len(codes) + 4)
            found = [search(codes, q, terminal, failed) for q in range(1 if is_first else 4)]
            paths.append([path + "I" * (ACCEPT[q] // 2 if is_last else 0) for _, path, q in found])
            exits.append([q for _, _, q in found])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(paths, pa.list_(pa.string())), pa.array(exits, pa.list_(pa.int32()))], ["conv", "p", "paths", "exits"]
        )


class _Repair:
    """One conversation as its rows go by."""

    def __init__(self, conv: str) -> None:
        self.conv, self.state = conv, START
        self.audit: list[str] = []
        self.edits, self.at = "", 0
        self.sha, self.lines, self.turn = hashlib.sha256(), 0, USER
        self.first_turn = self.last_turn = self.initial = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0

    def open(self, paths: list[str], exits: list[int]) -> None:
        self.edits, self.at = paths[self.state], 0
        self.state = exits[self.state]
        self.audit.append(self.edits)

    def out(self, role: str, text: str) -> None:
        self.sha.update((f"\n{role}:{text}" if self.lines else f"{role}:{text}").encode(errors="surrogatepass"))
        self.lines += 1

    def asked(self, text: str) -> None:
        """A turn of the role that is due."""
        self.out("user" if self.turn == USER else "assistant", text)
        self.turn = USER + ASSISTANT - self.turn
        self.cost += 2

    def inserted(self) -> None:
        while self.at < len(self.edits) and self.edits[self.at] == "I":
            self.asked("")
            self.at += 1

    def row(self, turn: int | None, role: str, text: str, fault: int, is_blank: bool, is_first: bool) -> None:
        if turn is not None:
            self.turns += turn != self.last_turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        if is_blank:
            self.blank += 1
        elif not is_first:
            self.duplicate += 1
        else:
            self.truncated += fault == TRUNCATED
        if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = role[:1]
        self.inserted()
        edit = self.edits[self.at]
        self.at += 1
        if edit == "D":
            self.cost += 3
        else:
            self.cost += fault == TRUNCATED
            if edit == "R":
                self.asked(text)
            else:
                self.out(role, text)
                self.turn = ASSISTANT if role[:1] == "u" else USER
        self.inserted()

    def result(self) -> tuple:
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns
        return self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest()


_NAMES = [c.split()[0] for c in RESULT.split(", ")]
_RESULT = pa.schema([(c, pa.string() if c in ("conv", "audit", "repaired_sha256") else pa.int64()) for c in _NAMES])


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Figures of each conversation of a sorted stream: the edits of a segment, then its rows."""
    now: _Repair | None = None
    for batch in batches:
        done = []
        for conv, paths, exits, *row in zip(*(batch.column(n).to_pylist() for n in ("conv", "paths", "exits", "turn", "role", "text", "fault", "is_blank", "is_first")), strict=True):
            if now is None or now.conv != conv:
                if now is not None:
                    done.append(now.result())
                now = _Repair(conv)
            if paths is not None:
                now.open(paths, exits)
            else:
                now.row(*row)
        yield _batch(done)
    if now is not None:
        yield _batch([now.result()])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_RESULT)], schema=_RESULT)


def segment_edits(rows: DataFrame) -> DataFrame:
    """Edits of each segment (conv, first p, paths and exits by entry state) of rows with faults."""
    kind = F.left("role", F.lit(1))
    code = (F.when(kind == "s", 1).when(kind == "u", 2).when(kind == "a", 3).otherwise(0) + 4 * F.col("fault")).cast("tinyint")
    one = F.sort_array(F.collect_list(F.struct("p", code.alias("code"))))
    segments = rows.groupBy("conv", F.shiftright("p", SEGMENT_BITS).alias("segment")).agg(one.alias("r"))
    segments = segments.select("conv", "segment", F.col("r")[0]["p"].alias("p"), F.transform("r", lambda r: r["code"]).alias("codes"))
    segments = written(segments, "conversation-segments")
    ends = segments.groupBy("conv").agg(F.min("segment").alias("lo"), F.max("segment").alias("hi"))
    segments = segments.join(ends, "conv")
    several = segments.filter("lo < hi").select("conv", "segment", "codes").mapInArrow(t.task(_cross), "conv string, segment long, costs array<long>")
    behind = several.groupBy("conv").applyInPandas(_chain, "conv string, segment long, behind array<long>")
    ready = segments.join(behind, ["conv", "segment"], "left").select("conv", "segment", "p", "codes", (F.col("segment") == F.col("lo")).alias("a"), (F.col("segment") == F.col("hi")).alias("b"), "behind")
    return ready.mapInArrow(t.task(_paths), "conv string, p long, paths array<string>, exits array<int>")


def repaired(rows: DataFrame) -> DataFrame:
    """One row per conversation that has rows (conv_id, turn, role, text): faults, cost, edits, and a hash of what they give.

    ``conv`` is ``=`` and the conversation's id as text, empty for a null one.
    """
    rows = written(with_faults(placed(rows)), "conversation-faults")
    edits = segment_edits(rows).withColumn("kind", F.lit(0))
    lines = rows.select("conv", "p", "turn", "role", "text", "fault", "is_blank", F.coalesce("is_first", F.lit(False)).alias("is_first"), F.lit(1).alias("kind"))
    stream = edits.unionByName(lines, allowMissingColumns=True)
    return stream.repartition("conv").sortWithinPartitions("conv", "p", "kind").mapInArrow(t.task(_repaired), RESULT)


def repair_conversations(conversations: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """One row per ``conv_id`` of the conversations; ``rows`` are what is left of them, if that is not all."""
    found = repaired(conversations if rows is None else rows)
    ids = conversations.select("conv_id").distinct().withColumn("conv", _conv())
    out = ids.join(found, "conv", "left").drop("conv")
    return out.fillna({**dict.fromkeys(_NAMES[1:7], 0), "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()})


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repair_conversations(conversations, damaged(conversations))


_SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
#: CRC-32 by its table, rows in order, and the cheapest edits from the last row back: costs and edits for each state.
ORACLE = {
    "op12_conversation_repair": f"""
WITH RECURSIVE tab AS (
  SELECT list(c ORDER BY i) AS crcs FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS r(i))),
named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
marks AS (
  SELECT n.*, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(name) + 1), lambda i: ascii(substr(name, i, 1))::BIGINT)),
    lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind FROM named n, tab),
rows AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM marks WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
    rtrim(text, {_SPACES}) AS body FROM rows),
faults AS (
  SELECT *, body = '' AS blank, body <> '' AND nth > 1 AS duplicate, body <> '' AND nth = 1 AND right(body, 1) NOT IN ('.', '!', '?') AS truncated,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM placed),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE duplicate) AS duplicate,
    count(*) FILTER (WHERE truncated) AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal,
    list(CASE left(role, 1) WHEN 's' THEN 1 WHEN 'u' THEN 2 WHEN 'a' THEN 3 ELSE 0 END ORDER BY i) AS kinds, list(CASE WHEN blank OR duplicate THEN 2 WHEN truncated THEN 1 ELSE 0 END ORDER BY i) AS costs
  FROM faults GROUP BY conv_id),
back AS (
  SELECT conv_id, kinds, costs, len(kinds) AS i, [{{'c': 0, 's': ''}}, {{'c': 4, 's': 'II'}}, {{'c': 2, 's': 'I'}}, {{'c': 0, 's': ''}}] AS best FROM counted
  UNION ALL
  SELECT conv_id, kinds, costs, i - 1, list_transform(range(1, 5), lambda q: list_sort([plain[q], {{'c': plain[CASE WHEN q = 3 THEN 4 ELSE 3 END].c + 2, 's': 'I' || plain[CASE WHEN q = 3 THEN 4 ELSE 3 END].s}}])[1])
  FROM (SELECT *, list_transform(range(1, 5), lambda q: list_sort([
      {{'c': best[q].c + 3, 's': 'D' || best[q].s}},
      {{'c': CASE WHEN costs[i] = 2 THEN 1000000000 ELSE best[CASE WHEN q = 3 THEN 4 ELSE 3 END].c + 2 + costs[i] END, 's': 'R' || best[CASE WHEN q = 3 THEN 4 ELSE 3 END].s}},
      {{'c': CASE WHEN costs[i] = 2 OR keep[q] = 0 THEN 1000000000 ELSE best[greatest(keep[q], 1)].c + costs[i] END, 's': 'K' || best[greatest(keep[q], 1)].s}}])[1]) AS plain
    FROM (SELECT *, CASE kinds[i] WHEN 1 THEN [2, 0, 0, 0] WHEN 2 THEN [3, 3, 0, 3] WHEN 3 THEN [0, 0, 4, 0] ELSE [0, 0, 0, 0] END AS keep FROM back WHERE i > 0))),
audits AS (SELECT conv_id, best[1].c AS cost, best[1].s AS audit FROM back WHERE i = 0),
steps AS (
  SELECT conv_id, k, substr(audit, k, 1) AS edit FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS k FROM audits)),
taken AS (
  SELECT *, count(*) FILTER (WHERE edit <> 'I') OVER w AS i, count(*) FILTER (WHERE edit <> 'D') OVER w AS o FROM steps WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
said AS (
  SELECT t.conv_id, t.k, t.o, t.edit, f.role, f.text, max(CASE WHEN t.o = 1 AND t.edit = 'K' AND left(f.role, 1) = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY t.conv_id) AS s
  FROM taken t LEFT JOIN faults f ON t.conv_id IS NOT DISTINCT FROM f.conv_id AND t.i = f.i AND t.edit <> 'I' WHERE t.edit <> 'D'),
joined AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role ELSE CASE WHEN (o - s) % 2 = 1 THEN 'user' ELSE 'assistant' END END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY k) AS whole FROM said GROUP BY conv_id)
SELECT d.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0)::BIGINT AS blank, coalesce(c.duplicate, 0)::BIGINT AS duplicate, coalesce(c.truncated, 0)::BIGINT AS truncated,
  coalesce(c.illegal, 0)::BIGINT AS illegal, coalesce(a.cost, 0)::BIGINT AS cost, coalesce(a.audit, '') AS audit, sha256(coalesce(j.whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN counted c ON d.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN audits a ON d.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN joined j ON d.conv_id IS NOT DISTINCT FROM j.conv_id"""
}
