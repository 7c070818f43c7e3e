"""Toxicity 4: a support vector machine on a gapped subsequence kernel, with landmarks.

The kernel of two words sums ``DECAY ** span`` over the common subsequences of three
letters within ``REACH`` letters, both spans counted, and is normalised; an inserted or
missing letter lowers it a little only.  A sentence is compared by its most toxic word, so
a long sentence doesn't thin out an insult.  Nystroem landmarks (words of the training
sentences) give each word a short vector, and a squared hinge machine is trained on these.

It is trained on sentences with the label of their document, as a multiple-instance
machine.  Not every sentence of a toxic document is toxic, and labels don't tell which:
the machine starts with all of them and is trained again for each entry of ``DOUBT``, each
time with the sentences that it finds that toxic, each represented by its most toxic
word; the last machine also learns every word that is telling by itself (``KNOWN``,
``TELLS``), so an insult isn't lost because a stronger one stands beside it.  Two machines, trained on half of the toxic sentences each, judge one another's
half, so that a word of one document can't vouch for itself.  A word that toxic sentences
don't have ``SPEAKS`` times as often as clean ones can't make a sentence toxic, and in a
sentence of a clean document every word is clean.

The machine's output is a linear function of a word's subsequences, so the landmarks are
folded into one weight for each letter triple (``Model.weights``); scoring a word does
not touch the landmarks again.  A document is as toxic as its most toxic sentence.  A
logistic curve turns that margin, and how many words lie beyond a few margins, into a
score; it is fitted on sampled documents that the machine wasn't trained on.

Training rows: at most ``TRAIN_ROWS`` labelled documents of each class, those with the
smallest hash of their text (copies count once; texts of more than ``TRAIN_BYTES`` bytes
are not chosen), each with its whole text.  Nothing else is sampled, and every text is
scored whole.

Other signs inside a word are dropped (``i.d-i*o't``), and single letters in a row are
read as one word (``i d i o t``).

Defined cases: a null or empty text has no words and gets the score of the least margin;
null labels and labels without a document are not learned from; a text labelled both ways
is toxic; with no toxic or no clean training row, or no word that tells them apart, every
score is 0, so nothing is rejected; repeated rows get equal scores, ties need no order; a very long text is
worked on in one piece, in memory in proportion to it; other columns are ignored, or kept
by ``drop_toxic``, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import copy
import re
import uuid
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as t
from .overlap import kept_in

DECAY = 0.6
REACH = 7
TRAIN_ROWS = 1000
TRAIN_BYTES = 200_000
LANDMARKS = 160
HARD = 60
#: Times as often as in clean sentences that a word stands in toxic ones if it can make one toxic.
SPEAKS = 4
#: A word of so many toxic documents, and so many times as frequent in toxic sentences as in clean ones, is learned even where it isn't a sentence's most toxic.
KNOWN, TELLS = 4, 40
#: Documents that share such a part of their sentences are near copies and count once there.
COPY = 0.6
#: A sentence of a toxic document with no higher margin than this teaches nothing in the next round.
DOUBT = (-0.5, 0.0, 0.5)
ROUNDS = len(DOUBT)
#: Every so many sampled documents, one is kept for the curve.
FOLD = 3
THRESHOLD = 0.3
LETTERS = 58  # a-z, and 32 for the continuation bytes of other letters
MAX_CACHE = 400_000
FLOOR = -2.0
LEVELS = (0.0, 0.4, 0.8)

_LETTER = np.zeros(256, bool)
_LETTER[0x61:0x7B] = _LETTER[0x80:0xC0] = True  # lead bytes are left out
_CODE = np.zeros(256, np.uint8)
_CODE[0x61:0x7B] = np.arange(26)
_CODE[0x80:0xC0] = 26 + (np.arange(0x80, 0xC0) & 0x1F)  # capitals of accented letters share a code with small ones
_SENTENCE = re.compile(r"[.!?\n]+\s*")


def triples(words: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """Letter triples (as numbers) at each choice of three places, and their weight; words: n x length codes."""
    n, size = words.shape
    w = words.astype(np.int32)
    for i in range(size - 2):
        for j in range(i + 1, min(size, i + REACH) - 1):
            two = (w[:, i] * LETTERS + w[:, j]) * LETTERS
            for k in range(j + 1, min(size, i + REACH)):
                yield two + w[:, k], DECAY ** (k - i + 1)


def norms(words: np.ndarray) -> np.ndarray:
    """Square root of the kernel of each word with itself."""
    found = list(triples(words))
    if not found:
        return np.zeros(len(words))
    keys = np.stack([x for x, _ in found], 1)
    values = np.broadcast_to(np.array([v for _, v in found]), keys.shape)
    by = np.argsort(keys, 1, kind="stable")
    keys, values = np.take_along_axis(keys, by, 1), np.take_along_axis(values, by, 1)
    same = np.zeros(keys.shape, np.int64)
    same[:, 1:] = np.cumsum(keys[:, 1:] != keys[:, :-1], 1)
    total = np.bincount((np.arange(len(keys))[:, None] * keys.shape[1] + same).ravel(), values.ravel(), keys.size)
    return np.sqrt((total.reshape(keys.shape) ** 2).sum(1))


def letters(word: str) -> bytes:
    """The letters of a word as bytes with a code each."""
    return re.sub(rb"[^a-z\x80-\xBF]+", b"", word.encode(errors="replace"))


def coded(words: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Words by length: their indices and codes."""
    groups: dict[int, list[int]] = {}
    for i, x in enumerate(words):
        groups.setdefault(len(x), []).append(i)
    return {n: (np.array(ix), _CODE[np.frombuffer(b"".join(words[i] for i in ix), np.uint8).reshape(-1, n)]) for n, ix in groups.items() if n}


def _groups(docs_of: list[list[int]], share: float) -> np.ndarray:
    """A group for each document; those that share such a part of their sentences are in the same."""
    first: dict[int, list[int]] = {}
    for docs in docs_of:
        for doc in docs:
            first.setdefault(doc, []).append(min(docs))
    group: dict[int, int] = {}
    for doc in sorted(first):
        other, times = Counter(first[doc]).most_common(1)[0]
        group[doc] = group[other] if other < doc and times >= share * len(first[doc]) else len(set(group.values()))
    return np.array([group.get(doc, -1) for doc in range(max(group) + 1)])


def _highest(value: np.ndarray, group: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each group, in order, its member with the highest value (then the first), and that value."""
    by = np.lexsort((-value, group))
    first = by[np.flatnonzero(np.r_[True, np.diff(group[by]) > 0])]
    return member[first], value[first]


class Landmarks:
    """Landmark words as rows of normalised weights over the triples that they have."""

    def __init__(self, words: list[bytes]) -> None:
        rows, keys, values = [], [], []
        for index, codes in coded(words).values():
            for key, weight in triples(codes):
                rows.append(index)
                keys.append(key)
                values.append(np.full(len(key), weight))
        self.keys, column = np.unique(np.concatenate(keys), return_inverse=True)
        base = np.zeros((len(words), len(self.keys)))
        np.add.at(base, (np.concatenate(rows), column), np.concatenate(values))
        self.base = base / np.maximum(np.linalg.norm(base, axis=1, keepdims=True), 1e-12)
        self.column = np.full(LETTERS**3, len(self.keys), np.int32)
        self.column[self.keys] = np.arange(len(self.keys))

    def kernel(self, words: list[bytes], out: np.ndarray | None = None) -> np.ndarray:
        """Normalised kernel of each word with each landmark."""
        by_key = np.vstack([self.base.T, np.zeros(len(self.base))]).astype(np.float32)
        out = np.zeros((len(words), len(self.base)), np.float32) if out is None else out
        for index, codes in coded(words).values():
            for i in range(0, len(index), 2000):
                some = codes[i : i + 2000]
                total = np.zeros((len(some), len(self.base)), np.float32)
                for key, weight in triples(some):
                    total += np.float32(weight) * by_key[self.column[key]]
                out[index[i : i + 2000]] = total / np.maximum(norms(some), 1e-12)[:, None]
        return out


def units(text: str) -> list[bytes]:
    """Words as the kernel reads them."""
    out, singles = [], []
    for x in [*map(letters, text.lower().split()), b"  "]:
        if len(x) == 1:
            singles.append(x)
            continue
        if len(singles) > 2:
            out.append(b"".join(singles))
        singles = []
        if x.strip():
            out.append(x)
    return out


class Model:
    """Weights of the letter triples, bias, and the curve from margin to score."""

    def __init__(self, rows: list[tuple[str, int]], share: float | None = None) -> None:
        self.weights, self.bias, self.curve = np.zeros(LETTERS**3, np.float32), 0.0, np.zeros(len(LEVELS) + 2)
        self.usual = np.zeros(len(LEVELS))
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros(0)
        label = np.array([y for _, y in rows], float)
        self.share = share if share is not None else float(label.mean()) if len(rows) else 0.0
        self.trained = len(rows) > 0 and 0 < label.mean() < 1
        if not self.trained:
            return
        # with few rows of a class the curve is fitted on the rows that the machine has seen
        nth = np.empty(len(rows), np.int64)
        for y in (0, 1):
            nth[label == y] = np.arange(int((label == y).sum()))
        own = (nth % FOLD > 0) | (min(label.sum(), (1 - label).sum()) < 5 * FOLD)
        self._machine([r for r, x in zip(rows, own, strict=True) if x])
        if not self.trained:
            return
        if not own.all():
            rows, label = [r for r, x in zip(rows, own, strict=True) if not x], label[~own]
        found = [self.evidence(pa.array([x for x, _ in rows[i : i + 100]])) for i in range(0, len(rows), 100)]
        margin, many, n_words = (np.concatenate(x) for x in zip(*found, strict=True))
        self.usual = many[label == 0].sum(0) / max(n_words[label == 0].sum(), 1)
        # rows weigh as much as their class does among all labelled rows
        weight = np.where(label > 0, self.share / label.mean(), (1 - self.share) / (1 - label.mean()))
        self.curve = logistic(self.features(margin, many, n_words), label, weight)
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros(0)

    def _machine(self, rows: list[tuple[str, int]]) -> None:
        """Weights and bias from labelled sentences."""
        number: dict[bytes, int] = {}
        sides: tuple[dict, dict] = {}, {}  # different sentences, as sorted word numbers, and the documents that hold them
        for doc, (text, y) in enumerate(rows):
            for s in map(units, _SENTENCE.split(text)):
                if ids := {number.setdefault(w, len(number)) for w in s if len(w) > 2}:
                    sides[int(y)].setdefault(array("i", sorted(ids)).tobytes(), []).append(doc)
        clean_rows, toxic_rows = sides
        for ids in toxic_rows.keys() & clean_rows.keys():
            del toxic_rows[ids]  # stands in clean text too
        if not toxic_rows or not clean_rows:
            self.trained = False
            return
        words, n = list(number), len(number)
        member = np.frombuffer(b"".join(toxic_rows), np.int32).astype(np.int64)
        sentence = np.repeat(np.arange(len(toxic_rows)), [len(s) // 4 for s in toxic_rows])
        in_clean, in_toxic = np.bincount(np.frombuffer(b"".join(clean_rows), np.int32), minlength=n), np.bincount(member, minlength=n)
        doc_of = [(k, doc) for k, docs in enumerate(toxic_rows.values()) for doc in docs]
        of_sentence, of_doc = np.array(doc_of, np.int64).T
        # to begin with, a sentence's most toxic word is the one that speaks most for toxic sentences
        share = len(toxic_rows) / (len(toxic_rows) + len(clean_rows))
        margin = (in_toxic - share * (in_toxic + in_clean)) / np.sqrt((in_toxic + in_clean) * share * (1 - share))
        by = np.argsort(-margin, kind="stable")
        chosen = list(dict.fromkeys([*by[: LANDMARKS // 2].tolist(), *np.argsort(-in_clean, kind="stable").tolist()]))[:LANDMARKS]
        clean = np.flatnonzero(in_clean)
        landmarks = Landmarks([words[i] for i in chosen])
        # one table with room for the landmarks to come: nothing of its size is made twice
        kernel = np.zeros((n, len(chosen) + HARD), np.float32)
        landmarks.kernel(words, kernel[:, : len(chosen)])
        half = _groups(list(toxic_rows.values()), 1 / 3)[[min(docs) for docs in toxic_rows.values()]] % 2
        margin = np.stack([margin, margin])
        toxic = np.ones(len(toxic_rows), bool)
        # what makes a sentence toxic is a word that toxic sentences have far more often than clean ones
        speaks = in_toxic / len(toxic_rows) > SPEAKS * in_clean / len(clean_rows)
        if not speaks.any():
            self.trained = False
            return
        # words that clean texts hardly have and several toxic ones do (near copies aside): each is an insult in its
        # own right, whether or not another word of its sentences is a stronger one
        loud = in_toxic / len(toxic_rows) > TELLS * in_clean / len(clean_rows)
        kind = _groups(list(toxic_rows.values()), COPY)
        held_by: dict[int, set[int]] = {}
        for ids, docs in toxic_rows.items():
            for w in array("i", ids):
                if loud[w]:
                    held_by.setdefault(w, set()).update(kind[docs].tolist())
        telling = np.zeros(n, bool)
        telling[[w for w, kinds in held_by.items() if len(kinds) >= KNOWN]] = True
        for step in range(ROUNDS + 1):
            # each half of the toxic sentences is judged by the machine of the other half, so a
            # word that one document alone has can't vouch for itself
            witness, best = np.zeros(len(toxic), np.int64), np.full(len(toxic), -np.inf)
            for side in (0, 1):
                own = half == side
                if (at := own[sentence] & speaks[member]).any():
                    word, value = _highest(margin[1 - side][member[at]], sentence[at], member[at])
                    which = np.unique(sentence[at])
                    witness[which], best[which] = word, value
            if step:
                top, high = _highest(best[of_sentence], of_doc, of_sentence)
                toxic = best > DOUBT[step - 1]
                if not toxic.any():
                    toxic[top] = True
            toxic &= best > -np.inf
            gram, vec = np.linalg.eigh(landmarks.base @ landmarks.base.T)
            ok = gram > 1e-5
            fold = (vec[:, ok] / np.sqrt(gram[ok])).astype(np.float32)  # Nystroem map: kernel with the landmarks -> vector
            x = kernel[:, : len(chosen)]
            machines = []
            for used in (toxic & (half == 0), toxic & (half == 1)) if step < ROUNDS else (toxic,):
                used = used if used.any() else toxic
                stands = np.bincount(witness[used], minlength=n)
                if step == ROUNDS:
                    stands = np.where(telling, np.maximum(stands, np.bincount(member, minlength=n)), stands)
                bad = np.flatnonzero(stands)
                side = np.r_[np.ones(len(bad)), -np.ones(len(clean))]
                weight = np.r_[np.minimum(stands[bad], 50), np.minimum(in_clean[clean], 200)].astype(float)
                weight[side > 0] *= 0.1 * (weight[side < 0].sum() + 1) / max(weight[side > 0].sum(), 1e-9)
                machines.append(squared_hinge(x, fold, np.r_[bad, clean], side, weight))
            if step == ROUNDS:
                break
            margin = np.stack([x @ (fold @ coef.astype(np.float32)) + bias for coef, bias in machines])
            # clean words that are told apart worst become landmarks too
            worst = clean[np.argsort(-(np.maximum(0, 1 + margin.mean(0)[clean]) * np.minimum(in_clean[clean], 200)), kind="stable")[: HARD // ROUNDS]]
            new = [i for i in worst.tolist() if i not in set(chosen)]
            if new:
                Landmarks([words[i] for i in new]).kernel(words, kernel[:, len(chosen) : len(chosen) + len(new)])
            chosen += new
            landmarks = Landmarks([words[i] for i in chosen])
        coef, self.bias = machines[0]
        self.weights[landmarks.keys] = landmarks.base.T @ (fold @ coef)

    def margins(self, words: list[bytes]) -> np.ndarray:
        out = np.full(len(words), FLOOR)
        for index, codes in coded(words).values():
            out[index] = self._margins(codes)
        return out

    def _margins(self, codes: np.ndarray) -> np.ndarray:
        if codes.shape[1] < 3:
            return np.full(len(codes), FLOOR)
        total = np.zeros(len(codes))
        for key, weight in triples(codes):
            total += weight * self.weights[key]
        return total / np.maximum(norms(codes), 1e-12) + self.bias

    def word_margins(self, words: t.Tokens) -> np.ndarray:
        """Margin of each word; distinct words are worked out once per worker."""
        key, first, back = np.unique(words.hash, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        known = self.keys[at] == key if len(self.keys) else np.zeros(len(key), bool)
        out = np.full(len(key), FLOOR)
        if len(self.keys):
            out[known] = self.values[at[known]]
        new = np.flatnonzero(~known)
        start = words.start[first[new]]
        size = words.end[first[new]] - start
        code = _CODE[words.data]
        for n in np.unique(size):
            pick = np.flatnonzero(size == n)
            step = max(1, 4_000_000 // (int(n) * 32))
            for i in range(0, len(pick), step):
                some = pick[i : i + step]
                out[new[some]] = self._margins(code[start[some][:, None] + np.arange(n)])
        if len(new):
            keys, values = (np.r_[self.keys, key[new]], np.r_[self.values, out[new]]) if len(self.keys) < MAX_CACHE else (key[new], out[new])
            by = np.argsort(keys)
            self.keys, self.values = keys[by], values[by]
        return out[back]

    def evidence(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Largest margin of each document, its words beyond each of ``LEVELS``, all its words."""
        rows = len(column)
        words = kernel_tokens(column)
        margin, many = np.full(rows, FLOOR), np.zeros((rows, len(LEVELS)))
        if len(words.start):
            own = self.word_margins(words)
            np.maximum.at(margin, words.row, own)
            for i, level in enumerate(LEVELS):
                many[:, i] = np.bincount(words.row, own > level, rows)
            short = words.end - words.start == 1
            if short.any():
                self._singles(words, short, margin, many)
        return margin, many, words.counts

    def features(self, margin: np.ndarray, many: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The largest margin, and how far the counts exceed what clean text of that length has."""
        return np.c_[np.clip(margin, -1, 1), np.log((many + 0.3) / (n[:, None] * self.usual + 0.3))]

    def score(self, column: pa.Array) -> np.ndarray:
        if not self.trained:  # nothing is known about any text, so none is rejected
            return np.zeros(len(column))
        return 1 / (1 + np.exp(-(self.features(*self.evidence(column)) @ self.curve[:-1] + self.curve[-1])))

    def _singles(self, words: t.Tokens, short: np.ndarray, margin: np.ndarray, many: np.ndarray) -> None:
        """Runs of at least three single letters count as one word."""
        new = np.r_[True, (short[1:] != short[:-1]) | (words.row[1:] != words.row[:-1])]
        begin = np.flatnonzero(new)
        end = np.r_[begin[1:], len(short)]
        for a, b in zip(begin.tolist(), end.tolist(), strict=True):
            if short[a] and b - a > 2:
                codes = _CODE[words.data[words.start[a:b]]]
                row = words.row[a]
                own = self._margins(codes[None])[0]
                margin[row], many[row] = max(margin[row], own), many[row] + (own > np.array(LEVELS))


def kernel_tokens(column: pa.Array) -> t.Tokens:
    """Words with signs inside them dropped, A-Z lower-cased."""
    data, off = t.string_buffers(column)
    low = t.LOWER[data]
    kept = _LETTER[low] | ~t._SPACE_WORD[low]
    at = np.r_[0, np.cumsum(kept)]
    return t.Tokens((low[kept], at[off]))


def squared_hinge(kernel: np.ndarray, fold: np.ndarray, index: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 4.0) -> tuple[np.ndarray, float]:
    """Primal L2 support vector machine on the rows ``index`` of ``kernel @ fold``, by Newton steps over its active rows."""
    w = np.zeros(fold.shape[1] + 1)
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-6
    c = cost * weight / weight.mean()
    for turn in range(50):
        active = np.flatnonzero(y * ((kernel @ (fold @ w[:-1].astype(np.float32)))[index] + w[-1]) < 1)
        gram, target = ridge.copy(), np.zeros(len(w))
        for i in range(0, len(active), 5000):
            some = active[i : i + 5000]
            part = np.c_[kernel[index[some]] @ fold, np.ones(len(some), np.float32)].astype(float)
            gram += 2 * (part.T * c[some]) @ part
            target += 2 * (part.T * c[some]) @ y[some]
        new = np.linalg.solve(gram, target)
        done = np.abs(new - w).max() < 1e-6
        w = w + (new - w) * (1.0 if turn < 10 else 0.5)
        if done:
            break
    return w[:-1], float(w[-1])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Slopes, none below 0, and bias of a logistic curve, by Newton steps with a small ridge."""
    used = list(range(x.shape[1]))
    while True:
        z = np.c_[x[:, used], np.ones(len(x))]
        w = np.zeros(z.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-z @ w))
            w += np.clip(np.linalg.solve((z.T * (weight * p * (1 - p))) @ z + 0.1 * np.eye(len(w)), z.T @ (weight * (y - p)) - 0.1 * w), -5, 5)
        if not used or w[:-1].min() >= 0:
            out = np.zeros(x.shape[1] + 1)
            out[[*used, -1]] = w
            return out
        used.pop(int(w[:-1].argmin()))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES) -> tuple[list[tuple[str, int]], float]:
    """Bounded sample of (text, label), and the share of toxic rows among all labelled ones.

    Of each class the distinct texts with the smallest hash.  Ids and hashes are joined and
    cut first; texts are then read for the chosen ids only.  So no text is shuffled, and
    what reaches the driver is bounded by ``rows`` and ``most_bytes``.
    """
    known = labels.filter("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    hashed = docs.filter("length(text) > 0").select("doc_id", F.xxhash64("text").alias("h"), (F.octet_length("text") <= most_bytes).alias("fits"))
    once = hashed.join(known, "doc_id").groupBy("h", "fits").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"))
    once = kept_in(docs.sparkSession, once, "labelled")
    n, toxic = once.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    fit = once.filter("fits").select("h", "doc_id", "toxic")
    chosen = fit.filter("toxic = 1").orderBy("h").limit(rows).union(fit.filter("toxic = 0").orderBy("h").limit(rows))
    # an id may stand for several texts, and a text for several rows: one row for each chosen hash
    found = docs.withColumn("h", F.xxhash64("text")).join(F.broadcast(chosen), ["doc_id", "h"]).dropDuplicates(["h"])
    picked = sorted((r["h"], r["text"], r["toxic"]) for r in found.select("h", "text", "toxic").toLocalIterator())
    return [(text, y) for _, text, y in picked], toxic / n if n else 0.0


def _score(trained, key: str, score_only: bool, threshold: float, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = t.held(key, lambda: copy.copy(trained.value))  # keeps its word cache from task to task
        for part in t.pieces(batches, text):
            score = model.score(part.column(part.schema.get_field_index(text)))
            if score_only:
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])
            else:
                yield part.filter(pa.array(score < threshold))

    return t.holding(run)


def _trained(docs: DataFrame, labels: DataFrame):
    return docs.sparkSession.sparkContext.broadcast(Model(*training_rows(docs, labels))), uuid.uuid4().hex


def toxicity_scores(docs: DataFrame, train_docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its score and prediction; a narrow job after training."""
    model, key = _trained(t.text_frame(train_docs, id_col, text_col), labels)
    return t.text_frame(docs, id_col, text_col).mapInArrow(_score(model, key, True, threshold, "text"), "doc_id long, score double, predicted int")


def drop_toxic(docs: DataFrame, train_docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents below the threshold, all their columns unchanged."""
    model, key = _trained(t.text_frame(train_docs, id_col, text_col), labels)
    return docs.mapInArrow(_score(model, key, False, threshold, text_col), docs.schema)


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = held_out(F.col("doc_id"))
    scores = toxicity_scores(docs, docs.filter(~held), labels.filter(~held))
    return scores.select("doc_id", held.alias("held_out"), "score", "predicted")
