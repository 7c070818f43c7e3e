"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def repetition(text):
    words = spaced(text)
    n = len(words)
    seen = Counter(tuple(words[i : i + 8]) for i in range(n - 7))
    hit = {j for i in range(n - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if spaced(line):
            dup += line in lines
            lines.add(line)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit), n < 20 or 100 * len(hit) > 30 * n


def decontamination(text, items):
    words, hit, found = alnum(text), set(), set()
    for item, body in items:
        w = alnum(body)
        k = min(10, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            for j in range(len(words) - k + 1):
                if words[j : j + k] == w[i : i + k]:
                    hit.update(range(j, j + k))
                    found.add(item)
    names = sorted(str(x) for x in found if x is not None)
    return len(words), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)


def substring_dedup(rows, window=50):
    first = {}
    for doc_id, text in rows:
        words = spaced(text)
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if doc_id is not None:
                first[key] = min(first.get(key, doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        words = spaced(text)
        gone = {j for i in range(len(words) - window + 1) if doc_id is not None and first[tuple(words[i : i + window])] < doc_id for j in range(i, i + window)}
        kept = " ".join(w for j, w in enumerate(words) if j not in gone)
        out.append((doc_id, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def suffix_dedup(rows, window=200, keep_first=False):
    data = [(i, (text or "").encode()) for i, text in rows]
    places = defaultdict(list)
    for row, (doc_id, b) in enumerate(data):
        for i in range(len(b) - window + 1):
            places[b[i : i + window]].append((row, i))
    out = []
    for row, (doc_id, b) in enumerate(data):
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            at = places[b[i : i + window]]
            if len(at) > 1 and (not keep_first or min(at) != (row, i)):
                gone[i : i + window] = b"\1" * window
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((doc_id, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def near_duplicates(rows, threshold=0.8):
    sets = []
    for _, text in rows:
        w = alnum(text)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    links, parent = Counter(), list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            if sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if common >= threshold * (len(sets[a]) + len(sets[b]) - common) - 1e-9:
                    links[a] += 1
                    links[b] += 1
                    parent[max(find(a), find(b))] = min(find(a), find(b))
    group = defaultdict(list)
    for a in range(len(rows)):
        group[find(a)].append(rows[a][0])
    return [(rows[a][0], min((x for x in group[find(a)] if x is not None), default=rows[a][0]), links[a]) for a in range(len(rows))]


def phrases(text, sample):
    """Phrases of a greedy parse of a text against a sample."""
    n, at = 0, 0
    while at < len(text):
        k = 1
        while at + k <= len(text) and text[at : at + k] in sample:
            k += 1
        at += max(k - 1, 1)
        n += 1
    return n


def kernel(a, b, decay, reach):
    """Normalised gapped subsequence kernel of two words of letters."""
    def weights(w):
        out = Counter()
        for i in range(len(w)):
            for j in range(i + 1, min(len(w), i + reach)):
                for k in range(j + 1, min(len(w), i + reach)):
                    out[w[i] + w[j] + w[k]] += decay ** (k - i + 1)
        return out

    x, y = weights(a), weights(b)
    dot = lambda p, q: sum(v * q[k] for k, v in p.items())
    return dot(x, y) / (dot(x, x) * dot(y, y)) ** 0.5 if x and y else 0.0


def license_places(text):
    """Words, places of base phrases, first and last of them, labels."""
    words, at, labels = alnum(text), [], set()
    for phrase, label in {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}.items():
        own = phrase.split()
        found = [i for i in range(len(words) - len(own) + 1) if words[i : i + len(own)] == own]
        at += found
        labels |= {label} if found else set()
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def repeats(text, least=8):
    """Longest repeat of a text in words, and the share of words in repeats of at least ``least`` words."""
    words = spaced(text)
    n, longest, hit = len(words), 0, set()
    for i in range(n):
        for j in range(i + 1, n):
            k = 0
            while j + k < n and words[i + k] == words[j + k]:
                k += 1
            if k >= least:
                longest = max(longest, k)
                hit |= {*range(i, i + k), *range(j, j + k)}
    return longest, len(hit) / max(n, 1)
