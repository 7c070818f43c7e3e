"""HTML extraction 10: a linear-chain conditional random field over leaf blocks.

A page becomes a chain of leaf text blocks.  Each has features of its ancestors (tags,
and words in their class, id and role) and of its text (length, link share, punctuation,
notices, place in the page).  The field has two labels, main text and the rest; it is
trained by maximum likelihood on labelled pages and decoded by Viterbi.

The labelled pages are composed here: page layouts of many kinds, whose parts are known
to be main text or not (``labelled_pages``, a fixed number of pages), some with names that
say nothing about a part.  Nothing is learned
from the pages to be extracted, so a page's result depends on that page only.

Defined cases: a null or empty page, or one without text blocks, has an empty text and
0 characters; white space inside a block becomes one blank; a line break is white space;
repeated pages get equal results, ties between labels count as the rest; a very long page
is one chain, in memory in proportion to it; other columns are ignored, whatever their
names; an empty table gives an empty result; nothing is cut or capped.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as t
from .html_blocks import Block, blocks

PAGES = 500
EPOCHS = 250
RIDGE = 0.002
STRANGE = 0.3

#: Words in class, id and role names, by what they say about a part of a page.
PARTS = {
    "advert": r"\bads?\b|\bad[-_]|[-_]ad\b|advert|sponsor|promo|banner|teaser",
    "menu": r"\bnav|menu|breadcrumb|pagination|pager|toolbar|tabs?\b|toc\b",
    "comment": r"comment|reply|replies|disqus|discussion|respond|feedback",
    "side": r"side|widget|related|recommend|popular|trending|more[-_]",
    "foot": r"foot|copyright|legal|colophon",
    "head": r"header|masthead|site[-_]?title|logo|brand",
    "notice": r"cookie|consent|notice|notification|gdpr|popup|modal|alert|newsletter|subscribe|signup|paywall",
    "share": r"share|social|follow",
    "form": r"form|search|login|contact",
    "main": r"content|article|post\b|post[-_]|entry|main|story|body|text",
}
_PARTS = {k: re.compile(v) for k, v in PARTS.items()}
_COPYRIGHT = re.compile(r"©|\(c\)\s*\d|copyright|all rights reserved", re.I)
_NOTICE = re.compile(r"cookie|subscribe|newsletter|sign up|log in|privacy policy|terms of", re.I)
_LEAVES = ("p", "h1", "h2", "h3", "li", "td", "th", "div", "blockquote", "pre", "figcaption", "dd", "dt", "a", "span", "body", "section", "article", "button", "label", "caption")
_AROUND = ("article", "main", "nav", "header", "footer", "aside", "form", "ul", "ol", "table", "figure", "section", "button", "dialog", "blockquote", "address", "menu", "fieldset")
_TEXT = ("long", "middle", "short", "tiny", "stop", "all links", "half links", "copyright", "notice", "first", "last", "early", "late", "upper")
NAMES = ["bias", *(f"leaf {x}" for x in _LEAVES), *(f"in {x}" for x in _AROUND), *(f"named {x}" for x in PARTS), *_TEXT,
         "inner main", "inner rest", "plain long", "heading in main part"]
_AT = {x: i for i, x in enumerate(NAMES)}
_leaf_of = set(_LEAVES)


def features(page: list[Block]) -> list[list[int]]:
    """Numbers of the features that hold for each block."""
    out = []
    n = len(page)
    for k, b in enumerate(page):
        tags = b.tags
        leaf = next((x for x in reversed(tags) if x in _leaf_of and x not in ("a", "span")), tags[-1] if tags else "body")
        inside = set(tags)
        named = [x for x, p in _PARTS.items() if p.search(b.names)] if b.names else []
        size = len(b.text)
        share = b.linked / max(size, 1)
        found = ["bias", f"leaf {leaf}", *(f"in {x}" for x in _AROUND if x in inside), *(f"named {x}" for x in named)]
        found.append("long" if size > 200 else "middle" if size > 80 else "short" if size > 25 else "tiny")
        if b.text[-1] in ".!?…:;\"'”»)":
            found.append("stop")
        if share > 0.8:
            found.append("all links")
        elif share > 0.4:
            found.append("half links")
        if _COPYRIGHT.search(b.text):
            found.append("copyright")
        if _NOTICE.search(b.text):
            found.append("notice")
        if k == 0:
            found.append("first")
        if k == n - 1:
            found.append("last")
        if k * 4 < n:
            found.append("early")
        if k * 4 >= 3 * n:
            found.append("late")
        if size > 3 and b.text.isupper():
            found.append("upper")
        around = [x for x in reversed(tags) if x in ("article", "main", "nav", "header", "footer", "aside", "form", "dialog")]
        rest = bool(around) and around[0] not in ("article", "main") or any(x not in ("main", "head") for x in named)
        if around and around[0] in ("article", "main") and not rest:
            found.append("inner main")
            if leaf in ("h1", "h2", "h3"):
                found.append("heading in main part")
        if rest:
            found.append("inner rest")
        elif size > 80 and share < 0.3:
            found.append("plain long")
        out.append([_AT[x] for x in found if x in _AT])
    return out


class Field:
    """Weights of a two-label linear chain."""

    def __init__(self, pages: list[tuple[list[list[int]], list[int]]]) -> None:
        longest = max(len(y) for _, y in pages)
        x = np.zeros((len(pages), longest, len(NAMES)))
        y = np.zeros((len(pages), longest), int)
        live = np.zeros((len(pages), longest), bool)
        for i, (found, labels) in enumerate(pages):
            for k, ids in enumerate(found):
                x[i, k, ids] = 1
            y[i, : len(labels)] = labels
            live[i, : len(labels)] = True
        self.state, self.step = np.zeros((len(NAMES), 2)), np.zeros((2, 2))
        moments = [np.zeros_like(self.state), np.zeros_like(self.step), np.zeros_like(self.state), np.zeros_like(self.step)]
        rate, count = 0.1, live.sum()
        for epoch in range(1, EPOCHS + 1):
            grads = self._gradient(x, y, live)
            for j, (w, g) in enumerate(zip((self.state, self.step), grads, strict=True)):
                g = g / count - RIDGE * w
                moments[j] = 0.9 * moments[j] + 0.1 * g
                moments[j + 2] = 0.999 * moments[j + 2] + 0.001 * g * g
                w += rate * (moments[j] / (1 - 0.9**epoch)) / (np.sqrt(moments[j + 2] / (1 - 0.999**epoch)) + 1e-8)
        self.rows, self.move = self.state.tolist(), self.step.tolist()

    def _gradient(self, x: np.ndarray, y: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Observed minus expected counts, by forward and backward passes over all pages at once."""
        pages, longest, _ = x.shape
        score = x @ self.state
        ahead = np.zeros((longest, pages, 2))
        back = np.zeros((longest, pages, 2))
        ahead[0] = score[:, 0]
        for k in range(1, longest):
            new = np.logaddexp(ahead[k - 1][:, 0, None] + self.step[0], ahead[k - 1][:, 1, None] + self.step[1]) + score[:, k]
            ahead[k] = np.where(live[:, k, None], new, ahead[k - 1])
        for k in range(longest - 2, -1, -1):
            after = back[k + 1] + score[:, k + 1]
            new = np.logaddexp(after[:, 0, None] + self.step[:, 0], after[:, 1, None] + self.step[:, 1])
            back[k] = np.where(live[:, k + 1, None], new, 0)
        total = np.logaddexp(ahead[-1][:, 0], ahead[-1][:, 1])
        p = np.exp(ahead + back - total[None, :, None]).transpose(1, 0, 2) * live[:, :, None]
        one = np.zeros_like(p)
        np.put_along_axis(one, y[:, :, None], 1, 2)
        g_state = np.einsum("pkf,pkl->fl", x, (one - p) * live[:, :, None])
        g_step = np.zeros((2, 2))
        for k in range(1, longest):
            both = live[:, k]
            pair = np.exp(ahead[k - 1][:, :, None] + self.step + (score[:, k] + back[k])[:, None] - total[:, None, None])[both].sum(0)
            seen = np.zeros((2, 2))
            np.add.at(seen, (y[both, k - 1], y[both, k]), 1)
            g_step += seen - pair
        return g_state, g_step

    def decode(self, found: list[list[int]]) -> list[int]:
        """Viterbi labels of a chain."""
        if not found:
            return []
        rows, ((m00, m01), (m10, m11)) = self.rows, self.move
        back: list[tuple[int, int]] = []
        a = b = 0.0
        for k, ids in enumerate(found):
            s0 = s1 = 0.0
            for i in ids:
                r = rows[i]
                s0 += r[0]
                s1 += r[1]
            if k == 0:
                a, b = s0, s1
                continue
            from0, from1 = int(b + m10 > a + m00), int(b + m11 > a + m01)
            back.append((from0, from1))
            a, b = s0 + (b + m10 if from0 else a + m00), s1 + (b + m11 if from1 else a + m01)
        label = int(b > a)
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]


def labelled_pages(n: int = PAGES, seed: int = 7, strange: float = STRANGE) -> list[tuple[list[list[int]], list[int]]]:
    """Features and labels of composed pages.  Blocks of main text start with a mark, by
    which their label is read back after parsing.  A share of the pages, ``strange``, has
    names of its own for header, menu, main part and footer, which no feature knows."""
    rng = random.Random(seed)
    mark = "\ue000"

    def words(low: int, high: int) -> str:
        return " ".join("".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(low, high))).capitalize()

    def prose() -> str:
        return ". ".join(words(3, 18) for _ in range(rng.choice([1, 1, 2, 3, 5]))) + rng.choice([".", ".", ".", "", "!", "%%%"])

    def links(k: int, wrap: str = "li") -> str:
        return "".join(f'<{wrap}><a href="/{i}">{words(1, 4)}</a></{wrap}>' for i in range(k))

    def main() -> str:
        out = [f"<h1>{mark}{words(1, 9)}</h1>"] if rng.random() < 0.85 else []
        for _ in range(rng.choice([1, 1, 2, 3, 4, 6, 9])):
            kind = rng.random()
            if kind < 0.6:
                inner = prose()
                if rng.random() < 0.3:
                    inner += f' <a href="/x">{words(1, 3)}</a> {words(2, 9)}.'
                out.append(f"<p>{mark}{inner}" + ("</p>" if rng.random() < 0.8 else ""))
            elif kind < 0.7:
                out.append(f"<h{(h := rng.choice([2, 2, 3]))}>{mark}{words(1, 7)}</h{h}>")
            elif kind < 0.76:
                out.append("<ul>" + "".join(f"<li>{mark}{words(1, 12)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif kind < 0.8:
                out.append(f"<blockquote>{mark}{prose()}</blockquote>")
            elif kind < 0.84:
                out.append("<table>" + "".join(f"<tr><td>{mark}{words(1, 3)}</td><td>{mark}{rng.randint(1, 999)}</td></tr>" for _ in range(3)) + "</table>")
            elif kind < 0.87:
                out.append(f"<pre>{mark}{words(2, 12)}</pre>")
            elif kind < 0.9:
                out.append(f"<figure><figcaption>{mark}{words(2, 9)}</figcaption></figure>")
            elif kind < 0.95:
                out.append(f"<p>{mark}<b>{words(1, 9)}<br>")
            elif kind < 0.98:
                out.append(advert())
            else:
                out.append(f'<div class="share"><a href="#">{words(1, 2)}</a></div>')
        return "".join(out)

    def advert() -> str:
        name = rng.choice(["ad", "ads", "advert", "ad-slot", "sponsored", "promo", "banner"])
        return f'<div class="{name}">{rng.choice([words(2, 6), prose(), f"<p>{prose()}</p>"])}</div>'

    def comments() -> str:
        body = "".join(f"<{w}>{prose()}</{w}>" for w in rng.choices(["p", "li", "div"], k=rng.randint(1, 4)))
        name = rng.choice(["comments", "comment-list", "replies", "discussion"])
        return rng.choice([f'<section class="{name}"><h3>{words(1, 2)}</h3>{body}</section>', f'<div id="{name}">{body}</div>'])

    def notice() -> str:
        name = rng.choice(["cookie-notice", "consent", "newsletter", "popup", "notice", "alert"])
        return f'<div class="{name}"><p>{rng.choice(["We use cookies. ", "Subscribe to our newsletter. ", ""])}{prose()}</p><button>{words(1, 2)}</button></div>'

    def form() -> str:
        return f'<form action="/s"><label>{words(1, 3)}</label><input><p>{prose()}</p><button>{words(1, 1)}</button></form>'

    def side() -> str:
        body = rng.choice([f"<ul>{links(4)}</ul>", f"<p>{prose()}</p>", f"<h3>{words(1, 3)}</h3><p>{prose()}</p>"])
        return rng.choice([f"<aside>{body}</aside>", f'<div class="{rng.choice(["sidebar", "widget", "related-posts"])}">{body}</div>'])

    out = []
    for _ in range(n):
        head = rng.choice(["", f"<header><h1>{words(1, 3)}</h1><p>{words(2, 6)}</p></header>", f'<div id="header">{words(1, 4)}</div>', f"<header>{words(1, 4)}</header>"])
        menu = rng.choice([f"<nav><ul>{links(rng.randint(2, 7))}</ul></nav>", f'<div class="menu">{links(4, "span")}</div>', f'<ul class="nav">{links(5)}</ul>', ""])
        open_, close = rng.choice([("<article>", "</article>")] * 4 + [("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<div id="content">', "</div>"), ('<div class="post-content">', "</div>"), ("<div>", "</div>"), ('<section class="entry">', "</section>")])
        inner = main()
        if rng.random() < 0.15:
            inner += comments()
        if rng.random() < 0.1:
            inner += form()
        after = "".join(f() for f in (comments, side, advert, notice, form) if rng.random() < 0.2)
        before = "".join(f() for f in (advert, notice, side) if rng.random() < 0.25)
        foot = rng.choice([f"<footer>&copy; {words(1, 3)}.com &middot; {prose()}</footer>", f'<div class="footer"><p>{words(3, 9)}. All rights reserved.</p></div>', f"<footer><p>{prose()}</p><ul>{links(3)}</ul></footer>", f"<footer>{prose()}</footer>", ""])
        if rng.random() < strange:
            head, menu, open_, foot = (re.sub(r'(class|id)="[^"]*"', lambda m: f'{m[1]}="{"".join(rng.choices("bdgkqvwxz", k=6))}"', part) for part in (head, menu, open_, foot))
        found = blocks(f"<html><head><title>{words(1, 5)}</title></head><body>{head}{menu}{before}{open_}{inner}{close}{after}{foot}</body></html>")
        labels = [int(b.text.startswith(mark)) for b in found]
        for b in found:
            b.text = b.text.replace(mark, "").strip() or "x"
        if found:
            out.append((features(found), labels))
    return out


def extract(field: Field, page: str | None) -> str:
    """Main text of one page."""
    found = blocks(page)
    labels = field.decode(features(found))
    return "\n\n".join(b.text for b, y in zip(found, labels, strict=True) if y)


def _extract(field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = field.value
        for part in t.pieces(batches, "html"):
            texts = [extract(model, x) for x in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    return run


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page with its main text; a narrow job after training."""
    field = pages.sparkSession.sparkContext.broadcast(Field(labelled_pages()))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(t.task(_extract(field)), "page_id long, url string, text string, n_chars long")


def op10_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
