"""Main text of web pages as the maximum-scoring subsequence of a page's tokens.

A page is read as words and tags. Words score positive, tags negative; one
linear scan finds the contiguous region with the highest sum. The weights are
learned from labelled pages: pages whose one ``article`` or ``main`` element
marks the content. A tag's weight is the log-odds of its place in and out of the
content; an element whose names and class words belong outside by clear odds is
boilerplate, and counts as one tag with its words. Pseudo-counts for common names
(fixed values below) stand in for what the labelled pages do not show.

Inside the region, boilerplate is left out, character references are decoded,
white space within a block becomes one space, and blocks are joined in order by
one space. Defined cases: a null or empty page, and one without words, has an
empty text; ids and urls may be null or repeat, each row is read by itself;
unclosed tags, quotes, comments and scripts are read to the end like a browser
does; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.session import ship_package

LABELLED_PAGES = 300            # pages the weights are learned from: the bound of the fit
LABELLED_CHARS = 200_000        # longer pages are not used for the fit
CLEAR_ODDS = -1.5               # log-odds below which an element is boilerplate
TAG_FLOOR, TAG_CEILING = -2.0, -0.05
SEED = 5

# Names of the HTML standard, and words that sites use in class names.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt "
                   "ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|textarea|title|iframe|noembed|noframes|xmp"
SEMANTIC = frozenset("address article aside button dialog fieldset figure footer form header main menu nav noscript "
                     "object option select svg template".split())
OUTSIDE = frozenset("ad ads adv advert advertisement aside banner breadcrumb breadcrumbs button comment comments "
                    "consent cookie cookies dialog disclaimer discussion disqus fieldset footer form gdpr header login "
                    "masthead menu modal nav navbar navigation newsletter noscript notice object option pager "
                    "pagination popup promo promoted promotion recommended related replies reply respond search select "
                    "share sharing sidebar signup skip social sponsor sponsored subscribe svg tags template toolbar "
                    "widget".split())
INSIDE = frozenset("article content entry main post story".split())
PRIOR = 20
# A class name that says how the page is laid out, by its first or last word, does not say what the element is.
STATE = frozenset("has hide is no not show with without".split())
LAYOUT = frozenset("layout open page template".split())
#: An element with this share of the page's words or more is never left out as a whole.
MOST = 0.75

_PAGE = ("html", "head", "body")
_TOKEN = re.compile(
    r"(?P<note><!--.*?(?:-->|\Z))"
    rf"|<(?P<raw>{RAW})\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:(?P<shut></(?P=raw)\s*+>)|\Z)"
    r"|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[A-Za-z][^\s/>]*+)(?P<rest2>[^>]*+)>"
    r"|<[!?/][^>]*+>", re.S | re.I)
_NAMED = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def parts_of(name: str, rest: str) -> tuple[str, ...]:
    """What an element is known by: its class, id and role words, and its name
    if that means something or nothing else is there."""
    found: list[str] = []
    for m in _NAMED.finditer(rest):
        for token in (m[1] or m[2] or m[3] or "").split():
            words = [w.lower() for w in _WORDS.findall(token)]
            if words and words[0] not in STATE and (len(words) == 1 or words[-1] not in LAYOUT):
                found += words
    return tuple(dict.fromkeys(found + ([name] if name in SEMANTIC or not found else [])))


def tokens(page: str) -> list[tuple]:
    """("text", string), ("open", name, parts) and ("close", name) in order."""
    out: list[tuple] = []
    at, stop = 0, page.rfind(">") + 1           # nothing after the last > is a tag, but a comment may begin there
    for m in _TOKEN.finditer(page, 0, stop):
        if m.start() > at:
            out.append(("text", page[at:m.start()]))
        at = m.end()
        name = m["name"] or m["name2"]
        if name:
            name = name.lower()
            if m["end"] or m["end2"]:
                out.append(("close", name))
            else:
                rest = m["rest"] or m["rest2"] or ""
                out.append(("open", name, parts_of(name, rest)))
                if rest.endswith("/") and name in SEMANTIC:
                    out.append(("close", name))
        elif m["raw"]:
            out.append(("gap", ""))
        if at == stop and (m["raw"] and not m["shut"] or m["note"] and not m["note"].endswith("-->")):
            return out                          # a script or comment that is never closed takes the rest
    tail = page[at:]
    if (note := tail.find("<!--", max(0, stop - at))) >= 0:
        tail = tail[:note]
    if tail:
        out.append(("text", tail))
    return out


class Weights:
    """Log-odds of words, tags and element parts, from counts in and out of the
    content of labelled pages."""

    def __init__(self):
        self.words, self.tags, self.parts = Counter(), Counter(), Counter()

    def learn(self, toks: list[tuple]) -> None:
        marked = [k for k, t in enumerate(toks) if t[0] == "open" and t[1] in ("article", "main")]
        names = {toks[k][1] for k in marked}
        if len(marked) != 1 and not (len(marked) == 2 and names == {"article", "main"}):
            return
        first = marked[-1]
        last = next((k for k in range(first + 1, len(toks)) if toks[k] == ("close", toks[first][1])), len(toks))
        for side, lo, hi in ((False, 0, first), (True, first + 1, last), (False, last + 1, len(toks))):
            stack: list[tuple] = []
            for t in toks[lo:hi]:
                # a tag outside counts where no block around it explains it
                if t[0] == "open" and t[2] == (t[1],) and (side or all(s[1] in INLINE or s[1] in _PAGE for s in stack)):
                    self.tags[t[1], side] += 1
                if t[0] == "open" and t[1] not in VOID:
                    stack.append(t)
                elif t[0] == "close":
                    k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][1] == t[1]), None)
                    if k is not None:
                        del stack[k:]
                if t[0] == "text" and (n := len(t[1].split())):
                    self.words[side] += n
                    blocks = [s for s in stack if s[1] not in INLINE and s[1] not in _PAGE]
                    # outside, the outermost block explains its words; inside, all blocks do
                    for s in blocks if side else blocks[:1]:
                        for part in s[2]:
                            self.parts[part, side] += 1

    @staticmethod
    def _odds(inside: float, outside: float) -> float:
        return math.log((inside + 1) / (outside + 1))

    def word(self) -> float:
        return max(0.5, min(2.0, self._odds(self.words[True], self.words[False])))

    def tag(self, name: str) -> float:
        odds = self._odds(self.tags[name, True], self.tags[name, False])
        return max(TAG_FLOOR, min(TAG_CEILING, odds))

    def part(self, part: str) -> float:
        return self._odds(self.parts[part, True] + PRIOR * (part in INSIDE),
                          self.parts[part, False] + PRIOR * (part in OUTSIDE))

    def boilerplate(self, parts: tuple[str, ...], within_content: bool) -> float | None:
        """The weight of a boilerplate element, None for any other. A header in
        the content element heads the article."""
        if within_content:
            parts = tuple(p for p in parts if p != "header")
        worst = min((self.part(p) for p in parts), default=0.0)
        if worst < CLEAR_ODDS and not any(p in ("article", "main") for p in parts):
            return max(TAG_FLOOR, worst)
        return None


def extents(toks: list[tuple]) -> list[int]:
    """The end of the element that opens at each token: after its close tag, or, unclosed,
    before the next tag that opens a block. One pass from each side."""
    end = [0] * len(toks)
    opened: dict[str, list[int]] = {}
    for k, t in enumerate(toks):
        if t[0] == "open":
            opened.setdefault(t[1], []).append(k)
        elif t[0] == "close" and opened.get(t[1]):
            end[opened[t[1]].pop()] = k + 1
    block = len(toks)
    for k in range(len(toks) - 1, -1, -1):
        if toks[k][0] == "open":
            end[k] = end[k] or block
            if toks[k][1] not in INLINE:
                block = k
    return end


def scored(toks: list[tuple], weights: Weights) -> list[tuple[float, str, str]]:
    """(score, kind, text) of each token; a boilerplate element is one of kind
    "block", as are block tags; others are "inline" or "text". An element that holds the
    longest article or main element, or most of the page's words, is never one: the
    scan decides about what is in it."""
    out: list[tuple[float, str, str]] = []
    word, end = weights.word(), extents(toks)
    before = list(accumulate((len(t[1].split()) if t[0] == "text" else 0 for t in toks), initial=0))
    marked = [i for i, t in enumerate(toks) if t[0] == "open" and t[1] in ("article", "main")]
    marker = max(marked, key=lambda i: before[end[i]] - before[i], default=None)
    k, depth, linked = 0, 0, 0
    while k < len(toks):
        t = toks[k]
        if t[0] == "text":
            n = before[k + 1] - before[k]
            out.append((0.0 if linked else word * n, "text", t[1]))
        elif t[0] == "gap":
            out.append((TAG_CEILING, "block", ""))
        else:
            if t[0] == "open":
                bad = None if t[1] in INLINE or t[1] in VOID or t[1] in _PAGE else weights.boilerplate(t[2], depth > 0)
                holds = marker is not None and k < marker < end[k] or before[end[k]] - before[k] >= MOST * before[-1] > 0
                if bad is not None and not holds or t[1] == "head":
                    out.append((TAG_FLOOR if bad is None else bad, "block", ""))
                    k = end[k]
                    continue
            step = 1 if t[0] == "open" else -1
            if t[1] in ("article", "main"):
                depth = max(0, depth + step)
            if t[1] == "a":
                linked = max(0, min(1, linked + step))
            elif t[1] not in INLINE:
                linked = 0                      # a block ends a link that was left open
            out.append((weights.tag(t[1]), "inline" if t[1] in INLINE else "block", ""))
        k += 1
    return out


def best_region(scores: list[float]) -> tuple[int, int]:
    """[start, end) of the highest sum, the first and longest of equals; empty if
    no sum is positive."""
    best, region, total, start = 0.0, (0, 0), 0.0, 0
    for k, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += s
        if total > best or (total == best and best > 0 and start == region[0]):
            best, region = total, (start, k + 1)
    return region


def main_text(page: str | None, weights: Weights) -> str:
    if not page:
        return ""
    found = scored(tokens(page), weights)
    a, b = best_region([s for s, _, _ in found])
    blocks, block = [], []
    for _, kind, text in [*found[a:b], (0, "block", "")]:
        if kind == "text":
            block.append(html.unescape(text))
        elif kind == "block" and block:
            blocks.append(" ".join("".join(block).split()))
            block = []
    return " ".join(x for x in blocks if x)


def learned(pages: DataFrame, html_col: str = "html", rows: int = LABELLED_PAGES) -> Weights:
    """Weights from at most 2 * ``rows`` labelled pages, spread over the table."""
    page = F.col(html_col)
    some = pages.where(page.isNotNull() & (F.length(page) <= LABELLED_CHARS) & page.rlike("(?i)<(article|main)[\\s>]"))
    share = min(1.0, rows / max(1, some.count()))
    weights = Weights()
    for r in some.sample(share, SEED).select(page.alias("h")).limit(2 * rows).collect():
        weights.learn(tokens(r.h))
    return weights


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            labelled_pages: int = LABELLED_PAGES) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    ship_package(pages.sparkSession)
    weights = learned(pages, html_col, labelled_pages)

    def run(batches):
        for batch in batches:
            texts = [main_text(h, weights) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
