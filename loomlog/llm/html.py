"""Main text of web pages by tag-path ratios.

A page is read once into blocks (runs of text between block tags) with their root-to-leaf tag paths. Text and punctuation
per block and the share of link text are taken per path and per path prefix (the containers), so a path's length doesn't
count; they are fused, smoothed over neighbouring blocks of a container and compared with the page's own level. Being in an article or main
raises a path's value, a name of a menu, header, advert and the like among the parts of a class or id lowers it. Elements
that are so by tag, role or a whole class or id, and hidden ones, don't count.

Edge cases: null or empty html: empty text; unclosed and stray tags are taken as browsers do, closely; text without any
tag is one block; character references are decoded once, after parsing; repeated rows are read each; very long and deep
pages are read whole in one pass; extra columns are ignored.
"""

from __future__ import annotations

import html as references
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import importable
from .tokens import in_slices

#: HTML's elements by how they lay out, and names of what isn't main text.
_RAW = "script|style|noscript|template|textarea|title|iframe|svg|math|canvas|object|select|option"
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul head".split()
)
_DROP = frozenset("nav footer aside form head button select menu dialog fieldset".split())
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr notice notices alert menu nav navbar navigation "
    "breadcrumb breadcrumbs sidebar side aside footer header masthead comment comments reply replies respond discussion disqus share sharing social related "
    "recommended newsletter subscribe signup login popup modal overlay widget pagination pager toolbar".split()
)
_ITEMS = ("li", "dt", "dd", "tr", "td", "th")
_CLOSES_P = _BLOCK - {"body", "html", "head"}
_TOKEN = re.compile(rf"(?is)<!--.*?(?:-->|\Z)|<({_RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*)>|<[!?][^>]*>")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_HIDING = re.compile(r"(?i)(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b")
DEEPEST = 512  # levels of a path
#: Set by hand: the least value of a main text's path, and the factors of a doubtful name, of an article and of the page as a container.
LEAST, DOUBTFUL, ARTICLE, WHOLE = 0.3, 0.6, 1.5, 0.3
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_PARTS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_MARKS = re.compile(r"[.,;:!?…、。，！？]")


def _standing(tag: str, attributes: str, in_article: bool) -> int:
    """2: boilerplate; 1: a part of a class or id is named like it; 0: neither."""
    if tag in _DROP or (tag == "header" and not in_article):
        return 2
    if not attributes.strip(" /"):
        return 0
    given: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attributes):
        given.setdefault(m[1].lower(), references.unescape(m[2] or m[3] or m[4] or ""))
    if tag in ("html", "body"):
        return 0
    if "hidden" in given or given.get("aria-hidden", "").strip().lower() == "true" or _HIDING.search(given.get("style", "")):
        return 2
    words = " ".join(given.get(k, "") for k in ("class", "id", "role")).lower().split()
    if tag in ("article", "main"):
        return 2 if tag == "article" and {"comment", "comments", "reply"}.intersection(words) else 0
    if _NAMES.intersection(words):
        return 2
    return int(any(_NAMES.intersection(_PARTS.findall(w)) for w in words))


class Paths:
    """Root-to-leaf tag paths as a tree: node 0 is the root; a node has its parent, tag, whether its name is doubtful and whether an article or main is on it."""

    def __init__(self):
        self.parent, self.tag, self.doubtful, self.article, self.depth = [-1], [""], [False], [False], [0]
        self._child: dict[tuple, int] = {}

    def below(self, at: int, tag: str, doubtful: bool) -> int:
        """The node of tag under at; beyond ``DEEPEST`` levels elements stay at the last one, as browsers have it."""
        if self.depth[at] >= DEEPEST:
            return at
        key = (at, tag, doubtful)
        found = self._child.get(key)
        if found is None:
            found = self._child[key] = len(self.parent)
            self.parent.append(at)
            self.tag.append(tag)
            self.doubtful.append(self.doubtful[at] or doubtful)
            self.article.append(self.article[at] or tag in ("article", "main"))
            self.depth.append(self.depth[at] + 1)
        return found


def blocks_of(page: str):
    """Paths, and (path, text, characters of link text) of each block outside boilerplate, in page order. One pass: nothing is searched
    for after the last ``>``, and the stack only for tags that are open."""
    paths, at_path = Paths(), 0
    stack: list[tuple[str, bool, int]] = []  # tag, in boilerplate, the path outside it
    opened: dict[str, int] = defaultdict(int)
    out, run, linked, at = [], [], 0, 0
    whole, page = page, page[: page.rfind(">") + 1]

    def add(piece: str) -> None:
        nonlocal linked
        if piece and not (stack and stack[-1][1]):
            piece = references.unescape(piece) if "&" in piece else piece
            run.append(piece)
            if opened["a"]:
                linked += len(piece)

    def end() -> None:
        nonlocal run, linked
        if run:
            text = _SPACE.sub(" ", "".join(run)).strip()
            if text:
                out.append((at_path, text, linked))
            run, linked = [], 0

    def pop(to: int) -> None:
        nonlocal at_path
        for t, _, _ in stack[to:]:
            opened[t] -= 1
        at_path = stack[to][2]
        del stack[to:]

    def top_of(tag: str) -> int:
        return next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag)

    for m in _TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        tag = (m[3] or m[6] or "").lower()
        if not tag:
            continue
        closing, attributes = m[2] or m[5], m[4] or m[7] or ""
        if tag in _BLOCK:
            end()
        elif tag == "br":
            add(" ")
        if closing:
            if opened[tag]:
                pop(top_of(tag))
            continue
        if tag in _VOID:
            continue
        if tag in _CLOSES_P:
            if opened["p"]:
                pop(top_of("p"))
            if tag in _ITEMS and any(opened[x] for x in _ITEMS):
                for k in range(len(stack) - 1, -1, -1):
                    open_ = stack[k][0]
                    if open_ in ("ul", "ol", "dl", "table", "div", "article", "section") or (tag in ("td", "th") and open_ == "tr"):
                        break
                    if open_ == tag or {open_, tag} in ({"dt", "dd"}, {"td", "th"}):
                        pop(k)
                        break
        skip = bool(stack) and stack[-1][1]
        inside = tag in ("article", "main") or paths.article[at_path]
        standing = 2 if skip else _standing(tag, attributes, inside)
        stack.append((tag, standing == 2, at_path))
        opened[tag] += 1
        if tag in _BLOCK:
            at_path = paths.below(at_path, tag, standing == 1)
    add(page[at:])
    tail = whole[len(page) :]
    cut = re.search(r"<[a-zA-Z/!?]", tail)  # a tag that never ends is none, and nothing follows it
    add(tail[: cut.start()] if cut else tail)
    end()
    return paths, out


def _ratio(of: list[int], level: float, marked: float) -> float:
    """Text and punctuation per block, relative to the page's, less the part in links."""
    n, chars, marks, links = of
    return (min(1.0, chars / n / level) + min(1.0, marks / n / marked)) / 2 * (1 - links / chars) if n else 0.0


def path_values(paths: Paths, blocks: list) -> list[float]:
    """The value of every path: the mean of its own ratio and of the best of its containers. The page as a whole (html, body, the
    root) is a container as far as it holds the text itself and not in sections of its own: by that share, ``WHOLE`` at least."""
    own = [[0, 0, 0, 0] for _ in paths.parent]  # blocks, text, punctuation, link text
    for path, text, links in blocks:
        of = own[path]
        of[0] += 1
        of[1] += len(text)
        of[2] += len(_MARKS.findall(text))
        of[3] += min(links, len(text))
    under = [of[:] for of in own]
    for k in range(len(own) - 1, 0, -1):  # children come after their parents
        up = under[paths.parent[k]]
        for x in range(4):
            up[x] += under[k][x]
    # the page's level: per block, of the paths in proportion to their text outside links
    weight = sum(c - e for _, c, _, e in own) or 1
    level = sum((c - e) * c / n for n, c, _, e in own if n) / weight or 1.0
    marked = sum((c - e) * m / n for n, c, m, e in own if n) / weight or 1.0
    whole = ("", "html", "body")
    direct = sum(c - e for k, (_, c, _, e) in enumerate(own) if paths.tag[k] in whole or paths.tag[paths.parent[k]] in whole) / weight
    outer = max(WHOLE, min(1.0, direct))
    best, value = [outer * _ratio(under[0], level, marked)], [0.0] * len(own)
    value[0] = (_ratio(own[0], level, marked) + best[0]) / 2
    for k in range(1, len(own)):
        up = paths.parent[k]
        value[k] = (_ratio(own[k], level, marked) + best[up]) / 2 * (DOUBTFUL if paths.doubtful[k] else 1.0) * (ARTICLE if paths.article[k] else 1.0)
        here = _ratio(under[k], level, marked) * (outer if paths.tag[k] in whole else 1.0)
        best.append(here if not up else max(best[up], here))
    return value


def chosen(paths: Paths, blocks: list, value: list[float], least: float = LEAST) -> list[str]:
    """Blocks whose value, or the mean of theirs and of neighbours in the same container, is at least ``least``, but for those that are links."""
    of: dict[int, list[int]] = defaultdict(lambda: [0, 0])
    for path, text, links in blocks:
        of[path][0] += len(text)
        of[path][1] += min(links, len(text))
    out = []
    for k, (path, text, links) in enumerate(blocks):
        near = [value[p] for p, _, _ in blocks[max(0, k - 1) : k + 2] if p == path or paths.parent[p] == paths.parent[path]]
        chars, in_links = of[path]
        linked = links > 0.6 * len(text) and not (paths.article[path] and (in_links <= 0.6 * chars or paths.tag[path] in _HEADINGS))
        if max(value[path], sum(near) / len(near)) >= least and not linked:
            out.append(text)
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    paths, blocks = blocks_of(page)
    return "\n".join(chosen(paths, blocks, path_values(paths, blocks))) if blocks else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def read(batches):
        for batch in batches:
            for a, b, pages_html in in_slices(batch.column("html")):
                texts = [main_text(x) for x in pages_html]
                yield pa.RecordBatch.from_arrays([batch.column("page_id").slice(a, b - a), batch.column("url").slice(a, b - a), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    importable(pages.sparkSession)
    return pages.select("page_id", "url", "html").mapInArrow(read, "page_id long, url string, text string, n_chars long")
