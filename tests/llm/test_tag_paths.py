"""Main text against a plain version that keeps whole paths, on all pages of a table and on hand-marked pages in five layouts."""

import time
from collections import defaultdict
from html.parser import HTMLParser

import duckdb
import pytest

from loomlog.llm import html, queries

S = "Some words of a longer paragraph, with marks; and then, at last, its end. "
DROPPED = html._DROP | {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "select", "option", "object", "canvas", "math"}


class Plain(HTMLParser):
    """Blocks as (path of block tags, text, characters in links) of pages whose tags are all closed."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.blocks, self.text, self.links = [], [], "", 0

    def handle_starttag(self, tag, attrs):
        if tag in html._BLOCK:
            self.cut()
        if tag not in html._VOID:
            given = dict(attrs)
            words = " ".join(given.get(k) or "" for k in ("class", "id", "role")).lower().split()
            inside = any(t[0] in ("article", "main") for t in self.stack)
            out = tag in DROPPED or (tag == "header" and not inside) or "hidden" in given or (tag not in ("article", "main") and bool(html._NAMES.intersection(words)))
            doubt = not out and tag not in ("article", "main") and any(html._NAMES.intersection(html._PARTS.findall(w)) for w in words)
            self.stack.append((tag, out, doubt))

    def handle_endtag(self, tag):
        if tag in html._BLOCK:
            self.cut()
        if any(t[0] == tag for t in self.stack):
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if not any(t[1] for t in self.stack):
            self.text += data
            self.links += len(data) * any(t[0] == "a" for t in self.stack)

    def cut(self):
        if text := " ".join(self.text.split()):
            self.blocks.append((tuple((t, d) for t, _, d in self.stack if t in html._BLOCK), text, self.links))
        self.text, self.links = "", 0


def plain_text(page, switched_off=False):
    p = Plain()
    p.feed(page)
    p.close()
    p.cut()
    own, under = defaultdict(lambda: [0, 0, 0, 0]), defaultdict(lambda: [0, 0, 0, 0])
    for path, text, links in p.blocks:
        for key, sums in [(path, own), *((path[:k], under) for k in range(len(path) + 1))]:
            for x, v in enumerate((1, len(text), sum(c in ".,;:!?\u2026\u3001\u3002\uff0c\uff01\uff1f" for c in text), min(links, len(text)))):
                sums[key][x] += v
    free = sum(c - e for _, c, _, e in own.values()) or 1
    level = sum((c - e) * c / n for n, c, _, e in own.values()) / free or 1.0
    marked = sum((c - e) * m / n for n, c, m, e in own.values()) / free or 1.0
    ratio = lambda s: (min(1, s[1] / s[0] / level) + min(1, s[2] / s[0] / marked)) / 2 * (1 - s[3] / s[1])
    page_itself = lambda path: not path or path[-1][0] in ("html", "body")
    outer = max(html.WHOLE, min(1.0, sum(c - e for k, (_, c, _, e) in own.items() if page_itself(k) or page_itself(k[:-1])) / free))
    value = {}
    for path, sums in own.items():
        around = max(ratio(under[path[:k]]) * (outer if page_itself(path[:k]) else 1) for k in range(1 if len(path) > 1 else 0, max(1, len(path))))
        value[path] = 1.0 if switched_off else (ratio(sums) + around) / 2 * (html.DOUBTFUL if any(d for _, d in path) else 1) * (html.ARTICLE if any(t in ("article", "main") for t, _ in path) else 1)
    out = []
    for k, (path, text, links) in enumerate(p.blocks):
        near = [value[b[0]] for b in p.blocks[max(0, k - 1) : k + 2] if b[0] == path or b[0][:-1] == path[:-1]]
        fine = any(t in ("article", "main") for t, _ in path) and (own[path][3] <= 0.6 * own[path][1] or path[-1][0] in html._HEADINGS)
        if max(value[path], sum(near) / len(near)) >= html.LEAST and (fine or links <= 0.6 * len(text)):
            out.append(text)
    return "\n".join(out)


BODY = "".join(f"<p>{k} {S * 4}</p>" for k in range(8)) + "<h2>Part two</h2><ul><li>one thing</li><li>another thing</li></ul>" + f"<p>{S * 3}</p>"
LINKS = "".join(f"<li><a href='/{k}'>Entry {k}</a></li>" for k in range(9))
#: Layouts with [boilerplate] in brackets; four of six have no article.
LAYOUTS = {
    "article": f"<html><body><nav><ul>{LINKS}</ul></nav><article><h1>Title</h1>{BODY}</article><footer><p>[Imprint]</p></footer></body></html>",
    "plain sections": f"<html><body><center><p>[Site name]</p><ul>{LINKS}</ul></center><div><h1>Title</h1>{BODY}</div><center><span>[All rights reserved]</span></center></body></html>",
    "named sections": f"<html><body><div class='top-menu'><p>[Home]</p></div><section><h1>Title</h1>{BODY}</section><div class='share-buttons'><p>[Tell others]</p></div></body></html>",
    "table layout": f"<html><body><div><table><thead><tr><th>[Left]</th></tr></thead></table></div><table><tbody><tr><td><div><h1>Title</h1>{BODY}</div></td></tr></tbody></table></body></html>",
    "body alone": f"<html><body><h1>Title</h1>{BODY}</body></html>",
    "card beside": f"<html><body><div><ul>{LINKS}</ul></div><div><section><h1>Title</h1>{BODY}</section></div><div><p>[Now]</p></div></body></html>",
}
WANT = "\n".join(["Title", *(f"{k} {S * 4}".strip() for k in range(8)), "Part two", "one thing", "another thing", (S * 3).strip()])


@pytest.mark.parametrize("name", LAYOUTS)
def test_hand_marked_pages(name):
    assert html.main_text(LAYOUTS[name]) == WANT == plain_text(LAYOUTS[name])


def test_ratios_decide():
    off = {name: plain_text(page, switched_off=True) for name, page in LAYOUTS.items()}
    assert [n for n, t in off.items() if "[" in t] == ["plain sections", "named sections", "table layout", "card beside"]


def test_op7(spark):
    d = "/root/testdata/sf0.001"
    want = {i: plain_text(h or "") for i, h in duckdb.sql(f"select page_id, html from '{d}/pages.parquet'").fetchall()}
    got = {r["page_id"]: r for r in queries.op7_html_text(spark, d).collect()}
    assert {i: r["text"] for i, r in got.items()} == want and all(r["n_chars"] == len(r["text"]) for r in got.values())


@pytest.mark.parametrize("page", ["<a " * 1_700_000, "<div>x" * 300_000, "<b>" * 600_000 + "</i>" * 300_000, '<a "' * 1_200_000 + ">", "<!-- " * 1_000_000])
def test_hostile_pages(page):
    began = time.time()
    html.main_text(page)
    assert time.time() - began < 20
