"""Main text of pages in layouts that the tables don't have."""

import pytest

from loomlog.llm import html

SENTENCE = "Some words of a longer paragraph, with marks; and then, at last, its end. "
MENU = "<ul>" + "".join(f"<li><a href=/{k}>Menu entry {k}</a></li>" for k in range(12)) + "</ul>"


def test_article_as_a_card_beside_the_body():
    body = "".join(f"<p>{k} {SENTENCE * 4}</p>" for k in range(10))
    got = html.main_text(f"<body><div>{MENU}</div><article><p>A card.</p></article><div><div>{body}</div></div></body>").split("\n")
    assert sum(SENTENCE.strip() in x for x in got) == 10 and not any("Menu entry" in x for x in got)


def test_article_does_not_settle_each_block():
    page = f"<body><article><p>{SENTENCE * 5}</p><p>{SENTENCE * 4}</p>{MENU}<p>{SENTENCE * 6}</p></article></body>"
    got = html.main_text(page)
    assert got.count("at last") == 15 and "Menu entry" not in got


@pytest.mark.parametrize("outer", ["<body>%s</body>", "<body><div class=page>%s</div></body>", "<body><div><section>%s</section></div></body>"])
def test_short_blocks_of_a_long_page(outer):
    text = "".join(f"<p>{k} {SENTENCE * 7}</p>" for k in range(190))
    items = [f"item number {k}" for k in range(20)]
    cells = [f"cell {k}" for k in range(30)]
    heads = ["Part one", "Chapter one", "Of first things", "Of these alone"]
    short = "<ul>" + "".join(f"<li>{x}" for x in items) + "</ul>" + "<table>" + "".join(f"<tr><td>{a}<td>{b}<td>{c}" for a, b, c in zip(cells[::3], cells[1::3], cells[2::3])) + "</table>" + "".join(f"<h{k}>{x}</h{k}>" for k, x in enumerate(heads, 1))
    got = html.main_text(outer % (MENU + text + short + text)).split("\n")
    assert len("\n".join(got)) > 100_000 and not set(items + cells + heads) - set(got) and not any("Menu entry" in x for x in got)


@pytest.mark.parametrize("given", ['style="overflow:hidden"', 'aria-hidden="false"', 'class="row hidden-xs"', 'title="Hidden gems"', 'class="article-header"', 'class="widget-content"', 'data-x="hidden"'])
def test_kept(given):
    page = f"<body><div {given}><h1>Headline</h1><p>{SENTENCE * 3}</p></div><p>{SENTENCE * 3}</p></body>"
    assert html.main_text(page).split("\n")[0] == "Headline" and html.main_text(page).count("at last") == 6


@pytest.mark.parametrize("given", ["hidden", 'hidden=""', 'aria-hidden="true"', "aria-hidden = 'TRUE'", 'style="color:red; display: none"', 'class="big ad"', "id=comments", "role=navigation"])
def test_dropped(given):
    assert html.main_text(f"<body><div {given}><p>{SENTENCE * 3}</p></div><p>Kept. {SENTENCE}</p></body>") == "Kept. " + SENTENCE.strip()
