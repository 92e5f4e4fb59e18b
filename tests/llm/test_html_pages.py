"""Main text of pages made from known parts."""

import html
import random

import pytest

from corpusloom.llm import html_text

LONG = ("long text of a paragraph " * 6).strip()
PAGES = {
    "an anchor without a target": (f'<body><a name="top"><p>{LONG}</p><p>{LONG}</p></body>', f"{LONG}\n\n{LONG}"),
    "a link that is never closed": (f'<body><a href="x">Home<p>{LONG}</p><p>{LONG} <a href=y>{LONG}</p></body>', f"{LONG}\n\n{LONG} {LONG}"),
    "short blocks and a list of links": (
        f"<article><p>Short intro.</p><ul><li><a href=a>one</a></li><li><a href=b>two</a><li><a href=c>three</a></ul><p>Short outro.</p><p>{LONG}</p></article>",
        f"Short intro.\n\none\n\ntwo\n\nthree\n\nShort outro.\n\n{LONG}",
    ),
    "a heading in an anchor": (f'<article><h2><a id="s1">Heading</a></h2><p>{LONG}</p><h2><a href="#s1">Last</a></h2></article>', f"Heading\n\n{LONG}\n\nLast"),
    "links behind the dive": (f"<main><p>{LONG}</p>{'<p><a href=x>a link</a></p>' * 5}<p>End</p></main>", "\n\n".join([LONG, *["a link"] * 5, "End"])),
    "long blocks outside": (f"<div>{LONG}</div><article><p>{LONG} here</p></article><div>{LONG}</div>", f"{LONG} here"),
    "a short article": (f"<div>{LONG}</div><article><p>Short.</p></article>", "Short."),
    "a list of links is no article": (f"<main><a href=x>only a link</a></main><div>{LONG}</div>", LONG),
    "several articles": (f"<article>{LONG} one</article><div>{LONG}</div><article><article>{LONG} two</article>end</article>", f"{LONG} one\n\n{LONG} two\n\nend"),
    "further marks": (
        f'<p>{LONG}</p><div class="left-sidebar">{LONG}</div><div class="right_sidebar">{LONG}</div><div class="user-comments">{LONG}</div><div id="gdpr-banner">{LONG}</div><div style="color: red; display:none">{LONG}</div>'
        f'<div aria-hidden="true">{LONG}</div><div class="copyright">{LONG}</div><div class="page-header">{LONG}</div>',
        LONG,
    ),
    "shown all the same": (f'<p style="display: none-such">{LONG}</p><p aria-hidden="false" style="visibility:visible">{LONG}</p>', f"{LONG}\n\n{LONG}"),
    "a link that ends in what is dropped": (f"<div><a href=x>go<nav></a>menu</nav></div><p>{LONG}</p>", f"{LONG}"),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    page, want = PAGES[name]
    assert html_text.extract(page) == want


JUNK = ["<nav>{}</nav>", "<aside><p>{}</p></aside>", '<div class="ad">{}</div>', "<footer><div>{}</div></footer>", '<form action=x><label>{}</label></form>', "<script>var x = '<p>{}</p>';</script>", '<section class="comments"><p>{}</p></section>', "<!-- {} -->", '<div hidden><p>{}</p></div>', '<div style="display:none">{}</div>', "<style>{}</style>", '<ul class="menu"><li><a href=x>{}</a></li></ul>']
INLINE = ["{}", "<b>{}</b>", "<a href='/x'>{}</a>", "<a name=y>{}</a>", "<i>{}</i> ", "<span class=note>{}</span>", "<em>{}\n</em>"]


def made(r, depth=0):
    """Markup of some nested blocks, and the texts of its blocks in page order."""
    page, texts = [], []
    for _ in range(r.randint(1, 5)):
        kind = r.random()
        if kind < 0.25:
            page.append(r.choice(JUNK).format("not the text " * r.randint(1, 30)))
        elif kind < 0.45 and depth < 4:
            inner, own = made(r, depth + 1)
            tag = r.choice(("div", "section", "blockquote", "article"))
            page.append(f"<{tag}>{inner}</{tag}>")
            texts += own
        elif kind < 0.6:
            items = [" ".join(f"item{r.randint(0, 99)}" for _ in range(r.randint(1, 9))) for _ in range(r.randint(1, 4))]
            page.append("<ul>" + "".join(f"<li>{r.choice(INLINE).format(i)}" + r.choice(("</li>", "")) for i in items) + "</ul>")
            texts += items
        else:
            words = [r.choice(("word", "é", "a<b", "AT&T", "漢字", "x" * 20)) for _ in range(r.randint(1, 40))]
            page.append("<p>" + " ".join(r.choice(INLINE).format(html.escape(w)) for w in words) + r.choice(("</p>", "</p>\n")))
            texts.append(" ".join(words))
    return "\n".join(page), texts


def test_nested_pages_keep_all_of_the_article_and_nothing_else():
    r = random.Random(11)
    for _ in range(400):
        body, texts = made(r)
        texts = [LONG, *texts]
        around = [r.choice([*JUNK, "<div><p>{}</p></div>"]).format("around the text " * r.randint(1, 20)) for _ in range(2)]
        tag = r.choice(("article", "main"))
        page = f"<html><head><title>t</title></head><body>{around[0]}<{tag}><p>{LONG}</p>{body}</{tag}>{around[1]}</body></html>"
        assert html_text.extract(page) == "\n\n".join(texts), page
