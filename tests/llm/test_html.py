from __future__ import annotations

import re
from html import unescape

import pytest

from paceline.llm.html import extract_main_text, main_text

LONG = "A sentence of the article that says a good deal about its subject, at length. "


def test_article_of_every_page(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    found = extract_main_text(pages).collect()
    assert len(found) == len(source)
    for r in found:
        inside = re.search(r"<article>(.*?)</article>", source[r.page_id], re.S)[1]
        plain = re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br)[^>]*>", " ", inside))
        assert r.text == " ".join(unescape(plain).split())
        assert r.n_chars == len(r.text)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<html><body></body></html>", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<p>one<p>two", "one two"),
        ("<div><p>a&nbsp; b</p>\n<p>c<b>d</b>e</p></div>", "a b cde"),
        ("<script>var a='<p>no</p>'</script><p>yes</p><style>p{}</style>", "yes"),
        ("<body><p>never closed <!-- comment", "never closed"),
        ("<p>a < b and c > d</p>", "a < b and c > d"),
        ('<p title="1 > 0">kept</p>', "kept"),
    ],
)
def test_small_pages(page, text):
    assert main_text(page) == text


def test_furniture_is_left_out():
    page = f"""<html><head><title>T</title></head><body><header><a href=/>Home</a></header><nav><ul><li><a href=/a>A</a></ul></nav>
    <div class="cookie-notice">We use cookies, accept them all please.</div><form><label>Name</label><input></form>
    <div id="content"><article><header><h1>Title</h1></header><p>{LONG * 3}</p><p>{LONG}<a href=/x>a link</a></p>
    <div class="ad">Buy this now</div><p>{LONG * 2}</p></article><aside>Other things</aside></div>
    <div class="comments"><p>{LONG}</p></div><footer>&copy; someone</footer></body></html>"""
    expected = f"Title {LONG * 3} {LONG} a link {LONG * 2}"
    assert main_text(page).replace("a link", "").split() == expected.replace("a link", "").split()


SLUGS = "naval-history navy promotion-to-captain social-policy related-work reply comments comments-on-the-law".split()


@pytest.mark.parametrize("slug", SLUGS)
def test_sections_named_like_furniture_stay(slug):
    own = f"<h2 id='{slug}'>Heading</h2><p>{LONG * 3}</p>"
    more = f"<p>{LONG * 2}</p><div class='ad'>Buy this now</div>"
    text = f"Title {LONG * 2} Heading {LONG * 3}".split()
    links = "<ul>" + "".join(f"<li><a href=/{i}>other page {i}</a></li>" for i in range(9)) + "</ul>"
    for element in (f"<section id='{slug}'>{own}</section>", f"<div id='{slug}'>{own}</div>", f"<section class='{slug}-part'>{own}</section>", own):
        assert main_text(f"<body><article><h1>Title</h1>{more}{element}</article></body>").split() == text
        assert main_text(f"<body><div class='menu'>{links}</div><div><h1>Title</h1>{more}{element}</div></body>").split() == text
    assert main_text(f"<div class='{slug} has-sidebar'><article><h1>Title</h1>{more}{own}</article></div>").split() == text
    assert main_text(f"<div class='x-{slug}'><h1>Title</h1><p>{LONG * 2}</p>{own}</div>").split() == text


@pytest.mark.parametrize("slug", SLUGS)
@pytest.mark.parametrize("words", [3, 10, 30])
def test_short_sections_named_like_furniture_stay(slug, words):
    """Inside the article no section is cut out for being short; one named ad or comments must not be a mere container."""
    part = " ".join(["word"] * words)
    own = f"<h2>Heading</h2><p>{part}</p>"
    more = f"<p>{LONG * 2}</p><div class='ad'>Buy this now</div>"
    text = f"Title {LONG * 2} Heading {part}".split()
    elements = [f"<section {a}='{slug}'>{own}</section>" for a in ("id", "class")]
    elements += [f"<div {a}='{slug}'>{own}</div>" for a in ("id", "class") if (a, slug) != ("class", "comments")]
    elements += [f"<section class='{slug}'>{own}</section>", f"<h2 class='{slug}'>Heading</h2><p class='{slug}'>{part}</p>"]
    for element in elements:
        assert main_text(f"<body><article><h1>Title</h1>{more}{element}</article></body>").split() == text


def test_comments_in_articles_of_their_own_are_left_out():
    page = f"<article><p>{LONG * 3}</p></article><div class='comments-area'><article><p>{LONG}</p></article></div>"
    assert main_text(page).split() == (LONG * 3).split()


def test_furniture_inside_an_article_is_left_out():
    links = "".join(f"<a href=/{i}>other page {i}</a> " for i in range(9))
    page = f"<article><p>{LONG * 3}</p><div class='newsletter'>Sign up now</div><section class='related'>{links}</section><p>{LONG}</p></article>"
    assert main_text(page).split() == (LONG * 4).split()
    for attrs in ("class='related-posts'", "id='related'", "class='nav-links'", "class='promo-box'"):
        page = f"<article><p>{LONG * 3}</p><div {attrs}>{links}</div><p>{LONG}</p></article>"
        assert main_text(page).split() == (LONG * 4).split()


def test_dense_block_without_an_article_element():
    links = "".join(f"<li><a href=/{i}>link number {i}</a></li>" for i in range(30))
    page = f"<body><div><ul>{links}</ul></div><div><div>{''.join(f'<p>{LONG * 2}</p>' for _ in range(5))}</div></div></body>"
    assert main_text(page) == " ".join([(LONG * 2).strip()] * 5)


def test_long_and_deep_pages():
    assert len(main_text("<div>" * 3000 + "<p>" + "long " * 100_000)) == 499_999
    assert main_text('<p a="' + "x" * 100_000 + "<p>end") != ""


def test_other_columns_stay(spark):
    df = spark.createDataFrame([(1, "<p>a</p>", "old", 5, "u")], "page_id long, html string, text string, n_chars int, row string")
    assert [tuple(r) for r in extract_main_text(df).select("page_id", "row", "text", "n_chars").collect()] == [(1, "u", "a", 1)]
    assert extract_main_text(df.limit(0)).collect() == []
