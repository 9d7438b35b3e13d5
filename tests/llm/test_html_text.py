"""Main text: whole pages with everything that must go."""

import pytest

from ledgerloom.llm import html_text, registry

ARTICLE = "<h1>A title &amp; more</h1><p>First  paragraph\nwith <b>bold</b> and <a href='/x'>one link</a>, long enough to count.</p><p>Second paragraph is here, with a &lt;tag&gt; and some words.<br>After a break.</p><ul><li>Item one</li><li>Item two</li></ul>"
TEXT = "A title & more\nFirst paragraph with bold and one link, long enough to count.\nSecond paragraph is here, with a <tag> and some words. After a break.\nItem one\nItem two"
NOISE = "<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>About us</a></li></ul></nav><header>Site header text</header><div class='cookie-notice'>We use cookies and tell you so at length in this banner.</div>"
AFTER = "<aside>Sidebar words</aside><div id=sidebar><p>More sidebar words that are many, many, many words long indeed.</p></div><form>Subscribe <input name=x><textarea>typed</textarea></form><section class='comments'><p>Reader: I disagree with every word of this article, and say so at length.</p></section><div class=ad>Buy now</div><footer>&copy; Someone</footer><script>var a = '<p>no</p>';</script><!-- a <p>comment</p> -->"


@pytest.mark.parametrize("holder", ["article", "main", "div", "div class='has-sidebar content'", "section"])
def test_page(holder):
    tag = holder.split()[0]
    page = f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{NOISE}<{holder}>{ARTICLE}</{tag}>{AFTER}</body></html>"
    assert html_text.main_text(page) == TEXT


def test_articles_own_remarks():
    page = f"<body><article>{ARTICLE}<div class='share-buttons'>Share this</div><section id=comments><article class=comment><p>Nice, but much too short for me to like it at all.</p></article></section></article></body>"
    assert html_text.main_text(page) == TEXT


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        (" \n ", ""),
        ("<nav>only</nav>", ""),
        ("plain &eacute; text\n only", "plain é text only"),
        ("<p>cut of<b>f here &am", "cut off here &am"),
        ("<p>a<p>b<div>c</div>d", "a\nb\nc\nd"),
        ("</p></div>stray<p>x", "stray\nx"),
        ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"),
        ("<p>unclosed <a href='x>text</p>", "unclosed"),
        ("<script>never closed <p>x", ""),
        ("<p>&#233;&#x1F600;&nbsp;&amp;amp;</p>", "é😀 &amp;"),
    ],
)
def test_odd(page, text):
    got = html_text.main_text(page)
    assert got == text or page.startswith("<p>unclosed") and got.startswith(text)


def test_deep_and_long():
    assert html_text.main_text("<div>" * 30_000 + "deep") == "deep"
    assert html_text.main_text("<p>" + "word " * 200_000).count("word") == 200_000


def test_operator(spark):
    rows = [(1, "u", "<p>x</p>", "clash", 9), (None, None, None, None, None), (1, "u", "<p>x</p>", "clash", 9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    assert sorted(map(tuple, html_text.extract_text(pages).collect()), key=str) == [(1, "u", "x", 1), (1, "u", "x", 1), (None, None, "", 0)]
    assert html_text.extract_text(pages.limit(0)).count() == 0


def test_query(spark, sf_dir):
    got = registry.op4_html(spark, sf_dir)
    assert got.count() == registry.table(spark, sf_dir, "pages").count()
    assert got.where("n_chars <> length(text) or text rlike '(?s)<p>|<b>| {2}|\\n\\n'").isEmpty()


@pytest.mark.parametrize("name", ["page sidebar-right", "layout-sidebar", "content share-enabled", "post related-content", "ad-free story", "footer-sticky wrap", "hidden-xs", "comments-open", "has-cookie-notice widget"])
@pytest.mark.parametrize("holder", ["div", "article", "section"])
def test_frames_keep_their_text(name, holder):
    """A wrapper's class doesn't make it side matter, with or without an article element in it."""
    assert html_text.main_text(f"<body>{NOISE}<div class='{name}'><{holder}>{ARTICLE}</{holder}></div>{AFTER}</body>") == TEXT


def test_names_inside_an_article():
    inside = "<section id='discussion'><h2 id='related-work'>Related work</h2><p class='notice'>A notice of the article itself.</p></section>"
    gone = "<div class='share-buttons'><a href=1>Share</a> <a href=2>Like</a></div><div class='ad'>Buy this</div><div class='comments'><p>Reader: no.</p></div>"
    page = f"<body>{NOISE}<main><article>{ARTICLE}{inside}{gone}</article></main>{AFTER}</body>"
    assert html_text.main_text(page) == f"{TEXT}\nRelated work\nA notice of the article itself."


def test_long_side_matter_next_to_a_short_article():
    advert = "<div class='ad'>" + "Buy more of this now. " * 20 + "</div>"
    comments = "<div class='comments'>" + "<p>I say, at length, what I think of this.</p>" * 30 + "</div>"
    assert html_text.main_text(f"<body>{advert}<article><p>Short and whole.</p></article>{comments}</body>") == "Short and whole."


def test_link_lists_in_main():
    links = "<div><ul>" + "".join(f"<li><a href={i}>Other story {i}</a></li>" for i in range(20)) + "</ul></div>"
    assert html_text.main_text(f"<body><main>{ARTICLE}{links}</main></body>") == TEXT


def test_several_articles_outside_main():
    one, two = (f"<article><h2>Part {i}</h2>" + f"<p>Part {i} has text that is long enough to be dense, and some more of it.</p>" * 3 + "</article>" for i in (1, 2))
    assert html_text.main_text(f"<body>{NOISE}<div>{one}{two}</div>{AFTER}</body>").count("long enough") == 6


def brute_density(page):
    """The method in plain code on a regular page: every element has an end tag."""
    import math
    import re

    stack, nodes = [], []
    for m in re.finditer(r"<(/?)(\w+)[^>]*>|([^<]+)", page):
        if m[3]:
            stack[-1]["text"] += len("".join(m[3].split()))
        elif m[1]:
            stack.pop()
        else:
            node = {"name": m[2], "kids": [], "text": 0, "up": stack[-1] if stack else None, "at": m.start()}
            if stack:
                stack[-1]["kids"].append(node)
            stack.append(node)
            nodes.append(node)
    below = lambda n: [n, *(x for k in n["kids"] for x in below(k))]
    links = lambda n: [x for x in below(n) if x["name"] == "a"]
    chars = lambda n: sum(x["text"] for x in below(n))
    body = nodes[0]
    linked = lambda n: chars(n) if n["name"] == "a" else sum(map(linked, n["kids"]))

    def density(n):
        c, t, lc, lt = chars(n), max(1, len(below(n)) - 1), linked(n), len(links(n)) - (n["name"] == "a")
        if not c:
            return 0.0
        base = c / max(1, c - lc) * lc + linked(body) / max(1, chars(body)) * c + math.e
        return c / t * max(0.0, math.log(c / max(1, lc) * t / max(1, lt), max(math.e, math.log(base))))

    def total(n):
        return sum(map(density, n["kids"])) + (chars(n) / max(1, len(below(n)) - 1) if n["text"] else 0)

    best = lambda n: max(below(n), key=lambda x: (total(x), -x["at"]))
    top, path = best(body), []
    while top:
        path.append(density(top))
        top = top["up"]
    marked = {best(n)["at"] for n in below(body) if chars(n) and density(n) >= min(path)}
    out = []

    def walk(n):
        if n["at"] in marked:
            out.append(n["at"])
        else:
            for k in n["kids"]:
                walk(k)

    walk(body)
    return out, min(path)


def test_density_against_plain_code():
    import random

    rng = random.Random(6)
    for _ in range(150):
        def element(depth):
            name = rng.choice(["div", "section", "a", "b", "span"] if depth else ["div"])
            if depth > 3 or rng.random() < 0.3:
                return f"<{name}>{'word ' * rng.randint(0, 60)}</{name}>"
            return f"<{name}>" + "".join(element(depth + 1) for _ in range(rng.randint(1, 4))) + "x" * rng.randint(0, 9) + f"</{name}>"

        page = "<body>" + "".join(element(0) for _ in range(4)) + "</body>"
        root = html_text.parse(page)
        html_text.weigh(html_text.tree_order(root))
        start = next(x for x in html_text.tree_order(root) if x.name == "body")
        found, limit = html_text.dense(start)
        want, least = brute_density(page)
        places = {id(n): i for i, n in enumerate(html_text.tree_order(start))}
        starts = [m.start() for m in html_text.re.finditer(r"<\w", page)]
        assert abs(limit - least) < 1e-9 * max(1, least)
        assert [starts[places[id(n)]] for n in found] == want


@pytest.mark.parametrize("page", ["<div>" * 150_000 + "</b>" * 150_000, '<a "' * 250_000, '<a "" ' * 150_000 + '">', "<ul>" + "<b>" * 100_000 + "<li>x" * 100_000, "<p><td>" + "<b>" * 100_000 + "<hr>" * 100_000, "<body>" * 150_000 + "x", "<div class=ad>" * 70_000 + "x"])
def test_hostile_pages_take_seconds(page):
    import time

    start = time.perf_counter()
    html_text.main_text(page)
    assert time.perf_counter() - start < 20
