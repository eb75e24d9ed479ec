"""HTML extraction: cuts against brute force over all labellings, pages of many forms, edge rows."""

import itertools
import random
import time

import pytest

from gritstone.llm.html_text import extract_text, main_text, min_cut


def test_minimum_cut_is_minimal():
    rnd = random.Random(1)
    for _ in range(60):
        n = rnd.randint(1, 8)
        odds = [rnd.uniform(-3, 3) for _ in range(n)]
        edges = [(a, b, rnd.uniform(0, 2)) for a in range(n) for b in range(a) if rnd.random() < 0.5]
        cost = lambda x: sum(o if o > 0 else 0 for o, k in zip(odds, x) if not k) + sum(-o if o < 0 else 0 for o, k in zip(odds, x) if k) + sum(c for a, b, c in edges if x[a] != x[b])  # noqa: B023, E731
        best = min(map(cost, itertools.product((True, False), repeat=n)))
        assert abs(cost(min_cut(odds, edges)) - best) < 1e-6


P = "<p>Some words of an article that go on for a while, {} and then end.</p>"
ARTICLE = " ".join(f"Some words of an article that go on for a while, {i} and then end." for i in range(3))


@pytest.mark.parametrize("page, text", [
    ("<nav><ul><li><a href='/'>Home</a></li></ul></nav><article>{}</article><footer>&copy; x</footer>", ARTICLE),
    ("<header><h1>Site</h1></header><main>{}</main><aside>Read more of our very good stories in this list of things</aside>", ARTICLE),
    ("<div id=content>{}</div><div class='sidebar left'><p>Many words of a sidebar that nobody wants to read at all, ever.</p></div>", ARTICLE),
    ("<article>{}<section id='comments'><p>I have read this article and found that it was good to read.</p></section></article>", ARTICLE),
    ("<div class='cookie-notice'>We use cookies on this site to make it good for you and all others.</div><article>{}</article>", ARTICLE),
    ("<article>{}<form action='/x'><label>Your mail</label><input><button>Send it to us now</button></form></article>", ARTICLE),
    ("<article><script>var a = '<p>no</p>';</script><style>p{{}}</style>{}<!-- <p>no</p> --></article>", ARTICLE),
    ("<body>{}</body>", ARTICLE),
    ("<article>{}<p>Of.</article>", ARTICLE + " Of."),
    ("<div class='post-share-story'>{}</div>", ARTICLE),
    ("<article>{}<p class='tag'>A paragraph that is part of the article, whatever its class may be.</p></article>", ARTICLE + " A paragraph that is part of the article, whatever its class may be."),
    ("<article><p class='related'>It starts with a paragraph that is part of the article.</p>{}</article>", "It starts with a paragraph that is part of the article. " + ARTICLE),
    ("<article><div class='entry-header'><h1>Title of it</h1></div>{}<div class='entry-footer'>Filed under many things by us</div></article>", "Title of it " + ARTICLE),
    ("<article>{}<p class='advert'>Buy our many good things in this shop of ours, today only.</p></article>", ARTICLE),
    ("<article>{}<div class='share-buttons'><a href=x>Share</a> <a href=y>Send</a></div></article>", ARTICLE),
    ("<div class='article-sidebar'><p>Many words of a sidebar that nobody wants to read at all, ever.</p></div><div class=content>{}</div>", ARTICLE),
])
def test_pages(page, text):
    assert main_text(page.format("".join(P.format(i) for i in range(3)))) == text


#: Wrappers of themes: names that tell a state, or what else the page has.
WRAPPERS = ['div class="content has-sidebar"', 'main class="no-sidebar"', 'article class="post comments-open"', 'div class="nav-open"', 'div class="ad-free"', 'div id="page" class="with-header"', 'div class="side-by-side"', 'div class="story-with-banner"', 'section class="layout sidebar-collapsed has_comments"']


@pytest.mark.parametrize("wrapper", WRAPPERS)
@pytest.mark.parametrize("inner", ["article", "div"])
def test_wrappers_keep_their_article_and_drop_the_rest(wrapper, inner):
    around = "<nav><a href='/'>Home page of this site</a></nav>", "<div class='sidebar'><p>Many words of a sidebar that nobody wants to read at all, ever.</p></div><section class='comments'><p>I have read this article and found that it was good to read.</p></section>"
    page = f"<{wrapper}>{around[0]}<{inner}>{''.join(P.format(i) for i in range(3))}</{inner}>{around[1]}</{wrapper.split()[0]}>"
    assert main_text(page) == ARTICLE


def test_main_element_in_a_wrapper_named_away():
    assert main_text(f"<div class='sidebar-layout sidebar'><main>{''.join(P.format(i) for i in range(3))}</main></div>") == ARTICLE
    assert main_text(f"<article>{''.join(P.format(i) for i in range(3))}<p class='no-comments'>Comments on this are closed.</p></article>") == ARTICLE


def test_characters_white_space_and_blocks():
    assert main_text("<article><h1>A &amp; B</h1><p>x&nbsp;y\n\t z<b>bold</b>er &#233;&lt;p&gt;<br>next</article>") == "A & B x y zbolder é<p> next"


def test_short_pages():
    assert main_text("<body><p>Opening hours.</p><table><tr><td>Mon</td><td>9</td></tr></table></body>") == "Opening hours. Mon 9"
    assert main_text("<nav><a href=x>Home</a></nav><p>Gone.</p><footer>x</footer>") == "Gone."
    assert main_text("<nav><ul><li><a href=x>Home</a></ul></nav><ul><li><a href=y>More</a></li></ul><p>© all of us</p>") == ""


def test_broken_and_empty_pages():
    for page in (None, "", "<", "<>", "<p", "<!--", "<script>x", "</p></div>", "<nav>" * 500, "\x00", "<a href='x>"):
        assert isinstance(main_text(page), str)


def test_query_rows(spark):
    rows = [(1, "u", "<article>" + P.format(1) + "</article>"), (2, None, None), (None, "v", ""), (1, "u", "<article>" + P.format(1) + "</article>"), (3, "w", "<article>" + P.format("é" * 50_000) + "</article>")]
    got = extract_text(spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, text string")).collect()
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got)
    assert sorted(map(str, ((r.page_id, r.url, r.text) for r in got))) == sorted(map(str, ((i, u, main_text(h)) for i, u, h in rows)))
    assert extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("tag", ["div", "span", "a", "section", "b"])
def test_deeply_nested_elements_take_linear_time(tag):
    start = time.perf_counter()
    page = "<article><p>" + P.format(1) + "</p>" + f"<{tag}>x " * 100_000 + f"</{tag}>" * 100_000 + "</em>" * 100_000
    assert "1" in main_text(page)
    assert time.perf_counter() - start < 30
