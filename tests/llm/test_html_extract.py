import itertools
import random

import pytest

from dunlin.llm import html_extract as H
from tests.llm.data import words

SENTENCES = [f"{words(k, 14)}. {words(k + 500, 9)}." for k in range(40)]


def page(k, extra_in="", extra_after=""):
    a, b, c = SENTENCES[k % 38: k % 38 + 3]
    return (f"<!DOCTYPE html><html><head><title>T {k}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>"
            f"<nav><ul><li><a href='/x'>Home</a></li><li><a href=\"/y\">About us</a></li></ul></nav><!-- c --><div class=\"ad\">Buy now. Really cheap things.</div>"
            f"<article><h1>Head {k}</h1><p><b>{a}<br><p>{b}</p>{extra_in}<p>{c} &amp; &eacute;&#8217;s</p></article>{extra_after}"
            f"<footer>&copy; site &middot; All rights.\nReserved.</footer></body></html>"), f"Head {k}\n{a}\n{b}\n%s{c} & é’s"


INSIDE = {
    "none": ("", ""), "aside": ("<aside>See also this other thing. It is good.</aside>", ""), "form": ("<form><label>Mail</label><input name=q> Subscribe to it.</form>", ""),
    "comments": ("<div class='comments'><p>I liked this a lot. Thanks for it, really.</p><p>Me too, and so on and on. Yes.</p></div>", ""),
    "quote": ("<blockquote><p>A quoted line that belongs here. Sure.</p></blockquote>", "A quoted line that belongs here. Sure.\n"),
    "list": ("<ul><li>first point</li><li>second point</li></ul>", "first point\nsecond point\n"),
    "space": ("<div>\n <span>split</span>ted   text\t<em>here</em>, and <a href=z>a link</a>.\n</div>", "splitted text here, and a link.\n"),
    "share": ("<div id=\"share-box\">Share on a. Share on b.</div>", ""), "button": ("<button>Click me</button><textarea>x</textarea>", ""),
}
AFTER = {"none": "", "comments": "<section id=comments><h3>2 comments</h3><p>First reader says this. A long text it is, with many words in it.</p></section>",
         "sidebar": "<div class='left sidebar'><p>Latest posts, and some words more. One two three.</p></div>", "notice": "<div role=dialog class=cookie-notice>We use cookies. Accept them all.</div>",
         "header": "<header><p>Big site. The best site of all sites in the world.</p></header>"}


@pytest.mark.parametrize("inside,after", list(itertools.product(INSIDE, AFTER)))
def test_content_alone_remains(inside, after):
    html, text = page(3, INSIDE[inside][0], AFTER[after])
    assert H.text_of(html, {"w0": -2.0, "w3": 1.0, "l2": -2.0, "s1": 0.5}) == text % INSIDE[inside][1]


def test_query_learns_and_extracts(spark):
    rows = [(k, f"u{k}", *page(k)) for k in range(20)]
    rows += [(100, None, None, ""), (101, "u", "", ""), (102, "u", "plain text. Only a text, without any markup at all.", None), (103, "u", "<p>", ""), (104, "u", "a < b <", None),
             (105, "u", "<article>" + "<p>".join(SENTENCES) * 60, None), (0, "u0", *page(0))]
    df = spark.createDataFrame([(i, u, h, "x", 1) for i, u, h, _ in rows], "page_id long, url string, html string, text string, n_chars int")
    got = H.extract(df.repartition(3)).collect()
    assert len(got) == len(rows) and got[0].__fields__ == ["page_id", "url", "text", "n_chars"]
    by = {r.page_id: r for r in got}
    for i, _, _, want in rows:
        if want is not None:
            assert by[i].text == (want % "" if want else "") and by[i].n_chars == len(by[i].text)
    assert len(by[105].text) > 50_000
    assert H.extract(df.limit(0)).count() == 0


def test_minimum_cut_is_minimal():
    rnd = random.Random(4)
    for _ in range(60):
        n = 6
        edges = [(s, k, rnd.choice([0.0, 1.5, 3.0]), 0.0) for k in range(n) for s in [n]] + [(k, n + 1, rnd.choice([0.0, 1.0, 4.0]), 0.0) for k in range(n)]
        edges += [(a, b, c, c) for a in range(n) for b in range(a) if rnd.random() < 0.5 for c in [rnd.choice([0.3, 0.9])]]

        def cost(side):
            return sum(c for u, v, c, _ in edges if side[u] and not side[v]) + sum(r for u, v, _, r in edges if side[v] and not side[u])

        best = min(cost([*bits, True, False]) for bits in itertools.product([True, False], repeat=n))
        side = H._max_flow(n + 2, edges, n, n + 1)
        assert abs(cost(side) - best) < 1e-9


LEARNED = {"w0": -2.0, "w3": 1.0, "l2": -2.0, "s1": 0.5}


@pytest.mark.parametrize("extra", ["<svg class=i />", "<svg-icon></svg-icon>", "<button-group></button-group>", "<button>Open it", "<div><button>Open</div>", "<p>See <select><option>One</p>",
                                   "<template><p>Hidden line, with a few words. Yes.</p></template>", "<button><div>Click. Me now.</div></button>", "<p><object><p>Old. Browser text here.</p></object></p>"])
def test_dropped_elements_take_their_own_text_alone(extra):
    html, text = page(5, extra)
    want = text % ("See\n" if "See" in extra else "")
    assert H.text_of(html, LEARNED) == want
    assert H.text_of(html.replace(extra, "").replace("<article>", f"{extra}<article>"), LEARNED).endswith(text % "")


def test_class_words_around_an_article_do_not_drop_it():
    html, text = page(6, "<div class='comments'><p>I liked this a lot. Thanks for it, really.</p></div>")
    for around in ("<div class='site has-sidebar'>", "<div class='layout sidebar'>"):
        assert H.text_of(html.replace("<article>", f"{around}<article>").replace("</article>", "</article></div>"), LEARNED) == text % ""
    assert H.text_of(html.replace("<article>", "<article hidden>"), LEARNED) == ""


def test_prior_odds_without_examples(spark):
    rows = [(1, "u", f"<div><a href=/>Home</a></div><p>{SENTENCES[0]} {SENTENCES[1]}</p><div><a href=/y>About us</a></div>")]
    got = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).first()
    assert got.text == f"{SENTENCES[0]} {SENTENCES[1]}"


@pytest.mark.parametrize("opening", [
    "<article class='post type-post category-legal tag-search status-publish'>", "<article><div class='post social-history'>", "<article><div class='left side'>",
    "<article><p data-x=don't>First line of it.</p><div class=entry>", "<article class='has-sidebar no-comments with-banner'>", "<article id='search-for-a-cure'>",
    "<article title='a > b' data-y=\"it's > that\">", "<main class=search-results-of-a-study><div class='share-price'>", "<article><a href=x?a='1>Link</a><div>"])
def test_articles_behind_ordinary_names_and_values_stay(opening):
    html, text = page(9)
    got = H.text_of(html.replace("<article>", opening), LEARNED)
    assert got.endswith(text % "")


@pytest.mark.parametrize("name", ["comments", "comment-list", "commentsArea", "cookie-notice", "share-box", "left sidebar", "nav-links", "site-footer", "related-posts", "social_icons", "ads", "ad-slot-3"])
def test_names_of_boilerplate(name):
    assert H.says_boilerplate(name)


def test_tags_without_an_end_are_given_up_at_once():
    import time
    begun = time.time()
    H.blocks("<a " + "b=\"1\" c='2' " * 20_000)
    assert time.time() - begun < 5


def test_generated_pages_against_their_article():
    rnd = random.Random(12)
    names = ["post", "entry category-legal", "tag-search", "social-history", "left side", "type-post", "story share-price", "notice-of-a-meeting"]
    boiler = ["<nav><a href=/>Home</a> <a href=/b>More of it</a></nav>", "<div class='ad'>Buy it now. Cheap.</div>", "<aside>Also this. Or that.</aside>",
              "<form><label>Mail</label> Subscribe. Now.</form>", "<footer>All rights. Reserved.</footer>", "<section class=comments><p>I like it. Very much so, as a reader.</p></section>"]
    for _ in range(60):
        paragraphs = [rnd.choice(SENTENCES) for _ in range(rnd.randrange(1, 9))]
        inside = [f"<div class='{rnd.choice(names)}'><p{rnd.choice(['', " data-x=don't", ' id=p1'])}>{p}</p></div>" for p in paragraphs]
        for b in rnd.sample(boiler[1:4] + boiler[5:], 2):
            inside.insert(rnd.randrange(len(inside) + 1), b)
        html = f"<body>{rnd.choice(boiler)}<article class='{rnd.choice(names)}'>{''.join(inside)}</article>{''.join(rnd.sample(boiler, 3))}</body>"
        assert H.text_of(html, LEARNED) == "\n".join(paragraphs)
