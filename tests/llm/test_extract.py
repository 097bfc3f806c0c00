"""Op 1 on pages of several makes, and the minimum cut against brute force."""

import itertools
import random

from tallyloom.llm.extract import blocks_of, extract, main_text, minimum_cut

LONG = "This is a long and plain sentence of the article, with commas, that ends as sentences do."


def test_article_page():
    page = f"""<!DOCTYPE html><html><head><title>No</title><style>p{{}}</style><script>var a = "</p><p>no</p>";</script></head><body class="home">
    <header class="site"><a href="/">Site name</a></header><nav><ul><li><a href=/a>One</a></li><li><a href=/b>Two</a></li></ul></nav>
    <div class="cookie-banner"><p>We use cookies. Please accept them, all of them, today.</p><form><input name=q><button>OK</button></form></div>
    <!-- <p>comment</p> --><main><article><header><h1>The  title &amp; more</h1></header><p><b>Bold&nbsp;start<br>next<p>{LONG}
    <div class="ad">Buy now. It is cheap, it is good, and everyone has one already, so do not wait.</div><p>Short one.<p>A &lt;b&gt; c &#233;
    <aside><p>{LONG}</p></aside><ul><li>first item<li>second item</ul></article>
    <section id="comments"><h2>Comments</h2><p>{LONG} I think so too.</p></section></main>
    <aside class="sidebar"><h3>Related</h3><a href=/x>{LONG}</a></aside><footer>&copy; 2024 Site. All rights reserved.</footer></body></html>"""
    assert main_text(page).split("\n\n") == ["The title & more", "Bold start next", LONG, "Short one.", "A <b> c é", "first item", "second item"]


def test_page_without_semantic_elements():
    page = f"""<body><div id=menu><a href=1>Home</a> <a href=2>News</a></div><div><a href=3>Log in</a></div>
    <table><tr><td><h2>Heading</h2><p>{LONG}</p><p>{LONG} Again.</p><p>Brief.</p></td><td class=sidebar><a href=4>More</a></td></tr></table>
    <div class="footer">Imprint</div></body>"""
    assert main_text(page).split("\n\n") == ["Heading", LONG, LONG + " Again.", "Brief."]


def test_odd_input():
    assert main_text(None) == main_text("") == main_text("<p> \n </p>") == main_text("<script>x") == ""
    assert main_text("<p>a < b and <i>c</i>d. </p") == "a < b and cd."
    assert main_text("<p title='a>b' x=\"c'd>\">Text here, that counts.<p hidden>not this text</p>") == "Text here, that counts."
    deep = "<div>" * 3000 + LONG + "</div>" * 3000
    assert main_text(deep) == LONG
    assert len(blocks_of("<p>" + "word " * 200_000)[0].text) == 999_999


def test_only_raw_text_runs_to_the_end_of_the_page():
    def shown(page):
        return [b.text for b in blocks_of(page)]

    assert main_text(f'<p>{LONG} a</p><svg class="i"/><p>{LONG} b</p><math/><p>{LONG} c</p>') == f"{LONG} a\n\n{LONG} b\n\n{LONG} c"
    for empty in ("<svg/>", '<svg class="i" />', "<svg focusable/>", "<math/>", "<video-js id=x></video-js>", "<title-bar>", "<style-guide></style-guide>", "<object-view/>"):
        assert shown(f"<p>a</p>{empty}<p>b</p><svg><text>no</text></svg><p>c</p>") == ["a", "b", "c"], empty
    for tag in ("svg", "math", "object", "canvas", "audio", "video", "noscript", "template"):
        assert shown(f"<p>a</p><{tag} class=x><g>no</g></{tag}><p>b <{tag}>no</{tag} >c</p>") == ["a", "b c"], tag
        # Without an end tag, before another such element, and where an element around it ends first.
        assert shown(f"<p>a</p><{tag} class=x><p>b</p><div>c</div>") == ["a", "b", "c"], tag
        assert shown(f"<p>a</p><{tag} class=x><p>b</p><{tag}>no</{tag}><div>c</div>") == ["a", "b", "c"], tag
    for tag in ("svg", "math", "canvas", "audio", "video"):
        assert shown(f"<p>a</p><div><{tag} class=x></div><p>b</p></{tag}><p>c</p>") == ["a", "b", "c"], tag
    for tag in ("script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp"):
        assert shown(f"<p>a</p><{tag} x='>'><p>no</p></{tag} ><p>b</p><{tag}><p>no") == ["a", "b"], tag
    assert shown("a<svg><svg>no</svg>no<title>no</title><style/><title/><desc><p>no</p></desc><g/></svg>b") == ["ab"]
    assert shown("<p>a<svg><path><p>b</p></svg>c") == ["a", "b", "c"]
    assert shown("<div><p>a<noscript><style></div><p>no<!-- </noscript>b</p></div>") == ["ab"]
    assert shown("<div><p>a<template><div></p></div></div><p>no</template>b</p></div>") == ["ab"]


def test_names_of_wrappers_and_headings():
    for wrapper in ('class="layout has-sidebar"', 'class="post comments-open"', 'id="notice-period"', 'class="sidebar"', 'aria-label="The legal history of search"', 'data-id="comment"', "title='class=ad'"):
        for inner in ("main", "article"):
            assert main_text(f"<body><nav><a href=1>No</a></nav><div {wrapper}><{inner}><p>{LONG}</p><p>{LONG}</p></{inner}></div>").split("\n\n") == [LONG, LONG], (wrapper, inner)
        assert main_text(f"<div id=menu><a href=1>Home</a></div><div {wrapper}><p>{LONG}</p><p>{LONG}</p></div>").split("\n\n") == [LONG, LONG], wrapper
    for kind in ("div class=sidebar", "div class=promo", "form"):
        end = kind.split()[0]
        three = "".join(f"<{kind}><article><p>{LONG} {i}</p></article></{end}>" for i in range(3))
        assert main_text(three).split("\n\n") == [f"{LONG} {i}" for i in range(3)], kind
        # Teasers beside the article stay out.
        assert main_text(f"<article><p>{LONG * 9}</p></article>" + three) == LONG * 9, kind
    for slug in ("social-history", "legal", "search", "share"):
        assert main_text(f'<article><h2 id="{slug}">A heading</h2><p>{LONG}</p><section id="{slug}"><p>{LONG} b</p></section></article>').split("\n\n") == ["A heading", LONG, f"{LONG} b"], slug
    for bad in ('class="site-footer"', 'class="comment-list"', 'id="comments"', 'class="x related-posts"', 'aria-label="Main navigation"', 'class="cookie_banner2"'):
        assert main_text(f"<article><p>{LONG}</p><p>{LONG}</p><div {bad}><p>{LONG} no</p></div></article>").split("\n\n") == [LONG, LONG], bad


def test_comments_that_are_articles():
    comments = "".join(f"<article class=comment id=comment-{i}><p>{LONG} {i}</p></article>" for i in range(5))
    assert main_text(f"<article class='post has-comments'><p>{LONG}</p></article>{comments}") == LONG
    assert main_text(f"<main><p>{LONG}</p><section class=comments>{comments}</section></main>") == LONG
    for page in (comments, f"<div id=comments>{comments}</div>"):
        assert main_text(page).split("\n\n") == [f"{LONG} {i}" for i in range(5)]


def test_hidden_is_an_attribute_and_not_a_word():
    for shown in ('title="the hidden cost of rain"', "data-title='a hidden gem'", 'class="md:flex hidden lg:block"', 'data-style="display:none"', 'title="set aria-hidden=true"', 'aria-hidden="false"',
                  'alt="display: none"', 'style="display:none;display:block"', 'style="--display:none"', "data-hidden", 'data-x="aria-hidden=\'true\'"', "title=hidden", 'title = "a > hidden "'):
        assert main_text(f"<div {shown}><p>{LONG}</p><p {shown}>{LONG}</p></div>").split("\n\n") == [LONG, LONG], shown
    for gone in ("hidden", "HIDDEN", 'class="a"hidden', 'hidden=""', "hidden='until-found'", "aria-hidden=true", 'aria-hidden = "TRUE"', "style=display:none", 'style="color:red; DISPLAY : none !important"', 'title="x" hidden class=y'):
        assert main_text(f"<div><p>{LONG}</p><p {gone}>{LONG} no</p></div>") == LONG, gone


def test_minimum_cut_equals_brute_force():
    r = random.Random(5)
    for _ in range(200):
        n = r.randrange(1, 8)
        terminal = [r.randrange(-6, 7) + 0.0 for _ in range(n)]
        edges = [(a, b, float(r.randrange(1, 5))) for a in range(n) for b in range(a + 1, n) if r.random() < 0.4]

        def price(side):
            cut = sum(c for a, b, c in edges if side[a] != side[b])
            return cut + sum(t for t, s in zip(terminal, side) if t > 0 and not s) - sum(t for t, s in zip(terminal, side) if t < 0 and s)

        best = min(price(s) for s in itertools.product([False, True], repeat=n))
        assert abs(price(minimum_cut(terminal, edges)) - best) < 1e-6


def test_table_with_nulls_repeats_and_extra_columns(spark):
    rows = [(1, "u", f"<article><p>{LONG}</p></article>", 5), (1, "u", f"<article><p>{LONG}</p></article>", 5), (None, None, None, None), (2, "v", "😀", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in extract(pages).collect())
    assert got == [(0, "", 0), (1, LONG, len(LONG)), (1, LONG, len(LONG)), (2, "😀", 1)]
    assert extract(pages.limit(0)).collect() == []


def around(inner):
    """A page with a menu before and a footer behind."""
    return f"<html><body><nav><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ul></nav>{inner}<footer><p>Imprint and contact</p></footer></body></html>"


def test_short_blocks_of_the_article_stay():
    items = "<ul><li>Milk</li><li>Two eggs</li><li>Salt</li></ul>"
    many = [f"{LONG} {i}" for i in range(3)]
    for inner, want in (
        ("<p>Hello world</p>", ["Hello world"]),
        (f"<h2>Shopping</h2>{items}", ["Shopping", "Milk", "Two eggs", "Salt"]),
        (f"<article><p>{LONG}</p>{items}<p>{LONG}</p></article>", [LONG, "Milk", "Two eggs", "Salt", LONG]),
        (f"<p>{LONG}</p>{items}<p>{LONG}</p>", [LONG, "Milk", "Two eggs", "Salt", LONG]),
        ("<table><tr><td>Name</td><td>Ann</td></tr><tr><td>Age</td><td>7</td></tr></table>", ["Name", "Ann", "Age", "7"]),
        ("<div class=content><p>今天天气很好</p><p>我们去公园玩吧。</p></div>", ["今天天气很好", "我们去公园玩吧。"]),
        ("<p><a href=1>First thing</a>, <a href=2>second thing</a> and <a href=3>a third thing</a></p>", ["First thing, second thing and a third thing"]),
        ("<dl><dt>Weight</dt><dd>3 kg</dd></dl>", ["Weight", "3 kg"]),
        ("<div>Just a div</div>", ["Just a div"]),
        ("<p>これは短い</p><p>終わり。</p>", ["これは短い", "終わり。"]),
        ("<blockquote>Less is more</blockquote>", ["Less is more"]),
        ("<pre>x = 1</pre>", ["x = 1"]),
        ("<main><p>ok</p></main>", ["ok"]),
        ("<article><h1>Title</h1><p>a</p><p>b</p></article>", ["Title", "a", "b"]),
        ("<div class=post><h1>Title</h1><div>Short line</div></div>", ["Title", "Short line"]),
        (f"<div><p>{many[0]}</p><p>Yes</p><p>{many[1]}</p><p>No</p><p>{many[2]}</p></div>", [many[0], "Yes", many[1], "No", many[2]]),
        (f"<section><h2>One</h2><p>{LONG}</p></section><section><h2>Two</h2><p>Brief</p></section>", ["One", LONG, "Two", "Brief"]),
        (f"<figure><img src=x><figcaption>A boat</figcaption></figure><p>{LONG}</p>", ["A boat", LONG]),
        (f"<article><table><tr><th>City</th><th>People</th></tr><tr><td>Oslo</td><td>700,000</td></tr></table><p>{LONG}</p></article>", ["City", "People", "Oslo", "700,000", LONG]),
        (f"<article><ol><li>Wash</li><li>Peel</li></ol></article><aside><p>{LONG}</p></aside>", ["Wash", "Peel"]),
    ):
        assert main_text(around(inner)).split("\n\n") == want, inner


def test_boilerplate_goes_where_it_is_short_as_well():
    for inner, want in (
        ("", ""),
        ("<p><a href=1>All of it</a></p>", ""),
        ("<div class=sidebar><p>Hello world</p></div>", ""),
        ("<form><p>Your name</p><button>Send</button></form>", ""),
        (f"<p>{LONG}</p><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul>", LONG),
        (f"<div><a href=1>Log in</a></div><p>{LONG}</p><div class=related><p>See also</p></div>", LONG),
        (f"<main><p>{LONG}</p></main><p>Outside</p>", LONG),
        (f"<article><p>{LONG}</p><div class=comments><p>First!</p></div></article>", LONG),
        (f"<p>{LONG}</p><div class=ad><ul><li>Cheap</li><li>Now</li></ul></div>", LONG),
        (f"<div class='cookie-banner'><p>We use cookies</p></div><p>{LONG}</p>", LONG),
    ):
        assert main_text(around(inner)) == want, inner


def test_long_pages_take_linear_time():
    import time

    for page in (
        "<article>" + "<p>ab cd</p>" * 50_000, "<div>" * 50_000 + "x y" + "</div>" * 50_000, "<span>" * 4000 + "</b> w" * 50_000, "<div class=nav>x</div>" * 50_000,
        "".join(f"<div>ab</div><p>{LONG}</p>" for _ in range(25_000)), "<ul>" + "<li>a" * 50_000 + "</ul>", "<table>" + "<tr><td>1<td>2" * 25_000,
    ):
        begin = time.process_time()
        main_text(page)
        assert time.process_time() - begin < 10, page[:40]


def test_minimum_cut_of_long_chains():
    r = random.Random(1)
    for n in (1, 2, 50, 3000):
        terminal = [r.choice([-9.0, -1.0, -0.75, 0.25, 1.5]) for _ in range(n)]
        edges = [(i, i + 1, r.choice([0.25, 0.5, 1.0])) for i in range(n - 1)]
        # On a chain the best labelling follows by dynamic programming.
        best = [0.0, 0.0]
        for i, t in enumerate(terminal):
            lose = [max(t, 0.0), max(-t, 0.0)]
            step = edges[i - 1][2] if i else 0.0
            best = [lose[0] + min(best[0], best[1] + step), lose[1] + min(best[1], best[0] + step)]
        side = minimum_cut(terminal, edges)
        price = sum(c for a, b, c in edges if side[a] != side[b]) + sum(max(t, 0.0) if not s else max(-t, 0.0) for t, s in zip(terminal, side))
        assert abs(price - min(best)) < 1e-6
