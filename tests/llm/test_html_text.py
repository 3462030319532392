import itertools
import random
import time

from factgraph.llm import html_text as H

SCHEMA = "page_id long, url string, html string, text string"
LONG = "This is a sentence of the article that says something at length, and then it goes on for a while longer."


def test_page_with_everything_around_the_article():
    page = f"""<!DOCTYPE html><html><head><title>T</title><script>var a = "</p>";</script><style>p{{}}</style></head>
    <body class="home has-sidebar"><header><a href="/">Site</a><nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav></header>
    <div class="cookie-notice">We use cookies to improve your experience on this site, see our policy.</div>
    <div id="content-wrapper"><main><article><header><h1>The   title &amp; more</h1></header><!-- a <p>comment</p> -->
    <p>{LONG}<p>Second &lt;b&gt; <b>bold</b>, x&nbsp;y and
    a <a href="/l">link</a>.<br>After a break.</p><ul><li>First point of a list<li>Second point</ul>
    <div class="advertisement"><p>Buy now! {LONG}</p></div><script>x()</script>
    <blockquote>Quoted words.</blockquote><pre>  keep
 this </pre><form><label>Name</label><input><button>Send</button></form>
    <section class="comments"><h2>Comments</h2><p>{LONG} said a reader.</p></section></article></main>
    <aside class="sidebar"><h3>Related</h3><p>{LONG}</p></aside></div>
    <footer><p>&copy; 2024 Somebody. {LONG}</p></footer></body></html>"""
    want = f"The title & more {LONG} Second <b> bold, x\xa0y and a link. After a break. First point of a list Second point Quoted words. keep this"
    assert H.main_text(page) == want


def test_page_without_an_article_element():
    page = f"<body><div class=menu><a href=/>Home</a> <a href=/x>News</a></div><div><h2>Heading of it</h2><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div><div class='footer'>All rights reserved</div>"
    assert H.main_text(page) == f"Heading of it {LONG} Short. {LONG}"


def test_odd_markup():
    assert H.main_text(None) == H.main_text("") == H.main_text("<p>  </p>") == ""
    assert H.main_text(f"<article><p>{LONG} 1 < 2 &unknown; &#233;.</p>") == f"{LONG} 1 < 2 &unknown; é."
    deep = "<div>" * 3000 + LONG
    assert H.main_text(deep) == LONG
    assert H.main_text(f"<p title='a > b'>{LONG}</p><style>unclosed") == LONG
    many = "<article>" + "".join(f"<p>{LONG} {i}.</p>" for i in range(4000)) + "</article>"
    assert H.main_text(many).count("This is") == 4000


def test_minimum_cut_is_minimal():
    rng = random.Random(1)
    for _ in range(60):
        n = rng.randint(1, 8)
        source, sink = [rng.random() * 3 for _ in range(n)], [rng.random() * 3 for _ in range(n)]
        edges = [(a, b, rng.random()) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]
        cost = lambda side: sum(source[i] if not s else sink[i] for i, s in enumerate(side)) + sum(w for a, b, w in edges if side[a] != side[b])
        best = min(cost(side) for side in itertools.product((False, True), repeat=n))
        assert abs(cost(H.minimum_cut(source, sink, edges)) - best) < 1e-6


def test_on_spark(spark):
    rows = [(1, "u", f"<article><p>{LONG}</p></article>", "x"), (1, "u", f"<article><p>{LONG}</p></article>", "x"), (2, None, None, ""), (None, "v", "", "")]
    got = sorted(map(tuple, H.extract(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    assert got == sorted([(1, LONG, "u"), (1, LONG, "u"), (2, "", None), (None, "", "v")], key=repr)
    assert H.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def labelled(page, cut=True):
    found = H.parse(page)
    keep = H.labels(found) if cut else [o > 0 for o in H.log_odds(found)]
    return " ".join(b.text for b, k in zip(found.blocks, keep, strict=True) if k)


def test_cut_decides_where_costs_alone_err():
    menu = "".join(f"<li><a href=/{i}>Part {i}</a></li>" for i in range(4))
    teaser = "<li>All the parts of our whole offer together, in short</li>"
    cases = {
        f"<body><div><h2>Of old</h2><p>{LONG}</p><div>So it goes</div><p>{LONG}</p></div></body>": f"Of old {LONG} So it goes {LONG}",
        f"<body><ul>{menu}{teaser}{menu}</ul><div><p>{LONG}</p><p>{LONG}</p></div></body>": f"{LONG} {LONG}",
    }
    for page, want in cases.items():
        assert labelled(page, cut=False) != want
        assert labelled(page) == want


def test_names_and_attributes_are_weak_evidence():
    assert H.main_text(f'<article><p>{LONG}</p><p title="the hidden story">{LONG}</p></article>') == f"{LONG} {LONG}"
    assert H.main_text(f'<article><p class="related-note">{LONG}</p></article>') == LONG
    assert H.main_text(f'<article><h1 id="search-results">Head line</h1><p>{LONG}</p></article>') == f"Head line {LONG}"
    assert H.main_text(f'<div class="layout sidebar-left"><article><p>{LONG}</p></article></div>') == LONG
    assert H.main_text(f'<article><p>{LONG}</p><div hidden><p>{LONG} unseen</p></div><div class="postComments"><p>{LONG} said one.</p></div></article>') == LONG


def test_comments_longer_than_the_article():
    said = "".join(f'<li><article class="comment-body"><p>{LONG} said reader {i}.</p></article></li>' for i in range(9))
    assert H.main_text(f'<main><article><h1>Title of it</h1><p>{LONG}</p></article><div id="comments"><ol>{said}</ol></div></main>') == f"Title of it {LONG}"


def test_time_grows_with_length():
    for piece in ("<div>x ", "<a ", "<svg>", '<p a="x>', "<![CDATA[", "<i><div>", "<b>x</i>", "</p>"):
        begin = time.process_time()
        H.main_text(piece * (1_000_000 // len(piece)))
        assert time.process_time() - begin < 12, piece


def test_text_is_that_of_the_best_labelling():
    """Against all labellings of small random pages, from costs and edges as stated."""
    rng = random.Random(4)
    parts = [f"<p>{LONG}</p>", "<p>Short</p>", "<li><a href=/>Link</a></li>", "<h2>Head</h2>", "<div class=ad>Buy it now, all of it.</div>", "<nav><a href=/>Home</a></nav>", "<div>", "</div>", "<article>", "</article>", "<ul>", "</ul>"]
    for _ in range(150):
        page = H.parse("".join(rng.choice(parts) for _ in range(rng.randint(1, 14))))
        if len(page.blocks) > 9:
            continue
        odds, ties = H.log_odds(page), H.edges(page)
        cost = lambda side: sum(max(0, -o) if s else max(0, o) for o, s in zip(odds, side, strict=True)) + sum(w for a, b, w in ties if side[a] != side[b])
        best = min(cost(s) for s in itertools.product((False, True), repeat=len(odds)))
        assert abs(cost(H.labels(page)) - best) < 1e-6


def test_fit_tells_kinds_of_text_apart(spark):
    page = f"<nav>{'<li><a href=/>One two</a></li>' * 5}</nav><article>{f'<p>{LONG}</p>' * 3}</article><footer>Somebody</footer>"
    rows = [(i % 40, "u", page, "x") for i in range(80)] + [(None, "u", page, ""), (90, "u", None, ""), (91, "u", "", "")]
    weights = H.learn(spark.createDataFrame(rows, SCHEMA))
    plain = H.parse(f"<p>{LONG}</p><li><a href=/>One two</a></li>")
    good, bad = H.features(plain) @ weights
    assert good > 1 and bad < -1
    empty = H.learn(spark.createDataFrame([], SCHEMA))
    assert (empty == H.WEIGHTS).all()
    got = H.extract(spark.createDataFrame(rows[:1], SCHEMA), weights=weights).first()
    assert got["text"] == " ".join([LONG] * 3)


OTHER = "Second thoughts came later, as they often do, when the price of stone was known to all of the members who had voted."


def fitted(spark):
    page = f"<nav>{'<li><a href=/>One two</a></li>' * 5}</nav><div class=ad>Buy this now and here.</div><article><h1>Head</h1>{f'<p>{LONG}</p>' * 3}</article><footer>Somebody</footer>"
    return H.learn(spark.createDataFrame([(i, "u", page, "x") for i in range(40)], SCHEMA))


def test_pages_that_names_and_paragraph_tags_do_not_decide(spark):
    pages = {
        f'<div id="nav"><a href=/>Home</a> <a href=/a>About</a></div><div><h1>Title here</h1><div>{LONG}</div><div>{OTHER}</div></div>': f"Title here {LONG} {OTHER}",
        f'<article><section class="alerting-systems"><p>{LONG}</p></section><section id="navigation-history"><p>{OTHER}</p></section></article>': f"{LONG} {OTHER}",
        f"<table><tr><td><a href=/>Home</a><br><a href=/b>News</a></td><td><h1>The bridge</h1><p>{LONG}</p><ul><li>Stone from the north</li><li>Wood from the south</li></ul></td></tr></table>": f"The bridge {LONG} Stone from the north Wood from the south",
        f"<div><h1>The bridge</h1><p>{LONG}</p><p>{OTHER}</p><h2>3 Comments</h2><p>{LONG} said one.</p><p>So do I, and it was a good idea to build.</p></div>": f"The bridge {LONG} {OTHER}",
        f"<div><h1>A</h1><p>{LONG}</p><h2>Kommentare</h2><p>{LONG} sagt einer.</p><h2>Further on</h2><p>{OTHER}</p></div>": f"A {LONG} Further on {OTHER}",
    }
    for weights in (H.WEIGHTS, fitted(spark)):
        for page, want in pages.items():
            assert H.main_text(page, weights) == want


def test_extraction_of_generated_pages_with_shuffled_names(spark):
    """Pages of known content, their tags and class names at random: what is kept is the content, and the cut errs less than costs alone."""
    rng, weights = random.Random(21), fitted(spark)
    words = "stone bridge river council winter price member debate hall north wood plan year cost rain road town vote law tax".split()
    sentence = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    right = alone = 0
    for _ in range(200):
        tags = lambda: rng.choice(["div", "p", "section", "div"])
        name = lambda: rng.choice(["", ' class="x9"', ' id="q-17"', ' class="col b2"', ' class="history"'])
        menu = "".join(f"<{(t := rng.choice(['li', 'div', 'span']))}{name()}><a href=/{i}>{rng.choice(words)}</a></{t}>" for i in range(rng.randint(3, 7)))
        body, content = "", []
        for _ in range(rng.randint(3, 6)):
            kind = rng.random()
            if kind < 0.2:
                text, tag = sentence(3)[:-1], "h2"
            elif kind < 0.4:
                text, tag = sentence(7), rng.choice(["div", "li"])
            else:
                text, tag = " ".join(sentence(rng.randint(12, 25)) for _ in range(2)), tags()
            body += f"<{tag}{name()}>{text}</{tag}>"
            content.append(text)
        page = f"<body><{(a := tags())}{name()}>{menu}</{a}><div{name()}>{body}</div><div{name()}><a href=/c>Contact</a> <a href=/d>Terms</a></div></body>"
        found = H.parse(page)
        right += H.main_text(page, weights) == " ".join(content)
        alone += " ".join(b.text for b, o in zip(found.blocks, H.log_odds(found, weights), strict=True) if o > 0) == " ".join(content)
    assert right >= 190 and right >= alone

