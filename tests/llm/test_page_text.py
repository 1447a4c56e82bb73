import html
import re

from placerank.llm.page_text import blocks, extract_pages, main_text, style_tree


def texts(page):
    return main_text(page, set(), set())


def test_parts_are_left_out():
    page = """<html><head><title>T &amp; t</title><style>p{}</style></head><body><header><h2>Site</h2></header><nav><ul><li><a href=/a>Menu</a></ul></nav>
    <div class="cookie-notice">We use cookies</div><main><article><header><h1>Title &amp;  more</h1></header><p>One<br>two &nbsp; <b>three</b></p>
    <p>Four<script>var x = "</p>";</script> five<div id="ad-3">Buy</div><ul><li>Six<li>Seven</ul><aside>Side</aside>
    <form>Mail <input></form><section class="comments"><p>Nice post</p></section></article></main><footer>&copy; host</footer></body></html>"""
    assert texts(page) == "Title & more\n\nOne two three\n\nFour five\n\nSix\n\nSeven"


def test_wrappers_named_like_parts_keep_their_text():
    story = "<h1>Title</h1><p>First paragraph of it</p><div class=related>More</div><p>Second</p>"
    want = "Title\n\nFirst paragraph of it\n\nSecond"
    for name in ("layout has-sidebar", "sidebar-layout", "widget", "share", "alert", "related", "promo", "menu", "social"):
        assert texts(f"<body><div class='{name}'><article>{story}</article><aside>Side</aside></div><footer>F</footer></body>") == want
        assert texts(f"<div id='{name}'><div><main>{story}</main></div></div><p>&copy; host</p>") == want
    assert texts(f"<body><form id=aspnetForm><nav>Menu</nav><article>{story}</article></form></body>") == want
    assert texts("<body class='home comments-open no-ads'><form id=aspnetForm><nav>Menu</nav><h1>Title</h1><p>Text</p></form></body>") == "Title\n\nText"
    long = "<p>" + "A long paragraph of the page. " * 20 + "</p>"
    assert "A long paragraph" in texts(f"<div class='elementor-widget'><h1>T</h1>{long}</div><div>&copy; host</div>")
    assert "A long paragraph" in texts(f"<article><h1>T</h1><div class='elementor-widget'>{long}</div></article>")


def test_named_parts_beside_the_main_text_stay_out():
    long = "<p>" + "A long paragraph of the page. " * 20 + "</p>"
    for part in ("<div class=related><article><h2>Teaser</h2></article></div>", "<div class=sidebar>Side</div>", "<form>Mail <input></form>"):
        assert texts(f"<article>{long}</article>{part}") == texts(f"<article>{long}{part}</article>").removesuffix("\n\nTeaser") == texts(long)
    assert texts(f"<div>{long}</div><section id=comments><article>{long}{long}</article></section>") == texts(long)
    assert texts(f"<nav><article>{long}</article></nav><aside class=x><main>{long}</main></aside><p>Text</p>") == "Text"
    assert texts(f"<div>{long}</div><div class=related><article><h2>Teaser</h2></article></div>").startswith(texts(long))


def test_broken_and_odd_markup():
    assert texts("") == texts("<!-- only -->") == texts("<p>") == texts("<script>never closed") == ""
    assert texts("plain &lt;text&gt;") == "plain <text>"
    assert texts("<p>a < b and c</p><p>d") == "a < b and c\n\nd"
    assert texts("<div>a<p>b</div>c</p>d<!-- x") == "a\n\nb\n\nc d" or texts("<div>a<p>b</div>c</p>d<!-- x").startswith("a\n\nb\n\nc")
    assert texts("<article><p>x &#233;&#x41; &am &unknown;</p></article><div>outside</div>") == "x éA &am &unknown;"
    assert len(texts("<p>" + "long " * 200_000)) == 999_999
    assert texts("<b>" * 3000 + "deep") == "deep"


def test_repeated_branches_have_low_importance(spark):
    rows = [(i, "http://h.test/x", f"<body><div class=box><p>Same words on every page</p></div><div class=story><p>Story {i} of its own {i * i}</p></div></body>") for i in range(30)]
    rows += [(100, "http://single.test/", "<body><div class=box><p>Alone</p></div></body>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    tree = {(r._host, r.path): r.importance for r in style_tree(df).collect()}
    assert tree["h.test", ">body>div.box>p"] < 0.05 and tree["h.test", ">body>div.story>p"] > 0.7
    got = {r.page_id: r.text for r in extract_pages(df).collect()}
    assert got[3] == "Story 3 of its own 9" and got[100] == "Alone"


def test_a_host_of_copies_keeps_its_text(spark):
    df = spark.createDataFrame([(i, "http://c.test/", "<body><p>One page, many times</p></body>") for i in range(40)], "page_id long, url string, html string")
    assert {r.text for r in extract_pages(df).collect()} == {"One page, many times"}


def test_copies_count_as_one_page_and_condemn_nothing_in_an_article(spark):
    """A host where copies of one page outweigh the rest, copies that differ in the footer, and a style only they have."""
    many = "<article><h1>Many</h1>" + "".join(f"<p>Paragraph {i}</p>" for i in range(100)) + "</article>"
    few = "<article><h1>Few</h1><p>One</p><p>Two</p></article>"
    rows = [(i, "http://copies.test/", many) for i in range(200)] + [(1000, "http://copies.test/", few)]
    rows += [(2000 + i, "http://near.test/", f"{many}<footer>Seen {i}</footer>") for i in range(50)] + [(3000, "http://near.test/", few)]
    quoted = "<article><h1>Quoted</h1><blockquote>Only here</blockquote></article>"
    rows += [(4000 + i, "http://quote.test/", f"{quoted}<footer>Seen {i}</footer>") for i in range(12)]
    rows += [(5000 + i, "http://quote.test/", f"<article><h1>Page {i}</h1><p>Story {i}</p><em><div>Subscribe now</div></em></article>") for i in range(12)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract_pages(df).collect()}
    long = "\n\n".join(["Many", *(f"Paragraph {i}" for i in range(100))])
    assert got[0] == got[2000] == long and got[1000] == got[3000] == "Few\n\nOne\n\nTwo"
    assert got[4000] == "Quoted\n\nOnly here" and got[5003] == "Page 3\n\nStory 3"
    tree = {(r._host, r.path): r.importance for r in style_tree(df).collect()}
    assert tree["copies.test", ">article>p"] > 0.9


def test_all_pages_against_the_template(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r for r in extract_pages(pages).collect()}
    for row in pages.collect():
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", row.html or "", re.S)
        cut = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", inner[1].replace("<br>", " "))) if inner else []
        want = "\n\n".join(x for x in (" ".join(html.unescape(c).split()) for c in cut) if x)
        assert got[row.page_id].text == want and got[row.page_id].n_chars == len(want) and got[row.page_id].url == row.url


def test_odd_rows_and_empty_tables(spark):
    rows = [(1, None, "<p>a</p>", "x"), (1, None, "<p>a</p>", "x"), (None, "not a url", None, "x"), (3, "http://u@H.test:80/", "", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, noise string")
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in extract_pages(df).collect()) == [("1", "a", 1), ("1", "a", 1), ("3", "", 0), ("None", "", 0)]
    assert extract_pages(df.limit(0)).count() == 0
    assert blocks("<p>a<p>b")[0][0].path == blocks("<p>a<p>b")[0][1].path


def test_few_pages_lose_their_menu_as_many_do(spark):
    page = "<body><div class=box><p>Same words on every page</p></div><div class=story><p>Story {0} of its own {1}</p></div></body>"
    rows = [(100 * n + i, f"http://h{n}.test/x", page.format(i, i * i)) for n in (1, 2, 5, 9, 10, 40) for i in range(n)]
    got = {r.page_id: r.text for r in extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {n for n in (5, 9, 10, 40) for i in range(n) if got[100 * n + i] != f"Story {i} of its own {i * i}"} == set()
    assert "Same words" in got[100] and "Story 0" in got[100] and "Story 1" in got[201]
