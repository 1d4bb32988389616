import re
from html import unescape

import pyarrow.parquet as pq

from tessera.llm.html_text import extract, main_text, op1_html_text


def test_article_without_its_surroundings():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><article>";</script></head>
    <body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href="/x">Menu one</a></li></ul></nav><!-- ad <p>no</p> -->
    <div class="ad">Buy <b>now</b> and here</div><div id="cookie-notice"><p>We use cookies</p></div>
    <article><h1>Head &amp; tail</h1><p>One&nbsp;two <b>thr</b>ee<br>four<p>fi&#118;e &lt;six&gt;<div class="advert-box">ad</div>
    <form><label>Name</label><input name="a > b"><button>Go</button></form><aside>Side</aside><p>To.</p><ul><li>a<li>b</ul>
    <table><tr><td>c</td><td>d</td></tr></table><section id="comments"><p>First!</p></section><footer>Foot</footer></article>
    <div class="sidebar"><p>Side text</p></div><footer>&copy; me</footer></body></html>"""
    assert main_text(page) == "Head & tail One two three four five <six> To. a b c d"


def test_surge_and_dive_without_a_marked_part():
    body = "".join(f"<p>{'word ' * 30}{i}.</p>" for i in range(5))
    page = f"<body><p>Short site line</p><div><a href=a>One</a></div><div><a href=b>Two</a></div><div><a href=c>Three</a></div><div>{body}</div><div><a>x</a></div><div><a>y</a></div><div><a>z</a></div><p>tiny</p></body>"
    got = main_text(page)
    assert all(f"word {i}." in got for i in range(5)) and "Two" not in got and "tiny" not in got


def test_parts_marked_by_class_or_id():
    page = "<body><div>Site</div><div id='sidebar'>side</div><div class='wide content'><h1>T</h1><p>a.</p><div class='related-posts'>no</div><p>b.</p></div><div>after</div></body>"
    assert main_text(page) == "T a. b."
    assert main_text(page.replace("<h1>T</h1>", "<article>T</article>")) == "T"


def test_body_outweighs_marked_teasers():
    body = [f"{'word ' * 40}{i}." for i in range(5)]
    cards = "".join(f"<article><h2>Card {i}</h2><p>More of it.</p></article>" for i in range(3))
    for wrap in ("<div>", "<div class='content'>"):
        page = f"<body><div>Site</div>{cards}{wrap}{''.join(f'<p>{x}</p>' for x in body)}</div><div>tiny</div></body>"
        got = main_text(page)
        assert all(x in got for x in body) and "Card 2" in got and "Site" not in got
    assert main_text(f"<body><p>{'note ' * 30}</p><article><p>{body[0]}</p><p>b</p></article></body>") == f"{body[0]} b"
    assert main_text(f"<body><p>{body[0]}</p><p>{body[1]}</p><article><p>T</p></article><p>tiny</p></body>") == f"{body[0]} {body[1]} T"


def test_wrappers_named_after_a_part_keep_the_page():
    body = f"<p>{'word ' * 30}end.</p>"
    want = f"{'word ' * 30}end."
    for page in (
        f"<div class='content-sidebar-wrap'><main>{body}</main><div class='sidebar'>Side</div></div>",
        f"<div class='layout-with-sidebar'><article>{body}</article></div>",
        f"<article class='post category-social tag-menu'>{body}<div class='post-share-buttons'>Share</div></article>",
        f"<div id='page-widget-area'>{body}</div>",
        f"<div class='sidebar-layout'><article>{body}</article><div>Side</div></div>",
        f"<div class='sidebar-layout'><div role='main'>{body}</div></div><p>{'note ' * 20}</p>",
        f"<article>{body}</article><div id='comments'><article class='comment'><p>{'reply ' * 90}</p></article></div>",
        f"<article>{body}<div class='comments-area'><p>First!</p></div><div class='popup-with-form'>Join</div><div class='has-menu'></div></article>",
    ):
        assert main_text(f"<body>{page}</body>") == want, page


def test_windows_decide_within_a_mark():
    words = "plain words of a paragraph, enough to count. "
    links = "".join(f"<li><a href='/{i}'>Another story number {i} of this week</a></li>" for i in range(5))
    page = f"<article><h1>Head</h1><p>{words}</p><p><a href='/x'>A link alone.</a></p><p>{words}</p><ul>{links}</ul><p>ad</p><ul>{links}</ul><p>{words}</p></article>"
    w = words.strip()
    assert main_text(f"<body>{page}</body>") == f"Head {w} A link alone. {w} {w}"
    assert main_text("<body><article><p>Two words</p></article></body>") == "Two words"  # a short page


def test_the_same_pages_without_marks():
    """The windows alone, against the text of the marked pages: most of it is found."""
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()
    same = total = both = 0
    for p in pages:
        want, got = main_text(p["html"]), main_text(re.sub("</?article>", "", p["html"]))
        a, b = set(want.split(". ")), set(got.split(". "))
        same += want == got
        both, total = both + len(a & b), total + len(a | b)
    assert same > 0.3 * len(pages) and both > 0.95 * total


def test_forms():
    body = f"<h1>T</h1><p>{'word ' * 60}end.</p>"
    want = f"T {'word ' * 60}end."
    for page in (f"<form><article>{body}</article></form>", f"<form id='aspnet'><div>{body}</div><input></form>", f"<form class='notice'><main>{body}</main></form>", f"<article>{body}<form><p>{'subscribe now to all of our letters ' * 4}</p></form></article>", f"<div>{body}</div><form><div class='content'><p>{'tell us what you think ' * 9}</p></div></form>"):
        assert main_text(f"<body>{page}</body>") == want, page


def test_reader_comments():
    body = f"<p>{'word ' * 40}end.</p>"
    want = f"{'word ' * 40}end."
    said = f"<p>{'I think that this is so, and more of it. ' * 6}</p>"
    for part in (f"<div class='reactions'>{said}</div>", f"<ol class='commentlist'><li>{said}</li></ol>", f"<div class='xyz'><h3>12 Comments</h3>{said}{said}</div>", f"<section><h2>Leave a reply</h2>{said}</section>", f"<div id='disqus_thread'>{said}</div>", f"<div class='comments'><div class='comments'><article>{said}</article></div>{said}</div>"):
        assert main_text(f"<body><article>{body}{part}</article></body>") == want, part
        assert main_text(f"<body><article>{body}</article>{part}</body>") == want, part
    assert main_text(f"<body><article>{body}<h2>Comments</h2><p>are what a parser skips in a program.</p></article></body>") == want + " Comments are what a parser skips in a program."


def test_words_around_or_on_the_only_part():
    body = f"<p>{'word ' * 40}end.</p>"
    want = f"{'word ' * 40}end."
    for page in (f"<div class='share-page'><article>{body}</article></div>", f"<article class='related'>{body}</article>", f"<div class='alert'><div class='notice'><article>{body}</article></div></div>"):
        assert main_text(f"<body>{page}</body>") == want, page


def test_odd_pages():
    assert [main_text(x) for x in (None, "", " ", "<p", "<!--", "<script>", "<nav>menu")] == [""] * 7
    assert main_text("<body><nav><a href=x>menu</a></nav><h1>Short</h1><p>plain & short.</p></body>") == "Short plain & short."
    assert main_text("<article>" + "<p>a b</p>" * 5000) == " ".join(["a b"] * 5000)
    assert main_text("<article><p>a < b and <b>c</b>d &am") == "a < b and cd &am"
    assert main_text("<main><p>x</p></main><article><p>y</p></article>") == "x y"
    assert main_text("<article>" + "x" * 200000) == "x" * 200000


def expected(html):
    """What these pages' generator means: the article's text."""
    inner = re.search(r"<article>(.*?)(</article>|\Z)", html, re.S)[1]
    return " ".join(unescape(re.sub("<[^>]*>", "", re.sub("<(?:/?p|br|/?h1)>", " ", inner))).split())


def test_whole_table(spark):
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()
    rows = {r.page_id: r for r in op1_html_text(spark, "/root/testdata/sf0.01").collect()}
    assert len(rows) == len(pages)
    for p in pages:
        r = rows[p["page_id"]]
        assert (r.url, r.text) == (p["url"], expected(p["html"])) and r.n_chars == len(r.text)


def test_nulls_repeats_and_empty(spark):
    schema = "page_id long, url string, html string, text string, n_chars string"
    df = spark.createDataFrame([(None, None, None, "clash", "x"), (1, "u", "<article>a", "clash", "x"), (1, "u", "<article>a", "clash", "x")], schema)
    assert sorted((r.page_id or 0, r.text) for r in extract(df).collect()) == [(0, ""), (1, "a"), (1, "a")]
    assert extract(spark.createDataFrame([], schema)).collect() == []
