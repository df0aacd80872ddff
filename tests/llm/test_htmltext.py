"""Main texts of made pages, and of the given ones by their markup."""

import html
import re

from cohortloom.llm import catalog, htmltext

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style></head><body class="home"><header><h1>Site</h1><nav><a href=x>Home</a></nav>
</header><div id="cookie-banner">We use cookies</div><div class="wrap"><div class="post-%d entry"><h2>Title &amp; more</h2><p>First para %d
<a href=q>link</a> text&nbsp;here.<p>Second <i>para</i>graph<br>line  two<div class="ad-slot">Buy now</div><ul><li>one<li>two</ul><form><input><label>Email
</label></form><blockquote>Quote &#8364;</blockquote><!-- hidden <p>comment</p> --><p hidden>Unseen</p></div><div id=comments><p>Great post! A very long
comment by a reader, longer than anything else on the page, it goes on and on and on and never ends, or so it seems to all the others.</p></div></div>
<aside class=sidebar>Side</aside><footer>foot</footer><script>var a="<p>x</p>";</script></body></html>"""
TEXT = "Title & more\n\nFirst para %d link text here.\n\nSecond paragraph line two\n\none\n\ntwo\n\nQuote €"


def test_made_page():
    path, weight = htmltext.vote(PAGE % (1, 1))
    assert path == ">html>body.home>div.wrap>div.entry.post-#" and 0 < weight <= 1
    assert htmltext.extract(PAGE % (1, 1), path) == TEXT % 1
    assert htmltext.extract(PAGE % (1, 1), ">html>body>nowhere") == TEXT % 1


def test_broken_markup():
    for page, want in [
        ("", ""), ("plain <b text", "plain <b text"), ("<p>a", "a"), ("<p>a</div></p>b", "a\n\nb"), ("a < b & c &lt; d", "a < b & c < d"),
        ("<p>x<script>never closed", "x"), ("<!-- never closed <p>x", ""), ('<p title="a>b">t</p>', "t"), ("<p title='a>t</p>", "t"), ("</p></p>", ""),
    ]:
        assert htmltext.extract(page, None) == want, page


def test_body_below_the_heading():
    long = "long text of the page " * 20
    for page, path, want in [
        (f"<body><article><h1>T</h1><p>lead</p><div class=body>{long}</div></article><p>teaser", ">body>article", ["T", "lead", long.strip()]),
        (f"<article><section class=intro>in</section><section class=body>{long}</section></article>", ">article", ["in", long.strip()]),
        (f"<main><h1>T</h1><article><div>{long}</div></article></main>", ">main", ["T", long.strip()]),
        (f"<body><div class=post><h1>T</h1><div><div class=text>{long}</div></div></div></body>", ">body>div.post", ["T", long.strip()]),
        (f"<body><h1>T</h1><p>lead</p><div class=text>{long}</div></body>", ">body", ["T", "lead", long.strip()]),
        (f"<body><div class=a><div class=links><a href=x>see this</a></div><div class=text>{long}</div></div></body>", ">body>div.a>div.text", [long.strip()]),
    ]:
        assert htmltext.vote(page)[0] == path, page
        assert htmltext.extract(page, path) == htmltext.extract(page, None) == "\n\n".join(want), page


def test_wrappers_of_an_article_stay():
    body, junk = "text of the article " * 5, "<nav><a href=x>menu</a></nav><footer>foot</footer><div class=sidebar>side</div>"
    for begin, end in [
        ("<form id=aspnetForm>", "</form>"), ("<form><div class='content no-sidebar'>", "</div></form>"), ("<div class=with-sidebar>", "</div>"),
        ("<div class=ad-free>", "</div>"), ("<div class='post comments-open'>", "</div>"), ("<div class=widget>", "</div>"),
        ("<div role=dialog>", "</div>"), ("<div class='main sidebar'><form>", "</form></div>"),
    ]:
        for inner in ("<article><p>%s</p></article>", "<div class=x><p>%s</p></div>"):
            page = f"<body>{junk}{begin}{inner % body}{end}</body>"
            assert htmltext.extract(page, htmltext.vote(page)[0]) == body.strip(), page
    kept = "<label>l</label><button>b</button><dialog open>d</dialog><div class=notice>n</div><div class=related>r</div>"
    left = "<dialog>D</dialog><div class='related'><a href=x>R</a></div><div class=ad>A</div><form>F<label>L</label></form>"
    assert htmltext.extract(f"<article><p>{body}</p>{kept}{left}</article>", None).split("\n\n") == [body.strip(), "lb", "d", "n", "r"]
    comments = f"<div id=comments><article>{body * 9}</article></div>"
    assert htmltext.extract(f"<div class=post><p>{body}</p></div>{comments}", None) == body.strip()
    assert htmltext.extract("<div class=comments><p>only text</p></div>", None) == "only text"


def test_elements_without_an_end():
    for begin in ("<svg width=1 />", "<svg/>", "<math />", "<noscript>", "<object data=x>", "<template>", "<iframe src=x>", "<svg>"):
        for end in ("", "<svg><text>drawn</text></svg>", "<p>b</p><svg><path d='M0'/></svg>"):
            if begin == "<svg>" and end:
                continue
            want = "a\n\nb" if "b" in end else "a"
            assert htmltext.extract(f"<body>{begin}<article><p>a</p>{end}</article></body>", None) == want, (begin, end)
    page = "<article><p>x <math><mi>y</mi><mo>=</mo><mn>2</mn><annotation>TeX</annotation></math> z<noscript>n</noscript><object>o</object></article>"
    assert htmltext.extract(page, None) == "x y=2 z"
    article = "<article><p>%s</article>" % ("text " * 9)
    assert htmltext.extract(f"<body><svg><path d=x></svg><svg width=1>{article}", None) == ("text " * 9).strip()


def test_hosts_vote(spark):
    wide = "<html><body><div class=story><p>%s</p></div><div class=teaser><p>%s</p></div></body></html>"
    long, short = "main text of the page " * 20, "see what else there is here " * 16
    rows = [(i, f"http://a.example/{i}", wide % (long, "short")) for i in range(6)]
    # Here the teaser is the longer one; the host's other pages tell which it is.
    rows += [(6, "HTTP://A.example:80/6", wide % (short, long)), (7, None, PAGE % (7, 7)), (8, "odd", ""), (9, "http://a.example/9", None), (9, "http://a.example/9", None)]
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, host string, path int")
    got = {r.page_id: r for r in htmltext.main_texts(pages).collect()}
    assert got[6].text == short.strip() and got[0].text == long.strip() and got[6].host_path == ">html>body>div.story"
    assert got[7].text == TEXT % 7 and got[8].text == "" and got[9].text == "" and got[9].n_chars == 0
    assert htmltext.main_texts(pages).count() == len(rows)
    assert htmltext.main_texts(pages.limit(0)).count() == 0


def test_given_pages(spark, small):
    pages = {r.page_id: r for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    got = catalog.QUERIES["op2_html_extraction"](spark, small).collect()
    assert len(got) == len(pages)
    for r in got:
        page = pages[r.page_id].html
        body = page[page.index("<article>") + 9 : page.index("</article>")]
        blocks = re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", re.sub(r"</?(?:p|h1)>", "\0", body))).split("\0")
        want = [" ".join(html.unescape(b).split()) for b in blocks]
        assert r.text == "\n\n".join(b for b in want if b) and r.n_chars == len(r.text)
