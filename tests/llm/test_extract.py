import html
import re

import pytest

from tessera.llm import extract


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain &lt;text&gt;\n\n &amp;  more", "plain <text> & more"),
        ("<p>one<p>two", "one\ntwo"),
        ("<body><nav>a</nav><footer>b</footer></body>", ""),
        ("<article><h1>T</h1><p><b>open<br><p>next</article><footer>f</footer>", "T\nopen\nnext"),
        ("<article><p>a&#233;&nbsp;b&#x1F600; &notanentity;</p></article>", "aé b😀 ¬anentity;"),
        ("<article><script>if (a</p>b) '<p>x</p>'</script><style>p{}</style><p>kept, this.</p><!-- <p>no</p> --></article>", "kept, this."),
        ("<main><ul><li>first<li>second</ul><table><tr><td>c1<td>c2</table></main>", "first\nsecond\nc1\nc2"),
        ("<article><p>text, here.</p><div class='comments'><p>I agree, friend. Yes, yes.</p></div><form><p>mail, me</p></form></article>", "text, here."),
        ("<div id=sidebar><p>a, b. c</p></div><div class=post-body><p>The story, as told. It goes on, and on.</p><p>Short</p></div>", "The story, as told. It goes on, and on.\nShort"),
        ("<div class='cookie-notice'>We use, as one does, cookies. Accept.</div><div><h2>Head</h2><p>Body text, with signs. More of it, too.</p></div>", "Head\nBody text, with signs. More of it, too."),
        ("<article><p>unclosed <b>bold <i>both</p><p>after</p>", "unclosed bold both\nafter"),
        ('<article><a href="x>y">link</a> and <img alt="a > b"> text</article>', "link and text"),
        ("<article><p>never ends <scr", "never ends"),
        ("<article><p style='display:none'>secret</p><p hidden>more</p><p>seen</p></article>", "seen"),
    ],
)
def test_pages(page, text):
    assert extract.main_text(page or "") == text


def test_whole_fixture(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in extract.extract(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1|br)[^>]*>", article)]
        text = "\n".join(b for b in blocks if b)
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (text, len(text), r.url)


def test_awkward_rows(spark):
    rows = [(1, None, None, "t"), (None, "u", "<p>x", "t"), (2, "u", "<p>y</p>" * 20_000, "t"), (2, "u", "<p>y</p>" * 20_000, "t")]
    got = extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted(r.n_chars for r in got) == [0, 1, 39_999, 39_999]
    assert extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize(("lead", "body", "n"), [(1500, 200, 60), (3000, 300, 60), (6000, 80, 100)])
def test_long_lead_does_not_hide_the_body(lead, body, n):
    first, rest = ("word, " * lead)[: lead - 1] + ".", [f"paragraph {i}, " + "w" * (body - 20) + "." for i in range(n)]
    page = f"<body><div class=lead><p>{first}</p></div><div class=body>" + "".join(f"<p>{x}</p>" for x in rest) + "</div></body>"
    assert extract.main_text(page) == "\n".join([first, *rest])


def test_link_lists_outside_the_article_stay_out():
    links = "".join(f"<li><a href=x>Link {i}</a>" for i in range(40))
    page = f"<body><div class=l><ul>{links}</ul></div><div class=r>" + "<p>A sentence of the story, as told here, goes on for a while. And on.</p>" * 20 + "</div></body>"
    assert "Link" not in extract.main_text(page)


@pytest.mark.parametrize("name", ["no-sidebar", "has-sidebar", "content with-sidebar", "elementor-widget-theme-post-content", "layout-sidebar", "widget"])
def test_layout_wrappers_are_not_left_out(name):
    story = "<p>The story, as told. It goes on, and on.</p>" * 5
    want = "\n".join(["The story, as told. It goes on, and on."] * 5)
    side = "<div class=sidebar><p>Aside, briefly.</p></div>"
    assert extract.main_text(f"<body><div class='{name}'><article>{story}</article></div>{side}</body>") == want
    assert extract.main_text(f"<body><div class='{name}'><div>{story}</div></div>{side}</body>") == want


def test_post_header_keeps_the_headline():
    assert extract.main_text("<article><div class=post-header><h1>Head</h1></div><p>Text, as told.</p><div class=comments-area><article><p>I agree, so much.</p></article></div></article>") == "Head\nText, as told."


def test_deep_nesting():
    assert extract.main_text("<div class=widget>" + "<div>" * 3000 + "<p>Text, as told.") == "Text, as told."


STORY = "The story, as told, number {}. It goes on, and on, as stories do."


def story(n, start=0):
    return "".join(f"<p>{STORY.format(i)}</p>" for i in range(start, start + n))


def lines(n, start=0):
    return [STORY.format(i) for i in range(start, start + n)]


SIDE = "<div class=sidebar><ul><li><a href=x>Link one</a><li><a href=x>Link two</a></ul></div>"
FOOT = "<footer><p>Copyright, Somebody. All rights reserved.</p></footer>"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<body><div class='layout with-sidebar'>{story(5)}</div>{FOOT}</body>", lines(5)),
        (f"<body><div id='social-history'>{story(5)}</div>{FOOT}</body>", lines(5)),
        (f"<body><div class='article-header'><h1>The title</h1></div><div class=c>{story(5)}</div>{SIDE}</body>", ["The title", *lines(5)]),
        (f"<body>{SIDE}<div class=a>{story(20)}</div><div class=b>{story(1, 20)}</div>{FOOT}</body>", lines(21)),
        (f"<body>{SIDE}<article>{story(3)}</article><article>{story(3, 3)}</article>{FOOT}</body>", lines(6)),
        (f"<body><main>{story(3)}<p class='banner-quote'>A quote, as said by someone.</p>{story(2, 3)}</main></body>", [*lines(3), "A quote, as said by someone.", *lines(2, 3)]),
        (f"<body><main>{story(3)}<p class='ad'>Buy this, now.</p><p class=cookie-notice>We use cookies, as one does.</p></main></body>", lines(3)),
        (f"<body><table><tr><td><a href=1>Home</a><br><a href=2>News</a></td><td><h1>Head</h1>{story(4)}</td></tr></table></body>", ["Head", *lines(4)]),
        (f"<body><div id=top><a href=1>Home</a> <a href=2>About</a></div><div id=c><h1>Head</h1>{story(4)}<h2>Sub</h2><ul><li>Point one<li>Point <a href=x>two</a></ul></div></body>", ["Head", *lines(4), "Sub", "Point one", "Point two"]),
        (f"<body><div><p><a href=x>{STORY.format(0)}</a></p>{story(3, 1)}</div></body>", lines(4)),
    ],
)
def test_layouts(page, want):
    assert extract.main_text(page).split("\n") == want


@pytest.mark.parametrize("name", ["div", "section", "div class=content"])
def test_ratios_find_the_article_of_the_fixture_without_its_name(name):
    import pyarrow.parquet as pq

    for page in pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist():
        renamed = page.replace("<article>", f"<{name}>").replace("</article>", f"</{name.split()[0]}>")
        assert extract.main_text(renamed) == extract.main_text(page)
