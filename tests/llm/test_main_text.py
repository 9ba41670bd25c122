import html
import re
import time

import pytest

from effectgrid.llm.main_text import extracted, main_text

SCHEMA = "page_id long, url string, html string, text string, n_chars string"
BODY = "<h1>Title &amp; more</h1><p>First  paragraph,\nwith <b>bold</b> and a <a href='/x'>link</a>.<p>Second &lt;one&gt;, long enough to be read as text.</p>"
TEXT = "Title & more\nFirst paragraph, with bold and a link.\nSecond <one>, long enough to be read as text."
LINKS = "".join(f"<li><a href='/{i}'>Item {i}</a></li>" for i in range(12))
AROUND = [
    ("", ""),
    (f"<nav><ul>{LINKS}</ul></nav>", "<footer>&copy; somebody</footer>"),
    (f"<header class=top><h2>Site</h2><ul>{LINKS}</ul></header><div class='ad big'>Buy this now</div>", "<aside>Other things of the day</aside>"),
    ("<div id='cookie-notice'><p>We use cookies, and this is a rather long sentence.</p></div>", "<div class=comments><p>A reader wrote a long comment here, really long.</p></div>"),
    ("<form action=/s><p>Search this site for words</p><input name=q></form>", f"<div class='sidebar'><ul>{LINKS}</ul></div><script>var x = '<p>no</p>';</script>"),
    ("<!-- <p>hidden</p> --><style>p > a {color: red}</style><div role=navigation><a href=/>Home</a></div>", "<section class='related'><p>Read also this other text of ours</p></section>"),
]


@pytest.mark.parametrize("before, after", AROUND)
@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main><div>{}</div></main>", "<div class=content>{}</div>"])
def test_boilerplate_goes(before, after, wrap):
    page = f"<!DOCTYPE html><html><head><title>t</title></head><body>{before}{wrap.format(BODY)}{after}</body></html>"
    assert main_text(page) == TEXT


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("plain words", "plain words"),
        ("<nav><a href=/>x</a></nav><footer>y</footer>", ""),
        ("<article><p>cut off here <a href='", "cut off here"),
        ("<article><p>cut &amp", "cut &"),
        ("<article><p>a<br>b<p>c</p></p></article></div>", "a b\nc"),
        ("<article><header><h1>T</h1></header><ul><li>a<li>b<ul><li>c</ul></ul><table><tr><td>x<td>y</table></article>", "T\na\nb\nc\nx\ny"),
        ("<article>a < b and 1<2 <p title='x > y'>c</p></article>", "a < b and 1<2\nc"),
        ("<article><p>x</p></article><article><p>y</p></article>", "x\ny"),
        ("<article><svg><text>no</text></svg><p>é&#233;&eacute;&nbsp;!</p></article>", "ééé !"),
        ("<div>" * 5000 + "deep" + "</div>" * 5000, "deep"),
        ("<article><p>" + "word " * 100_000, ("word " * 100_000).strip()),
    ],
)
def test_odd_pages(page, text):
    assert main_text(page) == text


LONG = "A sentence of the text that is long enough to be read, and then some. " * 3
HALVES = [f"<div>{''.join(f'<p>{LONG}{k}{i}' for i in range(10))}</div>" for k in "ab"]
LINES = [[f"{LONG}{k}{i}" for i in range(10)] for k in "ab"]


@pytest.mark.parametrize(
    "page, lines",
    [
        (f"<div id=content><h1>Title</h1>{HALVES[0]}{HALVES[1]}</div>", ["Title", *LINES[0], *LINES[1]]),
        (f"<ul>{LINKS}</ul><div>{HALVES[0]}</div><ul>{LINKS}</ul><div><div>{HALVES[1]}</div></div><p><a href=/>x</a></p>", [*LINES[0], *LINES[1]]),
        (f"<article>{HALVES[0]}</article><article>{HALVES[1]}</article>", [*LINES[0], *LINES[1]]),
        (f"<p>Read also</p><article>{HALVES[0]}</article><article>{HALVES[1]}</article>", [*LINES[0], *LINES[1]]),
        (HALVES[0] + HALVES[1].replace("div>", "article>"), [*LINES[0], *LINES[1]]),
        (f"<div>{LONG}<span><b>x</b></span></div>", [LONG + "x"]),
    ],
)
def test_text_in_several_containers(page, lines):
    assert main_text(f"<html><body>{page}</body></html>").split("\n") == lines


@pytest.mark.parametrize("name", ["class='content with-sidebar'", "class=has-menu", "id='page-nav-wrap'", "class='page-header'"])
@pytest.mark.parametrize("wrap", ["<div {}><article>{}</article></div>", "<div {}><main>{}</main></div>", "<div {}>{}</div>", "<article><div {}>{}</div></article>", "<article {}>{}</article>"])
def test_names_of_wrappers_do_not_drop_the_text(name, wrap):
    around = f"<div class=sidebar><ul>{LINKS}</ul></div>"
    assert main_text(f"<html><body>{around}{wrap.format(name, BODY)}{around}</body></html>") == TEXT


def test_named_parts_of_an_article_go():
    extra = "<div class=share><p>Tell others of it</p></div><div class='related'><p>Another text of ours</p></div>"
    assert main_text(f"<div class=has-sidebar><article>{BODY}{extra}</article></div>") == TEXT
    comments = f"<div id=comments><article class=comment><p>{LONG}</p></article><p>{LONG}</p></div>"
    assert main_text(f"<article>{BODY}</article>{comments}") == TEXT


@pytest.mark.parametrize(
    "page, lines",
    [
        (f"<div class=post><p>{LONG}a<p>{LONG}b</div><div class=comments>{f'<p>{LONG}' * 10}</div>", [LONG + "a", LONG + "b"]),
        (f"<article><p>One short sentence.</p><div class=ad>{f'<p>{LONG}' * 3}</div></article>", ["One short sentence."]),
        (f"<main><article>{HALVES[0]}</article><article><p>A short one.</p></article></main>", [*LINES[0], "A short one."]),
        (f"<div class=post><p>{LONG}a</div><div id=comment-wrapper>{f'<p>{LONG}' * 10}</div>", [LONG + "a"]),
        (f"<h1>Title</h1><div class=widget><p>{LONG}a<p>{LONG}b</div>", ["Title", LONG + "a", LONG + "b"]),
        (f"<div class=has-sidebar><p>{LONG}a<p>{LONG}b</div><div><p>Another part.</div><div class=sidebar>{f'<p>{LONG}' * 9}</div>", None),
    ],
)
def test_named_parts_of_any_size(page, lines):
    text = main_text(f"<html><body>{page}</body></html>").split("\n")
    if lines is None:  # what is beside may come or not, the wrapper's text is there and the named part is not
        assert text[:2] == [LONG + "a", LONG + "b"] and LONG.strip() not in text
    else:
        assert text == [" ".join(x.split()) for x in lines]


@pytest.mark.parametrize("page", ["<div>" * 20_000 + "deep", "<div>" * 20_000 + "</p>" * 20_000 + "deep", "<span>" * 20_000 + "deep" + "</span>" * 20_000, "<div><b>" * 5_000 + "<li>" * 5_000 + "deep"])
def test_nested_pages_take_linear_time(page):
    start = time.process_time()
    assert main_text(page) == "deep"
    assert time.process_time() - start < 2


def test_given_pages(spark, sf_mid):
    """The given pages keep their text in one article; a plain reading of it is the same."""

    def plain(page):
        m = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)
        x = re.sub(r"<[^>]*\Z", "", m[1]) if m else ""
        x = re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", re.sub(r"</?(?:p|h1)>", "\0", x)))
        return "\n".join(y for y in (" ".join(html.unescape(z).split()) for z in x.split("\0")) if y)

    pages = spark.read.parquet(f"{sf_mid}/pages.parquet")
    given = {r.page_id: r for r in pages.collect()}
    got = extracted(pages).collect()
    assert len(got) == len(given)
    for r in got:
        assert r.text == plain(given[r.page_id].html) and r.n_chars == len(r.text) and r.url == given[r.page_id].url


def test_frames(spark):
    assert extracted(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, None, None, "x", "y"), (1, None, None, "x", "y"), (None, "u", "<p>a</p>", None, None)]
    got = extracted(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, None, "", 0), (1, None, "", 0), (None, "u", "a", 1)], key=str)
