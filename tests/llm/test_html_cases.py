"""Pages of many shapes, hostile ones, and text that must not be lost."""

import time

import pytest
from pyspark.sql import functions as F

from tilescope.llm.html_wrapper import _off, _text, align, extract_main_text, slots, structure

FILLER = "Words of the {k}th story by page {i} go on and on."
SHAPES = {
    "article": "<body><nav><a href=/>Home</a></nav><article>{body}</article><footer>foot</footer></body>",
    "main": "<body><header><p>Site</p></header><main>{body}</main><aside><p>aside {i}</p></aside></body>",
    "named": "<div id=nav-main><p>menu</p></div><div class='post-content wide'>{body}</div><div class=post-comments><p>reader {i}</p></div>",
    "plain": "<body><div class=top-banner><p>banner</p></div><div>{body}</div><form><p>form</p></form></body>",
    "state": "<body class=home><div class='page no-sidebar'><div class='header-fixed hasMenu has-menu'>{body}</div></div></body>",
    "custom": "<site-header><svg-icon></svg-icon></site-header><button-group></button-group><div>{body}</div><div class=cookieNotice><p>ok</p></div>",
    "sections": "<section>{body}</section><section><p>A second section of page {i}.</p></section>",
    "classes": "<div><p class='text-center'>Centred {i}.</p>{body}<p data-x=5'>Odd {i}.</p></div>",
}
MORE = {"sections": ["A second section of page {i}."], "classes": ["Odd {i}."]}
BEFORE = {"classes": ["Centred {i}."]}


def page_of(shape, i, free):
    """A page of a shape, and the lines of its main text; free bodies differ in their elements from page to page."""
    lines, body = [], ""
    for k in range(3 + (i % 3 if free else 0)):
        line = FILLER.format(k=k, i=i)
        tag = ["p", "h2", "blockquote", "p"][(i + k) % 4] if free else "p"
        body += f"<{tag}>{line}</{tag}>"
        lines.append(line)
    lines = [x.format(i=i) for x in BEFORE.get(shape, [])] + lines + [x.format(i=i) for x in MORE.get(shape, [])]
    return SHAPES[shape].format(body=body, i=i), "\n".join(lines)


def test_shapes(spark):
    """Every shape as a host of its own, with fixed and free bodies, all shapes on one host, and each page alone."""
    pages, want = [], {}
    for free in (False, True):
        for shape in SHAPES:
            for i in range(7):
                page, text = page_of(shape, i, free)
                for host in (f"{shape}{free}", "mixed", f"alone{len(pages)}"):
                    want[len(pages)] = text
                    pages.append((len(pages), host, page))
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    got = {r["page_id"]: r["text"] for r in extract_main_text(frame, F.col("url")).collect()}
    wrong = [(pages[k][1:], got[k]) for k in want if got[k] != want[k]]
    assert not wrong, (len(wrong), wrong[0])


HOSTILE = {
    "nested": "<div>" * 5000 + "<p>deep text</p>" + "</div>" * 5000 + "<p>after</p>",
    "nested kinds": "".join(f"<div class=k{'abcdefghij'[k % 10]}x>" for k in range(5000)) + "deep text",
    "open tags": '"' + "<i y " * 200_000,
    "open quote": '<p x="' + "<i y " * 200_000,
    "deep": "<div>" * 200_000 + "x" + "<p>y" * 1000,
    "stray ends": "<table><li>" + "<div>" * 100_000 + "</li>" * 100_000 + "x",
    "open raw": "<svg>" * 200_000 + "<p>text",
    "signs": "1 < 2 " * 150_000,
    "comments": "<!-- " * 200_000,
    "quotes": "<a b='\"" * 140_000,
    "siblings": "".join(f"<h{k % 6 + 1}>a</h{k % 6 + 1}><div class=k{'abcdefgh'[k % 8]}>b</div><ul><li>c</ul>" for k in range(12_000)),
}


def test_hostile_pages(spark):
    """Pages of about a megabyte, deep or never closed, take seconds and do not end the job."""
    for name, page in HOSTILE.items():
        begun = time.time()
        found = list(slots(page))
        tree = structure([(path, elements) for path, _, _, elements in found])
        align(tree, tree)
        assert time.time() - begun < 20, name
    rows = [(k, "host", page) for k, page in enumerate(HOSTILE.values())]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    text = dict(zip(HOSTILE, (r["text"] for r in extract_main_text(frame, F.col("url")).orderBy("page_id").collect()), strict=True))
    assert text["nested"] == "deep text\nafter" and text["nested kinds"] == "deep text"
    assert text["deep"].startswith("x\ny\ny") and text["stray ends"] == "x" and text["open raw"] == "text"
    assert text["signs"] == ("1 < 2 " * 150_000).strip() and text["open quote"] == ""


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<p title="a>b">one</p>', "one"),
        ('<p title="x>one</p><p>two</p>', "one\ntwo"),  # a quote that is never closed is none
        ("<p>a <b and c</p>", "a"),  # by the rules of HTML `<b` begins a tag here
        ("<p>3 <4 & 5&lt;6</p>", "3 <4 & 5<6"),
        ("<script>x='<p>no</p>'</SCRIPT ><p>yes</p><script>open <p>no", "yes"),
        ("<p>one<button>two <p>three", "onetwo\nthree"),
        ("<div data-class='comments'><p>x</p></div>", "x"),
        ("<!doctype html><!-- a > b --><p>x<?php echo ?>y</p>", "xy"),
    ],
)
def test_tokens(page, text):
    assert _text(page, frozenset()) == text


def test_names_count_whole():
    for off in ("div.post-comments", "div.sidebar-left", "section.cookie-notice", "div.ad_box"):
        assert _off((off,))
    for on in ("div.no-sidebar", "div.has-menu", "div.header-fixed", "div.headline", "p.text-center", "body.sidebar"):
        assert not _off((on,))
