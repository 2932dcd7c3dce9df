import time

import numpy as np
import pytest

from studyspark.llm.html import extract_main_text, main_text, text_regions

BODY = "<p>" + "Real words stand here in a row. " * 8 + "</p>"
TEXT = " ".join(["Real words stand here in a row."] * 8)


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""),
        ("", ""),
        ("<html><body></body></html>", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<article><h1>T</h1><p>a  b<br>c</p></article>", "T\na b c"),
        ("<article><p>x &lt;p&gt; y&nbsp;z &#233; &eacute;</article>", "x <p> y z é é"),
        ("<nav><a href='/'>Home</a></nav><article><p>A</p><p>B</article><footer>F</footer>", "A\nB"),
        ("<article><header><h1>H</h1></header><p>A</p></article><header>site</header>", "H\nA"),
        ("<article><p>A</p><aside>side</aside><p>B</p><form><input>Send</form></article>", "A\nB"),
        ("<article><p>A</p><div class='ad-box'>Buy</div><script>var t='</p>';</script><p>B</p></article>", "A\nB"),
        ("<main><p>A</p></main><section id='comments'><article><p>I say</p></article></section>", "A"),
        ("<article><p>A</p><section class='reader-comments'><p>me too</p></section></article>", "A"),
        ("<article><p>A<b>b</b>c<i> d</i></p><div role=\"complementary\">n</div></article>", "Abc d"),
        ("<article><p title='a > b'>A</p><!-- <p>no</p> --><p>B</p>", "A\nB"),
        ("<article><ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table></article>", "one\ntwo\nc1\nc2"),
        ("<article><p><b>bold<br><p>next</p></article>", "bold\nnext"),
        ("<article><p>A</p><div class='cookie-notice'><p>We use cookies</p></div><p>B</p></article>", "A\nB"),
        ("<article><div class='article-content'><p>A</p></div><p style='display:none'>no</p></article>", "A"),
        ("<article><p>1 < 2 and 3 > 2</p></article>", "1 < 2 and 3 > 2"),
        (f"<body><div><a href='/'>Home</a></div>{BODY}<div class='footer'>(c)</div></body>", TEXT),
        (f"<body><div>short</div><div class=sidebar>x</div>{BODY}{BODY}</body>", f"{TEXT}\n{TEXT}"),
    ],
)
def test_main_text(page, text):
    assert main_text(page) == text


def test_sums_decide_beside_the_named_article():
    more = "Further words of it stand in a plain box. " * 10
    page = f"<article>{BODY * 9}</article><div>Our shop sells pens.</div><nav>n</nav><div>{more}</div>"
    assert main_text(page) == "\n".join([TEXT] * 9 + [more.strip()])


def test_boxes_in_the_flow_take_no_text_with_them():
    box = "<div class=ad>Buy</div>"
    first = "<p>" + "An introduction. " * 24 + "</p>"
    intro = ("An introduction. " * 24).strip()
    body = "\n".join([TEXT] * 12)
    assert main_text(f"<body>{first}{box}{BODY * 12}</body>") == f"{intro}\n{body}"
    assert main_text(f"<body><div>{first}</div>{box}<div>{BODY * 12}</div></body>") == f"{intro}\n{body}"
    assert main_text(f"<body>{BODY * 12}{box}<p>The end.</p></body>") == f"{body}\nThe end."
    assert main_text(f"<body><div>{BODY * 12}</div>{box}<div>Pens</div></body>") == body


LONG = "\n".join([TEXT] * 3)


@pytest.mark.parametrize(
    "page,text",
    [
        (f"<div class='layout has-sidebar'><article>{BODY * 3}</article></div>", LONG),
        (f"<div id='no-sidebar'><article>{BODY * 3}</article></div>", LONG),
        (f"<article class='post comments-open'>{BODY * 3}</article>", LONG),
        (f"<form id='aspnetForm'><div>{BODY * 3}</div></form>", LONG),
        (f"<form id='aspnetForm'><article>{BODY * 3}</article><form>Send</form></form>", LONG),
        (f"<div class='sidebar-left'><main>{BODY * 3}</main></div><p>(c)</p>", LONG),
        (f"<article class='card'><p>Short</p></article><div class=ad>Buy</div><div>{BODY * 3}</div>", LONG),
        # what is boilerplate stays so
        (f"<article>{BODY * 3}</article><div class=sidebar>{BODY * 5}</div>", LONG),
        (f"<div>{BODY * 3}</div><div class=comments><article>{BODY * 5}</article></div>", LONG),
        (f"<article>{BODY * 3}<div class='cookie-notice'>{BODY * 5}</div></article>", LONG),
        (f"<article>{BODY * 3}</article><div class=related><article>{BODY}</article></div>", LONG),
    ],
)
def test_wrappers_with_a_junk_word_keep_their_text(page, text):
    assert main_text(page) == text


def test_surges_and_dives():
    assert text_regions(np.array([0, 5, 0, 0, 4, 0, 0, 0, 9])) == [(1, 5), (8, 9)]
    assert text_regions(np.array([], int)) == []
    assert text_regions(np.array([9, 0, 0, 0, 40, 50, 0, 0, 0, 30]), surge=80) == [(4, 6)]
    assert text_regions(np.array([9, 0, 0, 0, 3]), surge=80) == [(0, 1)]


def test_pages_with_clashing_columns(spark):
    pages = spark.createDataFrame(
        [(1, "u", "<article><p>é b</p></article>", "old", -1), (2, None, None, None, None)],
        "page_id bigint, url string, html string, text string, n_chars int",
    )
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in extract_main_text(pages).collect()}
    assert got == {1: ("é b", 3), 2: ("", 0)}
    assert extract_main_text(pages.limit(0)).count() == 0


SAID = "".join(f"<p>{'I think so too, and more. ' * 12}</p>" for _ in range(5))


@pytest.mark.parametrize(
    "page,text",
    [
        # short titles and paragraphs before an advert
        (f"<div><h1>Title</h1></div><div class=ad>Buy</div><div>{BODY * 3}</div>", f"Title\n{LONG}"),
        (f"<div><p>Twenty characters...</p></div><div class=ad>Buy</div><div>{BODY * 3}</div>", f"Twenty characters...\n{LONG}"),
        # a class of a paragraph is about its text
        (f"<article>{BODY}<p class='market-share'>Shares fell.</p><li id='search'>Look</article>", f"{TEXT}\nShares fell.\nLook"),
        # readers' comments are never the text, however short that is
        (f"<div><p>A body of some forty characters stands.</p></div><div id='comments'>{SAID}</div>", "A body of some forty characters stands."),
        (f"<div><p>Short.</p></div><div class='replies'><article>{SAID}</article></div>", "Short."),
        (f"<div class='discussion'><main>{BODY}</main></div>", TEXT),
    ],
)
def test_short_text_stays_and_comments_go(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize(
    "page,text",
    [
        ("<div class=menu><p>abc</p>" * 40_000, None),
        ("<a b=\"" * 200_000, None),
        ("<p>x</p>" + "<a b=\"c" * 100_000 + "<p>y</p>", None),
        ("<center>" * 100_000 + "</td></b><p>x" * 20_000, None),
        ("<div class=menu><article>" * 20_000, None),
        ("<ul><li>" * 50_000 + "</i></zz>" * 50_000, None),
        ("<!-- " * 100_000, ""),
        ("<script>" * 100_000, ""),
        ("<article>" + "<p>word</p>" * 100_000 + "</article>", "\n".join(["word"] * 100_000)),
    ],
)
def test_long_and_deep_pages_take_linear_time(page, text):
    start = time.process_time()
    got = main_text(page)
    assert time.process_time() - start < 4
    assert text is None or got == text
