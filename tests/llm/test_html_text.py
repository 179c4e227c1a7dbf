"""Operator 9 on small pages with known articles."""

import time

import pytest

from sessionlake.llm.html_text import extract, main_text

LONG = "It is the story of a house and of the people who lived in it for a long time, with all that was said by them and of them, " * 3
PAGE = f"""<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{{}}</style><script>var t="</p><p>no</p>";</script></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href="/a">the</a></li><li><a href="/b">of</a></li></ul></nav><!-- <p>gone</p> -->
<div class="cookie-notice">We use cookies and the like of them to be of help to you in all that you do on this site, as it is.</div>
<article><h1>A  title</h1><p><b>{LONG}<br><p>Caf&eacute;&nbsp;&lt;b&gt; is.</p><div class="ad">Buy it.</div><p>Of.</p>
<form>Name <input><button>Send</button></form><section id="comments"><p>{LONG}</p></section></article>
<aside>More of the same</aside><footer>&copy; x &middot; y</footer></body></html>"""


def test_article_only():
    want = ["A title", LONG.strip(), "Café <b> is.", "Of."]
    assert main_text(PAGE).split("\n") == want


def test_blocks_without_containers():
    page = f"<body><div><a href=1>one</a> <a href=2>two</a></div><p>{LONG}</p><p>Yes.</p><p>{LONG}</p><div><a href=x>next page of all</a></div></body>"
    assert main_text(page).split("\n") == [LONG.strip(), "Yes.", LONG.strip()]


def test_article_without_function_words():
    page = "<nav><a>x</a></nav><article><p>alpha | beta | gamma</p><p>" + "delta | epsilon " * 20 + "</p></article><footer>f</footer>"
    assert main_text(page) == "alpha | beta | gamma\n" + ("delta | epsilon " * 20).strip()


def test_broken_markup():
    assert main_text("<article><p>cut off in the mid") == "cut off in the mid"
    assert main_text("<article><p title='it>x</p><p>b") != ""
    assert main_text("<article>" + "<p>a <b" * 3) .startswith("a")
    assert main_text("<!-- open") == "" and main_text("<script>x") == "" and main_text("<") == ""


def test_rows(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None), (2, "v", "", ""), (3, "w", "<article><p>" + "a b " * 200000, "")]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == 5 and by[None].text == "" and by[2].n_chars == 0 and by[3].n_chars == 200000 * 4 - 1
    assert by[1].text == main_text(PAGE) and by[1].n_chars == len(by[1].text)
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_other_languages_without_containers():
    finnish = "Talo seisoi pitkään mäen päällä ja sen asukkaat kertoivat vanhoja tarinoita kaikille, jotka kävivät kylässä. " * 3
    chinese = "这座房子在山上矗立了很久，住在里面的人们向每一位来访的客人讲述古老的故事，" * 4
    for text in (finnish, chinese):
        page = f"<body><div><a href=1>yksi</a> <a href=2>kaksi</a></div><p>{text}</p><p>Niin.</p><p>{text}</p><div><a href=x>{text}</a></div><footer>{text}</footer></body>"
        assert main_text(page).split("\n") == [text.strip(), "Niin.", text.strip()]


STORY = "The story of the town and its people is told here in full, with all that was said of it at that time. "


@pytest.mark.parametrize("name", ["content has-sidebar", "no-sidebar", "single related-posts-off", "social-media-report", "page", "sidebar", "related"])
@pytest.mark.parametrize("inner", ["article", "main", "div"])
def test_names_around_the_article_say_nothing_of_it(name, inner):
    page = f'<body><div class="ad">Buy this.</div><div class="{name}"><{inner}><p>{STORY * 3}</p></{inner}></div><div class="site-footer">{STORY}</div></body>'
    assert main_text(page) == (STORY * 3).strip()


def test_names_inside_the_page_do():
    marks = ["site-footer", "sidebar", "cookie-banner", "related-posts", "comment-list", "share_buttons", "post-comments"]
    page = f"<article><h1>Head</h1><p>{STORY}</p>" + "".join(f'<div class="{m}">{STORY[:75]}</div>' for m in marks) + "</article>"
    page += f'<div id="comments"><article class="comment"><p>{STORY * 9}</p></article></div>'
    assert main_text(page) == "Head\n" + STORY.strip()


def test_unclosed_elements_take_linear_time():
    begun = time.process_time()
    assert main_text("<article>" + "<li>x</b>" * 100_000).count("x") == 100_000
    assert time.process_time() - begun < 20
