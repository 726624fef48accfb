import html as lib
import re
import time

import pytest

from kerbline.llm.html import extract
from kerbline.llm.queries import QUERIES


def article(page):
    """What stands in the article of the test pages, block by block."""
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1].replace("<br>", " ")
    blocks = (" ".join(lib.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?p>|</?h1>", inner))
    return "\n".join(b for b in blocks if b)


def test_whole_table(spark, sf):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = QUERIES["op5_html"](spark, sf).collect()
    assert len(got) == len(pages)
    assert all(r["text"] == article(pages[r["page_id"]]) and r["n_chars"] == len(r["text"]) for r in got)


LONG = "This paragraph is long enough to be a surge of text on its own, as the main text of a page usually is."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("<nav>only a menu</nav>", ""),
        (f"<p>{LONG}</p>", LONG),
        (f"<ul class='menu'><li>Home</li></ul><div id=content><p>{LONG}</p><p>Short.</p></div><div class='page-footer'>(c) someone</div>", f"{LONG}\nShort."),
        (f"<header>Site</header><article><header><h1>T &amp; U</h1></header><p>a<b>b</b>\n c&nbsp;d</p><aside>more</aside><p>e</p><footer>by me</footer></article><section id='comments'><p>{LONG}</p></section>", "T & U\nab c d\ne"),
        (f"<main><p>x<!-- <p>no</p> --><script>var a='</p>'</script>y<style>p{{}}</style></p><form>name <input></form><p>z</main><p>{LONG}", "xy\nz".replace("xy", "x y")),
        (f"<div role=navigation>{LONG}</div><article><p>one &lt;tag&gt; &amp;amp; &#233;&eacute</p></article><div class=ad-banner>{LONG}</div>", "one <tag> &amp; éé"),
        (f"<article><p>kept</p><div class=cookie-notice><p>{LONG}</p></div><p>kept too</p><div class=comments><article>no</article></div></article>", "kept\nkept too"),
        ("<article><p>cut of", "cut of"),
        ("<article><p>cut in a tag <a hre", "cut in a tag"),
        ("<script>never closed <p>x</p>", ""),
        ("a < b and c > d", "a < b and c > d"),
    ],
)
def test_cases(page, want):
    assert extract(page) == want


def test_links_and_distance_decide_without_an_article():
    menu = "".join(f"<li><a href=/{i}>a long menu entry number {i}</a></li>" for i in range(20))
    page = f"<ul>{menu}</ul><div><p>{LONG}</p><p>{LONG}</p></div><ul>{menu}</ul><p>tail</p>"
    assert extract(page) == f"{LONG}\n{LONG}"


def test_long_page_is_linear():
    page = "<article>" + "<p>words and <b>more" * 60_000
    assert extract(page).count("\n") == 59_999


def test_sums_decide_beside_an_article():
    body = "".join(f"<p>{LONG} {i}</p>" for i in range(4))
    text = "\n".join(f"{LONG} {i}" for i in range(4))
    # a teaser card doesn't take the place of the body
    assert extract(f"<article><h3>Read on</h3></article><div>{body}</div>") == text
    assert extract(f"<div>{body}</div><article><h3>Read on</h3></article>") == text
    # a short note outside doesn't surge beside the article, as much text as the article's does
    assert extract(f"<div>{LONG}</div><article>{body}</article>") == text
    assert extract(f"<article>{body}</article><div>{body}</div>") == f"{text}\n{text}"
    # in an article, too, what stands far off and doesn't surge is left out
    gap = "<aside>a</aside>" * 4
    assert extract(f"<article>{body}{gap}<p>tail</p></article>") == text


@pytest.mark.parametrize("attrs", ['style="overflow:hidden"', 'title="A hidden story"', "data-id='menu'", 'data-class="ad"', 'alt="x id=menu y"', "data-role=search", "aria-hidden=false", 'data-x="it\'s hidden"'])
def test_only_whole_attribute_names_mark_boilerplate(attrs):
    assert extract(f"<div {attrs}><p>{LONG}</p></div>") == LONG


@pytest.mark.parametrize("attrs", ["hidden", "HIDDEN=''", 'title="x" hidden', "id = menu", "data-a=1 class='a ad b'", 'role="search"', "aria-hidden=true"])
def test_attributes_that_mark_boilerplate(attrs):
    assert extract(f"<div {attrs}><p>{LONG}</p></div><p>{LONG} 2</p>") == f"{LONG} 2"


def test_main_by_a_whole_attribute():
    assert extract(f"<div data-role=\"main\"><p>a</p></div><p>{LONG}</p>") == f"a\n{LONG}"
    assert extract(f"<div role='main'><p>a</p></div><p>{LONG}</p>") == "a"


def test_names_on_wrappers_and_headers():
    body = f"<p>{LONG}</p><p>{LONG} 2</p>"
    text = f"{LONG}\n{LONG} 2"
    for wrapper in ("content-sidebar-wrap", "with-sidebar", "page has-banner", "sidebar", "layout search"):
        assert extract(f'<div class="{wrapper}">{body}</div>') == text
        assert extract(f'<div class="{wrapper}"><article>{body}</article></div>') == text
    assert extract(f'<article><div class="entry-header"><h1>Title</h1></div>{body}</article>') == f"Title\n{text}"
    assert extract(f'<article><p>{LONG}</p><p class="legal-case">Smith v Jones</p><p>{LONG} 2</p></article>') == f"{LONG}\nSmith v Jones\n{LONG} 2"
    for name in ("comments-area", "commentList", "page-footer", "sidebar-content", "related posts", "newsletter", "SHARE"):
        assert extract(f"<div>{body}</div><div class='{name}'><p>{LONG} 3</p></div>") == text
    # comments are never a wrapper, however long they are
    assert extract(f"<div>{body}</div><div id=comments>{body * 5}</div>") == text


def test_references_are_decoded_between_tags():
    assert extract("<p>&<b>amp;</b> and &am<!-- -->p; but &amp;lt;</p>") == "&amp; and &amp; but &lt;".replace("&amp; and &amp;", "&amp; and &am" + "p;")
    assert extract("<article><p>x <math><mi>y</mi></math> <object>z</object></p></article>") == "x y z"


@pytest.mark.parametrize("page", ["<a " * 100_000, "<b>" * 100_000 + "</i>" * 100_000, "<p title=\"" * 100_000, "<" * 100_000, "<a '\">" * 50_000, "</p" * 100_000, "<!--" * 100_000, "<div class=menu>" * 50_000, "&" * 100_000, "<li>" * 100_000, '<a ">"' * 100_000, "<p x='>' \">\"" * 50_000, '<a x=">"y' * 100_000])
def test_bad_markup_takes_linear_time(page):
    began = time.perf_counter()
    extract(page)
    assert time.perf_counter() - began < 5


def test_window_and_surge_decide():
    page = "<div><p>Short one here.</p><p>Another short one.</p></div><hr><nav>n</nav><nav>n</nav><nav>n</nav>" + f"<div><p>{LONG}</p></div>" + "<nav>n</nav>" * 3 + f"<article><p>{LONG} 2</p></article>"
    assert len({extract(page, window, surge) for window, surge in ((3, 80), (9, 20), (3, 10**9))}) > 1
