import time

import pytest

from verivane.llm import html_extract as h

STORY = "The council said on Monday that it will not build the road, and that the money is to go to the schools of the town. It was a long debate, with many who spoke for it and some against, and in the end the vote was close."


def test_article_with_everything_around_it():
    page = f"""<html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
    <header><h2>The Daily</h2></header><nav><ul><li><a href="/a">The news of the day</a></li></ul></nav>
    <div class="cookie-notice">We use cookies for all that you do on this site and you agree to it.</div><!-- an <p>ad</p> -->
    <article class="post"><h1>Road &amp; school</h1><p>{STORY}</p><div class="ad">Buy the best of the cars that you can get here.</div>
    <p>So.</p><ul><li>One&nbsp;item</li></ul><form><p>Write to us with all that you have to say.</p></form>
    <section id="comments"><h3>Comments</h3><p>I am of the view that it is a good thing for all of us.</p></section></article>
    <aside class="sidebar"><p>{STORY}</p></aside><footer>&copy; The Daily</footer></body></html>"""
    assert h.main_text(page) == f"Road & school {STORY} So. One item"


def test_page_without_marks():
    page = f"<body><div><a href=x>Home</a> <a href=y>About</a></div><div><p>{STORY}</p><p>A short one.</p><p>{STORY}</p></div><div><a href=z>Next</a></div></body>"
    assert h.main_text(page) == f"{STORY} A short one. {STORY}"


def test_a_short_page_keeps_its_words():
    assert h.main_text("<p>Hello there</p>") == "Hello there"
    assert h.main_text("plain &lt;text&gt;\n of  two lines") == "plain <text> of two lines"


@pytest.mark.parametrize("page", [None, "", "<", "<p", "<!-- ", "<script>x", "</div></p>", "<a href='x", '<p title="a>b', "&#0;" * 3])
def test_broken_markup(page):
    h.main_text(page)


def test_long_pages_take_linear_time():
    assert len(h.main_text("<article>" + f"<p>{STORY}</p>" * 3000)) == 3000 * (len(STORY) + 1) - 1
    h.main_text('<p x="' * 50000)


def test_table_with_other_columns(spark):
    df = spark.createDataFrame([(1, "u", "<p>Hello there</p>", "x", 5), (2, None, None, None, None), (1, "u", "<p>Hello there</p>", "x", 5)], "page_id long, url string, html string, text string, extra int")
    got = sorted(map(repr, (tuple(r) for r in h.extract(df).select("page_id", "url", "extra", "text", "n_chars").collect())))
    assert got == sorted(map(repr, [(1, "u", 5, "Hello there", 11), (1, "u", 5, "Hello there", 11), (2, None, None, "", 0)]))
    assert h.extract(df.where("false")).collect() == []


def test_given_pages(spark, small):
    import html
    import re

    for page_id, page in small("pages").select("page_id", "html").collect():
        article = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
        assert h.main_text(page) == " ".join(html.unescape(re.sub("<[^>]*>", " ", article)).split()), page_id


@pytest.mark.parametrize("before", ["<svg class=i viewBox='0 0 1 1'/>", "<math/>", "<button>Menu", "<select><option>One", "<video-player>", "<button-group>", "<svg><path d=z>", "<button>A<button>B</button>", "<svg><svg></svg>icon</svg>"])
def test_elements_without_an_end_tag_hide_no_article(before):
    page = f"<body><div>{before}</div><p>{STORY}</p><p>{STORY}</p><div><button>x</button></div></body>"
    assert h.main_text(page).endswith(f"{STORY} {STORY}") and "icon" not in h.main_text(page) and "Menu" not in h.main_text(page)


def test_skipped_elements_take_linear_time():
    assert h.main_text("<button><p>" * 50000 + STORY) == STORY


def test_a_language_without_known_stop_words():
    story = "Rada miasta ogłosiła wczoraj, że nowa droga nie zostanie zbudowana, ponieważ pieniądze są potrzebne szkołom. Debata trwała bardzo długo i zakończyła się niewielką przewagą głosów."
    assert h.main_text(f"<body><div><a href=x>Strona</a></div><p>{story}</p><p>{story}</p></body>") == f"{story} {story}"


@pytest.fixture(scope="module")
def pages():
    import pyarrow.parquet as pq

    return pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist()


def unwrapped(page):
    import re

    return re.sub("</?(article|main)[^>]*>", "", page)


def test_most_pages_give_the_same_without_their_article_tag(pages):
    same = [h.main_text(p) == h.main_text(unwrapped(p)) for p in pages]
    assert sum(same) >= 0.95 * len(same)


def test_stop_words_part_prose_from_lists(monkeypatch):
    listing = "Kettle 20 | Toaster 35 | Blender 48 | Mixer 90 | Lamp 12 | Chair 55 | Table 120 | Shelf 75"
    page = f"<body><h1>Road</h1><p>{STORY}</p><p>{STORY}</p><div><p>{listing}</p></div></body>"
    assert h.main_text(page) == f"Road {STORY} {STORY}"
    inside = f"<body><article><h1>Road</h1><p>{STORY}</p><p>{listing}</p><p>{STORY}</p></article></body>"
    assert h.main_text(inside) == f"Road {STORY} {listing} {STORY}"
    monkeypatch.setattr(h, "STOP_WORDS", frozenset())
    assert h.main_text(page) == f"Road {STORY} {STORY} {listing}"


def test_neighbours_decide_short_blocks():
    page = f"<body><div><p>By the way</p><p><a href=x>All the other news of the day</a></p></div><div><h2>Schools</h2><p>{STORY}</p><p>So it is.</p><p>{STORY}</p></div></body>"
    assert h.main_text(page) == f"Schools {STORY} So it is. {STORY}"


@pytest.mark.parametrize("tag", ["article class='post with-sidebar'", "div class='has-sidebar'", "div class='sidebar-layout'", "div id=newsletter-page", "form id=aspnetForm"])
def test_a_wrapper_erases_nothing(tag):
    end = tag.split()[0]
    page = f"<body><{tag}><h1>Road</h1><p>{STORY}</p><p>Short.</p><div class=sidebar><p>{STORY[:120]}</p></div></{end}><footer>The end of it</footer></body>"
    assert h.main_text(page) == f"Road {STORY} Short."


def test_a_teaser_is_not_the_body():
    page = f"<body><div><h1>Road</h1><p>{STORY}</p><p>{STORY}</p></div><article class=teaser><h2>More</h2><p>{STORY[:90]}</p></article></body>"
    assert h.main_text(page) == f"Road {STORY} {STORY}"


def test_comments_longer_than_the_article_go():
    page = f"<body><article><h1>Road</h1><p>{STORY}</p><div class=comments><article>" + f"<p>{STORY}</p>" * 6 + "</article></div></article></body>"
    assert h.main_text(page) == f"Road {STORY}"


@pytest.mark.parametrize("n", [100, 9000, 100_000])
def test_attributes_of_any_length(n):
    assert h.main_text(f'<p data-x="{"a" * n}>LEAK">Hello there') == "Hello there"


def test_odd_quotes_take_linear_time():
    for page in ("<a '\" >" * 60000, "<a x='\" >" * 60000, "<p x=\"" * 60000, "<a x=" * 60000, "<a = = =" * 40000):
        h.main_text(page)
    h.main_text("<div>" * 60000 + STORY + "</p></span>" * 60000)


@pytest.mark.parametrize("name", ["post category-notices", "tag-advertising", "category-search", "post comments-open", "post-share", "legal-news"])
def test_an_article_is_not_erased_by_its_subject(name):
    prose = " ".join([STORY] * 4)
    page = f"<body><header><h1>The Daily</h1></header><nav><a href=x>Home</a></nav><article class='{name}'><h2>Road</h2><p>{prose}</p><p>So it is.</p></article><footer>The end of it</footer></body>"
    assert h.main_text(page) == f"Road {prose} So it is."


def test_a_comment_in_an_article_of_its_own_goes():
    page = f"<body><article class=post><h1>Road</h1><p>{STORY}</p></article><article class='comment even'><p>{STORY} {STORY}</p></article></body>"
    assert h.main_text(page) == f"Road {STORY}"


def test_unmatched_end_tags_take_linear_time():
    start = time.perf_counter()
    h.main_text("<div>" * 20000 + "</p></span></ul>" * 80000)
    h.main_text("<div><ul>" * 20000 + "</ul></li></table>" * 20000 + STORY)
    assert time.perf_counter() - start < 8
