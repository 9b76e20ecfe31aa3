import html
import random
import re
import time

import pyarrow.parquet as pq
import pytest

from tidemark.llm.extract import extract, main_text

LONG = "The cat sat on the mat and it was of the opinion that the house is for all. " * 4


def test_articles_of_the_sample_pages():
    for page in pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"]).column(0).to_pylist():
        inner = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
        assert main_text(page) == " ".join(html.unescape(re.sub(r"<[^>]*(>|$)", " ", inner)).split())


def test_boilerplate_goes():
    page = f"""<html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body><header><h1>Site</h1></header><nav><a href=/>Home</a></nav>
    <div id="cookie-notice">We use cookies on this site and on the others that we have for all of you.</div>
    <div class="content"><h2>A title</h2><p>{LONG}</p><p>Short&nbsp;one &amp; two.</p><form><p>{LONG}</p></form><p>{LONG}</p></div>
    <aside><p>{LONG}</p></aside><section class="comments"><p>{LONG}</p></section><div style="display:none">{LONG}</div><footer>&copy; 2020</footer>"""
    assert main_text(page) == " ".join(["A title", LONG.strip(), "Short one & two.", LONG.strip()])


def test_short_blocks_follow_their_neighbours():
    links = "<ul>" + "".join(f"<li><a href=/{i}>Some link text {i}</a></li>" for i in range(9)) + "</ul>"
    page = f"<body>{links}<p>By us.</p>{links}<p>{LONG}</p><p>Tiny.</p><p>{LONG}</p>{links}"
    assert main_text(page) == f"{LONG.strip()} Tiny. {LONG.strip()}"


def test_unclosed_and_cut_off_markup():
    assert main_text(f"<article><p>{LONG}<p>And so on") == f"{LONG.strip()} And so on"
    assert main_text(f"<article><p>{LONG}</p><!-- cut") == LONG.strip()
    assert main_text("<div <p>") == ""


def page_of(*blocks):
    return "<body><nav><a href=/>Home</a></nav>" + "".join(blocks) + "<footer>end</footer>"


@pytest.mark.parametrize("wrapper", ["content has-sidebar", "layout no-comments", "with-menu", "page article-share", "site tag", "post header"])
def test_a_container_of_the_text_is_no_boilerplate(wrapper):
    assert main_text(page_of(f'<div class="{wrapper}"><p>{LONG}</p><p>{LONG}</p></div>')) == f"{LONG.strip()} {LONG.strip()}"
    assert main_text(page_of(f'<div class="{wrapper}"><article><p>{LONG}</p></article></div><p>{LONG}</p>')) == LONG.strip()


def test_marked_elements_beside_the_text_go():
    for mark in ("share-buttons", "post-comments", "ad", "side-bar", "related", "cookie-notice"):
        assert main_text(page_of(f"<p>{LONG}</p><p>{LONG}</p>", f'<div class="{mark}"><p>{LONG}</p></div>')) == f"{LONG.strip()} {LONG.strip()}"
    # reader comments may be longer than the text
    assert main_text(page_of(f"<p>{LONG}</p>", f'<section id=comments><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></section>')) == LONG.strip()


def test_attributes_as_browsers_read_them():
    assert main_text(page_of(f"<p title=don't>{LONG}</p><p data-x='a>b' class=\"x\">{LONG}</p><p title=it's id=y>{LONG}")) == " ".join([LONG.strip()] * 3)
    assert main_text(page_of(f'<p title="never closed>{LONG}</p>')) == LONG.strip()
    assert main_text(page_of(f"<p =x a = b c>{LONG}</p>")) == LONG.strip()


def test_other_languages_by_length_and_links():
    for text in ("Это длинный абзац о том, как люди жили в городе и что они делали каждый день. " * 4, "这是一个很长的段落讲述人们在城市里如何生活以及他们每天都在做什么事情。" * 8, "Dit is nogal wat tekst over mensen die samen iets moois bouwden zonder veel geld. " * 4):
        page = page_of("<ul>" + "<li><a href=/>Link</a></li>" * 9 + "</ul>", f"<p>{text}</p><p>{text}</p>")
        assert main_text(page) == f"{text.strip()} {text.strip()}"


def test_code_and_long_links_between_paragraphs_stay():
    code = "x = f(y); " * 40
    linked = LONG + "<a href=/>" + LONG[: len(LONG) // 2] + "</a>"
    plain = re.sub("<[^>]*>", "", linked).strip()
    assert main_text(page_of(f"<p>{LONG}</p><pre>{code}</pre><p>{LONG}</p>")) == f"{LONG.strip()} {code.strip()} {LONG.strip()}"
    assert main_text(page_of(f"<p>{LONG}</p><p>{linked}</p><p>{LONG}</p>")) == " ".join(f"{LONG.strip()} {plain} {LONG.strip()}".split())


def test_time_is_linear():
    began = time.perf_counter()
    assert main_text("<div class=x>" * 8000 + f"<p>{LONG}</p>") == LONG.strip()
    assert main_text("<div class=share>" * 8000 + f"<p>{LONG}</p>") == LONG.strip()
    main_text("<p title='" * 20000)
    main_text("<a href=x " * 20000)
    main_text("<!-- " * 20000)
    assert time.perf_counter() - began < 5


def test_random_pages_against_a_parser(spark):
    """Articles and boilerplate of known places, their text read by the library's own parser."""
    rng = random.Random(1)
    pages, wanted = [], []
    for _ in range(150):
        kept, out = [], []
        for _ in range(rng.randrange(1, 6)):
            words = " ".join(rng.choice(["the", "of", "and", "to", "was", "river", "stone", "&amp;", "caf&eacute;", "<b>bold</b>", "<i>so</i>,", "in", "it"]) for _ in range(80))
            kept.append(words)
            out.append(f"<p{rng.choice(['', ' class=text', ' data-a=\"x>y\"'])}>\n {words}{rng.choice(['</p>', ''])}")
        for mark in rng.sample(["<nav><a href=/>x y</a></nav>", "<div class='ad'>Buy the things of the day and be of good cheer.</div>", "<script>if (a<b) c('</p>')</script>", "<!-- <p>no</p> -->", "<form><input><p>Name of the user</p></form>"], 2):
            out.insert(rng.choice([0, len(out)]), f"</p>{mark}")
        pages.append("<html><body><header><h1>Site</h1></header>" + "".join(out) + "<footer>f</footer>")
        wanted.append(" ".join(" ".join(html.unescape(re.sub("<[^>]*>", "", w)).split()) for w in kept))
    assert [main_text(p) for p in pages] == wanted
    df = spark.createDataFrame([(i, "u", p, "x", "y") for i, p in enumerate(pages)], "page_id long, url string, html string, text string, n_chars string")
    assert {r["page_id"]: r["text"] for r in extract(df).collect()} == dict(enumerate(wanted))


STORY = " ".join(f"<p>{'This is the text of the article and it is here for the reader to read, as it was written by the author of it. ' * 3}</p>" for _ in range(3))
TOLD = " ".join(["This is the text of the article and it is here for the reader to read, as it was written by the author of it."] * 9)
COMMENT = "<p>I do not agree with what is said here, as it was not so when I was there with the others, and that is all.</p>" * 3


@pytest.mark.parametrize(
    "page",
    [
        "<body><form action='/' id='aspnetForm'><nav><a href='/'>Home</a></nav><div>{}</div></form></body>",
        "<body><form method=post><article>{}</article></form></body>",
        "<body><div class='post hentry comments-open'>{}</div></body>",
        "<body><div class='wrapper footer-sticky'>{}</div></body>",
        "<body><div class='page nav-down'>{}</div></body>",
        "<body><div class='cookie-accepted'><main>{}</main></div></body>",
        "<body><div class='nav-down'><article>{}</article></div></body>",
        "<body><div id='app' class='modal-open'><article>{}</article></div></body>",
        "<body><div class='modal'><article>{}</article></div></body>",
        "<body><article>{}</article><div id='discussion'>" + COMMENT + "</div></body>",
        "<body><div>{}</div><div class='comments'><article class='comment-body'>" + COMMENT + "</article></div></body>",
        "<body><article>{}</article><form class='comment-form'><p>Leave a reply to this article, if you have one for the author.</p><textarea>x</textarea></form></body>",
        "<body><div>{}</div><form class='search'><label>Search this site for what you want to know.</label></form></body>",
    ],
)
def test_states_forms_and_readers(page):
    assert main_text(page.replace("{}", STORY)) == TOLD


def test_discussion_inside_an_article_stays():
    page = f"<article>{STORY}<section id='discussion'>{STORY}</section></article>"
    assert main_text(page) == f"{TOLD} {TOLD}"


def test_a_page_of_short_paragraphs():
    short = [f"Line {i} is short." for i in range(5)]
    for around in ("<div>{}</div>", "<article>{}</article>", "{}"):
        page = "<body><nav><a href='/'>Home</a> <a href='/x'>More</a></nav>" + around.format("".join(f"<p>{x}</p>" for x in short)) + "<footer><p>All rights are reserved.</p></footer></body>"
        assert main_text(page) == " ".join(short)
    assert main_text("<body><div>Menu</div><div>All rights reserved.</div></body>") == ""
