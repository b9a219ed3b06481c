"""Main text: the pages' articles, and pages of other kinds."""

import html as entities
import re

from panelspark.llm import html
from tests.llm.helpers import empty, rows_of

PROSE = "The quick brown fox is one of the animals that are in this story, and it was not the only one of them. "


def test_pages(spark):
    def article(page):
        inside = re.search("<article>(.*?)(?:</article>|<footer>|$)", page, re.S)[1]
        parts = (" ".join(entities.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", inside))
        return "\n".join(p for p in parts if p)

    folder = "/root/testdata/sf0.01"
    frame = spark.read.parquet(f"{folder}/pages.parquet")
    pages = {r["page_id"]: r["html"] for r in frame.collect()}
    got = html.extract(frame).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r["text"] == article(pages[r["page_id"]])
        assert r["n_chars"] == len(r["text"])


def test_a_page_without_an_article_element():
    page = f"""<html><head><title>no text</title></head><body>
    <div class="site-header"><a href="/">Home</a></div>
    <div id="topMenu"><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></div>
    <div class="content"><h2>A heading</h2><p>{PROSE}</p><p>Short one.</p><p>{PROSE}<br>{PROSE}</p>
    <div class="ad">{PROSE}</div><script>document.write("<p>no</p>")</script>
    <form><p>{PROSE}</p><input value="x"></form></div>
    <div class="cookie-notice"><p>{PROSE}</p></div>
    <div class="related"><a href="/c">{PROSE}</a></div>
    <section id="comments"><p>{PROSE}</p></section>
    <div>Copyright 2020</div><aside><p>{PROSE}</p></aside></body></html>"""
    prose = PROSE.strip()
    assert html.main_text(page).split("\n")[:4] == ["A heading", prose, "Short one.", f"{prose} {prose}"]
    assert html.main_text(page).count("quick") == 3


def test_an_article_with_things_inside():
    page = f"""<body class="with-sidebar"><header><h1>The site</h1></header><div class="page sidebar-left"><article>
    <header><h1>The headline</h1><p>By somebody</p></header><p>One.</p><div class="ad"><p>{PROSE}</p></div><p>Two &amp; &eacute;&nbsp;three.</p>
    <ul class="share"><li>Share</li></ul><p>{PROSE}</p><p><a href="/x">Read more about it here</a></p>
    <footer>Filed under things</footer></article></div><footer><p>{PROSE}</p></footer>"""
    assert html.main_text(page) == f"The headline\nOne.\nTwo & é three.\n{PROSE.strip()}"


def test_markup_that_is_broken():
    assert html.main_text("<article><p>a < b and <b>c</b> > d <p title='x>y'>next") == "a < b and c > d\nnext"
    assert html.main_text("<article><p>one<!-- two <p>three --><p>four<!-- five") == "one\nfour"
    assert html.main_text("<article><script>var a = '<p>no</p>'") == ""
    assert html.main_text("<article><p a=\"b>c\" d=e'f>text") == "text"
    assert html.main_text("<article>" + "<div>" * 3000 + "deep") == "deep"
    assert html.main_text("<p " + "a=\"" * 3000) == ""


def test_odd_rows(spark):
    schema = "page_id long, url string, html string"
    rows = [(1, None, None), (2, "u", ""), (3, "u", "no markup"), (None, "u", "<article>x</article>"), (4, "u", "<article>y</article>"), (4, "u", "<article>y</article>")]
    frame = spark.createDataFrame(rows, schema).selectExpr("*", "1 AS text", "2 AS n_chars")
    got = sorted(map(tuple, html.extract(frame).collect()), key=str)
    assert got == sorted([(1, None, "", 0), (2, "u", "", 0), (3, "u", "", 0), (None, "u", "x", 1), (4, "u", "y", 1), (4, "u", "y", 1)], key=str)
    assert html.extract(empty(spark, schema)).count() == 0
    long = "<article>" + f"<p>{PROSE}</p>" * 5000
    assert html.main_text(long).count("\n") == 4999


def test_unmarked_pages_in_other_languages():
    texts = {
        "sv": "Det var en gång en gammal fiskare som bodde vid havet och som varje morgon rodde ut för att lägga sina nät, men den dagen kom han inte hem till middagen.",
        "pl": "Stary rybak mieszkał nad morzem i każdego ranka wypływał łodzią, żeby zarzucić sieci, ale tego dnia nie wrócił do domu na obiad, który czekał na stole.",
        "ru": "Старый рыбак жил у моря и каждое утро выходил на лодке, чтобы забросить сети, но в тот день он не вернулся домой к обеду, который ждал его на столе.",
        "fi": "Vanha kalastaja asui meren rannalla ja souti joka aamu ulapalle laskemaan verkkonsa, mutta sinä päivänä hän palannut kotiin vasta myöhään illalla väsyneenä.",
        "zh": "从前有一位老渔夫住在海边，每天早晨他都划着小船出海撒网，可是那一天他没有回家吃午饭，家里的人一直等到天黑，才看见他的小船慢慢靠近岸边。",
    }
    for text in texts.values():
        page = f"""<body><div id="nav"><a href="/">x</a></div><div class="content"><h2>{text[:9]}</h2><p>{text}</p><p>{text[:20]}</p>
        <p>{text}</p></div><div><a href="/a">{text}</a> <a href="/b">{text}</a></div><div class="cookie"><p>{text}</p></div></body>"""
        assert html.main_text(page) == f"{text[:9].strip()}\n{text}\n{text[:20].strip()}\n{text}"
    # Where a language has a list, a long row of names is no running text.
    tags = "Zork Quimby Plugh Xyzzy " * 8
    page = f"<body><div><p>{PROSE * 3}</p><p>{PROSE * 2}</p></div><div>{tags}</div></body>"
    assert "Zork" not in html.main_text(page) and html.main_text(page).count("quick") == 5


def test_links_are_measured_as_they_are_read():
    linked = "".join(f"&#{ord(c)};" for c in "a fifth of it all")
    text = f"<p>This paragraph has a link to <a href='/x'>{linked}</a> and goes on for a while after it, as they do.</p>"
    page = f"<article><p>{PROSE}</p>{text}<p><a href='/y'>   Read   more\n  </a> here</p><p>{PROSE}</p></article>"
    got = html.main_text(page).split("\n")
    assert got == [PROSE.strip(), "This paragraph has a link to a fifth of it all and goes on for a while after it, as they do.", PROSE.strip()]


def test_comments_written_as_articles():
    text = PROSE.strip()
    comment = f"<article class='comment'><p>{PROSE} I think so too.</p></article>"
    for comments in (
        f"<section id='comments'><article><p>{PROSE} No!</p></article></section>",
        f"<div class='comment-list'>{comment}</div>",
        f"<ol class='commentlist'><li id='comment-7'><article><p>{PROSE} No!</p></article></li></ol>",
        f"<div id='disqus_thread'><article><p>{PROSE} No!</p></article></div>",
        comment,
    ):
        assert html.main_text(f"<body><article><p>{PROSE}</p></article>{comments}</body>") == text
        assert html.main_text(f"<body><article><p>{PROSE}</p>{comments}</article></body>") == text
    # A page that takes comments is no comment.
    page = f"<body class='single comments-open'><div class='post has-comments'><article><p>{PROSE}</p></article></div></body>"
    assert html.main_text(page) == text


def test_names_of_sections_inside_an_article():
    text = PROSE.strip()
    parts = "".join(
        f"<{tag}><p>{PROSE}</p></{tag.split()[0]}>"
        for tag in ("section id='related-work'", "div id='search-algorithms'", "section class='copyright-law'", "div class='comment-policy-history'")
    )
    page = f"<article>{parts}<p class='alert'>{PROSE}</p><div class='related-posts'><p>{PROSE}</p></div><p class='ad'>{PROSE}</p><div class='share'>{PROSE}</div></article>"
    assert html.main_text(page) == "\n".join([text] * 5)
    # A section's name decides by the whole of it on an unmarked page, too.
    page = f"<body><section id='related-work'><p>{PROSE}{PROSE}</p></section><section class='related-posts'><p>{PROSE}</p></section></body>"
    assert html.main_text(page) == f"{text} {text}"


def test_formulas_and_fallbacks_are_text():
    page = f"<article><p>{PROSE}<math><mi>E</mi><mo>=</mo><mi>m</mi><annotation encoding='tex'>E=m</annotation></math> holds.</p><object data='x'><p>{PROSE}</p></object></article>"
    assert html.main_text(page) == f"{PROSE.strip()} E=m holds.\n{PROSE.strip()}"


def test_an_article_in_the_main_part():
    text = PROSE.strip()
    page = f"<main><h1>The headline</h1><article><p>{PROSE}</p><p>{PROSE}</p></article><div class='teasers'><h2>Next</h2><p>{PROSE}</p></div></main>"
    assert html.main_text(page) == f"The headline\n{text}\n{text}"
    # A card beside the text is not the text.
    page = f"<main><p>{PROSE * 2}</p><p>{PROSE * 3}</p><article><p>{PROSE}</p></article></main>"
    assert html.main_text(page).count("quick") >= 5
