import random
import time

import pytest
from bidloom.llm import html_text

PAGE = """<!DOCTYPE html><html><head><title>x</title><script>var a="</p>";</script><style>p{}</style></head><body>
<header><p>Site, name, and more, words in a header</p></header><nav><ul><li><a href=a>Menu, one</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies, many, many cookies, to track, you, always.</p></div>
<div id=wrap><div class=content><h1>The &amp; title</h1><p>First   paragraph, with <b>bold</b> text, and a <a href=x>link</a>, of some length.<p>Second one,<br>unclosed &eacute;&#233;, with commas, and words.
<ul><li>one, item</li><li>two</li></ul><p>Short.</p></div><aside><p>Related, stuff, here, that is long enough.</p></aside></div>
<form><p>Search, for, something, in, this, form</p></form><div class="comments"><p>Nice post, really, very nice, I agree, with it all, yes.</p></div>
<footer><p>Copyright, someone, 2020, all rights, reserved</p></footer></body></html>"""
WANT = "The & title\nFirst paragraph, with bold text, and a link, of some length.\nSecond one, unclosed éé, with commas, and words.\none, item\ntwo\nShort."


def test_article_is_kept_and_the_rest_left_out():
    assert html_text.main_text(PAGE) == WANT


def test_a_layout_named_after_its_sidebar_is_kept():
    page = "<body><div class='with-sidebar'><article><p>Main text, with commas, and words enough.</p></article><div class=sidebar><p>Side, text, here, and more, of it.</p></div></div></body>"
    assert html_text.main_text(page) == "Main text, with commas, and words enough."
    assert html_text.main_text(page.replace("article>", "section>")) == "Main text, with commas, and words enough."


def test_broken_markup():
    assert html_text.main_text("<p>a, b, c and some words that are long enough, yes</p></div></p><p>tail, cut &am<b") == "a, b, c and some words that are long enough, yes\ntail, cut &am"
    assert html_text.main_text("<article><p>one, two<p>three, four") == "one, two\nthree, four"
    assert html_text.main_text("<!-- only --><script>x</script>") == ""
    deep = "<div>" * 5000 + "<p>deep, text</p>" + "</div>" * 5000
    assert html_text.main_text(deep) == "deep, text"


def test_rows_nulls_repeats_and_empty_table(spark):
    schema = "page_id long, url string, html string, text int"
    got = html_text.extract(spark.createDataFrame([(1, "u", PAGE, 1), (1, "u", PAGE, 1), (2, None, None, 2), (None, "v", "", 3)], schema)).collect()
    assert sorted((r.page_id or -1, r.n_chars) for r in got) == [(-1, 0), (1, len(WANT)), (1, len(WANT)), (2, 0)]
    assert html_text.extract(spark.createDataFrame([], schema)).count() == 0


def test_sample_pages_keep_their_article(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for row in html_text.extract(pages).collect():
        assert row.n_chars == len(row.text) and row.text


def article(inner):
    return f"<html><body><nav><a href=a>Menu, one, two</a></nav><div class=ad>Buy, this, now, please, all of you.</div><article>{inner}</article><footer>Foot, notes</footer></body></html>"


@pytest.mark.parametrize(
    ("inner", "want"),
    [
        ('<p style="overflow: hidden">one, two</p>', "one, two"),
        ('<p title="hidden gems">one, two</p><p>x</p>', "one, two\nx"),
        ('<p data-hidden="false">one, two</p>', "one, two"),
        ('<div class="related-work"><p>one, two, three</p></div><p>x</p>', "one, two, three\nx"),
        ('<p>x</p><div class="tags"><p>all kinds of tags, explained</p></div><section id="search"><p>how to search, and find</p></section>', "x\nall kinds of tags, explained\nhow to search, and find"),
        ("<header><h2>Title</h2></header><p>text, more</p>", "Title\ntext, more"),
        ("<p>before</p><svg><path d='M0 0'><text>drawn</text><p>after, it</p>", "before\nafter, it"),
        ("<p>before</p><svg><text>drawn</text></svg><p>after, it</p>", "before\nafter, it"),
        ("<p>with <select><option>x<option>y</select>choice</p><p>end</p>", "with choice\nend"),
        ("<p>the sum <math><mi>a</mi><mo>+</mo><mi>b</mi></math> is c, so</p>", "the sum a+b is c, so"),
        ("<p>a, b</p><object><p>instead, of it</p></object><canvas>fallback, text</canvas>", "a, b\ninstead, of it\nfallback, text"),
        ('<p>a, b</p><p aria-hidden="true">unseen</p><p hidden>unseen</p><p style="display: none">unseen</p>', "a, b"),
        ('<p>a, b</p><div class="ad">buy</div><div class="comments"><article><p>nice, one</p></article></div><aside>side</aside><div class="tags"><a href=x>tag</a></div>', "a, b"),
        ("<section>" + "<p>long, text, of, many, words and more of it</p>" * 10 + "</section>loose <b>text</b><section><p>short</p></section>", "\n".join(["long, text, of, many, words and more of it"] * 10) + "\nloose text\nshort"),
        ("<p>a, b<noscript>c, d", "a, bc, d"),
        ("<p>tiny</p>", "tiny"),
        ("", ""),
    ],
)
def test_article_text_is_kept_whole(inner, want):
    assert html_text.main_text(article(inner)) == want


def test_generated_pages_whose_article_is_known():
    draw = random.Random(3)
    words = "alpha, beta gamma delta, epsilon zeta eta".split()

    def text(k):
        return " ".join(draw.choices(words, k=k))

    def junk():
        return draw.choice(
            [
                lambda: f"<nav><ul><li><a href=x>{text(3)}</a></ul></nav>",
                lambda: f"<div class='{draw.choice(['ad', 'sidebar', 'cookie-notice', 'comments', 'newsletter widget'])}'><p>{text(20)}</p></div>",
                lambda: f"<form><label>{text(3)}</label><input><button>{text(1)}</button></form>",
                lambda: f"<script>if (a < b) {{ '</p>' }}</script><style>p {{}}</style><!-- {text(4)} -->",
                lambda: f"<div role=navigation>{text(4)}</div><aside><p>{text(20)}</p></aside>",
            ]
        )()

    def block():
        kind, t = draw.randrange(6), text(draw.randrange(1, 40))
        if kind == 0:
            return f"<h2>{t}</h2>", [t]
        if kind == 1:
            parts = [text(draw.randrange(1, 9)) for _ in range(3)]
            return "<ul>" + "".join(f"<li>{p}" + draw.choice(["", "</li>"]) for p in parts) + "</ul>", parts
        if kind == 2:
            return f"<p>{t} &amp; <b>{t}</b>&nbsp;&#233;<br>{t}" + draw.choice(["", "</p>"]), [f"{t} & {t} é {t}"]
        if kind == 3:
            return f"<table><tr><td>{t}</td><td> {t}  </table>", [t, t]
        if kind == 4:
            inner, want = block()
            return f"<div class='{draw.choice(['box', 'related-work', 'tags', 'text'])}'>{inner}</div>", want
        return f"<blockquote>{t}</blockquote>{junk()}", [t]

    for _ in range(300):
        blocks = [block() for _ in range(draw.randrange(1, 12))]
        tag = draw.choice(["article", "main"])
        page = f"<!DOCTYPE html><html><head><title>{text(3)}</title></head><body>{junk()}{junk()}<{tag}>{''.join(b for b, _ in blocks)}</{tag}>{junk()}<footer>{text(9)}</footer></body></html>"
        assert html_text.main_text(page) == "\n".join(w for _, want in blocks for w in want), page


def test_time_is_linear_in_broken_pages():
    for page in ("<b>" * 20000 + "</i>" * 20000, "<b>" * 20000 + "<td>x</td>" * 5000, "<iframe>" * 20000 + "<p>a</p>", "<p>" * 30000, "<svg>" * 20000 + "<p>x"):
        began = time.perf_counter()
        html_text.main_text(page)
        assert time.perf_counter() - began < 20


def test_sibling_articles_are_kept_and_teasers_are_not():
    prose = lambda w: "<p>" + ", ".join(f"{w} speaks of many things in long sentences {i}" for i in range(9)) + ".</p>"
    page = f"<body><div><article>{prose('ONE')}</article><article>{prose('TWO')}</article><article><p>SHORT</p></article><article><a href='#'>{prose('LINK')}</a></article></div><article class='comment'>{prose('REPLY')}</article></body>"
    text = html_text.main_text(page)
    assert "ONE" in text and "TWO" in text and text.index("ONE") < text.index("TWO")
    assert not any(w in text for w in ("SHORT", "LINK", "REPLY"))
