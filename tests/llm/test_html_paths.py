"""Extraction by tag-path ratios: scores against a plain form, what they decide, hostile pages."""

import math
import random
import time

import pytest

from veristrata.llm import html_text

TEXT = "This is a paragraph of the article, with marks. It says more, and more; then it ends."
MENU = "<div class='x1'><ul><li><a href=a>One</a></li><li><a href=b>Two</a></li><li><a href=c>Three</a></li></ul></div>"


def plain_scores(nodes):
    """nodes: (path as a string, text, in a link)."""
    whole = max(1, sum(len(t) for _, t, link in nodes if not link))
    fused = []
    for path, _, _ in nodes:
        mine = [(t, link) for p, t, link in nodes if p == path]
        length = sum(len(t) for t, link in mine if not link)
        marks = sum(sum(c in ".,;:!?。、，！？…" for c in t) for t, link in mine if not link)
        fused.append(math.sqrt(length / len(mine) * (1 + marks / len(mine)) * length / whole))
    smooth = [0.25 * fused[max(0, k - 1)] + 0.5 * fused[k] + 0.25 * fused[min(len(fused) - 1, k + 1)] for k in range(len(fused))]
    return [sum(s for s, n in zip(smooth, nodes, strict=True) if n[0] == path) / sum(n[0] == path for n in nodes) for path, _, _ in nodes]


def test_scores_against_a_plain_form():
    r = random.Random(3)
    for _ in range(30):
        nodes = [(r.choice("abc"), "".join(r.choice("xy.,") for _ in range(r.randint(1, 40))), r.random() < 0.2) for _ in range(r.randint(1, 20))]
        got = html_text.path_ratios([ord(p) for p, _, _ in nodes], [0 if link else len(t) for _, t, link in nodes], [0 if link else sum(c in ".,;:!?" for c in t) for _, t, link in nodes])
        assert got == pytest.approx(plain_scores(nodes))


def test_scores_decide(monkeypatch):
    soup = f"<body>{MENU}<div class='x2'><p>{TEXT}</p><p>{TEXT}</p></div><div class='x3'>Made by us.</div></body>"
    article = f"<body><div class='ad'>Buy this now, please.</div><article><h1>Head</h1>{f'<p>{TEXT}</p>' * 30}</article></body>"
    assert html_text.main_text(soup) == f"{TEXT}\n\n{TEXT}"
    assert html_text.main_text(article) == "\n\n".join(["Head", *[TEXT] * 30])
    monkeypatch.setattr(html_text, "path_ratios", lambda p, n, m: [1.0] * len(p))
    assert "Made by us." in html_text.main_text(soup) and "Buy this" in html_text.main_text(article)


def test_names_do_not_drop_content():
    for name in ("legal", "search", "related-work", "notice"):
        assert html_text.main_text(f"<article><p>Hi there, friend.</p><p class='{name}'>Legal analysis, of the case.</p></article>") == "Hi there, friend.\n\nLegal analysis, of the case."
    long = f"<div class='related-work'><p>{TEXT} {TEXT}</p></div>"
    assert html_text.main_text(f"<body><article><p>{TEXT}</p><p>{TEXT}</p>{long}</article>").endswith(f"{TEXT} {TEXT}")


def test_furniture_in_an_article():
    parts = "<div class='ad'>Buy now.</div><div class='share'><a href=x>Share</a></div><aside>See also.</aside><form>Your name <input></form><section class='comments'><p>I like it, really. Yes!</p></section>"
    refs = "<ul><li><a href=a>Ref one</a></li><li><a href=b>Ref two</a></li><li><a href=c>Ref three</a></li></ul>"
    assert html_text.main_text(f"<body>{MENU}<article><h1>T</h1><p>{TEXT}</p><p>{TEXT}</p>{parts}{refs}</article></body>") == "\n\n".join(["T", TEXT, TEXT, "Ref one", "Ref two", "Ref three"])


def test_short_articles():
    for word in ("a", "Word.", "one two"):
        assert html_text.main_text(f"<body><div class='ad'>A longer line, of an advert. Yes.</div><article><h1>{word}</h1><p>{word}</p></article>") == f"{word}\n\n{word}"
    assert html_text.main_text("<body><div class='ad'>A longer line, of an advert.</div><article><h1></h1></article>") == ""


def test_forms():
    assert html_text.main_text(f"<body><form><div><p>{TEXT}</p></div></form></body>") == TEXT
    assert html_text.main_text(f"<body><form><article><p>{TEXT}</p></article><p>Send.</p></form></body>") == TEXT


@pytest.mark.parametrize("page", ["<div>" * 32000 + "x", "<div>a" * 20000, "<a <a" * 20000, "<" * 160000, "<p>a" * 40000, "<b>a" * 40000, "<td><div>" + "<b>" * 8000 + "<td></td>" * 8000, "<title>" * 20000, "<script>" * 20000, "<!--" * 40000, '<a b="' * 30000, "<ul><li>" * 10000, "</x" * 50000, "&" * 160000, "&#x41;" * 20000])
def test_hostile_pages_take_linear_time(page):
    start = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - start < 5


def test_deep_and_long_pages_are_used_whole():
    assert html_text.main_text("<div>" * 20000 + f"<p>{TEXT}") == TEXT
    many = f"<article>{f'<p>{TEXT}</p>' * 5000}</article>"
    assert html_text.main_text(many) == "\n\n".join([TEXT] * 5000)


def test_markup():
    assert html_text.main_text(f"<article><p title='a>b' class=x>1 &lt; 2 &amp; 3 < 4, {TEXT}<!-- c > d --><script>if (a<b) '</p>'</script></p></article>") == f"1 < 2 & 3 < 4, {TEXT}"
    assert html_text.main_text(f"<ARTICLE><P>{TEXT}<STYLE>p{{}}</STYLE><BR/>x</P></ARTICLE><SCRIPT>y") == f"{TEXT} x"


def test_empty_table_and_clashing_columns(spark):
    schema = "page_id long, url string, html string, text string, n_chars long, path string"
    assert html_text.extract_text(spark.createDataFrame([], schema)).collect() == []
    got = html_text.extract_text(spark.createDataFrame([(1, None, "<p>a b</p>", "t", 5, "p"), (None, "u", None, None, None, None), (1, None, "<p>a b</p>", "t", 5, "p")], schema)).collect()
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in got) == [("1", "a b", 3), ("1", "a b", 3), ("None", "", 0)]
