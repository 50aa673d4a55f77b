"""op1: the ratios decide where markup doesn't say, and time grows with the page."""

import html
import re
import time

import duckdb
import numpy as np
import pytest

from tidemark.llm import html_extract as H

SF = "/root/testdata/sf0.001"


def pages():
    return [r[0] for r in duckdb.sql(f"select html from '{SF}/pages.parquet' where html is not null order by page_id").fetchall()]


def plain(page):
    """These pages hold one article with headings, paragraphs, bold text and line breaks."""
    body = re.search(r"(?s)<article>(.*?)</article>", page)[1]
    text = re.sub(r"<(/?(?:p|h\d)|br)>", " ", body)
    return " ".join(html.unescape(re.sub(r"<[^>]+>", "", text)).split())


def unmarked(page):
    """The same page without elements or classes that tell what is what."""
    page = re.sub(r"<(/?)(?:article|main|nav|footer)[^>]*>", r"<\1div>", page)
    return page.replace(' class="ad"', "")


def test_real_pages_give_their_articles():
    all_pages = pages()
    assert len(all_pages) > 20
    assert all(H.main_text(p) == plain(p) for p in all_pages)


def test_articles_are_found_without_telling_markup():
    """All of the article, and in nine of ten pages nothing else (a footer may be as long as a short article)."""
    all_pages = pages()
    got = [H.main_text(unmarked(p)) for p in all_pages]
    want = [plain(p) for p in all_pages]
    assert all(w in g for g, w in zip(got, want, strict=True))
    assert np.mean([g == w for g, w in zip(got, want, strict=True)]) >= 0.9


LONG = "a paragraph of the story with many plain words and no tags at all, long enough to be dense. " * 3
FLAT = "<body>" + "".join(f"<p><a href=/{i}>Menu {i}</a></p>" for i in range(12)) + f"<p>{LONG}<p>{LONG}<p>short one<p>{LONG}<p>{LONG}" + "".join(f"<p><a href=/f{i}>About {i}</a></p>" for i in range(12))


def test_a_flat_page_keeps_its_dense_cluster():
    story = " ".join(LONG.split())
    assert H.main_text(FLAT) == " ".join([story, story, "short one", story, story])


def test_without_the_ratios_the_result_falls_apart(monkeypatch):
    good = [H.main_text(FLAT)] + [H.main_text(unmarked(p)) for p in pages()]
    rng = np.random.default_rng(3)
    monkeypatch.setattr(H, "ratios", lambda page: rng.random(len(page.lines)) * 300)
    bad = [H.main_text(FLAT)] + [H.main_text(unmarked(p)) for p in pages()]
    assert good[0] != bad[0] and good != bad


def test_without_the_threshold_menus_come_in(monkeypatch):
    monkeypatch.setattr(H, "dense", lambda values: np.ones(len(values), bool))
    assert "Menu 1" in H.main_text(FLAT)


def test_lists_and_sections_inside_the_region_stay():
    page = f"<body><div><ul><li><a>x</a><li><a>y</a></ul></div><div><p>{LONG}<ul><li>one<li>two</ul><p>{LONG}<div><p>{LONG}</div></div><div><p>end notes</div>"
    story = " ".join(LONG.split())
    assert H.main_text(page) == " ".join([story, "one two", story, story])


@pytest.mark.parametrize("tag", ["div", "p", "b", "article", "li", "unknown", "ul", "td", "nav"])
def test_deep_nesting_takes_linear_time(tag):
    n = 100_000
    began = time.perf_counter()
    got = H.main_text(f"<{tag}>" * n + "text" + f"</{tag}>" * n)
    assert time.perf_counter() - began < 8  # quadratic work would take minutes
    assert got == ("" if tag == "nav" else "text")


def test_stray_and_missing_ends():
    assert H.main_text("<article><p>a</b></i><p>b</div></section><p><b>c<p>d</article>") == "a b c d"
    assert H.main_text("<main><table><tr><td>a<td>b<tr><td>c</table><p>d</main>") == "a b c d"
    assert H.main_text("</p></div>x") == "x"
