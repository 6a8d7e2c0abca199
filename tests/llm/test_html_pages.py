"""Whole pages against the text of their articles, and what the cut decides."""

import html as chars
import re

import pytest

from turnstone.llm import html

BLOCK = re.compile(r"</?(?:p|h[1-6]|ul|ol|li|br|div|table|tr|td|th|blockquote|pre|section|figure|figcaption|dl|dt|dd|hr)\b[^>]*>", re.I)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet("/root/testdata/sf0.01/pages.parquet")


def article_text(page):
    """The text of the only article, by patterns alone."""
    (inside,) = re.findall(r"<article\b[^>]*>(.*?)</article>", page, re.S)
    inside = re.sub(r"<!--.*?-->|<(script|style)\b.*?</\1>", "", inside, flags=re.S)
    inside = re.sub(r"<(?:nav|aside|form|footer|div class=\"ad\").*?</(?:nav|aside|form|footer|div)>", "\0", inside, flags=re.S)
    parts = [chars.unescape(re.sub(r"<[^>]+>", "", x)) for x in re.split(r"\0", BLOCK.sub("\0", inside))]
    return " ".join(" ".join(x.split()) for x in parts if x.split())


def test_whole_pages(pages):
    rows = [r for r in pages.collect() if len(re.findall(r"<article\b", r["html"])) == 1]
    assert len(rows) > 100
    got = {r["page_id"]: r for r in html.extracted(pages.union(pages.limit(5))).collect()}
    for r in rows:
        assert got[r["page_id"]]["text"] == article_text(r["html"])
        assert got[r["page_id"]]["n_chars"] == len(article_text(r["html"]))


def judged_against(pages, taken, turned):
    """F1 of characters and blocks judged wrongly, by the classifier alone and by the cut, on pages of odd id with some regions' names taken
    away or turned round; and blocks that the cut judges against the names seen."""
    found = {"alone": [0, 0, 0], "cut": [0, 0, 0]}
    against = 0
    for seed, page in enumerate(pages):
        blocks, has_content = html.parsed(page)
        seen = html.blurred(blocks, seed, taken, turned)
        for (text, place, *_), other, (_, alone, cut) in zip(blocks, seen, html.judged(seen, has_content)):
            against += other[1] != 0 and cut != (other[1] > 0)
            for name, keep in (("alone", alone), ("cut", cut)):
                found[name][0] += 2 * len(text) * (keep and place > 0)
                found[name][1] += len(text) * (keep + (place > 0))
                found[name][2] += keep != (place > 0)
    return {k: (a / b, wrong) for k, (a, b, wrong) in found.items()}, against


def test_the_cut_is_better_than_the_classifier_where_names_are_wrong(spark):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").filter("page_id % 2 = 1").orderBy("page_id").collect()]
    right, _ = judged_against(pages, 0, 0)
    assert right["cut"] == (1, 0)
    mixed, against = judged_against(pages, 0.1, 0.1)
    assert mixed["cut"][0] > mixed["alone"][0] > 0.95 and mixed["cut"][1] < mixed["alone"][1] and against > 100


def test_the_cut_decides():
    """Short paragraphs that the classifier gives up follow their neighbours, and lists of links leave their article."""
    words = "This paragraph of the story has enough words to be one, and it ends as sentences do."
    page = f"<div><p>{words}</p><p>No.</p><p>{words}</p></div>"
    assert [(alone, cut) for _, alone, cut in html.labelled(page)] == [(True, True), (False, True), (True, True)]
    assert html.extract(f"<main><p>{words}</p></main><section><p>{words}</p></section>") == f"{words} {words}"
    assert html.extract(f"<article><p>{words}</p><ul><li><a href=x>Read more stories</a></li><li><a href=y>Subscribe now</a></li></ul></article>") == words
    assert html.extract(f'<div class="post-list related-posts"><p>{words * 3}</p><p>{words * 2}</p></div>') == f"{words * 3} {words * 2}"


def test_weights_are_those_of_the_fit(spark):
    assert html.fitted(spark.read.parquet("/root/testdata/sf0.1/pages.parquet")) == pytest.approx(html.WEIGHTS, abs=0.02)


def test_pages_without_regions_are_judged_by_their_text():
    links = "".join(f"<li><a href='/{i}'>Item {i}</a></li>" for i in range(8))
    page = f"<body><ul>{links}</ul><div><h2>A heading</h2><p>The first paragraph has some words.</p><p>Short.</p><p>And a last one, with more of them.</p></div></body>"
    assert html.extract(page) == "A heading The first paragraph has some words. Short. And a last one, with more of them."


def test_ties_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "u", "<article><p>Same words.</p><p>Same words.</p></article>")] * 3 + [(2, None, "   "), (3, "x", "<article></article>")], "page_id long, url string, html string")
    rows = sorted((r["page_id"], r["text"]) for r in html.extracted(df).collect())
    assert rows == [(1, "Same words. Same words.")] * 3 + [(2, ""), (3, "")]
