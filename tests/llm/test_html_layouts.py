"""Pages with many open inline tags, and layouts whose names only sound like boilerplate."""

from turnstone.llm import html

WORDS = "The article's own words are here, and they must be found by every reader of it."
ARTICLE = f"<article><p>{WORDS}</p></article>"


def test_end_tags_are_found_below_many_open_inline_tags():
    for open_, close in (("<nav>", "</nav>"), ("<aside>", "</aside>"), ("<div hidden>", "</div>"), ("<div class='ad'>", "</div>")):
        assert html.extract(f"<body>{open_}{'<span><font>' * 150}Menu{close}{ARTICLE}</body>") == WORDS
    assert html.extract(f"<div>{'<span>' * 20_000}{'</b>' * 20_000}{ARTICLE}") == WORDS


def test_text_deep_in_a_link_is_linked():
    page = html.Blocks()
    page.feed("<a href=x><b><i><u><s><em><strong><span>deep</span></strong></a><p>free</p>")
    page.flush()
    assert [(b[0], b[2]) for b in page.out] == [("deep", 1.0), ("free", 0.0)]


def test_names_of_layouts_do_not_make_boilerplate():
    side = "<aside><p>Other words.</p></aside>"
    for layout in ('<body class="home no-sidebar">{}</body>', '<body class="sidebar header-fixed">{}</body>', '<div class="page with-sidebar">{}</div>', '<div class="page has-header">{}</div>', '<div id="page" class="sidebar-right">{}</div>', '<div class="wrap banner"><main>{}</main></div>'):
        assert html.extract(layout.format(ARTICLE + side)) == WORDS, layout
    assert html.extract(f'<article class="post category-social tag-search"><p>{WORDS}</p></article>') == WORDS


def test_headers_of_content_stay():
    for name in ("entry-header", "post-header", "header", "page-header"):
        assert html.extract(f'<article><div class="{name}"><h1>A title</h1></div><p>{WORDS}</p></article>') == f"A title {WORDS}"
    assert html.extract(f'<div class="post"><header class="entry-header"><h1>A title</h1></header><p>{WORDS}</p></div>') == f"A title {WORDS}"


def test_boilerplate_by_name_goes():
    for name in ("sidebar", "site-header", "main-nav", "related-posts", "comments"):
        page = f'{ARTICLE}<div class="{name}"><article><p>A teaser that is long enough to be read as a sentence.</p></article><p>More.</p></div>'
        assert html.extract(page) == WORDS, name
    assert html.extract(f'<nav><article><p>Teaser.</p></article></nav>{ARTICLE}') == WORDS
