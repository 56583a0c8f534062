"""Names of containers: properties of a page do not make its article an aside."""

import pytest

from lakehealth.llm import htmltext

WORDS = "plain words of the article that go on for a while " * 6
BODY = f"<h1>A headline of six words here</h1><p>{WORDS}</p><p>{WORDS}</p>"
KEPT = "\n".join(["A headline of six words here", WORDS.strip(), WORDS.strip()])


@pytest.mark.parametrize("open_,close", [
    ("<article class='post comments-open'>", "</article>"),
    ("<article class='post category-search share'>", "</article>"),
    ("<main class='content has-sidebar'>", "</main>"),
    ("<main class='sidebar'>", "</main>"),
    ("<div id='page' class='no-sidebar'>", "</div>"),
    ("<div id='page' class='no-sidebar'><article>", "</article></div>"),
    ("<div class='overlay'><article class='post'>", "</article></div>"),
    ("<div class='layout sidebar'><main>", "</main></div>"),
    ("<div class='menu-open header-fixed social-enabled'>", "</div>"),
])
def test_properties_do_not_drop_the_article(open_, close):
    tree = htmltext.train()
    assert htmltext.main_texts([f"<html><body>{open_}{BODY}{close}</body></html>"], tree) == [KEPT]


@pytest.mark.parametrize("extra", [
    "<div class='ad'>{}</div>", "<div class='ad-slot'>{}</div>", "<section id='comments'><article class='comment'>{}</article></section>",
    "<div class='site-footer'>{}</div>", "<ul class='comment-list'><li>{}</li></ul>", "<article class='comment'>{}</article>",
    "<div class='related-posts'><article class='post'>{}</article></div>", "<div role='complementary'>{}</div>",
])
def test_asides_by_name_are_dropped(extra):
    tree = htmltext.train()
    page = f"<html><body><article class='post'>{BODY}</article>{extra.format(WORDS)}</body></html>"
    assert htmltext.main_texts([page], tree) == [KEPT]
