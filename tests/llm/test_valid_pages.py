"""Pages as HTML allows them keep their article."""

import pytest

from shoalsong.llm import extract


@pytest.mark.parametrize("page, main", [
    ("<html><head><title>x</title><body><article><p>Hello world</article>", ["Hello world"]),
    ("<!doctype html><head><meta charset=utf-8><title>x</title><article><p>Hello</article>", ["Hello"]),
    ("<head><title>x</title><link rel=a><script>var a</script><main><h1>A</h1>b</main>", ["A", "b"]),
    ("<div class=menu><ul><li>a</ul><article><p>Hello</p><aside>b</aside></article>", ["Hello"]),
    ("<div class='search-engine-history'><article><p>Hello</article></div>", ["Hello"]),
    ("<body class='has-sidebar-left'><div id=nav-bar>m</div><article class='sharing-knowledge'>Hello</article>", ["Hello"]),
    ("<article><p>Hello</article><aside class=related-posts><article>Teaser</article></aside>", ["Hello"]),
    ("<article>Hello<div class='ad-slot-2'>Buy</div><div class=site-notice>n</div><div class=comments>c</div></article>", ["Hello"]),
    ("<header>top</header><main><nav>m</nav><p>Hello</main><footer>f", ["Hello"]),
])
def test_article(page, main):
    assert [b[1] for b in extract.blocks(page) if b[0] == extract.MAIN] == main


def test_text_after_an_open_head():
    assert [b[:2] for b in extract.blocks("<head><title>x</title>Hello <b>there</b>")] == [(extract.OPEN, "Hello there")]
