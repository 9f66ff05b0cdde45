"""Pages whose tags leave out what HTML allows to leave out."""

import pytest

from pairlens.llm.crf_pages import leaf_blocks


@pytest.mark.parametrize(("page", "texts"), [
    ("<html><head><title>x</title><body><article><p>Hello world text.</p></article></body></html>", ["Hello world text."]),
    ("<head><meta charset=u><link rel=a href=b><noscript><link></noscript><p>Hello", ["Hello"]),
    ("<head><title>x</title></head><p>Hello", ["Hello"]),
    ("<head><template><p>no</p></template><p>yes", ["yes"]),
    ("<p title=it's>Hello", ["Hello"]),
    ("<p title=\"a>b\" class='c>d' e = \"f>g\">Hello<p x=y>there", ["Hello", "there"]),
    ("<article><select><option>a<option>b<p>After it.</p></article>", ["After it."]),
    ("<article><button>go<h2>Title</h2><p>Text</p></article>", ["Title", "Text"]),
    ("<article><noscript>no</noscript><p>Text", ["Text"]),
    ("a = b < c and d > e", ["a = b < c and d > e"]),
])
def test_blocks(page, texts):
    assert [b[0] for b in leaf_blocks(page)] == texts
