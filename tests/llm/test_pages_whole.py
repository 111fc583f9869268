"""Pages whose text must not be lost with what stands around it."""

from __future__ import annotations

import pytest
from voxframe.llm import html_blocks as H


@pytest.mark.parametrize(
    "page, want",
    [
        ("<html><head><meta charset=utf-8><body><article><p>Text</p></article>", ["Text"]),
        ("<head><title>t</title><link rel=x><p>Text<p>more", ["Text", "more"]),
        ("<head><meta charset=utf-8>Text <b>goes</b> on", ["Text goes on"]),
        ("<head><script>a</script>\n<img src=x>Text", ["Text"]),
        ("<head> <style>p{}</style> <title>t</title> </head><p>Text", ["Text"]),
        ("<p>so <math><mi>x</mi><mo>+</mo><mn>1</mn></math> is</p>", ["so x+1 is"]),
        ("<p>a <object data=x>shown <b>instead</b></object> b</p>", ["a shown instead b"]),
        ("<div><svg><title>t</title><defs/><path d='M0'/><text>drawn</text></svg><p>b</p></div>", ["drawn", "b"]),
        ("<p>a <svg><path d='M0'/></svg> b</p><svg/><p>c", ["a b", "c"]),
    ],
)
def test_shown_text_is_kept(page, want):
    assert [b[0] for b in H.blocks(page)] == want
