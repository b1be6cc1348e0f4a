"""What the minimum cut of the HTML extraction decides, on hand-labelled pages and on the driver's."""

import os
import re

import pandas as pd
import pytest

from ledgerleaf.llm import html_text

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01").replace("sf0.001", "sf0.01")

LONG = "The council met again on this matter in the spring and found that much was left to do before the summer."
BEFORE = "<header><h1>Site</h1><div>News of the day</div></header><nav><ul><li><a href=/>Home</a></li><li><a href=/b>About us</a></li></ul></nav>"
AFTER = """<aside><h3>Related</h3><p>Another story that you may like to read as well, we think.</p></aside><section class='comments'><h3>2 comments</h3>
<div class='comment'><p>I do not agree with this at all, the council has done what it could and more than that in a very hard year for all of us.</p></div><div class='comment'><p>Well said.</p></div></section>
<footer><p>All rights reserved. Privacy policy. Contact.</p></footer>"""
BODY = "".join(f"<p>{LONG} {LONG}</p><p>{t}</p>" for t in ("Yes", "It was late", "Then silence"))
KEPT = ["Title here"] + [x for t in ("Yes", "It was late", "Then silence") for x in (f"{LONG} {LONG}", t)]
# html of the article's part, and the blocks of it that are content
LABELLED = [
    (f"<article><h1>Title here</h1>{BODY}</article>", KEPT),
    (f"<article><div class='post-share-story'><h1>Title here</h1>{BODY}</div></article>", KEPT),
    (f"<div class='story-header'><h1>Title here</h1>{BODY}</div>", KEPT),
    (f"<div id='x1'><h1>Title here</h1>{BODY}</div>", KEPT),
    (f"<main><h2>Title here</h2>{BODY}<ul><li>{LONG}</li><li>short</li><li>{LONG}</li></ul></main>", [*KEPT, LONG, "short", LONG]),
    (f"<div class='content'><h1>Title here</h1>{BODY}<div class='newsletter'><p>Get the newsletter</p></div><p>{LONG}</p></div>", [*KEPT, LONG]),
]


def scores(kept, wanted):
    common = sum(min(kept.count(x), wanted.count(x)) for x in set(kept))
    p, r = common / max(1, len(kept)), common / max(1, len(wanted))
    return 2 * p * r / (p + r) if p + r else 0.0


def test_the_cut_labels_hand_labelled_pages():
    with_cut, without = [], []
    for own, wanted in LABELLED:
        blocks = html_text.read_blocks(BEFORE + own + AFTER)
        with_cut.append(scores([b.text for b, k in zip(blocks, html_text.labels(blocks)) if k], wanted))
        without.append(scores([b.text for b in blocks if html_text.leaning(b) > 0], wanted))
    assert min(with_cut) == 1.0
    assert max(without) < 0.8  # short lines of the article are lost where each block is judged alone


@pytest.mark.parametrize("tag", "button select svg canvas audio video noscript template textarea iframe".split())
def test_an_open_element_ends_at_the_next_block(tag):
    text = html_text.main_text(f"<article><p>{LONG}</p><p>One <{tag}>press<p>{LONG}</article>")
    assert text == f"{LONG} One {LONG}"


def test_text_of_formulas_objects_and_hidden_elements():
    page = f"<article><p>{LONG} Let <math>x = y</math> and <object>seen</object> be <SPAN hidden>secret words</SPAN> so <span style='Display:None'>no</span>.</p></article>"
    assert html_text.main_text(page) == f"{LONG} Let x = y and seen be so ."


def test_names_alone_decide_nothing():
    named = [html_text.read_blocks(f"<div class='{c}'><p>{LONG} {LONG}</p></div>")[0] for c in ("header", "side", "share", "widget", "related", "notice")]
    assert all(html_text.leaning(b) > -0.5 for b in named)


def test_a_very_long_page():
    page = BEFORE + "<article>" + f"<p>{LONG}</p><p>Yes</p>" * 10_000 + f"<p>{LONG} <button>x" * 500 + "</article>" + AFTER
    text = html_text.main_text(page)
    assert text.startswith(f"{LONG} Yes {LONG}") and text.count("Yes") == 10_000 and "Related" not in text


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
def test_the_cut_on_driver_pages():
    """The driver's pages hold their content in one article element, which the extraction is not told to trust."""
    changed = n = 0
    for page in pd.read_parquet(f"{SF}/pages.parquet").html:
        inner = re.search(r"<article>(.*?)(?:</article>|<footer)", page, re.S)
        wanted = [b.text for b in html_text.read_blocks("<article>" + inner[1])]
        blocks = html_text.read_blocks(page)
        kept = html_text.labels(blocks)
        assert [b.text for b, k in zip(blocks, kept) if k] == wanted
        changed += any((html_text.leaning(b) > 0) != k for b, k in zip(blocks, kept))
        n += 1
    assert changed >= 0.01 * n
