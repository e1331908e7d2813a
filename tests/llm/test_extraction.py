from __future__ import annotations

import html
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from knitgraph.llm import extraction

PAGES = "page_id bigint, url string, html string"


@pytest.fixture(scope="module")
def tree(spark):
    return extraction.fit(extraction.labelled_pages(spark))


def texts(page):
    return [b.text for b in extraction.text_blocks(page)]


def test_blocks_are_flat_text():
    page = """<!DOCTYPE html><title>no</title><style>p{}</style><script>var t = "</p><p>no";</script><body>
    <!-- <p>no</p> --><p>one <b>two</b>th<i>ree</i><br>four&nbsp;&amp;&lt;b&gt;&#233; &copy <p>five<div>six <img alt=">"> seven</div>
    <ul><li>a<li>b<ul><li>c</ul>d</ul><table><tr><td>e<td>f<tr><th>g</table><textarea>no</textarea><SCRIPT>no</SCRIPT>
    1 < 2 <select><option>no</select> <span hidden>no</span><p style="color:red; display : none">no</p><svg><text>no</text></svg>end"""
    assert texts(page) == ["one twothree four &<b>é ©", "five", "six seven", "a", "b", "c", "d", "e", "f", "g", "1 < 2", "end"]


def test_unclosed_markup_swallows_the_rest():
    assert texts("<p>a<!-- b <p>c") == ["a"]
    assert texts("<p>a<script>b <p>c") == ["a"]
    assert texts("<p>a<div class='x <p>c") == ["a", "c"] and texts('<p>a</p><a href="x') == ["a"]
    assert texts("a</p>b</div></nonsense>c<b>d</b>") == ["a", "b", "cd"]
    assert texts(None) == texts("") == texts("<p> \n</p><br>") == []


def test_links_furniture_and_flags():
    page = """<nav><a href=x>Home page</a></nav><div class="post-comments"><p>c</p></div><div class="content with-sidebar"><h2>t
    <a href=y>l</a></h2></div><header>h</header><div id=cookieNotice>n</div><p><a href=z>un closed<p>after</p>"""
    blocks = extraction.text_blocks(page)
    assert [(b.text, b.linked, b.furniture, b.header, b.main, b.heading) for b in blocks] == [
        ("Home page", 2, True, False, False, False), ("c", 0, True, False, False, False), ("t l", 1, False, False, True, True),
        ("h", 0, False, True, False, False), ("n", 0, True, False, False, False), ("un closed", 2, False, False, False, False),
        ("after", 0, False, False, False, False),
    ]
    rows = extraction.features(blocks)
    assert rows[0].tolist() == [2, 1, 0, 0, 1, 0, 1, 0, 0, 0, 1] and rows[-1, 4] == 0


def test_tree_splits_on_what_tells_labels_apart():
    random = np.random.default_rng(1)
    rows = random.integers(0, 20, size=(400, 3)).astype(float)
    labels = ((rows[:, 1] > 7) & (rows[:, 2] <= 12)).astype(float)
    grown = extraction.grow(rows, labels)
    assert ((grown.score(rows) > 0.5) == (labels > 0)).all()
    assert extraction.grow(rows[:0], labels[:0]).score(rows[:3]).tolist() == [0, 0, 0]
    assert extraction.grow(rows, np.ones(400)).score(rows[:2]).tolist() == [1, 1]


def test_held_out_layouts(tree):
    """Each labelled page is judged by a tree grown on all the others."""
    folder = os.path.join(os.path.dirname(extraction.__file__), "labelled_pages")
    pages = [open(os.path.join(folder, name), encoding="utf-8").read() for name in sorted(os.listdir(folder))]
    blocks = [extraction.text_blocks(page, marked=True) for page in pages]
    right = total = 0
    for out in range(len(pages)):
        rest = [b for i, b in enumerate(blocks) if i != out and b]
        grown = extraction.grow(
            np.concatenate([extraction.features(b) for b in rest]), np.array([x.keep for b in rest for x in b], dtype=float)
        )
        kept = grown.score(extraction.features(blocks[out])) > 0.5
        right += sum(k == b.keep for k, b in zip(kept, blocks[out]))
        total += len(kept)
    assert right / total > 0.92


def test_new_layouts(tree):
    story = ["The well of the castle", "It is ninety metres deep.", "Deep.", "Water was drawn by two donkeys in a wheel, for four hundred years and longer."]
    body = f"<h1>{story[0]}</h1>" + "".join(f"<p>{p}</p>" for p in story[1:])
    around = [
        '<div class="cookie-banner"><p>We use small files to make these pages better for all who come here, and for us as well.</p></div>{}<aside><p>More wells can be found in the hills around the town, and some of them are open to the public.</p></aside>',
        '<header><nav><a href="/">Home</a></nav></header><main>{}</main><section id="comments"><p>My uncle fell into it when he was a boy, and lived to tell us of it on every single birthday.</p></section>',
        '<ul class="menu"><li><a href="/a">A</a></li></ul>{}<form><p>Write your mail address here to get a letter each month, with news of wells.</p><label>Mail</label></form><footer>End</footer>',
    ]
    for frame in around:
        page = f"<html><body>{frame.format(f'<article>{body}</article>')}</body></html>"
        assert extraction.main_text(page, tree) == "\n\n".join(story)


def test_all_pages_keep_their_article(spark, smallest, tree):
    pages = spark.read.parquet(f"{smallest}/pages.parquet")
    found = {r["page_id"]: r for r in extraction.extract_pages(pages, tree).collect()}
    rows = pages.collect()
    assert len(found) == len(rows)
    for page in rows:
        inside = re.search(r"<article>(.*)</article>", page["html"], re.DOTALL)[1].replace("<br>", " ")
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", p)).split()) for p in re.split("</?(?:p|h1)>", inside)]
        expected = "\n\n".join(p for p in parts if p)
        got = found[page["page_id"]]
        assert (got["text"], got["n_chars"], got["url"]) == (expected, len(expected), page["url"])


def test_odd_pages(spark, tree):
    long = "<article>" + "<p>" * 200_000 + "<p>word " * 100_000 + "</article>"
    deep = "<article>" + "<div>" * 3_000 + "x" + "</div>" * 3_000
    rows = [(1, "u", None), (2, None, ""), (2, None, "<p>"), (None, "v", "<article>a\x00b é</article>"), (5, "", long), (6, "d", deep)]
    frame = spark.createDataFrame(rows, PAGES).withColumn("text", F.lit("own")).withColumn("n_chars", F.lit(-1)).withColumn("words", F.lit(0))
    found = {(r["page_id"], r["url"]): r for r in extraction.extract_pages(frame, tree).collect()}
    assert [found[k]["n_chars"] for k in ((1, "u"), (2, None), (None, "v"), (6, "d"))] == [0, 0, 5, 1]
    assert found[5, ""]["text"] == "\n\n".join(["word"] * 100_000)
    assert extraction.extract_pages(frame.limit(0), tree).count() == 0
    assert extraction.fit(extraction.labelled_pages(spark).limit(0)).score(np.zeros((1, 11))).tolist() == [0]
