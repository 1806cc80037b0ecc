import html
import random
import re

import pandas as pd
import pytest
from conftest import SF_DIR

from offerscope.llm import boosting, html_text


@pytest.fixture(scope="module")
def pages():
    return pd.read_parquet(f"{SF_DIR}/pages.parquet")


@pytest.fixture(scope="module")
def extractor(pages):
    return html_text.learn(pages.html.tolist())


def test_pages_of_the_table(pages, extractor):
    """The article of each page, by a pattern that fits this template only."""
    for found, page in zip(extractor.texts(pages.html.tolist()), pages.html):
        inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        text = re.sub(r"<[^>]+>", lambda m: "" if m[0] in ("<b>", "</b>") else " ", inner)
        assert found == " ".join(html.unescape(text).split())


def test_other_layouts(pages, extractor):
    rng = random.Random(7)
    texts = [t for t in extractor.texts(pages.html.tolist()) if t]
    right = wrong = missed = 0
    for _ in range(150):
        page = html_text.read_page(html_text.recomposed(rng, texts))
        label = html_text.known_runs(page)
        kept = set(html_text.keep_runs(page, extractor.trees.logits(extractor.features.of([page]))))
        for i, tag in enumerate(page.tag):
            if tag == html_text.RUN:
                right += i in kept and label[i] == 1
                wrong += i in kept and label[i] == 0
                missed += i not in kept and label[i] == 1
    assert right / (right + wrong) > 0.9 and right / (right + missed) > 0.8


def test_nothing_is_kept_below_what_is_not(extractor):
    page = html_text.read_page("<div><form><p>one</p></form><p>two</p></div>")
    kept = html_text.keep_runs(page, __import__("numpy").full(len(page.tag), 5.0))
    assert [page.text[i] for i in kept] == ["two"]


def test_decoding_equals_brute_force():
    import itertools

    import numpy as np

    page = html_text.read_page("<div><p>a</p><div><p>b</p>c</div></div><p>d</p>")
    n = len(page.tag)
    rng = np.random.default_rng(5)
    for _ in range(50):
        logits = rng.normal(0, 2, n)
        best, choice = -1e9, None
        for bits in itertools.product((0, 1), repeat=n - 1):
            label = (1, *bits)
            if all(label[page.parent[i]] >= label[i] for i in range(1, n)):
                value = sum(x for x, b in zip(logits[1:], bits) if b)
                if value > best:
                    best, choice = value, label
        expected = [i for i in range(n) if choice[i] and page.tag[i] == html_text.RUN]
        assert html_text.keep_runs(page, logits) == expected


def test_broken_and_empty_pages(spark, extractor):
    rows = [
        (1, "u", None), (2, "u", ""), (3, "u", "<"), (4, "u", "<p>a<p>b &amp; c<div"), (5, "u", "<script>x"),
        (6, "u", "plain   text"), (6, "u", "plain   text"), (None, None, "</div></p><b>x"), (7, "u", "<div>" * 3000 + "deep"),
        (8, "u", "<article>" + "<p>word word, word.</p>" * 3000 + "</article>"),
    ]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, text string, n string")
    found = html_text.extract(docs, extractor).collect()
    assert len(found) == len(rows) and all(r["text"] is not None for r in found)
    by_id = {r["page_id"]: r["text"] for r in found}
    assert by_id[1] == by_id[2] == by_id[5] == ""
    assert by_id[8] == " ".join(["word word, word."] * 3000)
    assert html_text.extract(docs.limit(0), extractor).count() == 0
    assert html_text.learn([]) is not None


def test_boosting_learns_an_interaction():
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.integers(0, 8, (2000, 5)).astype(np.uint8)
    y = ((x[:, 0] > 3) ^ (x[:, 3] > 5)).astype(float)
    trees = boosting.fit(x[:1500], y[:1500])
    assert ((trees.logits(x[1500:]) > 0) == y[1500:]).mean() > 0.98


def test_training_pages_have_a_key_each(spark):
    rows = [(i, f"<p>{i}</p>") for i in range(10)] + [(i, f"<p>{i} again</p>") for i in range(10) for _ in range(50)]
    pages = spark.createDataFrame(rows, "page_id long, html string")
    assert sorted(html_text.training_pages(pages, most=10)) == sorted(f"<p>{i} again</p>" for i in range(10))


def test_all_tokens_of_a_node_are_read():
    names = "container mx auto px py max xl lg md sm wide sidebar"
    page = html_text.read_page(f'<div class="{names}" role="complementary"><p>text</p></div>')
    assert page.tokens[1] == (*names.split(), "complementary")
    marked = html_text.read_page(f'<article><p>main</p><div class="{names}"><p>aside</p></div></article>')
    label = html_text.marked_runs(marked)
    assert [t for t, y in zip(marked.text, label) if y and t] == ["main"]


def test_whole_pages_inside_a_form_or_an_open_menu(pages, extractor):
    wholes = pages.html.tolist()[:40]
    menu = '<ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li></ul>'
    for before, after in (("<form>", "</form>"), ("<form>", ""), ("<nav>" + menu, ""), ("<object>", "</object>")):
        changed = [re.sub(r"<body>(.*)</body>", lambda m: f"<body>{before}{m[1]}{after}</body>", x, flags=re.S) for x in wholes]
        assert changed != wholes
        assert list(extractor.texts(changed)) == list(extractor.texts(wholes))
    wrapped = html_text.read_page("<form><article><p>main</p><form>search</form><nav>menu</nav></article><p>end</p></form>")
    label = html_text.marked_runs(wrapped)
    assert [t for t, y in zip(wrapped.text, label) if y and t] == ["main"]
