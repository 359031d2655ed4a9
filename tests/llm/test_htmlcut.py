"""Optional end tags, hidden elements, hostile pages; what the classifier and the cut decide."""

import time

import numpy as np
import pytest

from loomline.llm import htmlcut

TEXT = "A sentence of the article that is long enough to be kept."


@pytest.mark.parametrize(
    "before",
    [
        "<select>" + "<option>x" * 9 + "</select>", "<datalist>" + "<option>x" * 12 + "</datalist>", "<svg>" + "<path d='M0 0'>" * 9 + "</svg>",
        "<object>" + "<i>" * 9 + "</object>", "<select><optgroup label=a>" + "<option>x" * 3 + "<optgroup label=b>" + "<option>y" * 9 + "</select>",
    ],
)
def test_hidden_elements_end_at_their_end_tag(before):
    assert htmlcut.main_text(f"<article><div>{before}</div><p>{TEXT}</p></article>") == TEXT
    assert htmlcut.main_text(f"<article>{before}<p>{TEXT}</p></article>") == TEXT


@pytest.mark.parametrize("head", ["<head><title>T</title>", "<head><meta charset=utf-8><link href=x><style>p{}</style>", "<head>\n<!-- c -->\n<noscript><img src=x></noscript><script>var a;</script>"])
def test_head_without_end_tag(head):
    for body in (f"<body><article><p>{TEXT}</p></article></body>", f"<article><p>{TEXT}</p></article>", f"<p>{TEXT}", TEXT):
        assert htmlcut.main_text(f"<!doctype html><html>{head}{body}</html>") == TEXT
    assert htmlcut.main_text(f"<html>{head}</head><body><article><p>{TEXT}</p></article></body></html>") == TEXT


def test_math_and_buttons_are_text():
    assert htmlcut.main_text(f"<article><p>{TEXT} Here <math><mi>x</mi></math> is <button>shown</button>.</p></article>") == f"{TEXT} Here x is shown."


MARKED = "<html><body><nav><ul>" + "".join(f"<li><a href='/{i}'>Menu {i}</a></li>" for i in range(5)) + "</ul></nav><div class='ad'>Buy it now, it is very cheap, and it will not be so for long.</div><article><h1>A title</h1><p>The first paragraph has a good many words, as paragraphs have.</p><p>So it is</p><p>The last one is long enough as well, and it ends here.</p></article><footer>Contact us</footer></body></html>"


def counted(pages):
    counts, agree = np.zeros((len(htmlcut._vectors()), 2)), np.zeros((3, 2))
    for h in pages:
        blocks, cues = htmlcut.blocks_of(h)
        y = htmlcut.weak_labels(blocks, cues)
        for b, v in zip(blocks, y):
            if v:
                counts[htmlcut.cell_of(b), int(v > 0)] += 1
        for a, b, p, q in zip(blocks, blocks[1:], y, y[1:]):
            if p and q:
                agree[htmlcut.relation(a, b), int(p == q)] += 1
    return counts, agree


def test_the_cut_flips_blocks_that_their_own_cost_mislabels():
    """Without smoothness an advert reads like text and a short paragraph like a menu: the cut settles both."""
    found = {b.text: (cost > 0, keep) for b, cost, keep in htmlcut.labelled(MARKED, htmlcut.Costs())}
    assert found["Buy it now, it is very cheap, and it will not be so for long."] == (True, False)
    assert found["So it is"] == (False, True)
    plain = "<body><div><p>A paragraph of a page without any cue of structure, with some words more to it than a few others have.</p><p>So it is</p><p>Another paragraph of that page, which is just as long as the one before it was and ends likewise.</p></div></body>"
    assert [keep for _, _, keep in htmlcut.labelled(plain, htmlcut.Costs())] == [True, True, True]
    assert [cost > 0 for _, cost, _ in htmlcut.labelled(plain, htmlcut.Costs())] == [True, False, True]


def test_the_classifier_learns_from_weak_labels(spark):
    """In a corpus whose articles are of short paragraphs, they are kept in pages without a cue, too."""
    pages = ["<nav><ul>" + "<li><a href='/'>Go on</a></li>" * 4 + "</ul></nav><article>" + f"<p>So it is</p><p>Is it {i}</p>" * 3 + "</article>" for i in range(40)]
    costs = htmlcut.fit(spark.createDataFrame([(p,) for p in [*pages, None, "", "<p>nothing to learn</p>"]], "html string").repartition(3))
    same = htmlcut.Costs(*counted(pages))
    assert costs.cells == same.cells and costs.edges == same.edges
    plain = "<div><p>So be it</p><p>Is it so</p></div>"
    assert htmlcut.main_text(plain) == "" and htmlcut.main_text(plain, costs) == "So be it Is it so"
    none = htmlcut.fit(spark.createDataFrame([], "html string"))
    assert none.cells == htmlcut.Costs().cells and none.edges == htmlcut.Costs().edges


def test_text_after_a_script_and_a_letter_that_changes_length():
    assert htmlcut.main_text("<article><p>İİİİİİİİ one.</p><script>x</SCRIPT ><p>Two three.</p></article>") == "İİİİİİİİ one. Two three."


@pytest.mark.parametrize("piece", ["<b>x ", "<div>x ", "<p>some words here</p>", '<a "', "<a 'x=\"", "<![CDATA[", "<", "<!-- ", "</p>", "<header>", "<p>some words here</p><li>a b</li><p>one two three four five six seven eight nine ten.</p>"])
def test_long_and_hostile_pages_take_time_in_proportion(piece):
    start = time.perf_counter()
    htmlcut.main_text(piece * 20000 + ">")
    assert time.perf_counter() - start < 10
