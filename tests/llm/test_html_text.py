import html
import itertools
import re
import time

import numpy as np
import pytest

from tablecheck.llm import html_text


@pytest.fixture(scope="module")
def field():
    return html_text.trained([])


def test_examples_are_learned(field):
    for example in html_text.EXAMPLES:
        blocks = html_text.leaf_blocks(example)
        assert field.best(html_text.features(blocks)) == [int(b.keep) for b in blocks]


def test_other_pages(field):
    page = """<html><head><title>Title</title><script>var a = "<p>no</p>";</script><style>p {}</style></head><body>
    <nav><a href="/">Home</a> <a href="/n">News</a></nav><aside class="sidebar"><p>Archive</p><a href="/">2019</a></aside>
    <article><h1>Old &amp; new</h1><p>First&nbsp;line<br>second  line.<p>Unclosed <b>bold.</p>
    <!-- <p>hidden</p> --><p>5 &lt; 6 &#8211; and so on.</p><form><label>Your mail</label><input></form></article>
    <section class="comments"><h2>3 replies</h2><p class="comment">I do not think so.</p></section>
    <footer>&copy; 2024 somebody. All rights reserved.</footer></body></html>"""
    assert html_text.main_text(page, field) == "Old & new First line second line. Unclosed bold. 5 < 6 – and so on."


@pytest.mark.parametrize(
    "page",
    [None, "", "   ", "<", "<p", "</p></p>", "<!--", "<script>never closed <p>x</p>", "<p title='a>b", "\x00", "&#99999999;", "<a" * 3000,
     "<div>" * 3000 + "deep" + "</div>" * 3000, "<b>" * 2000 + "<p>x</p>" * 500, '<p a="' + "x" * 50_000, "<table><tr><td>1<td>2<tr><td>3</table>"],
)
def test_broken_pages(page, field):
    assert isinstance(html_text.main_text(page, field), str)


def test_long_page(field):
    text = " ".join(f"word{i}." for i in range(100_000))
    assert html_text.main_text(f"<body><nav><a>x</a></nav><article><p>{text}</p></article></body>", field) == text


def test_blocks():
    blocks = html_text.leaf_blocks("<div>a<p>b <i>c</i><li>d<li>e</div>f<hr>g<a href=x>h</a>")
    assert [b.text for b in blocks] == ["a", "b c", "d", "e", "f", "gh"]
    assert blocks[-1].linked == 1 and "t:p" in blocks[1].names and "t:p" not in blocks[-2].names


def test_viterbi_and_marginals_against_all_paths():
    rng = np.random.default_rng(0)
    field = html_text.ChainField()
    field.steps, field.start = rng.normal(size=(2, 2)), rng.normal(size=2)
    page = [[f"f{i}"] for i in range(6)]
    field.weights = {f"f{i}": float(rng.normal()) for i in range(6)}
    paths = list(itertools.product((0, 1), repeat=6))
    score = [
        field.start[p[0]] + sum(field.weights[f"f{i}"] * s for i, s in enumerate(p)) + sum(field.steps[a, b] for a, b in zip(p, p[1:]))
        for p in paths
    ]
    assert field.best(page) == list(paths[int(np.argmax(score))])
    chance = np.exp(score) / np.exp(score).sum()
    want = sum(c * np.array(p) for c, p in zip(chance, paths))
    assert np.allclose(field.marginals(field.scores(page))[0][:, 1], want)


def article(page):
    inside = page[page.index("<article>") + 9 : page.index("</article>")]
    return " ".join(re.split(r"[\x20\x09-\x0D]+", html.unescape(re.sub(r"</?(?:p|h1)>|<br>|</?b>", " ", inside)).strip()))


def test_table(spark):
    rows = html_text.op5_html_text(spark, "/root/testdata/sf0.001").collect()
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        assert r["text"] == article(pages[r["page_id"]])
        assert r["n_chars"] == len(r["text"])


def test_null_empty_and_clashing_columns(spark):
    schema = "page_id long, url string, html string, text string, n_chars string"
    df = spark.createDataFrame([(1, "u", None, "x", "y"), (1, "u", "", "x", "y"), (None, None, "<p>Just text here.</p>", "x", "y")], schema)
    got = html_text.extracted(df)
    assert got.columns == df.columns
    assert sorted(r["text"] for r in got.collect()) == ["", "", "Just text here."]
    assert html_text.extracted(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "hidden",
    [
        "<script>for(i=0;i<n;i++){f(i)}</script>",
        "<script>if(a<b && c) f('<!--')</script>",
        "<SCRIPT>a<b</Script >",
        "<style>p::before{content:'<x'}</style>",
        "<textarea>1 <2 <!-- </textarea>",
        "<datalist><option value=a><option value=b></datalist>",
        "<select><option>a<optgroup label=x><option>b<optgroup label=y><option>c</select>",
        "<div><button>Go</div>",
        "<button>a<button>b</button>",
        "<svg><svg><path d=x></svg><text>c</text></svg>",
        "<template><p>a</p><template>b</template>c</template>",
    ],
)
def test_text_after_hidden_elements_stays(hidden):
    # Twice, as a later end tag must not hide what is between.
    page = f"<body><p>one</p>{hidden}<article><p>two</p></article>{hidden}<p>three</p></body>"
    assert [b.text for b in html_text.leaf_blocks(page)] == ["one", "two", "three"]


def test_hidden_elements_do_not_end_a_block():
    blocks = html_text.leaf_blocks("<p>a<button><div>x<br></div></button>b<svg><g><a>y</a></g></svg>c<div><select><option>z</div>d")
    assert [b.text for b in blocks] == ["abc", "d"]
    assert "t:article" not in html_text.leaf_blocks("<article><option>x</article><p>y</p>")[0].names


N = 20_000
HOSTILE = {
    "unfinished tag": "<div " + " ".join(f'a{i}="v"' for i in range(N)),
    "open quotes": '<p a="' * N,
    "stray quotes": "<p " + "'\"" * N + ">",
    "unfinished starts": "<div a=" * N,
    "declarations": "<!x " * N,
    "end tags of scripts": "<script>" + "</script x" * N,
    "scripts in scripts": "<script>" * N,
    "open elements": "<div>" * N + "deep" + "</div>" * N,
    "inline elements": "<b>" * N + "<p>x</p>" * N + "</i>" * N,
    "end tags of nothing": "<div>" * N + "</nav>" * N + "</b>" * N,
    "names": "".join(f'<div class="n{i}">x' for i in range(N)),
    "blanks": "<p " + " " * 50 * N + "class" + " " * 50 * N + "=x>y",
    "less thans": "<" * 50 * N,
    "slashes": "</" * 50 * N,
    "cells": "<table>" + "<tr><td><b>x" * N,
    "hidden": "<button><svg>" * N,
}


@pytest.mark.parametrize("name", list(HOSTILE))
def test_time_is_linear(name, field):
    began = time.time()
    assert isinstance(html_text.main_text(HOSTILE[name], field), str)
    assert time.time() - began < 20


def test_deep_pages_keep_their_structure():
    """Beyond hundreds of open elements an end tag still closes what it names."""
    page = "<nav>" + "<div>" * 10_000 + "menu</nav><article><p>text</p></article>"
    menu, text = html_text.leaf_blocks(page)
    assert "t:nav" in menu.names and "t:nav" not in text.names and "t:article" in text.names
    inline = html_text.leaf_blocks("<p>" + "<i>" * 5000 + "a<p>b")
    assert [b.text for b in inline] == ["a", "b"] and "t:i" not in inline[1].names


def test_all_names_and_long_values():
    page = '<div class="flex flex-col mt-4 p-4 bg-white a b c d sidebar" id=top role=\'x\'>t</div>'
    names = html_text.leaf_blocks(page)[0].names
    assert {"c:flex", "c:sidebar", "c:top", "c:x"} <= set(names)
    long = f'<p title="{"x > y " * 5000}" class="late">t</p>'
    block = html_text.leaf_blocks(long)[0]
    assert block.text == "t" and "c:late" in block.names


def test_quotes_count_at_values_only():
    assert [b.text for b in html_text.leaf_blocks("<p title=it's>a</p><p x'y>b</p><p a = 'c>d'>e</p><br/>f")] == ["a", "b", "e", "f"]
    assert [b.text for b in html_text.leaf_blocks('<p>a</p><p class="cut>b</p>')] == ["a"]
    assert [b.text for b in html_text.leaf_blocks("1 < 2 <3 </> x <p")] == ["1 < 2 <3 </> x"]


def test_text_of_formulas_and_objects_stays():
    page = "<p>a <math><mi>x</mi><mo>=</mo><mn>2</mn></math> b <object data=v><a href=v>see v</a></object></p>"
    assert " ".join(b.text for b in html_text.leaf_blocks(page)).replace(" ", "") == "ax=2bseev"


def test_weights_of_ancestors_are_summed_as_they_open(field):
    for page in [*html_text.EXAMPLES, "<div class=a><p class=a>x<b class=b>y</p>z</div>w" * 20]:
        blocks = html_text.leaf_blocks(page)
        scored = html_text.leaf_blocks(page, field.weights)
        whole = field.scores(html_text.features(blocks))
        parts = field.scores(html_text.features(scored)) + np.array([b.above for b in scored])
        assert np.allclose(whole, parts) and field.states(page)[1] == field.best(html_text.features(blocks))
