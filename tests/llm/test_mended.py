"""Inputs that earlier versions of operators lost."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from workmill.llm import compression_toxicity, pruned_graph, redirect_blocks, text_density
from workmill.llm.queries import RULES


@pytest.mark.parametrize("size", [1e200, 1e-200, 1e-320])
def test_vectors_of_any_magnitude_find_each_other(spark, size):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=8) * size).tolist()) for i in range(40)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = pruned_graph.nearest(table, table.where("vec_id % 20 = 0"), top=20).collect()
    assert sorted((r.query_id, r.rank) for r in got) == [(q, k) for q in (0, 20) for k in range(1, 21)]


@pytest.mark.parametrize("long", [1e3, 1e5, 1e7])
def test_a_long_vector_does_not_spoil_the_others(spark, long):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1500, 32))
    x[77] *= long
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got: dict = {}
    for r in pruned_graph.nearest(table, table.where("vec_id % 20 = 0"), top=20).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    recall = []
    for q in range(0, 1500, 20):
        score = x @ x[q]
        score[q] = -np.inf
        recall.append(len(got[q] & set(np.argsort(-score, kind="stable")[:20].tolist())) / 20)
    assert np.mean(recall) >= 0.9


def test_every_link_of_a_page_counts(spark):
    bad = "http://bad.net/r"
    html = {
        1: f'<link rel=canonical><link rel="canonical" href="{bad}">',
        2: f'<link href="{bad}" rel="alternate canonical">',
        3: f"<link rel='canonical nofollow' href='{bad}'>",
        4: f'<link rel="canonical" href="http://c.com/4"><link rel=canonical href={bad}>',
        5: f'<meta http-equiv=refresh content="0"><meta http-equiv="refresh" content="0; url={bad}">',
        6: f'<link rel="notcanonical" href="{bad}">',
        7: f'<link rel="canonical-x" href="{bad}">',
        8: f'<link rel=canonicals href="{bad}">',
        9: "<link rel=canonical " * 3000,
    }
    pages = spark.createDataFrame([(0, bad, "")] + [(i, f"http://p{i}.com/", h) for i, h in html.items()], "page_id long, url string, html string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = {r.page_id: r.verdict for r in redirect_blocks.judge(pages, rules).collect()}
    assert got == {i: "block" if i <= 5 else "allow" for i in range(10)}


def test_labels_are_joined_by_id(spark):
    toxic = "vile gruk scum "
    rows = [(i, ("plain words about rivers and towns " * 4 if i % 4 else toxic * 12) + f" n{i}") for i in range(200)] + [(None, toxic), (5, None), (300, "")]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200) for _ in range(1 + i % 2)] + [(None, 1), (7, None), (999, 1)], "doc_id long, toxic int")
    model = compression_toxicity.fit(docs, labels.where(~compression_toxicity.held_out(F.col("doc_id"))))
    joined = compression_toxicity.fit(docs.drop("toxic").join(labels.where(~compression_toxicity.held_out(F.col("doc_id"))), "doc_id"))
    assert np.allclose(model["weights"], joined["weights"]) and model["toxic"] == joined["toxic"] and model["ordinary"] == joined["ordinary"]
    got = {r.doc_id: r.predicted for r in compression_toxicity.classify(docs, model).collect()}
    assert [got[i] for i in range(200)] == [int(i % 4 == 0) for i in range(200)]
    assert "constant" in compression_toxicity.fit(docs, labels.limit(0)) and "constant" in compression_toxicity.fit(docs.limit(0), labels)


TEXT = "The river rose in the night and the town woke to water in its streets, while boats were brought from the harbour. "


def article(inner, before="", after=""):
    return f"<html><body><nav><a href=/>Home</a> <a href=/b>News</a></nav>{before}<article><h1>Flood</h1><p>{TEXT * 2}</p>{inner}<p>{TEXT * 3}</p></article>{after}<footer>All rights</footer></body></html>"


WHOLE = ["Flood", (TEXT * 2).strip(), (TEXT * 3).strip()]


@pytest.mark.parametrize(
    ("inner", "own"),
    [
        ("<table><tr><td>Level</td><td>4 m</td></tr><tr><td>Rise</td><td>1 m</td></tr></table>", ["Level", "4 m", "Rise", "1 m"]),
        ("<div class='header'><h2>What came next</h2></div>", ["What came next"]),
        ("<div class='ad-banner'>Buy boats now, cheap boats for all the family and friends</div>", []),
        ("<div class='user_comments'>First! I saw it too, it was terrible to see that</div>", []),
        ("<div><a href=1>More</a> <a href=2>Links</a> <a href=3>Here</a></div><div><a href=4>And</a></div>", []),
    ],
)
def test_what_an_article_holds(inner, own):
    assert text_density.main_text(article(inner)).split("\n") == [*WHOLE[:2], *own, WHOLE[2]]


def test_sources_close_an_article():
    sources = "<ul><li><a href=a>First source</a></li><li><a href=b>Second source</a></li><li><a href=c>Third source</a></li></ul>"
    page = article("").replace("</article>", sources + "</article>")
    assert text_density.main_text(page).split("\n") == [*WHOLE, "First source", "Second source", "Third source"]


def test_a_class_name_does_not_empty_a_page():
    page = f"<body><div class='content login'><p>{TEXT * 3}</p><p>{TEXT}</p></div></body>"
    assert text_density.main_text(page).split("\n") == [(TEXT * 3).strip(), TEXT.strip()]
    page = f"<body><div class='user-comments'><p>I saw that too, it was a terrible thing</p></div><div><p>{TEXT * 3}</p></div></body>"
    assert text_density.main_text(page) == (TEXT * 3).strip()


@pytest.mark.parametrize("tag", ["div", "nav", "span", "article", "b class=menu", "p"])
def test_time_does_not_grow_with_nesting(tag):
    began = time.process_time()
    text_density.main_text(f"<{tag}>" * 50_000 + "<p>text " + "</i></div>" * 20_000)
    assert time.process_time() - began < 5


def test_generated_layouts(spark):
    """Pages of known text: articles, and plain divs among named boilerplate."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(2, 9)))
    pages = []
    for i in range(120):
        blocks = [" ".join(word() for _ in range(rng.randint(25, 80))) for _ in range(rng.randint(2, 7))]
        inner = "".join(rng.choice([f"<p>{b}</p>", f"<p>{b[:40]}<b>{b[40:60]}</b>{b[60:]}</p>", f"<blockquote>\n {b} </blockquote>"]) for b in blocks)
        body = f"<article>{inner}</article>" if i % 2 else f"<div id=c{i}>{inner}</div>"
        side = "".join(f"<li><a href=/{k}>{word()} {word()}</a></li>" for k in range(8))
        junk = [f"<nav><ul>{side}</ul></nav>", f"<aside>{word()} {word()}</aside>", f"<div class='sidebar'><ul>{side}</ul></div>", "<script>var a = '<p>no</p>';</script>", f"<form><input name=q><button>{word()}</button></form>"]
        rng.shuffle(junk)
        pages.append((i, f"http://x/{i}", f"<html><head><title>t</title><style>p{{}}</style></head><body>{''.join(junk[:3])}{body}{''.join(junk[3:])}<footer>{word()}</footer></body></html>", "\n".join(blocks)))
    table = spark.createDataFrame([(*p[:3], 1) for p in pages], "page_id long, url string, html string, n_chars int")
    got = {r.page_id: r.text for r in text_density.extract(table).collect()}
    assert got == {p[0]: p[3] for p in pages}
