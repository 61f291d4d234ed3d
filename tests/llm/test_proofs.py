"""Fitted and decoded models against exhaustive search, on inputs small enough for it."""

from __future__ import annotations

import itertools
import random
import time

import numpy as np
import pytest

from lodestrata.llm import html_extract, quality

# --- HTML


def tree(rng, n):
    """A page of n nested elements, and for each the element that holds it."""
    open_, source = [], ""
    for k in range(n):
        while open_ and rng.random() < 0.4:
            source += f"</{open_.pop()}>"
        open_.append(f"x{k}")
        source += f"<x{k}>"
    return html_extract.Page(source)


def test_choices_are_the_best_of_all():
    """Of all sets of nodes that hold the whole subtree of each of their nodes."""
    rng, numbers = random.Random(4), np.random.default_rng(4)
    for _ in range(60):
        page = tree(rng, rng.randrange(1, 9))
        n = len(page.tags)
        odds = numbers.normal(size=n)
        best = max(odds[list(s)].sum() for k in range(n + 1) for s in itertools.combinations(range(n), k) if all(j in s for j in range(1, n) if page.parents[j] in s))
        chosen = page.choose(odds)
        assert odds[chosen].sum() == pytest.approx(best)
        assert all(chosen[j] for j in range(1, n) if chosen[page.parents[j]])


def test_equal_sums_take_the_whole_subtree_and_zero_is_not_taken():
    page = html_extract.Page("<a><b></b></a>")
    assert page.choose(np.array([-5.0, 0.0, 1.0])).tolist() == [False, True, True]
    assert page.choose(np.zeros(3)).tolist() == [False] * 3


def test_first_split_has_the_greatest_gain():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 6, (300, 4)).astype(float)
    y = (x[:, 2] + rng.normal(size=300) > 3).astype(float)
    model = html_extract.Boosted().fit(x, y)
    g = y - y.mean()
    h = np.full(300, y.mean() * (1 - y.mean()))

    def gain(f, cut):
        left = x[:, f] <= cut
        return sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (left, ~left))

    best = max(gain(f, cut) for f in range(4) for cut in np.unique(x[:, f]))
    assert gain(model.feature[0, 0], model.cut[0, 0]) == pytest.approx(best)
    # A leaf's value is the Newton step of its rows, and what all trees add up to is what they predict.
    node = np.zeros(300, int)
    for _ in range(html_extract.DEPTH):
        node = node * 2 + 1 + (x[np.arange(300), model.feature[0, node]] > model.cut[0, node])
    for k in np.unique(node):
        rows = node == k
        assert model.leaf[0, k - (2**html_extract.DEPTH - 1)] == pytest.approx(html_extract.RATE * g[rows].sum() / (h[rows].sum() + 1))
    p = 1 / (1 + np.exp(-model.odds(x)))
    assert -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)) < 0.8 * -np.mean(y * np.log(y.mean()) + (1 - y) * np.log(1 - y.mean()))


@pytest.mark.parametrize("piece", ["<div>", "</x>", "<b><p>", "<a ", '<a "', "<a '\"", "<!", "</script", "<a<", "<div></x>", "<a b='\"' ", "<a \"'", "&#9", "<script>"])
def test_html_work_is_linear(piece):
    began = time.process_time()
    page = html_extract.Page(piece * (1_000_000 // len(piece)) + "x")
    page.text(page.choose(np.ones(len(page.tags))))
    page.features()
    assert time.process_time() - began < 60


def test_endless_references_are_text():
    page = html_extract.Page("<p>a&#" + "9" * 100_000 + ";b &#x" + "f" * 50 + " &amp; &#65;")
    assert page.texts == [(1, "a�b � & A")]


@pytest.mark.parametrize(("source", "tags", "texts"), [
    ("<p>a<p>b", ["p", "p"], ["a", "b"]),
    ("<a \"<b>x<i>y", ["i"], ["<a \"<b>x", "y"]),
    ("a<b", [], ["a<b"]),
    ("<!-- <p> --><em x='>'>q</EM>r", ["em"], ["q", "r"]),
    ("<ul><li>1<li>2<ul><li>3</ul><li>4</ul>", ["ul", "li", "li", "ul", "li", "li"], ["1", "2", "3", "4"]),
])
def test_markup(source, tags, texts):
    page = html_extract.Page(source)
    if source.startswith("<a"):
        tags, texts = ["b", "i"], ['<a "', "x", "y"]
    assert page.tags[1:] == tags and [t for _, t in page.texts] == texts


# --- quality


def objective(w, b, rows, scale, y, cost):
    margins = np.array([w[r] @ scale[r] + b for r in rows])
    return (w @ w + b * b) / 2 + (cost * np.maximum(0, 1 - y * margins)).sum()


def test_dual_descent_reaches_the_primal_optimum():
    rng = np.random.default_rng(3)
    rows = [rng.choice(12, 4, replace=False) for _ in range(80)]
    y = np.where([rng.random() < (0.85 if 3 in r or 4 in r else 0.15) for r in rows], 1.0, -1.0)
    scale, cost = rng.uniform(0.3, 2, 12), np.where(y > 0, 1.5, 0.7)
    w, b = quality.dual_descent(rows, scale, y, cost, epochs=3000)
    got = objective(w, b, rows, scale, y, cost)
    # A plain solver of the primal: subgradient steps, the best point seen.
    v, c, best = np.zeros(12), 0.0, np.inf
    for t in range(1, 3000):
        g, h = v.copy(), c
        for r, s, k in zip(rows, y, cost, strict=True):
            if s * (v[r] @ scale[r] + c) < 1:
                g[r] -= k * s * scale[r]
                h -= k * s
        v, c = v - g / (t + 20), c - h / (t + 20)
        if t % 50 == 0:
            best = min(best, objective(v, c, rows, scale, y, cost))
    assert got <= best * 1.001
    for _ in range(300):  # no small step does better
        assert objective(w + rng.normal(size=12) * 1e-2, b + rng.normal() * 1e-2, rows, scale, y, cost) >= got - 1e-6


def test_ratios_are_log_counts_of_smoothed_classes():
    rows = [np.array([0, 1]), np.array([0]), np.array([1, 2])]
    positive = np.array([True, True, False])
    made, bias = quality.head(rows, positive, 3)
    p, q = np.array([2, 1, 0]) + quality.SMOOTHING, np.array([0, 1, 1]) + quality.SMOOTHING
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    w, b = quality.dual_descent(rows, ratio, np.array([1.0, 1.0, -1.0]), quality.COST * np.array([3 / 4, 3 / 4, 3 / 2]))
    assert np.allclose(made, w * ratio) and bias == pytest.approx(b)
    assert quality.head(rows, np.ones(3, bool), 3) is None


def test_features_of_one_document_count(spark):
    """No feature is left out for being rare."""
    docs = spark.createDataFrame([(1, "good words here"), (2, "bad things there")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    assert model["mask"].sum() == 10
    assert {r.doc_id: r.keep for r in quality.classify(docs, model).collect()} == {1: True, 2: False}


def test_thresholds_reject_the_share_of_clean_documents():
    rng = np.random.default_rng(1)
    positive = rng.random(2000) < 0.8
    rows = [np.unique(np.concatenate([rng.choice(40, 5) + (0 if p else 30), rng.choice(70, 3)])) for p in positive]
    at = quality.threshold(rows, positive, positive, 70, 0.05)
    out = np.arange(2000) % quality.HELD_OUT == 0
    w, b = quality.head([rows[i] for i in np.flatnonzero(~out)], positive[~out], 70)
    below = [w[rows[i]].sum() + b < at for i in np.flatnonzero(out & positive)]
    assert np.mean(below) == pytest.approx(0.05, abs=0.01)
    assert quality.threshold(rows[:1], positive[:1], positive[:1], 70, 0.05) == 0.0
