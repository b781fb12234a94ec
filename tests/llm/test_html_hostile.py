"""Broken and deeply nested pages: the parser's time grows with their length, and nothing is lost."""

import time

import numpy as np
import pytest

from solvara.llm import html_text

MEGABYTE = 1_000_000


@pytest.mark.parametrize("unit", ["<a ", "<title>", "<div>", "<div>x", "<p><b>x", '<a ">"', "<li>x", "<td>x", "<script ", "<!--", "</div>", "<div class='"])
def test_a_megabyte_of_one_fragment(unit):
    page = unit * (MEGABYTE // len(unit))
    began = time.process_time()
    found = html_text.blocks(page)
    assert time.process_time() - began < 8  # seconds; hours where each tag looks through all open ones
    assert sum(t.count("x") for _, t, _ in found) == (page.count("x") if unit.endswith("x") else 0)


def test_features_of_deep_paths_with_many_names():
    names = ["".join(chr(97 + (k // 26**j) % 26) for j in range(4)) for k in range(20_000)]
    page = "".join(f"<div class={n}>x" for n in names)
    began = time.process_time()
    found = html_text.blocks(page)
    paths, words, measures = html_text.Features().of(found)
    assert len(found) == len(names) and len(found[-1][0]) == len(names) and time.process_time() - began < 20
    assert html_text.Labeller(1).predict([(paths, words, measures)])[0].shape == (len(names),)


def test_path_buckets_by_hand():
    """Buckets of a path: distance from the block (3 and further alike), tags anywhere, names anywhere."""
    path = ("html", "body", "div.page", "article.post.big", "ul", "li")
    names = {"0:li", "1:ul", "2:article", "3:div", "3:body", "3:html", "name:page", "name:post", "name:big"} | {f"in:{x.split('.')[0]}" for x in path}
    (buckets,), _, measures = html_text.Features().of([(html_text.Path.of(path), "a word.", 0.0)])
    assert buckets == sorted({html_text._bucket(x) for x in names}) and measures[0][6] == np.float32(len(path) / 8)
    features = html_text.Features()
    for _ in range(2):  # the same when paths are known, and after they were forgotten
        assert features.of([(html_text.Path.of(path), "a", 0.0), (html_text.Path(), "b", 0.0)])[0] == [buckets, []]
        features.forget()


def test_paths_are_sequences():
    ((path, text, _),) = html_text.blocks("<html><body class=main><p>a</p>")
    assert (list(path), path[-1], len(path), text) == (["html", "body.main", "p"], "p", 3, "a")
    ((path, _, _),) = html_text.blocks("bare text")
    assert list(path) == [] and len(path) == 0


def test_bag_of_shared_lists():
    table = np.arange(12, dtype=np.float64).reshape(6, 2)
    shared = [0, 2]
    got = html_text._bag(table, [shared, [], [5], shared])
    assert got.tolist() == [[2, 3], [0, 0], [10, 11], [2, 3]]
    assert html_text._bag(table, []).shape == (0, 2)
