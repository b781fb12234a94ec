"""The Jaccard join against all pairs, in blocks of every size."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from solvara.llm import jaccard_join as jj

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if len(w) < 5:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4))


def brute(rows):
    """(n, component) of each row position; rows of one id are separate documents."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            o = len(a & sets[j])
            if o and 100 * o >= 80 * (len(a) + len(sets[j]) - o):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    passage = [" ".join(r.choices(vocab, k=60)) for _ in range(2)]
    rows = []

    def add(t):
        rows.append((len(rows) * 3 + 5, t))

    for _ in range(60):
        add(" ".join(r.choices(vocab, k=r.choice([3, 5, 7, 40, 120]))))
    for size, change in ((40, 2), (25, 4), (30, 8)):  # families around the threshold
        base = r.choices(vocab, k=150)
        for _ in range(size):
            own = list(base)
            for _ in range(r.randint(0, change)):
                own[r.randrange(len(own))] = r.choice(vocab)
            add(" ".join(own))
    for _ in range(20):  # documents of shared passages with a little of their own
        add(" ".join([r.choice(passage), *r.choices(vocab, k=r.randint(0, 14))]))
    for k in range(10):
        add(rows[k * 3][1].upper())
    for n in (4, 5):  # sets of four and five shingles: overlap exactly 80 %
        add(" ".join(f"s{k}" for k in range(n + 4)))
    for t in (None, "", " \t\n", "one", "One", "one two", "x y z w"):
        add(t)
    rows += [(rows[3][0], rows[3][1]), (rows[4][0], "entirely other text of the same id here"), (None, rows[5][1]), (None, "nobody knows me at all today"), (2, " ".join(r.choices(vocab, k=20_000)))]
    return rows


@pytest.mark.parametrize(("seed", "tree", "often", "shard"), [(1, 4096, 16, 2_000_000), (2, 7, 2, 300), (3, 16, 3, 40), (4, 2, 2, 100), (5, 3, 50, 60)])
def test_components_equal_brute_force(spark, monkeypatch, seed, tree, often, shard):
    for name, value in (("TREE_DOCS", tree), ("TREE_TOKENS", 900 * tree), ("OFTEN", often), ("SHARD_TOKENS", shard), ("FLUSH_DOCS", 20)):
        monkeypatch.setattr(jj, name, value)
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, component_id int").repartition(3)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jj.near_duplicates(df).collect()), key=str)
    assert got == brute(rows)


def test_empty_and_blank(spark):
    schema = "doc_id long, text string"
    assert jj.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    got = jj.near_duplicates(spark.createDataFrame([(3, None), (1, ""), (2, " ")], schema)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]


def test_one_of_each(spark):
    text = " ".join(f"w{k}" for k in range(50))
    rows = [(4, text, "a"), (2, text + " end", "b"), (2, text + " end", "b"), (9, "short one", None), (None, "x", None), (None, "x", None), (None, "", None), (None, None, None), (9, "", None), (9, "", None)]
    # unrelated texts of one id, each the least of its group
    other = [" ".join(f"{p}{k}" for k in range(40)) for p in "pq"]
    rows += [(5, other[0], "c"), (5, other[1], "d"), (6, other[0] + " more", "e"), (7, other[1].upper(), "f"), (None, other[0], "g"), (5, "nobody has this text but id five", "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, rows string")
    got = jj.one_of_each(df)
    assert got.columns == df.columns
    want = [(2, text + " end"), (9, "short one"), (None, "x"), (None, ""), (None, None), (9, ""), (9, ""), (5, other[0]), (5, other[1]), (5, rows[-1][1])]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize(("seed", "tree"), [(1, 4096), (2, 7)])
def test_all_links(spark, monkeypatch, seed, tree):
    monkeypatch.setattr(jj, "TREE_DOCS", tree)
    rows = corpus(seed)
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets = [shingles(t) for _, t in rows]
    linked = {(i, j) for i in range(len(sets)) for j in range(len(sets)) if i != j and sets[i] and 100 * (o := len(sets[i] & sets[j])) >= 80 * (len(sets[i]) + len(sets[j]) - o)}
    members, links = jj.near_links(df)
    keys = {}
    for m in members.collect():
        if m.n:
            keys.setdefault(bytes(m.set_key), []).append(m.doc_id)
    pairs = links.collect()
    assert len(pairs) == len({(bytes(p.a), bytes(p.b)) for p in pairs}) and all(p.a < p.b for p in pairs)
    got = {(i, j) for ids in keys.values() for i in ids for j in ids if i != j}
    got |= {x for p in pairs for i in keys[bytes(p.a)] for j in keys[bytes(p.b)] for x in ((i, j), (j, i))}
    assert got == linked
    counted = {r.doc_id: r.n_links for r in jj.link_counts(df).collect()}
    per = collections.Counter(i for i, _ in linked)
    assert counted == {k: per[k] for k, _ in rows}


def test_repeated_rows_stay_few(spark):
    # one id and text in a third of all rows: each set is read once, so nothing grows with the square of its rows
    text = " ".join(f"w{k}" for k in range(30))
    df = spark.createDataFrame([(7, text)] * 1500 + [(None, text)] * 500 + [(k + 10, f"{text} x{k}") for k in range(40)] + [(k + 100, " ".join(f"o{k}_{j}" for j in range(9))) for k in range(2000)], "doc_id long, text string").repartition(5)
    _, _, _, sets = jj._prepared(df, 5, 80)
    assert sets.count() == sets.select("set_key").distinct().count() == 41
    assert jj.one_of_each(df).count() == 2001
    assert {(r.component_id, r["count"]) for r in jj.near_duplicates(df).groupBy("component_id").count().where("count > 1").collect()} == {(7, 2040)}


def test_traversal_loses_no_link():
    r = np.random.default_rng(5)
    base = r.integers(1, 2**62, 120).astype(np.uint64)
    sets = []
    for _ in range(90):
        own = base.copy()
        at = r.integers(0, 120, r.integers(0, 30))
        own[at] = r.integers(1, 2**62, len(at)).astype(np.uint64)
        sets.append(np.unique(own[: r.integers(60, 120)]))
    order = jj._tree_order(sets)
    sets = [sets[k] for k in order]
    for bits in (512, 4096):
        tree = jj.SignatureTree(sets, bits)
        found = jj.dual_traversal(tree, None, 80, np.arange(len(sets)))
        labels = list(range(len(sets)))

        def same(links):
            lab = list(labels)
            for a, b in links:
                lab = [lab[a] if x == lab[b] else x for x in lab]
            return collections.Counter(collections.Counter(lab).values()), [[lab[i] == lab[j] for j in range(i)] for i in range(len(lab))]

        want = [(i, j) for i in range(len(sets)) for j in range(i) if jj.linked(sets[i], sets[j], 80)]
        assert same(found) == same(want)


def test_hot_family_rows(spark):
    # a third of all rows in one group of near copies
    base = [f"w{k}" for k in range(60)]
    near = [(k, " ".join([*base[: k % 60], f"x{k}", *base[k % 60 :]])) for k in range(300)]
    other = [(1000 + k, " ".join(f"o{k}_{j}" for j in range(20))) for k in range(600)]
    df = spark.createDataFrame(near + other, "doc_id long, text string")
    out = jj.near_duplicates(df).groupBy("component_id").agg(F.count("*").alias("n")).where("n > 1").collect()
    assert [(r.component_id, r.n) for r in out] == [(0, 300)]
