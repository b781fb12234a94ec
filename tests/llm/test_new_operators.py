"""Sharding, hard negatives and collocations against brute force, and their odd inputs."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from solvara.llm import collocations as co
from solvara.llm import hard_negatives as hn
from solvara.llm import sharding as sh

# ---------------------------------------------------------------- sharding


@pytest.mark.parametrize("n", [1, 2, 3, 17, 100, 101, 2503])
def test_permutation_and_inverse(spark, n):
    rows = spark.range(n).withColumn("p", F.col("id"))
    image = {r.id: r.p for r in sh.permuted(rows, "p", n).collect()}
    assert sorted(image.values()) == list(range(n))
    back = {r.id: r.p for r in sh.permuted(rows, "p", n, inverse=True).collect()}
    assert all(back[p] == i for i, p in image.items())
    for i, p in image.items():
        assert sh.place_of(i, n, 4) == (p % 4, p // 4) and sh.row_at(p % 4, p // 4, n, 4) == i
    assert n < 17 or image != {r.id: r.p for r in sh.permuted(rows, "p", n, key=7).collect()}


def test_shards_whole_and_reproducible(spark):
    rows = [(k % 40 if k % 7 else None, None if k % 11 == 0 else "é" * (k % 13), k, "x") for k in range(300)] + [(5, "same", 0, "x")] * 200
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int, slot string")
    got = sh.sharded(df, 6).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert (r.shard, r.slot) == sh.place_of(r.row, len(rows), 6)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and sorted(slots) == list(range(6))
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    # rows are numbered by id and digest, nulls first
    order = [r.doc_id for r in sorted(got, key=lambda r: r.row)]
    assert order == sorted(order, key=lambda x: (x is not None, x or 0))
    # the same places however the table is partitioned and ordered
    random.Random(3).shuffle(rows)
    again = sh.sharded(spark.createDataFrame(rows, df.schema).repartition(7), 6).collect()
    same = lambda rs: Counter((r.doc_id, r.text_crc32, r.row, r.shard, r.slot) for r in rs)
    assert same(got) == same(again)
    assert sh.sharded(df.limit(0)).collect() == []


def test_written_shards_read_by_place(spark, tmp_path):
    df = spark.createDataFrame([(k, f"text {k}", f"own {k}") for k in range(50)], "doc_id long, text string, extra string")
    path = f"file://{tmp_path}/shards"
    sh.write_shards(df, path, 4)
    got = spark.read.parquet(path)
    assert sorted(got.columns) == ["doc_id", "extra", "row", "shard", "slot", "text"] and got.count() == 50
    one = got.where("shard = 2 AND slot = 3").first()
    assert one.row == sh.row_at(2, 3, 50, 4) and one.text == f"text {one.doc_id}" and one.extra == f"own {one.doc_id}"


# ---------------------------------------------------------------- hard negatives

VECTORS = "vec_id long, embedding array<double>, label int, anchor_id int, q string"


def brute(rows, every=100):
    kept = []
    for i, v, y, *_ in rows:
        if i is None or y is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, (y + 1) % 10 if i % 7 == 0 else y, [math.floor(256 * x) for x in v]))
    out = []
    for i, y, q in kept:
        if i % every:
            continue
        scores = sorted(((sum(a * b for a, b in zip(q, w)), j, z) for j, z, w in kept), key=lambda s: (-s[0], s[1]))
        for s, j, _ in [x for x in scores if x[2] == y and x[1] != i][:5]:
            near = [x for x in scores if x[2] != y and 80 * s <= 100 * x[0] <= 100 * s][:5]
            out += [(i, j, k + 1, x[1], s, x[0]) for k, x in enumerate(near)]
    return sorted(out)


def test_hard_negatives_against_brute_force(spark, monkeypatch):
    r = random.Random(5)
    rows = [(k, [r.gauss(0, 1) + (k % 5) for _ in range(6)], r.randrange(4), 0, "clash") for k in range(1, 900)]
    rows += [(k, [1.0] * 6, k % 3, 0, "copy") for k in range(1000, 1300)]  # a large group of equal vectors: ties by id
    rows += [(2000, None, 1, 0, ""), (2001, [1.0, None], 1, 0, ""), (2002, [float("nan")] * 6, 1, 0, ""), (2003, [float("inf")], 1, 0, ""), (2100, [1.0] * 6, None, 0, ""), (None, [9.0] * 6, 1, 0, "")]
    rows += [(2200, [], 1, 0, "none"), (2300, [2.0], 2, 0, "short"), (2400, [-1.0] * 8, 2, 0, "long")]
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    want = brute(rows)
    assert len(want) > 50 and sorted(map(tuple, hn.hard_negatives(df).collect())) == want
    # small tiles, blocks and leaves change the work, not the result
    monkeypatch.setattr(hn, "BLOCK", 3)
    monkeypatch.setattr(hn, "tiles", lambda rows, f=hn.tiles: f(rows, 50, 3))
    assert sorted(map(tuple, hn.hard_negatives(df).collect())) == want
    assert hn.hard_negatives(df.limit(0)).collect() == []


def test_large_products_stay_exact(spark):
    rows = [(100, [5e6, 1.0], 1, 0, ""), (1, [5e6, 1.0], 1, 0, ""), (2, [5e6 - 1, 3.0], 2, 0, ""), (3, [5e6, 0.996], 3, 0, "")]
    got = sorted(map(tuple, hn.hard_negatives(spark.createDataFrame(rows, VECTORS)).collect()))
    assert got == brute(rows) and len(got) == 2 and got[0][4] > 2**53
    with pytest.raises(Exception, match="fit into a long"):
        hn.hard_negatives(spark.createDataFrame([(100, [1e12], 1, 0, ""), (1, [1e12], 1, 0, "")], VECTORS)).collect()


def test_tree_prunes_boxes_out_of_reach():
    r = np.random.default_rng(1)
    v = np.floor(np.concatenate([r.normal(c, 3, (500, 4)) for c in (-200, 0, 200)]))
    tree, boxes = hn.Tree.pack(np.arange(1500), np.ones(1500, int), v, leaf=16), [0, 0]
    found = hn.Found(v[[1400]], np.array([1400]), np.array([1]), np.arange(1), np.array([-np.inf]), np.array([np.inf]), True)
    tree.search(found, boxes)
    best = sorted((-int(s), k) for k, s in enumerate(v @ v[1400]) if k != 1400)[:5]
    assert [(-s, i) for _, s, i in zip(*found.held)] == best and boxes[0] < boxes[1] / 2


# ---------------------------------------------------------------- collocations


def brute_phrases(rows, least, first=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate({c: c + 32 for c in range(65, 91)})):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f[lang].update(" ".join(w[i : i + m]) for m in range(1, 6) for i in range(len(w) - m + 1))
    out = []
    for lang in f:
        good = {p: a for p, a in f[lang].items() if " " in p and a >= least}
        rows = []
        for p, a in good.items():
            w = p.split(" ")
            cuts = [(1000 * a * n[lang] // (f[lang][" ".join(w[:k])] * f[lang][" ".join(w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            if not any(f" {p} " in f" {q} " and b >= a for q, b in good.items() if len(q.split(" ")) > len(w)):
                rows.append((-score, -a, p.encode(), f[lang][" ".join(w[:k])], f[lang][" ".join(w[k:])]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:first])]
    return sorted(out)


def corpus():
    r = random.Random(9)
    vocab = ["Alpha", "beta", "GAMMA", "délta", "ε", "zeta", "a", "the", "x\x0bq", "\x1ck", "\xa0n"]
    rows = [(r.choice(["en", "de", None, "und"]), "".join(r.choice(vocab) + r.choice([" ", " ", "  ", "\t", ", ", ".", "\n", " !"]) for _ in range(r.randrange(60)))) for _ in range(400)]
    rows += [("en", "one two three four five six. " * 30), ("en", "a a a a a a a a"), ("en", None), ("fr", ""), ("fr", "once only"), ("en", "very long " * 40_000), ("en", "...;;;")]
    return rows


def test_collocations_against_brute_force(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame([(lang, text, "clash", 1) for lang, text in rows], "lang string, text string, word string, f int").repartition(3)
    want = brute_phrases(rows, 12)
    assert len(want) > 100 and sorted(map(tuple, co.collocations(df, 12).collect())) == want
    assert sorted(map(tuple, co.collocations(df, 12, first=7).collect())) == brute_phrases(rows, 12, 7)
    # several dictionaries, tries and chunks
    for name, value in (("DICTIONARY_WORDS", 5), ("TRIE_PHRASES", 20), ("CHUNK_POSITIONS", 500), ("CHUNK_BYTES", 1000), ("ROW_CODES", 50)):
        monkeypatch.setattr(co, name, value)
    assert sorted(map(tuple, co.collocations(df, 12).collect())) == want


def test_collocations_without_phrases(spark):
    for rows in ([], [("en", None)], [("en", "a b c d e")], [("en", "w. " * 500)]):
        assert co.collocations(spark.createDataFrame(rows, "lang string, text string")).collect() == []


def test_double_array_holds_exactly_its_phrases():
    r = np.random.default_rng(2)
    phrases = sorted({(int(r.integers(3)), *map(int, r.zipf(1.4, 3).clip(max=5000)), 0) for _ in range(3000)} | {(1, k, 0, 0, 0) for k in range(1, 3000)})
    a = np.array(phrases)
    trie = co.DoubleArray.build(3, a[:, 0], a[:, 1:], np.arange(len(a)))
    state = a[:, 0] + 1
    for d in range(1, 4):
        state = np.where(a[:, d] > 0, trie.step(state, a[:, d]), state)
    assert (trie.ids[state] == np.arange(len(a))).all()
    probe = np.column_stack([r.integers(0, 3, 5000), r.integers(1, 20, (5000, 3))])
    state = probe[:, 0] + 1
    for d in range(1, 4):
        state = trie.step(state, probe[:, d])
    known = set(phrases)
    assert [bool(s) and trie.ids[s] >= 0 for s in state] == [(*map(int, p), 0) in known for p in probe]
