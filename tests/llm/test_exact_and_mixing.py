"""Exact deduplication (cuckoo index) and source mixing."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from solvara.llm import exact_dedup as ed
from solvara.llm import mixing

DOCS = "doc_id long, text string, source string, kept string, keep_id int"


def lower(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def test_cuckoo_filter_insert_delete_grow():
    r = random.Random(1)
    keys = [hashlib.sha256(str(k).encode()).digest() for k in range(5000)]
    f = ed.CuckooFilter(16)
    start = f.bits
    assert all(f.insert(k) for k in keys) and not any(f.insert(k) for k in keys[:50])
    assert f.bits > start and all(k in f for k in keys)
    gone = set(r.sample(keys, 2500))
    assert all(f.delete(k) for k in gone) and not any(f.delete(k) for k in gone)
    assert [k in f for k in keys] == [k not in gone for k in keys]
    assert f.live == 2500 and sorted(x[0] for x in f.items()) == sorted(set(keys) - gone)
    for k in gone:
        f.insert(k, 2, 7)
    assert {x[0]: (x[1], x[2]) for x in f.items() if x[0] in gone} == {k: (2, 7) for k in gone}
    # the filter spares reading content: of unknown digests hardly any is compared
    f.read = 0
    assert not any(hashlib.sha256(f"y{k}".encode()).digest() in f for k in range(20_000)) and f.read < 40
    # a fingerprint hit alone is not taken for a copy
    near = next(h for k in range(10**6) if f.maybe(h := hashlib.sha256(f"x{k}".encode()).digest()))
    assert near not in f and f.insert(near)
    # copies go one by one, the digest with the last of them
    assert f.insert(b"z" * 32, 3, 5) and f.delete(b"z" * 32, 2) and b"z" * 32 in f and f.delete(b"z" * 32, 1) and b"z" * 32 not in f


def test_exact_duplicates_edges(spark):
    rows = [(1, "Ab c"), (5, "aB C"), (3, "Äb"), (4, "äb"), (6, None), (7, ""), (8, "x" * 300_000), (9, "X" * 300_000), (9, "X" * 300_000), (None, "solo"), (None, "solo")]
    df = spark.createDataFrame([(i, t, "s", "clash", 0) for i, t in rows], DOCS)
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in ed.exact_duplicates(df).collect()]
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    want = []
    for i, t in rows:
        ids = groups[lower(t)]
        keep = max((x for x in ids if x is not None), default=None)
        want.append((i, keep, len(ids), i == keep, hashlib.sha256(lower(t).encode()).hexdigest()))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert ed.exact_duplicates(df.limit(0)).count() == 0
    assert ed.deduplicate(df.where("doc_id < 6")).count() == 3


def test_deduplicate_by_id_and_text(spark):
    rows = [(5, "A"), (5, "B"), (9, "b"), (5, "a"), (None, "q"), (None, "Q"), (None, "b"), (3, None), (4, ""), (7, "x" * 100_000), (7, "X" * 100_000)]
    df = spark.createDataFrame([(i, t, "s", "clash", 0) for i, t in rows], DOCS).repartition(3)
    got = ed.deduplicate(df)
    assert got.columns == df.columns
    # of each text the row with the largest id; a repeated one counts once
    want = [(4, ""), (5, "a"), (7, "x" * 100_000), (9, "b"), (None, "q")]
    assert sorted(((r.doc_id, lower(r.text)) for r in got.collect()), key=str) == sorted(want, key=str)
    assert ed.deduplicate(df.limit(0)).count() == 0


def test_index_changes(spark):
    d = [hashlib.sha256(str(k).encode()).digest() for k in range(40)]
    index = ed.build_index(spark.createDataFrame([(k, d[k % 20]) for k in range(40)], "doc_id long, digest binary"), 4)
    assert {(bytes(r.digest), r.group_size, r.keep_id) for r in index.collect()} == {(d[k], 2, k + 20) for k in range(20)}
    changes = spark.createDataFrame([(d[0], None, None, False), (d[30], 1, 99, True), (d[1], 3, 500, True), (d[2], 1, None, False), (d[39], 1, None, False), (None, 1, 1, True)], "digest binary, copies long, doc_id long, add boolean")
    for shards in (None, 1, 4, 9):  # an index may be dealt to other shards
        made = ed.apply_changes(index, changes, shards).collect()
        live = {bytes(r.digest): (r.group_size, r.keep_id) for r in made}
        assert d[0] not in live and live[d[30]] == (1, 99) and live[d[1]] == (5, 500) and live[d[2]] == (1, 22) and len(live) == len(made) == 20
        assert {r.shards for r in made} == {shards or 4}
    again = ed.apply_changes(ed.apply_changes(index, changes), changes.limit(0)).collect()
    assert {bytes(r.digest) for r in again} == set(live)
    assert ed.apply_changes(None, changes, 2).count() == 2


def test_hot_group(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("text"))
    out = ed.exact_duplicates(df)
    assert out.where("kept").count() == 2001 and out.where("group_size = 1000 AND keep_id = 2997").count() == 1000


def fill(sizes, weights, total):
    """Targets by the words of the contract: cap and share the excess again until none is above."""
    caps, open_, target = [3.0 * s for s in sizes], set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        left = total - sum(caps[i] for i in range(len(sizes)) if i not in open_)
        share = {i: left * weights[i] / sum(weights[j] for j in open_) for i in open_}
        above = {i for i in open_ if share[i] > caps[i]}
        if not above:
            for i in open_:
                target[i] = share[i]
            break
        open_ -= above
        for i in above:
            target[i] = caps[i]
    return target


@pytest.mark.parametrize("seed", range(3))
def test_targets_and_thresholds(spark, seed):
    r = random.Random(seed)
    names = [None, "é", "a", "b", "z", "Z", "c"]
    big = r.choice(names)
    rows = []
    for k in range(900):
        s = big if r.random() < 0.7 else r.choice(names)
        rows.append((k, "w " * r.randint(0, 30), s, "x", 1))
    df = spark.createDataFrame(rows, DOCS)
    out = mixing.mix(df).join(df.select("doc_id", "source"), "doc_id").collect()
    size = {}
    for x in out:
        size[x.source] = size.get(x.source, 0) + x.size
    order = sorted(size, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, fill([size[s] for s in order], [k % 3 + 1 for k in range(len(order))], sum(size.values()))))
    taken = {}
    for x in out:
        assert x.source_size == size[x.source] and abs(x.target - want[x.source]) < 1e-6 and 0 <= x.taken <= 3 * x.size
        taken[x.source] = taken.get(x.source, 0) + x.taken
    assert all(abs(taken[s] - want[s]) <= 30 for s in order)
    again = {x.doc_id: x.taken for x in mixing.mix(df.repartition(5)).collect()}
    assert again == {x.doc_id: x.taken for x in out}
    times = {x.doc_id: x.times for x in out}
    mixed = mixing.repeat_rows(df).groupBy("doc_id").count().collect()
    assert {x.doc_id: x["count"] for x in mixed} == {k: v for k, v in times.items() if v}


def test_mix_edges(spark):
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    df = spark.createDataFrame([(1, None, None, "", 1), (1, None, None, "", 1), (None, "a\x0bb c", "s", "", 1)], DOCS)
    got = sorted(((r.doc_id, r.size, r.taken) for r in mixing.mix(df).collect()), key=str)
    assert got == [(1, 0, 0), (1, 0, 0), (None, 2, 2)]
    assert mixing.repeat_rows(df).columns == df.columns


def test_many_sources_take_another_way_to_the_same_mix(spark, monkeypatch):
    r = random.Random(11)
    rows = [(k, "w " * r.randint(0, 30), r.choice([None, *(f"s{j}" for j in range(40))]) if k % 3 else "hot", "x", 1) for k in range(1500)]
    df = spark.createDataFrame(rows, DOCS)
    few = {x.doc_id: (x.source_size, round(x.target, 6), x.taken) for x in mixing.mix(df).collect()}
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 3)
    assert {x.doc_id: (x.source_size, round(x.target, 6), x.taken) for x in mixing.mix(df).collect()} == few
