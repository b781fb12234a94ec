"""Suffix-array decontamination against a direct search."""

import hashlib
import random
import re

from solvara.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items):
    windows = []
    for i, t in items:
        w = words(t)
        m = min(10, len(w))
        if m and i is not None:
            windows += [(str(i), tuple(w[j : j + m])) for j in range(len(w) - m + 1)]
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        at = {}
        for j in range(len(w)):
            for m in {len(x) for _, x in windows}:
                if j + m <= len(w):
                    at.setdefault(tuple(w[j : j + m]), []).append(j)
        for i, x in windows:
            for j in at.get(x, ()):
                hit.update(range(j, j + len(x)))
                found.add(i)
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def setup(seed):
    r = random.Random(seed)
    vocab = ["Aa", "b", "ç", "d9", "e", "éÉ", "g", "h_i", "j-k", "LL"]
    text = lambda n: "".join(r.choice(vocab) + r.choice([" ", ", ", "\n", "  "]) for _ in range(n))
    items = [(k, text(r.choice([0, 1, 3, 9, 10, 11, 30]))) for k in range(12)] + [(100, None), (None, "a b c"), (5, text(12))]
    docs = [(k, text(r.randint(0, 60))) for k in range(40)]
    docs += [(200 + k, text(5) + items[k % 12][1].upper() + text(4)) for k in range(24)]
    docs += [(300, None), (301, ""), (302, "... --"), (303, (items[6][1] + " zzz ") * 400), (None, items[7][1]), (200, items[8][1])]
    return docs, items


def brute_spans(docs, items):
    """All matches that can't be made longer, item by item, from every pair of places."""
    out = {}
    for d, (_, t) in enumerate(docs):
        w, found = words(t), set()
        for i, x in items:
            v = words(x)
            least = min(10, len(v))
            if not least or i is None:
                continue
            for a in range(len(w)):
                for b in range(len(v)):
                    if a and b and w[a - 1] == v[b - 1] or w[a] != v[b]:
                        continue
                    n = 0
                    while a + n < len(w) and b + n < len(v) and w[a + n] == v[b + n]:
                        n += 1
                    if n >= least:
                        found.add((a, a + n, str(i), b))
        # of an item's matches those inside another of the same item are not the longest there
        whole = {(a, e, i) for a, e, i, _ in found if not any(j == i and (x, y) != (a, e) and x <= a and e <= y for x, y, j, _ in found)}
        out[d] = {(a, e, i): min(b for x, y, j, b in found if (x, y, j) == (a, e, i)) for a, e, i in whole}
    return out


def test_longest_matches_equal_brute_force(spark, monkeypatch):
    for seed, block, piece in ((4, 500_000, 100_000), (5, 40, 100_000), (6, 25, 12)):
        monkeypatch.setattr(dc, "BLOCK_WORDS", block)
        monkeypatch.setattr(dc, "PIECE_WORDS", piece)
        docs, items = setup(seed)
        items = [x for x in items if x[0] != 5]  # one text for each id
        items += [(5, "g h_i " * 7)] if piece > 50 else []  # a periodic one
        docs = [(k, t) for k, (_, t) in enumerate(docs) if t is None or len(t) < 900] + [(900, "x g h_i g h_i g h_i g h_i g h_i g h_i g h_i g h_i g y"), (901, items[6][1] + items[7][1] + items[10][1])]
        got = {r.doc_id: r for r in dc.contamination_report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
        want = brute_spans(docs, items)
        for k, (d, _) in enumerate(docs):
            spans = {(m.start, m.end, m.item_id): m.item_start for m in got[d].matches}
            assert set(spans) == set(want[k]) and got[d].longest == max((e - a for a, e, _ in want[k]), default=0)
            if piece > 50:
                assert spans == want[k]


def test_neighbouring_windows_of_two_items(spark):
    a, b = [f"a{k}" for k in range(12)], [f"b{k}" for k in range(10)]
    bench = spark.createDataFrame([(1, " ".join(a)), (2, " ".join([*a[1:10], b[0]])), (3, "x y z")], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join([*a[:10], b[0], "x", "y", "z"]))], "doc_id long, text string")
    row = dc.contamination_report(docs, bench).first()
    assert [tuple(m) for m in row.matches] == [(0, 10, "1", 0), (1, 11, "2", 0), (11, 14, "3", 0)]
    assert (row.longest, row.n_hit, row.n_items) == (10, 14, 3)


def test_equals_brute_force(spark, monkeypatch):
    for seed, block, piece in ((1, 500_000, 100_000), (2, 15, 100_000), (3, 40, 11)):
        monkeypatch.setattr(dc, "BLOCK_WORDS", block)  # small blocks: several passes
        monkeypatch.setattr(dc, "PIECE_WORDS", piece)  # small pieces: items longer than one
        docs, items = setup(seed)
        df = spark.createDataFrame([(d, t, 7) for d, t in docs], "doc_id long, text string, n_hit int")
        bench = spark.createDataFrame(items, "item_id long, text string")
        got = dc.contamination_report(df, bench).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got), key=str) == brute(docs, items)


def test_long_match_and_removal(spark):
    passage = " ".join(f"p{k}" for k in range(80))
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    df = spark.createDataFrame([(1, "before " + passage + " after", "x"), (2, "clean words only", "y"), (3, " ".join(passage.split()[20:60]), "z"), (4, None, None)], "doc_id long, text string, contaminated string")
    assert {r.doc_id: r.longest for r in dc.contamination_report(df, bench).collect()} == {1: 80, 2: 0, 3: 40, 4: 0}
    kept = dc.decontaminate(df, bench)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [2, 4]


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in dc.contamination_report(docs, bench).collect()] == [False]
    assert dc.contamination_report(docs.limit(0), bench).count() == 0
