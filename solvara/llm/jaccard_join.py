"""Exact Jaccard join of documents on word shingles with signature trees.

A signature tree holds documents at its leaves; each node has the OR of its documents' token
bitmaps, their range of set sizes and the most tokens that share a bit.  Two trees are walked
together, and a pair of nodes is left out when the largest overlap that its bitmaps allow is
below the least that its sizes require.  What remains is verified on the full sets.

Trees are small and live inside tasks; which documents meet is decided by three exact steps:

1. *Shared shingles.*  All shingles are dealt to shards by hash and those that stand in two
   documents are counted back to their documents.  A document with less than 80 % of shared
   shingles can't link, so that only members of near-copy groups go on.
2. *Blocks.*  These documents meet by their first few shingles (rare ones first), in blocks of
   bounded size; a tree joined with itself gives links, and the links give components.
3. *Remainder.*  Two linked documents share a shingle of their prefixes (the first fifth of the
   shingles in one fixed order).  Groups of different components that share one are joined tree
   against tree, so no link between components is missed whatever the blocks left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from solvara.llm.common import components, join_groups, materialize, repeated_ids, rows_of_ids, small_batches, text_bytes

SHINGLE, PERCENT = 5, 80
#: Tokens in one shard of the shared-shingle count, and documents of one map-side block.
SHARD_TOKENS, FLUSH_DOCS = 2_000_000, 4096
#: Entries of the table of frequent shingles, which only steers the order, and the documents that
#: make one frequent; documents and tokens in one tree.
FREQUENT, OFTEN, TREE_DOCS, TREE_TOKENS = 50_000, 16, 1024, 1_000_000
FANOUT, FIRST = 16, 2
MULT, MIX1, MIX2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
U64 = np.uint64


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(30))) * MIX1
    h = (h ^ (h >> U64(27))) * MIX2
    return h ^ (h >> U64(31))


def shingle_sets(texts: list[bytes | None], k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted 64-bit tokens of the distinct ``k``-word shingles of each text.

    A-Z is lower-cased; ASCII white space separates words; a text of fewer words, but not none,
    is one shingle.
    """
    each = [(t or b"").lower().split() for t in texts]
    lengths = [len(w) for w in each]
    codes = np.fromiter((x for w in each for x in map(xxhash.xxh3_64_intdigest, w)), dtype=U64, count=sum(lengths))
    with np.errstate(over="ignore"):
        wide = max(len(codes) - k + 1, 0)
        h = np.zeros(wide, dtype=U64)
        for i in range(k):
            h = (h + codes[i : i + wide]) * MULT
        h = _finish(h)
        out, start = [], 0
        for n in lengths:
            if n >= k:
                own = h[start : start + n - k + 1]
            elif n:
                own = np.array([n], dtype=U64)
                for c in codes[start : start + n]:
                    own = _finish((own + c) * MULT)
            else:
                own = h[:0]
            out.append(np.unique(own))
            start += n
    return out


def set_key(tokens: np.ndarray) -> bytes:
    """16 bytes that name a set; equal sets have equal keys."""
    return xxhash.xxh3_128_digest(tokens.tobytes())


# ---------------------------------------------------------------- signature trees


class SignatureTree:
    """Documents sorted by set size; ``levels[0]`` are documents, each level above groups ``FANOUT``."""

    def __init__(self, sets: list[np.ndarray], bits: int):
        self.sets = sets
        size = np.array([len(s) for s in sets], dtype=np.int64)
        bitmap = np.zeros((len(sets), bits // 64), dtype=U64)
        for k, s in enumerate(sets):
            at = (s & U64(bits - 1)).astype(np.int64)
            np.bitwise_or.at(bitmap[k], at >> 6, U64(1) << (at & 63).astype(U64))
        excess = size - np.bitwise_count(bitmap).sum(1, dtype=np.int64)
        self.levels = [(bitmap, size, size, excess)]
        while len(self.levels[-1][1]) > 1:
            b, low, high, e = self.levels[-1]
            cut = np.arange(0, len(low), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(b, cut, axis=0), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(e, cut)))


def bits_for(sets: list[np.ndarray]) -> int:
    typical = int(np.median([len(s) for s in sets])) if sets else 1
    return int(min(max(1 << (4 * typical - 1).bit_length(), 512), 1 << 16))


def possible(a: tuple, i: np.ndarray, b: tuple, j: np.ndarray, percent: int) -> np.ndarray:
    """Which node pairs (rows ``i`` of level ``a``, rows ``j`` of level ``b``) may hold a link.

    Common tokens set common bits; tokens beyond one for each bit are at most the excess.  An
    overlap must be at least p / (100 + p) of both sizes together.
    """
    bits = np.bitwise_count(a[0][i][:, None, :] & b[0][j][None, :, :]).sum(-1, dtype=np.int64)
    most = bits + np.minimum(a[3][i][:, None], b[3][j][None, :])
    most = np.minimum(most, np.minimum(a[2][i][:, None], b[2][j][None, :]))
    least = percent * (a[1][i][:, None] + b[1][j][None, :])
    near = (100 * a[2][i][:, None] >= percent * b[1][j][None, :]) & (100 * b[2][j][None, :] >= percent * a[1][i][:, None])
    return near & (most * (100 + percent) >= least)


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, on the full sets."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    common = int((y[at] == x).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def dual_traversal(a: SignatureTree, b: SignatureTree | None, percent: int, labels: np.ndarray, other_labels: np.ndarray | None = None, every: bool = False) -> list[tuple[int, int]]:
    """Links between two trees, or within one (``b`` None), that join different labels.

    Pairs of one label are connected already and passed over; a link makes its two labels one, so
    the result is a spanning forest over the labels.  With ``every`` labels stay as they are, and
    all links between different labels are found.
    """
    same = b is None
    b, right = (a, labels) if same else (b, other_labels)
    found: list[tuple[int, int]] = []
    stack = [(len(a.levels) - 1, 0, len(b.levels) - 1, 0)]
    if stack[0][0] == stack[0][2] == 0 and not same and labels[0] != right[0] and linked(a.sets[0], b.sets[0], percent):
        found.append((0, 0))
    while stack:
        la, i, lb, j = stack.pop()
        if la == 0 and lb == 0:
            continue
        da = la - 1 if la >= lb else la
        db = lb - 1 if lb >= la else lb
        kids_a = np.arange(i * FANOUT, min((i + 1) * FANOUT, len(a.levels[da][1]))) if da < la else np.array([i])
        kids_b = np.arange(j * FANOUT, min((j + 1) * FANOUT, len(b.levels[db][1]))) if db < lb else np.array([j])
        leaves = da == 0 and db == 0
        if leaves and not (apart := labels[kids_a][:, None] != right[kids_b][None, :]).any():
            continue
        ok = possible(a.levels[da], kids_a, b.levels[db], kids_b, percent)
        if leaves:
            ok &= apart
        if same:
            ok &= kids_a[:, None] < kids_b[None, :] if leaves else kids_a[:, None] <= kids_b[None, :]
        for p, q in zip(*np.nonzero(ok)):
            x, y = int(kids_a[p]), int(kids_b[q])
            if not leaves:
                stack.append((da, x, db, y))
            elif labels[x] != right[y] and linked(a.sets[x], b.sets[y], percent):
                found.append((x, y))
                if every:
                    continue
                keep, gone = labels[x], right[y]
                labels[labels == gone] = keep
                if not same:
                    right[right == gone] = keep
    return found


# ---------------------------------------------------------------- step 1: shared shingles

PACKED = "kind int, uid long, one binary, two binary, three binary"


def count_shared(docs: DataFrame, k: int = SHINGLE) -> tuple[DataFrame, DataFrame, int]:
    """Documents with their shared shingles, frequent shingles, and the shift that gives a token's shard.

    The first result has doc_id, set_key, n and shared.  The tokens of a shard travel as packed
    arrays, six bytes each: the shard is the token's upper bits, and of the others the lower 32 are
    kept (two tokens that agree in these are counted as shared, which lets a document more through,
    never less), with the document's number in its map-side block.
    """
    small_batches(docs.sparkSession)
    shards, words = 16, text_bytes(docs) / 6
    while shards * SHARD_TOKENS < words and shards < 1 << 20:
        shards *= 2
    shift = 64 - (shards.bit_length() - 1)

    def blocks(uid: int, ids: list, sets: list[np.ndarray]) -> pa.RecordBatch:
        """Packs the sets and empties their list: arrays of a whole block are let go as soon as they are used."""
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        keys = b"".join(map(set_key, sets))
        tokens = np.concatenate([*sets, np.zeros(0, U64)])
        sets.clear()
        low, shard = tokens.astype("<u4"), np.empty(len(tokens), np.uint16 if shards <= 1 << 16 else np.uint32)
        np.right_shift(tokens, U64(shift), out=shard, casting="unsafe")
        del tokens
        order = np.argsort(shard, kind="stable")  # documents stay in order within a shard
        edge = np.concatenate([[0], np.cumsum(np.bincount(shard, minlength=shards))])
        del shard
        low, doc = low[order], np.repeat(np.arange(len(sizes), dtype="<u2"), sizes)[order]
        del order
        out = [(s, uid, low[x:y].tobytes(), doc[x:y].tobytes(), None) for s, (x, y) in enumerate(zip(edge[:-1], edge[1:])) if x < y]
        del low, doc
        named = np.array([x is not None for x in ids])
        facts = np.stack([np.array([x or 0 for x in ids], dtype="<i8"), sizes.astype("<i8"), named.astype("<i8")])
        out.append((shards + uid % shards, uid, facts.tobytes(), keys, b""))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), *[pa.binary()] * 3))], ["shard", "uid", "one", "two", "three"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, part = 0, TaskContext.get().partitionId()
        ids, sets, held = [], [], 0
        for b in batches:
            own = shingle_sets(b.column(1).to_pylist(), k)
            ids, sets, held = ids + b.column(0).to_pylist(), sets + own, held + sum(map(len, own))
            if len(ids) > FLUSH_DOCS or held > SHARD_TOKENS:
                yield blocks(part << 32 | number, ids, sets)
                number, ids, sets, held = number + 1, [], [], 0
        if ids:
            yield blocks(part << 32 | number, ids, sets)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), *[pa.binary()] * 3))], [x.split()[0] for x in PACKED.split(", ")])

    def gather(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, uids, lows, docs_of = key[0].as_py(), [], [], []
        for b in batches:
            for row in b.to_pylist():
                if shard >= shards:
                    yield packed([(0, row["uid"], row["one"], row["two"], None)])
                else:
                    uids.append(row["uid"])
                    lows.append(np.frombuffer(row["one"], "<u4"))
                    docs_of.append(np.frombuffer(row["two"], "<u2"))
        if not lows:
            return
        low = np.concatenate(lows)
        lows.clear()
        order = np.argsort(low, kind="stable")
        ranked = low[order]
        equal = ranked[1:] == ranked[:-1]
        twin = np.zeros(len(low), dtype=bool)
        twin[1:] |= equal
        twin[:-1] |= equal
        shared = np.empty(len(low), dtype=bool)
        shared[order] = twin
        value, times = np.unique(ranked[twin], return_counts=True)
        often = np.flatnonzero(times >= OFTEN)
        often = often[np.argsort(-times[often], kind="stable")[:FREQUENT]]
        if len(often):
            yield packed([(2, 0, (np.int64(shard) << 32 | value[often].astype(np.int64)).astype("<i8").tobytes(), times[often].astype("<i8").tobytes(), None)])
        at = 0
        for uid, doc in zip(uids, docs_of):
            idx, count = np.unique(doc[shared[at : at + len(doc)]], return_counts=True)
            at += len(doc)
            if len(idx):
                yield packed([(1, uid, idx.astype("<u2").tobytes(), count.astype("<u4").tobytes(), None)])

    def total(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        facts, shared, later = None, None, []
        for b in batches:
            for row in b.to_pylist():
                if row["kind"] == 0:
                    facts, keys = np.frombuffer(row["one"], "<i8").reshape(3, -1), row["two"]
                else:
                    later.append((np.frombuffer(row["one"], "<u2"), np.frombuffer(row["two"], "<u4")))
        doc, n, named = facts
        shared = np.zeros(len(doc), np.int64)
        for idx, count in later:
            shared[idx] += count
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc, mask=named == 0), pa.array([keys[16 * i : 16 * i + 16] for i in range(len(doc))], pa.binary()), pa.array(n.astype(np.int32)), pa.array(shared.astype(np.int32))],
            ["doc_id", "set_key", "n", "shared"],
        )

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for token, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(token, "<i8")), pa.array(np.frombuffer(n, "<i8"))], ["token", "n"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    dealt = rows.mapInArrow(split, "shard int, uid long, one binary, two binary, three binary")
    counted = materialize(dealt.groupBy("shard").applyInArrow(gather, PACKED), "shared")
    found = counted.where("kind < 2").groupBy("uid").applyInArrow(total, "doc_id long, set_key binary, n int, shared int")
    return found, counted.where("kind = 2").select("one", "two").mapInArrow(opened, "token long, n long"), shift


# ---------------------------------------------------------------- steps 2 and 3: trees


def _ordered(tokens: np.ndarray, often: np.ndarray, rank: np.ndarray, shift: int) -> np.ndarray:
    """The tokens in the one fixed order: those outside the frequent table by value, then frequent ones."""
    key = ((tokens >> U64(shift)) << U64(32) | (tokens & U64(0xFFFFFFFF))).astype(np.int64)
    if not len(often):
        return tokens
    at = np.minimum(np.searchsorted(often, key), len(often) - 1)
    place = np.where(often[at] == key, rank[at] + 1, 0)
    return tokens[np.lexsort((tokens, place))]


SET = "set_key binary, n int, tokens binary, firsts array<long>, prefix array<long>"
LINK = "a binary, b binary"


def _sets(docs: DataFrame, wanted: DataFrame, again: DataFrame, frequent: DataFrame, shift: int, k: int, percent: int) -> DataFrame:
    """(set_key, n, tokens, firsts, prefix) of ``wanted(doc_id, set_key)``, one row for each set; frequent
    tokens come last in a prefix.  Rows of the repeated ids ``again`` are reduced to one for each set."""
    small_batches(docs.sparkSession)
    table = sorted(frequent.orderBy(F.desc("n"), "token").limit(FREQUENT).collect(), key=lambda r: r["token"])
    often = np.array([r["token"] for r in table], dtype=np.int64)
    rank = np.empty(len(table), dtype=np.int64)
    rank[np.argsort([r["n"] for r in table], kind="stable")] = np.arange(len(table))
    held = docs.sparkSession.sparkContext.broadcast((often, rank))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, rank = held.value
        for b in batches:
            found = [(d, s) for d, s in zip(b.column(0).to_pylist(), shingle_sets(b.column(1).to_pylist(), k)) if len(s)]
            ids, sets = [d for d, _ in found], [s for _, s in found]
            prefix = [_ordered(s, often, rank, shift)[: len(s) - (-(-percent * len(s) // 100)) + 1].view(np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([set_key(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int32()), pa.array([s.tobytes() for s in sets], pa.binary()), *(pa.array(x, pa.list_(pa.int64())) for x in ([s[:FIRST].view(np.int64) for s in sets], prefix))],
                ["doc_id", "set_key", "n", "tokens", "firsts", "prefix"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    once = wanted.join(again.select("doc_id"), "doc_id", "left_anti").where("doc_id IS NOT NULL").select("doc_id")
    made = rows.join(once, "doc_id", "left_semi").mapInArrow(run, "doc_id long, " + SET).drop("doc_id")
    if not again.isEmpty():
        more = rows_of_ids(rows, again).mapInArrow(run, "doc_id long, " + SET)
        named = wanted.select(F.col("set_key").alias("__key"), F.col("doc_id").alias("__id"))
        more = more.dropDuplicates(["doc_id", "set_key"]).join(named, (F.col("set_key") == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
        made = made.unionByName(more.drop("doc_id"))
    return materialize(made, "sets")


def _load(batches: Iterator[pa.RecordBatch], *names: str) -> list[list]:
    """Columns of a group as lists; ``tokens`` as views of the group's own memory."""
    table = pa.Table.from_batches(list(batches))
    return [_views(table[c]) if c == "tokens" else table[c].to_pylist() for c in names]


def _views(column: pa.ChunkedArray) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for chunk in column.chunks:
        _, offsets, data = chunk.buffers()
        edge = np.frombuffer(offsets, np.int32)[chunk.offset : chunk.offset + len(chunk) + 1].tolist()
        out += [np.frombuffer(data, U64, (y - x) // 8, x) if y > x else np.zeros(0, U64) for x, y in zip(edge[:-1], edge[1:])]
    return out


def _tree_order(sets: list[np.ndarray]) -> list[int]:
    return sorted(range(len(sets)), key=lambda k: (len(sets[k]), int(sets[k][0])))


def _links(pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.binary())], ["a", "b"])


def _parts(docs: str, tokens: str):
    """How many trees a group of documents is dealt to: each of bounded documents and tokens."""
    return F.ceil(F.greatest(F.col(docs) / TREE_DOCS, F.col(tokens) / TREE_TOKENS)).cast("int")


def _part(parts):
    """The part that a document is dealt to."""
    return F.pmod(F.xxhash64("set_key"), parts)


def _placed(sets: DataFrame) -> DataFrame:
    """(set_key, block, part, place, docs) of each document's first tokens; steps 2 and 3 share it, so that a
    unit of step 3 never holds two documents that step 2 did not compare.

    Blocks are counted first, and the hot ones are broadcast, so that their documents stay where they are.
    """
    firsts = sets.select("set_key", "n", F.posexplode("firsts").alias("place", "block"))
    size = materialize(firsts.groupBy("block").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("held")).withColumn("parts", _parts("docs", "held")), "blocks")
    placed = join_groups(firsts, size, "block", "docs")
    return materialize(placed.select("set_key", "block", _part(F.col("parts")).alias("part"), "place", "docs"), "placed")


def block_links(sets: DataFrame, placed: DataFrame, percent: int, every: bool = False) -> DataFrame:
    """Step 2: spanning links (or all) within blocks of documents that share one of their smallest tokens."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, tokens = _load(batches, "set_key", "tokens")
        own = dict(zip(keys, tokens))
        keys, values = list(own), list(own.values())
        order = _tree_order(values)
        keys, values = [keys[k] for k in order], [values[k] for k in order]
        tree = SignatureTree(values, bits_for(values))
        yield _links([(keys[x], keys[y]) for x, y in dual_traversal(tree, None, percent, np.arange(len(keys)), every=every)])

    own = placed.where("docs > 1").select("set_key", "block", "part")
    return sets.select("set_key", "tokens").join(own, "set_key").groupBy("block", "part").applyInArrow(run, LINK)


def remainder_links(sets: DataFrame, placed: DataFrame, roots: DataFrame, percent: int, every: bool = False) -> DataFrame:
    """Step 3: links between components, as spanning forests of the units that are joined (or all links).

    A unit is a part of a block of documents with the same smallest token; step 2 has settled all
    pairs within it.  Two units are joined, tree against tree, if documents of different components
    in them share a prefix shingle and their ranges of sizes can agree.
    """
    unit = placed.where("place = 0").select("set_key", F.xxhash64("block", "part").alias("unit")).distinct()
    known = sets.select("set_key", "n", "prefix").join(roots.select(F.col("node").alias("set_key"), "root"), "set_key", "left").join(unit, "set_key")
    known = known.withColumn("root", F.coalesce("root", "set_key"))
    known = materialize(known.select("set_key", "n", "prefix", "root", "unit"), "known")
    posted = known.select("root", "unit", "n", F.explode("prefix").alias("token"))
    posted = posted.groupBy("token", "unit").agg(F.min("root").alias("r"), F.max("root").alias("s"), F.min("n").alias("low"), F.max("n").alias("high"))
    contested = posted.groupBy("token").agg(F.min("r").alias("r"), F.max("s").alias("s"), F.count(F.lit(1)).alias("units")).where("units > 1 AND r != s")
    posted = posted.join(contested.select("token"), "token")
    other = posted.select("token", *(F.col(c).alias(f"{c}2") for c in ("unit", "r", "s", "low", "high")))
    apart = (F.least("r", "r2") != F.greatest("s", "s2")) & (100 * F.col("high") >= percent * F.col("low2")) & (100 * F.col("high2") >= percent * F.col("low"))
    pairs = posted.join(other, "token").where((F.col("unit") < F.col("unit2")) & apart)
    pairs = materialize(pairs.select("unit", "unit2").distinct(), "pairs")
    tasks, halves = _tasks(known, pairs)
    if tasks is None:
        return sets.select(F.col("set_key").alias("a"), F.col("set_key").alias("b")).limit(0)

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side, keys, tokens, root = _load(batches, "side", "set_key", "tokens", "root")
        numbers = {r: k for k, r in enumerate(dict.fromkeys(root))}
        trees, names, labels, widths = [], [], [], []
        for s in (0, 1):
            own = {k: (t, numbers[r]) for k, t, r, x in zip(keys, tokens, root, side) if x == s}
            order = _tree_order([t for t, _ in own.values()])
            held = list(own)
            names.append([held[k] for k in order])
            rows = [own[k] for k in names[-1]]
            trees.append([t for t, _ in rows])
            labels.append(np.array([r for _, r in rows]))
            widths.append(bits_for(trees[-1]))
        if trees[0] and trees[1]:
            a, b = (SignatureTree(t, max(widths)) for t in trees)
            yield _links([(names[0][x], names[1][y]) for x, y in dual_traversal(a, b, percent, *labels, every=every)])
        elif trees[0]:
            tree = SignatureTree(trees[0], widths[0])
            yield _links([(names[0][x], names[0][y]) for x, y in dual_traversal(tree, None, percent, labels[0], every=every)])

    full = sets.select("set_key", "tokens").join(halves.join(known.select("set_key", "root"), "set_key"), "set_key")
    return full.groupBy("task").applyInArrow(run, LINK)


def _tasks(known: DataFrame, pairs: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """(set_key, task, side): which documents each tree join of step 3 reads.

    Units that are linked by pairs, directly or not, are a family.  A family is joined with itself
    in chunks of ``TREE_DOCS`` documents (one chunk: one tree) where that reads fewer rows than its
    pairs of units would; else each pair of units is a task of its own.  Either way every pair of
    units meets, so no link is missed.
    """
    if pairs.isEmpty():
        return None, None
    as_key = lambda x: F.unhex(F.lpad(F.hex(x), 16, "0"))
    family = components(pairs.select(as_key(F.col("unit")).alias("a"), as_key(F.col("unit2")).alias("b")))
    family = family.select(F.col("node").alias("k"), F.col("root").alias("family"))
    docs = known.groupBy("unit").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("held"))
    held = materialize(docs.withColumn("k", as_key(F.col("unit"))).join(family, "k").select("unit", "docs", "held", "family"), "families")
    size = held.groupBy("family").agg(F.sum("docs").alias("all"), F.sum("held").alias("tokens"))
    one, two = held.select("unit", "family", "docs"), held.select(F.col("unit").alias("unit2"), F.col("docs").alias("docs2"))
    read = pairs.join(one, "unit").join(two, "unit2").groupBy("family").agg(F.sum(F.col("docs") + F.col("docs2")).alias("read"))
    plan = size.join(read, "family").withColumn("chunks", _parts("all", "tokens")).withColumn("whole", F.col("all") * F.col("chunks") <= F.col("read"))
    plan = materialize(held.join(plan, "family").select("unit", "family", "chunks", "whole"), "plan")
    rows = known.select("set_key", "unit").join(plan, "unit")
    chunk = F.pmod(F.xxhash64("set_key"), F.col("chunks")).cast("int")
    # chunk c of a family meets every chunk: itself as one tree, the others as sides 0 and 1
    meets = F.expr("explode(sequence(0, chunks - 1))")
    whole = rows.where("whole").withColumn("c", chunk).select("set_key", "family", "c", meets.alias("o"))
    whole = whole.select("set_key", F.xxhash64("family", F.least("c", "o"), F.greatest("c", "o")).alias("task"), (F.col("c") > F.col("o")).cast("int").alias("side"))
    single = pairs.join(plan.where("NOT whole").select("unit"), "unit", "left_semi").withColumn("task", F.xxhash64("unit", "unit2"))
    sides = single.select("unit", "task", F.lit(0).alias("side")).union(single.select(F.col("unit2").alias("unit"), "task", F.lit(1).alias("side")))
    parts = rows.where("NOT whole").select("set_key", "unit").join(sides, "unit").select("set_key", "task", "side")
    return pairs, whole.union(parts)


def _prepared(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, set_key, n, near), repeated ids, groups (set_key, least doc_id, docs) and the groups' sets."""
    counted, frequent, shift = count_shared(docs, k)
    rows = materialize(counted.select("doc_id", "set_key", "n", ((100 * F.col("shared") >= percent * F.col("n")) & (F.col("n") > 0)).alias("near")), "rows")
    again = repeated_ids(rows)
    groups = materialize(rows.where("near").groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("docs")), "groups")
    return rows, again, groups, _sets(docs, groups, again, frequent, shift, k, percent)


def _grouped(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows, repeated ids, and (set_key, doc_id, docs, component_id, keep_key) of the sets that may link.

    keep_key is the set that stays of its component: that of the smallest (doc_id, set_key), null ids last.
    """
    rows, again, groups, sets = _prepared(docs, k, percent)
    placed = _placed(sets)
    links = materialize(block_links(sets, placed, percent), "block-links")
    rest = materialize(remainder_links(sets, placed, components(links), percent), "rest-links")
    roots = components(links.union(rest))
    named = groups.join(roots.select(F.col("node").alias("set_key"), "root"), "set_key", "left").withColumn("root", F.coalesce("root", "set_key"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "set_key"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"), first.alias("first")).select("root", "component_id", F.col("first.set_key").alias("keep_key"))
    return rows, again, named.join(least, "root").drop("root")


def near_duplicates(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id.

    Two documents link when ``100 * intersection >= percent * union`` of their sets of distinct
    ``k``-word shingles; component_id is the smallest doc_id reachable by links.  Null, empty and
    blank texts have an empty set and link with nothing, not even each other.  Null ids are never
    the smallest; a component of null ids only has a null component_id.  Equal texts, repeated rows
    and texts of one set are one node.  An empty table gives no rows; other columns are ignored.
    """
    rows, _, named = _grouped(docs, k, percent)
    alone = rows.where("NOT near").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    together = join_groups(rows.where("near").select("doc_id", "n", "set_key"), named.select("set_key", "component_id", "docs"), "set_key", "docs").select("doc_id", "n", "component_id")
    return alone.unionByName(together).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")


def near_links(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Classes and all links between them: (doc_id, set_key, n) of each row, and (a, b) with ``a < b``.

    Rows of one set_key have equal sets and link with each other, if ``n`` isn't 0; every other link
    is a pair of set_keys, each once.
    """
    rows, _, _, sets = _prepared(docs, k, percent)
    none = sets.select(F.col("set_key").alias("node"), F.col("set_key").alias("root")).limit(0)
    placed = _placed(sets)
    found = block_links(sets, placed, percent, every=True).unionByName(remainder_links(sets, placed, none, percent, every=True))
    return rows.select("doc_id", "set_key", "n"), found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def link_counts(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs``: doc_id, set_key and n_links, the number of other rows that it links with."""
    rows, links = near_links(docs, k, percent)
    held = materialize(rows.where("n > 0").groupBy("set_key").agg(F.count(F.lit(1)).alias("docs")), "classes")
    both = links.union(links.select("b", "a"))
    far = both.join(held.withColumnRenamed("set_key", "b"), "b").groupBy(F.col("a").alias("set_key")).agg(F.sum("docs").alias("far"))
    per = held.join(far, "set_key", "left").select("set_key", "docs", (F.col("docs") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"))
    empty = rows.where("n = 0").select("doc_id", "set_key", F.lit(0).cast("long").alias("n_links"))
    return join_groups(rows.where("n > 0"), per, "set_key", "docs").select("doc_id", "set_key", "n_links").unionByName(empty)


def _with_set_keys(rows: DataFrame, text: str, k: int) -> DataFrame:
    """``rows`` with __set_key and __n of the text column."""
    at = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = shingle_sets([None if t is None else t.encode() for t in b.column(at).to_pylist()], k)
            more = [pa.array([set_key(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int32())]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, "__set_key", "__n"])

    schema = StructType([*rows.schema.fields, StructField("__set_key", BinaryType()), StructField("__n", IntegerType())])
    return rows.mapInArrow(run, schema)


def one_of_each(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The documents that stay: of each component one row, that of the smallest doc_id, all columns.

    Where an id repeats, the row with the smallest set of this id in the component stays; a component
    of rows without ids keeps one of them.  Null, empty and blank texts link with nothing and all stay.
    """
    rows, again, named = _grouped(docs, k, percent)
    named = materialize(named.select("set_key", "docs", "keep_key", F.col("doc_id").alias("keep_id")), "named")
    again = again.select("doc_id", "times")
    near = join_groups(rows.where("near").select("doc_id", "set_key"), named, "set_key", "docs")
    stays = (F.col("set_key") == F.col("keep_key")) & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    gone = materialize(near.where(~stays & F.col("doc_id").isNotNull()).select("doc_id").union(again.where("doc_id IS NOT NULL").select("doc_id")).distinct(), "gone")
    own = docs.columns
    made = docs.toDF(*(f"__own_{j}" for j in range(len(own))))
    made = made.withColumns({"__id": F.col(f"__own_{own.index('doc_id')}").cast("long"), "__text": F.col(f"__own_{own.index('text')}").cast("string")})
    once = made.where("__id IS NOT NULL").join(gone.withColumnRenamed("doc_id", "__id"), "__id", "left_anti")
    kept = once.select(*made.columns[:-2])
    if not again.isEmpty():
        small_batches(docs.sparkSession)
        more = _with_set_keys(rows_of_ids(made, again, "__id"), "__text", k)
        empty, full = more.where("__n = 0"), more.where("__n > 0").dropDuplicates(["__id", "__set_key"])
        full = full.join(named.withColumnRenamed("set_key", "__set_key"), "__set_key", "left")
        full = full.where(F.col("keep_key").isNull() | ((F.col("__set_key") == F.col("keep_key")) & F.col("__id").eqNullSafe(F.col("keep_id"))))
        for part in (empty, full):
            kept = kept.unionByName(part.select(*kept.columns))
    return kept.toDF(*own)
