"""Benchmark decontamination with sharded suffix arrays of the training text.

Every Arrow batch of documents is one shard.  A shard sorts its word suffixes (only those that
begin with a word pair, or single word, with which some test suffix begins: no other suffix can
match) by as many words as a match needs, and every test suffix is binary-searched in it; the
matching range gives the locations.  From each location the match is stretched along its item to
the longest verbatim match.  No document text is shuffled.  A benchmark beyond one block is read
in blocks of bounded size, one pass over the documents for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solvara.llm.common import materialize, small_batches

WINDOW = 10
#: Words of benchmark text in one broadcast block, and of one piece of an item: longer items are cut
#: into pieces that overlap by all but one word of a window.
BLOCK_WORDS, PIECE_WORDS = 500_000, 100_000
#: Bytes outside [0-9A-Za-z] and non-ASCII separate words; A-Z becomes a-z.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


class Automaton:
    """The substrings of one item: ``longest`` gives, for each word of a text, the longest substring that
    ends there and its first place in the item.  Both are linear in the words read."""

    def __init__(self, codes: list[int]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size, self.end = [-1], [0], [0]
        last = 0
        for place, code in enumerate(codes, 1):
            new = self._state({}, -1, self.size[last] + 1, place)
            at = last
            while at >= 0 and code not in self.next[at]:
                self.next[at][code] = new
                at = self.link[at]
            if at < 0:
                self.link[new] = 0
            else:
                to = self.next[at][code]
                if self.size[to] == self.size[at] + 1:
                    self.link[new] = to
                else:
                    twin = self._state(dict(self.next[to]), self.link[to], self.size[at] + 1, self.end[to])
                    while at >= 0 and self.next[at].get(code) == to:
                        self.next[at][code] = twin
                        at = self.link[at]
                    self.link[to] = self.link[new] = twin
            last = new

    def _state(self, follow: dict[int, int], link: int, size: int, end: int) -> int:
        self.next.append(follow)
        self.link.append(link)
        self.size.append(size)
        self.end.append(end)
        return len(self.next) - 1

    def matches(self, codes: list[int], least: int) -> list[tuple[int, int, int]]:
        """(start, end, place in the item) of the matches of ``least`` words or more that can't be made longer."""
        out, at, size = [], 0, 0
        for k, code in enumerate([*codes, -1]):
            before = (k - size, k, self.end[at] - size)
            grown = size + 1
            while at > 0 and code not in self.next[at]:
                at = self.link[at]
                size = self.size[at]
            if code in self.next[at]:
                at, size = self.next[at][code], size + 1
            else:
                at = size = 0
            if size < grown and before[1] - before[0] >= least:
                out.append(before)
        return out


class TestBlock:
    """Test suffixes of some benchmark items (or pieces of them) as rank codes, sorted for the search.

    ``items`` are (id, place of the piece in the item, words of the whole item, words of the piece).
    """

    __test__ = False

    def __init__(self, items: list[tuple[str, int, int, list[bytes]]], window: int):
        self.ids, self.places, self.window = [i for i, _, _, _ in items], [p for _, p, _, _ in items], window
        vocabulary = sorted({w for *_, ws in items for w in ws})
        self.code = {w: k + 1 for k, w in enumerate(vocabulary)}  # 0: a word of no item
        self.base = base = len(vocabulary) + 1
        self.least = np.array([min(window, n) for _, _, n, _ in items], dtype=np.int64)  # words of a match
        size = np.array([len(ws) for *_, ws in items], dtype=np.int64)
        self.start = np.concatenate([[0], np.cumsum(size)])
        self.words = np.fromiter((self.code[w] for *_, ws in items for w in ws), dtype=np.int64, count=int(size.sum()))
        count = np.where(self.least > 0, np.maximum(size - self.least + 1, 0), 0)
        item = np.repeat(np.arange(len(items)), count)
        at = np.repeat(self.start[:-1] - np.cumsum(count) + count, count) + np.arange(count.sum())
        grid = np.arange(window)
        table = np.concatenate([self.words, np.zeros(window, np.int64)])[at[:, None] + grid]
        table[grid >= self.least[item][:, None]] = 0
        self.keys_low, number = np.unique(self._keys(table), return_inverse=True)
        owners = np.unique(number.ravel() * max(len(items), 1) + item)
        self.owner = owners % max(len(items), 1)
        self.owned = np.searchsorted(owners // max(len(items), 1), np.arange(len(self.keys_low) + 1))
        rows = self.keys_low.view(">u4").reshape(-1, window).astype(np.int64)
        self.lengths = (rows > 0).sum(1)
        self.keys_high = self._keys(np.where(rows > 0, rows, 2**32 - 1))
        self.single = np.zeros(base, dtype=bool)
        self.single[rows[self.lengths == 1, 0]] = True
        more = rows[self.lengths > 1]
        self.pairs = np.unique(more[:, 0] * base + more[:, 1]) if len(more) and window > 1 else np.zeros(0, np.int64)

    def _keys(self, table: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(table.astype(">u4")).view(f"S{4 * self.window}").ravel()

    def search(self, codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the test suffixes stand in a shard: positions and window numbers.

        ``codes``: the shard's words; ``ends``: for each word, the end of its document.
        """
        none = np.zeros(0, dtype=np.int64)
        if not len(codes) or not len(self.keys_low):
            return none, none
        follow = np.zeros_like(codes)
        follow[:-1] = codes[1:]
        at = np.flatnonzero(codes)
        pair = codes[at] * self.base + np.where(ends[at] > at + 1, follow[at], 0)
        where = np.minimum(np.searchsorted(self.pairs, pair), max(len(self.pairs) - 1, 0))
        keep = self.single[codes[at]]
        if len(self.pairs):
            keep |= self.pairs[where] == pair
        at = at[keep]
        if not len(at):
            return none, none
        grid = np.arange(self.window)
        suffix = np.concatenate([codes, np.zeros(self.window, dtype=codes.dtype)])[at[:, None] + grid]
        suffix[at[:, None] + grid >= ends[at][:, None]] = 0
        key = self._keys(suffix)
        order = np.argsort(key, kind="stable")
        array, key = at[order], key[order]  # the suffix array of the shard and its sorted suffixes
        low = np.searchsorted(key, self.keys_low, "left")
        count = np.maximum(np.searchsorted(key, self.keys_high, "right") - low, 0)
        hit = np.flatnonzero(count)
        offset = np.arange(count[hit].sum()) - np.repeat(np.cumsum(count[hit]) - count[hit], count[hit])
        return array[np.repeat(low[hit], count[hit]) + offset], np.repeat(hit, count[hit])

    def spans(self, codes: np.ndarray, at: np.ndarray, window: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(start, end, item, place in the item) of the longest verbatim matches around the places found."""
        if not len(at):
            return []
        count = self.owned[window + 1] - self.owned[window]
        offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        item = self.owner[np.repeat(self.owned[window], count) + offset]
        where = np.unique(np.stack([item, np.repeat(at, count)]), axis=1)
        item, where = where
        cut = np.flatnonzero((item[1:] != item[:-1]) | (where[1:] != where[:-1] + 1)) + 1
        known: dict[int, Automaton] = {}
        out = []
        for first, last in zip([0, *cut], [*cut, len(item)]):
            k, least = int(item[first]), int(self.least[item[first]])
            if k not in known:
                known[k] = Automaton(self.words[self.start[k] : self.start[k + 1]].tolist())
            start = int(where[first])
            run = codes[start : int(where[last - 1]) + least].tolist()
            out += [(start + x, start + y, k, self.places[k] + z) for x, y, z in known[k].matches(run, least)]
        return out


SPAN = "struct<start:long,end:long,item_id:string,item_start:long>"
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("item_id", pa.string()), ("item_start", pa.int64())]))


def _joined(spans: list[tuple[int, int, str, int]]) -> list[tuple[int, int, str, int]]:
    """Distinct spans in order.  Those of one item that touch on one diagonal (a match over several pieces)
    are one, and a span within another of the same item goes."""
    out: list[tuple[int, int, str, int]] = []
    for start, end, item, place in sorted(set(spans), key=lambda s: (s[2], s[0] - s[3], s[0])):
        if out and out[-1][2] == item and out[-1][0] - out[-1][3] == start - place and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end), item, out[-1][3])
        else:
            out.append((start, end, item, place))
    kept: list[tuple[int, int, str, int]] = []
    for s in sorted(out, key=lambda s: (s[2], s[0], -s[1], s[3])):
        if not kept or kept[-1][2] != s[2] or kept[-1][1] < s[1]:
            kept.append(s)
    return sorted(kept)


def _pass(rows: DataFrame, block, schema: str) -> DataFrame:
    """Adds one block's matches to the state that each document row carries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = block.value
        find = test.code.get
        for b in batches:
            table = pa.Table.from_batches([b])
            each = [words(t) for t in table["__text"].to_pylist()]
            length = np.array([len(ws) for ws in each], dtype=np.int64)
            codes = np.fromiter((find(w, 0) for ws in each for w in ws), dtype=np.int64, count=int(length.sum()))
            end = np.cumsum(length)
            doc = np.repeat(np.arange(len(each)), length)
            at, window = test.search(codes, end[doc] if len(codes) else end[:0])
            found: dict[int, list] = {}
            for x, y, k, place in test.spans(codes, at, window):
                d = int(doc[x])
                zero = int(end[d] - length[d])
                found.setdefault(d, []).append((x - zero, y - zero, test.ids[k], place))
            spans = table["matches"].to_pylist()
            for d, new in found.items():
                spans[d] = [dict(zip(("start", "end", "item_id", "item_start"), s)) for s in _joined(new + [tuple(s.values()) for s in spans[d]])]
            for name, values in (("n_words", pa.array(length, pa.int64())), ("matches", pa.array(spans, _SPAN))):
                k = table.column_names.index(name)
                table = table.set_column(k, table.schema.field(k).with_type(values.type), values)
            yield from table.to_batches()

    return rows.mapInArrow(run, schema)


def test_pieces(benchmark: DataFrame, window: int) -> tuple[DataFrame, int]:
    """(item_id, place, total, words, block) of all items with words, and the number of blocks.

    Items longer than a piece are cut in tasks; pieces are dealt to blocks by a hash, so that a block
    holds about half of ``BLOCK_WORDS`` and hardly ever more than that.
    """
    small_batches(benchmark.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ws = words(text)
                step = max(PIECE_WORDS - window + 1, 1)
                starts = range(0, max(len(ws) - window + 1, 1) if ws else 0, step)
                cut = [b" ".join(ws[s : s + step + window - 1]) for s in starts]
                columns = ([item] * len(cut), list(starts), [len(ws)] * len(cut), [x.count(b" ") + 1 for x in cut], cut)
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["item_id", "place", "total", "n", "words"])

    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("binary")).where("item_id IS NOT NULL")
    pieces = materialize(rows.mapInArrow(run, "item_id string, place long, total long, n long, words binary"), "test-pieces")
    held = int(pieces.agg(F.sum("n")).first()[0] or 0)
    blocks = 1 if held <= BLOCK_WORDS else -(-2 * held // BLOCK_WORDS)
    return pieces.withColumn("block", F.pmod(F.xxhash64("item_id", "place"), F.lit(blocks))), blocks


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """All columns of ``docs`` and n_words, n_hit, item_ids (sorted as strings), matches, longest, contaminated.

    A document word inside any occurrence of a window (``window`` consecutive words of an item, or
    a shorter item as a whole) is hit.  ``matches`` are the longest verbatim matches: words start to
    end of the document (zero-based, end not included) are those of item item_id from its word
    item_start on (the first place, if the item has several), and can't be made longer on either
    side; ``longest`` is the longest one's words.  (In an item beyond ``PIECE_WORDS`` that repeats
    itself, a match over a border of pieces may be reported as several.)  Null and empty texts have no words; items without
    words or without an id match nothing; rows of one item_id are one item of several texts; an
    empty benchmark leaves every document clean.  Input columns that have the names of results are
    replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    made = ["n_words", "n_hit", "item_ids", "matches", "longest", "contaminated"]
    rows = docs.drop(*made, "__text").withColumns({"__text": F.col("text").cast("binary"), "n_words": F.lit(0).cast("long"), "matches": F.array().cast(f"array<{SPAN}>")})
    pieces, blocks = test_pieces(benchmark, window)
    for k in range(blocks):
        # one block's items, of bounded size, on the driver at a time
        items = [(r["item_id"], r["place"], r["total"], bytes(r["words"]).split(b" ")) for r in pieces.where(F.col("block") == k).orderBy("item_id", "place", "words").toLocalIterator()]
        held = spark.sparkContext.broadcast(TestBlock(items, window))
        rows = _pass(rows, held, rows.schema)
        if k < blocks - 1:
            rows = materialize(rows, "hits")
            held.unpersist()
    # hit words: the length of the union of the spans, which are sorted by their start
    step = lambda a, s: F.struct((a["n"] + F.greatest(s["end"] - F.greatest(s["start"], a["to"]), F.lit(0))).alias("n"), F.greatest(a["to"], s["end"]).alias("to"))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    longest = F.coalesce(F.array_max(F.transform("matches", lambda s: s["end"] - s["start"])), F.lit(0).cast("long"))
    found = {"n_hit": F.aggregate("matches", zero, step)["n"], "item_ids": F.array_sort(F.array_distinct(F.transform("matches", lambda s: s["item_id"]))), "longest": longest}
    return rows.withColumns(found).withColumn("contaminated", F.col("n_hit") > 0).drop("__text")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without any benchmark window, with their own columns, whatever these are called.

    Each row is judged by its own whole text, repeated ids and rows too; null, empty and blank texts hold
    no window and stay.  An empty benchmark, or one without words, lets all stay; an empty table stays empty.
    """
    own = docs.columns
    made = [f"__own_{k}" for k in range(len(own))]
    renamed = docs.toDF(*made).withColumn("text", F.col(made[own.index("text")]))
    return benchmark_hits(renamed, benchmark, window).where("NOT contaminated").select(*made).toDF(*own)


def contamination_report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest, matches."""
    return benchmark_hits(docs.select("doc_id", "text"), benchmark, window).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
        "longest",
        "matches",
    )
