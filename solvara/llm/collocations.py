"""Phrase collocations: exact phrase counts by double-array tries over coded texts.

1. Words are counted by language; words seen often enough get codes, and every text is written as the
   codes of its words (0: a rare word or the end of a piece).
2. Candidates of m words are chosen Apriori-safe: only where the phrases of m - 1 words at two adjacent
   places are both frequent can a frequent phrase begin.  Each shard adds up what it sees of these, and what
   reaches the bar in all shards together becomes a candidate.
3. All candidates go into double-array tries that are broadcast in blocks of bounded size.  numpy moves the
   states of all text positions at once, one word after the other, and counts accepting states
   (``bincount``); the sums over shards are the phrase counts.
4. Scores of all cuts in exact decimals, the containment rule and the first phrases of each language are joins and
   windows of Spark over the table of phrases.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from solvara.llm.common import materialize, small_batches
from solvara.llm.sharding import numbered

MIN_COUNT, MOST_WORDS, FIRST = 100, 5, 2000
#: Phrases in one trie, words in one broadcast dictionary: more are dealt to further blocks, one pass for each.
TRIE_PHRASES, DICTIONARY_WORDS = 1_000_000, 1_000_000
#: Bits of a word's second digit, children from which a node takes fresh room, and slots looked at together for others.
DIGIT, WIDE, WINDOW = 10, 256, 1024
#: Codes in a written row, about; states in a vector of counts.
ROW_CODES, SLICE = 16_384, 1024
#: Bytes of text cut at once, and positions whose phrases are added up at once.
CHUNK_BYTES, CHUNK_POSITIONS = 2 << 20, 1 << 19

# ---------------------------------------------------------------- words

#: What each byte is: 0 in a word, 1 a blank, 2 the end of a piece.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def words(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words of a column of texts (nulls count as empty), the text each is of, and whether it goes on from the word before."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = column.buffers()[1]
    cuts = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[cuts[0] : cuts[-1]]
    cuts = cuts - cuts[0]
    kind = _KIND[data]
    inside = kind == 0
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    fresh = cuts[:-1][np.diff(cuts) > 0]
    starts[fresh] = inside[fresh]
    first = np.flatnonzero(starts)
    if not len(first):
        return pa.array([], pa.large_binary()), first, first.astype(bool)
    # the letters of all words on end: a word's bytes are those inside words between its start and the next
    before = np.cumsum(inside, dtype=np.int64) - 1
    flat = _LOWER[data[inside]]
    own = np.append(before[first], len(flat)).astype(np.int64)
    found = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(own), pa.py_buffer(flat)])
    text = np.searchsorted(cuts, first, side="right") - 1
    ends = np.cumsum(kind == 2)
    goes_on = np.zeros(len(first), bool)
    goes_on[1:] = (ends[first[1:]] == ends[first[:-1]]) & (text[1:] == text[:-1])
    return found, text, goes_on


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(lang, text) of as many batches as hold about ``CHUNK_BYTES`` of text."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= CHUNK_BYTES:
            yield _joined(held)
            held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> tuple[pa.Array, pa.Array]:
    t = pa.Table.from_batches(held).combine_chunks()
    return t.column(0).combine_chunks(), t.column(1).combine_chunks()


def _by_lang(lang: pa.Array, text: pa.Array) -> Iterator[tuple[str, pa.Array]]:
    for name in pc.unique(lang).to_pylist():
        yield name, text.filter(pc.equal(lang, name))


def word_counts(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """(lang, word, f): how often each frequent word stands in the texts of a language; word null: all words."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, texts in _chunks(batches):
            for lang, own in _by_lang(langs, texts):
                found = words(own)[0]
                counts = pc.value_counts(found)
                word, n = counts.field(0).cast(pa.binary()), counts.field(1)
                word = pa.concat_arrays([word.cast(pa.string()), pa.array([None], pa.string())])
                n = pa.concat_arrays([n, pa.array([len(found)], pa.int64())])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(word), pa.string()), word, n], ["lang", "word", "f"])

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    counts = rows.mapInArrow(run, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))
    return counts.where((F.col("f") >= min_count) | F.col("word").isNull())


# ---------------------------------------------------------------- tries


@dataclass
class DoubleArray:
    """A trie in two arrays: the child of state ``s`` by digit ``d`` is ``base[s] + d``, if ``check`` there is ``s``.

    A word is two digits, so that children lie close together and the arrays fill up.  State 0 is dead, states 1 to the number of languages are their roots.  ``ids`` holds the id of the phrase that ends in a
    state, or -1.
    """

    base: np.ndarray
    check: np.ndarray
    ids: np.ndarray
    roots: int

    @classmethod
    def build(cls, roots: int, langs: np.ndarray, flat: np.ndarray, ids: np.ndarray) -> DoubleArray:
        """From phrases as rows of codes from 1 on, filled up with zeros."""
        flat = np.stack([np.where(flat > 0, (flat >> DIGIT) + 1, 0), np.where(flat > 0, (flat & (2**DIGIT - 1)) + 1, 0)], axis=2).reshape(len(flat), -1)
        lengths = (flat > 0).sum(axis=1)
        size = max(1024, 4 * (roots + 1 + len(flat)))
        base, check, found = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        free = np.ones(size, bool)
        free[: roots + 1] = False
        check[0] = -2
        state = langs.astype(np.int64) + 1
        hint = top = roots + 1

        def grow(size: int) -> None:
            nonlocal base, check, found, free
            more = size - len(free)
            free, base = np.append(free, np.ones(more, bool)), np.append(base, np.zeros(more, np.int64))
            check, found = np.append(check, np.full(more, -1)), np.append(found, np.full(more, -1))

        for depth in range(flat.shape[1]):
            rows = np.flatnonzero(lengths > depth)
            edges, back = np.unique(np.stack([state[rows], flat[rows, depth]]), axis=1, return_inverse=True)
            parent, code = edges
            cuts = np.flatnonzero(np.diff(parent, prepend=-1))
            ends = np.append(cuts[1:], len(parent))
            child = np.zeros(len(parent), np.int64)
            wide = np.flatnonzero(ends - cuts > 1)
            for k in wide[np.argsort(cuts[wide] - ends[wide], kind="stable")]:
                own = code[cuts[k] : ends[k]]
                # nodes with many children take fresh room, others the next gap that they fit
                at = top if len(own) > WIDE else hint
                while True:
                    if at + WINDOW + own[-1] - own[0] >= len(free):
                        grow(2 * len(free) + own[-1])
                    slots = at + np.flatnonzero(free[at : at + WINDOW])
                    fits = np.flatnonzero(free[(slots - own[0])[:, None] + own].all(axis=1)) if len(own) <= WIDE else np.zeros(1, int)
                    if len(slots) and len(fits):
                        break
                    at += WINDOW
                at = int(slots[fits[0]])
                hint = hint if len(own) > WIDE else at
                at -= int(own[0])
                free[at + own] = False
                top = max(top, at + int(own[-1]) + 1)
                base[parent[cuts[k]]] = at
                child[cuts[k] : ends[k]] = at + own
            # a single child can stand anywhere
            narrow = np.flatnonzero(ends - cuts == 1)
            room = np.flatnonzero(free)
            if len(room) < len(narrow):
                grow(2 * len(free) + len(narrow))
                room = np.flatnonzero(free)
            room = room[: len(narrow)]
            free[room] = False
            base[parent[cuts[narrow]]] = room - code[cuts[narrow]]
            child[cuts[narrow]] = room
            top = max(top, int(room.max(initial=0)) + 1)
            check[child] = parent
            state[rows] = child[back]
        found[state] = ids
        return cls(base[:top], check[:top], found[:top], roots)

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The states after one more word, of all positions at once; code 0 and missing children lead to the dead state."""
        state = np.where(code > 0, state, 0)
        return self._child(self._child(state, (code >> DIGIT) + 1), (code & (2**DIGIT - 1)) + 1)

    def _child(self, state: np.ndarray, digit: np.ndarray) -> np.ndarray:
        to = self.base[state] + digit
        to = np.where((to >= 0) & (to < len(self.check)), to, 0)
        return np.where((self.check[to] == state) & (state > 0), to, 0)


# ---------------------------------------------------------------- codes

CODES = "lang int, codes binary"


def coded(docs: DataFrame, dictionary: DataFrame, langs: list[str]) -> DataFrame:
    """(lang, codes): the texts as codes of their words, 0 for other words and between pieces.

    ``dictionary`` has (word, code) and is broadcast in blocks of ``DICTIONARY_WORDS``; with more words than
    one block holds, each block adds its codes to those written before.
    """
    spark, number = docs.sparkSession, {x: k for k, x in enumerate(langs)}
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"), F.lit(None).cast("binary").alias("codes"))
    top = int(dictionary.agg(F.max("code")).first()[0] or 0)
    starts = range(1, top + 1, DICTIONARY_WORDS)
    for start in starts:
        block = dictionary.where(F.col("code").between(start, start + DICTIONARY_WORDS - 1)).orderBy("code").select("word").toPandas()["word"]
        shared = spark.sparkContext.broadcast(pa.array(block, pa.string()).cast(pa.large_binary()))
        last = start == starts[-1]

        def run(batches: Iterator[pa.RecordBatch], start: int = start, shared=shared, last: bool = last, single: bool = len(starts) == 1) -> Iterator[pa.RecordBatch]:
            def codes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                found, text, goes_on = words(texts)
                at = pc.index_in(found, value_set=shared.value)
                return np.where(at.is_valid(), at.fill_null(0).to_numpy(zero_copy_only=False) + start, 0).astype(np.int32), text, goes_on

            def spaced(code: np.ndarray, goes_on: np.ndarray) -> np.ndarray:
                """Codes with a 0 before each word that doesn't go on."""
                out = np.zeros(len(code) + int((~goes_on).sum()), np.int32)
                out[np.arange(len(code)) + np.cumsum(~goes_on)] = code
                return out

            if single:
                for langs, texts in _chunks(batches):
                    for lang, own in _by_lang(langs, texts):
                        if lang in number:
                            code, _, goes_on = codes_of(own)
                            parts = [c.tobytes() for c in _cut(spaced(code, goes_on))]
                            yield pa.RecordBatch.from_arrays([pa.array([number[lang]] * len(parts), pa.int32()), pa.array(parts, pa.binary())], ["lang", "codes"])
                return
            for b in batches:
                code, text, goes_on = codes_of(b.column(1))
                cuts = np.searchsorted(text, np.arange(1, b.num_rows))
                own = [spaced(c, g) for c, g in zip(np.split(code, cuts), np.split(goes_on, cuts))]
                own = [c if old is None else np.maximum(c, np.frombuffer(old, np.int32)) for c, old in zip(own, b.column(2).to_pylist())]
                joined = pa.array([c.tobytes() for c in own], pa.binary())
                if last:
                    known = [k for k, x in enumerate(b.column(0).to_pylist()) if x in number]
                    yield pa.RecordBatch.from_arrays([pa.array([number[b.column(0)[k].as_py()] for k in known], pa.int32()), joined.take(pa.array(known, pa.int64()))], ["lang", "codes"])
                else:
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), joined], ["lang", "text", "codes"])

        rows = materialize(rows.mapInArrow(run, CODES if last else "lang string, text string, codes binary"), "codes")
    return rows if len(starts) else rows.select(F.lit(0).alias("lang"), "codes").limit(0)


def _cut(code: np.ndarray) -> list[np.ndarray]:
    """Codes in runs of about ``ROW_CODES``, cut only at zeros."""
    ends = np.flatnonzero(code == 0)
    at = np.unique(ends[np.searchsorted(ends, np.arange(ROW_CODES, len(code), ROW_CODES)).clip(max=len(ends) - 1)]) if len(ends) else ends
    return np.split(code, at)


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(language, code) of consecutive positions, about ``CHUNK_POSITIONS`` at once; rows end in a 0."""
    lang: list[np.ndarray] = []
    code: list[np.ndarray] = []
    size = 0
    for b in batches:
        for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            own = np.append(np.frombuffer(raw, np.int32), np.int32(0))
            lang.append(np.full(len(own), k, np.int32))
            code.append(own)
            size += len(own)
            if size >= CHUNK_POSITIONS:
                yield np.concatenate(lang), np.concatenate(code)
                lang, code, size = [], [], 0
    if size:
        yield np.concatenate(lang), np.concatenate(code)


# ---------------------------------------------------------------- candidates and counts


def _blocks(phrases: DataFrame, n: int, roots: int, words: int) -> Iterator[DoubleArray]:
    """Tries of (id, lang, codes), as many as the bound asks for; only one block is held at a time."""
    several = -(-n // TRIE_PHRASES)
    for k in range(several):
        part = phrases.where(F.pmod(F.col("id"), F.lit(several)) == k) if several > 1 else phrases
        rows = part.select("id", "lang", *[F.coalesce(F.try_element_at("codes", F.lit(j + 1)), F.lit(0)).cast("long").alias(f"c{j}") for j in range(words)]).toArrow()
        if rows.num_rows:
            ids, langs, *codes = (c.to_numpy() for c in rows.columns)
            yield DoubleArray.build(roots, langs, np.stack(codes, axis=1), ids)


class _PairSums:
    """Adds up keys (state, code) of a task, as many distinct ones as ``CHUNK_POSITIONS`` at once."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.keys, self.counts = ids, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        keys, counts = np.unique(keys, return_counts=True)
        keys = np.concatenate([self.keys, keys])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], np.concatenate([self.counts, counts])[order]
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        self.keys, self.counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts
        if len(self.keys) > CHUNK_POSITIONS:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(self.keys), 65536):
            keys, counts = self.keys[k : k + 65536], self.counts[k : k + 65536]
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[keys >> 32], pa.int64()), pa.array((keys & (2**32 - 1)).astype(np.int32)), pa.array(counts, pa.int64())], ["id", "code", "f"])
        self.keys, self.counts = self.keys[:0], self.counts[:0]


def extensions(texts: DataFrame, phrases: DataFrame, n: int, roots: int, m: int, min_count: int) -> DataFrame:
    """(id, code): phrases of m - 1 words by a further word, seen ``min_count`` times in all shards together.

    With one trie both parts must be frequent; with several, a place whose second part another trie
    holds is not judged by it, which only lets more through to the sums.
    """
    out = None
    for trie in _blocks(phrases, n, roots, m - 1):
        shared, whole = texts.sparkSession.sparkContext.broadcast(trie), n <= TRIE_PHRASES

        def run(batches: Iterator[pa.RecordBatch], shared=shared, whole: bool = whole) -> Iterator[pa.RecordBatch]:
            trie: DoubleArray = shared.value
            sums = _PairSums(trie.ids)
            for lang, code in _positions(batches):
                at = np.flatnonzero(code)
                state = lang[at].astype(np.int64) + 1
                for k in range(m - 1):
                    state = trie.step(state, code[at + k])
                    at, state = at[state > 0], state[state > 0]
                    if not len(at):
                        break
                # codes end in 0, so what follows a phrase is inside the chunk
                reached = np.zeros(len(code) + 1, np.int32)
                reached[at] = state * (trie.ids[state] >= 0)
                own = np.flatnonzero(reached[:-1])
                own = own[code[own + m - 1] > 0]
                if whole:
                    own = own[reached[own + 1] > 0]
                yield from sums.add(reached[own].astype(np.int64) << 32 | code[own + m - 1])
            yield from sums.rest()

        seen = texts.mapInArrow(run, "id long, code int, f long").groupBy("id", "code").agg(F.sum("f").alias("f")).where(F.col("f") >= min_count).select("id", "code")
        seen = materialize(seen, "extensions")
        out = seen if out is None else out.unionByName(seen)
    return out


def phrase_counts(texts: DataFrame, phrases: DataFrame, n: int, roots: int, words: int) -> DataFrame:
    """(id, f) of all ``phrases``: the sums over shards of accepting states, one pass for each trie.

    A shard's counts are vectors of ``SLICE`` states; a slice's vectors are added up as they arrive.
    """
    out = None
    for trie in _blocks(phrases, n, roots, words):
        shared = texts.sparkSession.sparkContext.broadcast(trie)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            trie: DoubleArray = shared.value
            counts = np.zeros(len(trie.check), np.int64)
            for lang, code in _positions(batches):
                at = np.flatnonzero(code)
                state, depth = lang[at].astype(np.int64) + 1, 0
                while len(at):
                    state = trie.step(state, code[at + depth])
                    at, state, depth = at[state > 0], state[state > 0], depth + 1
                    counts += np.bincount(state, minlength=len(counts))
            if counts.any():
                counts = np.append(counts, np.zeros(-len(counts) % SLICE, np.int64)).reshape(-1, SLICE)
                own = np.flatnonzero(counts.any(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([counts[k].tobytes() for k in own], pa.binary())], ["slice", "counts"])

        def add(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for b in batches:
                for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    sums[k] = sums.get(k, 0) + np.frombuffer(raw, np.int64)
            for k, counts in sums.items():
                ids = shared.value.ids[k * SLICE : (k + 1) * SLICE]
                counts = counts[: len(ids)]
                own = np.flatnonzero((counts > 0) & (ids >= 0))
                yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(counts[own])], ["id", "f"])

        vectors = texts.mapInArrow(run, "slice long, counts binary")
        sums = materialize(vectors.repartition("slice").mapInArrow(add, "id long, f long"), "phrase-counts")
        out = sums if out is None else out.unionByName(sums)
    return out


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, most_words: int = MOST_WORDS, first: int = FIRST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the ``first`` phrases of each language.

    A null text has no words and a null lang is ``und``.  Phrases that agree in score and count are in
    the order of their bytes, so nothing depends on where rows stand; repeated rows count each time; without a
    frequent phrase (an empty table) there are no rows; other columns are ignored.
    """
    counts = materialize(word_counts(docs, min_count), "word-counts")
    frequent = counts.where("word IS NOT NULL")
    named, _ = numbered(frequent.select("word").distinct(), ["word"], "code")
    dictionary = materialize(named.select("word", (F.col("code") + 1).cast("int").alias("code")), "dictionary")
    langs = sorted(r[0] for r in frequent.select("lang").distinct().collect())
    texts = coded(docs, dictionary, langs)
    number = F.create_map(*[F.lit(x) for k, name in enumerate(langs) for x in (name, k)]) if langs else F.create_map(F.lit(""), F.lit(0))
    level = frequent.join(dictionary, "word").select(F.element_at(number, F.col("lang")).alias("lang"), F.array("code").alias("codes"), F.col("word").alias("phrase"))
    levels = []
    word = dictionary.withColumnRenamed("word", "__next")
    for m in range(1, most_words + 1):
        level = materialize(level.withColumn("id", F.monotonically_increasing_id()), f"phrases-{m}")
        levels.append(level.withColumn("m", F.lit(m)))
        n = level.count()
        if not n or m == most_words:
            break
        longer = extensions(texts, level, n, len(langs), m + 1, min_count).join(level, "id").join(word, "code")
        level = longer.select("lang", F.concat("codes", F.array("code")).alias("codes"), F.concat_ws(" ", "phrase", "__next").alias("phrase"))
    if len(levels) == 1:
        return _none(docs)
    longer = levels[1]
    for x in levels[2:]:
        longer = longer.unionByName(x)
    longer = materialize(longer.withColumn("id", F.monotonically_increasing_id()), "candidates")
    n = longer.count()
    if not n:
        return _none(docs)
    back = F.element_at(F.array(*[F.lit(x) for x in langs]), F.col("lang") + 1)
    counted = longer.join(phrase_counts(texts, longer, n, len(langs), most_words), "id").select(back.alias("lang"), "phrase", "m", "f")
    counted = materialize(counted.where(F.col("f") >= min_count), "counted")
    totals = counts.where("word IS NULL").select("lang", F.col("f").alias("n"))
    return scored(counted, frequent.select("lang", F.col("word").alias("phrase"), "f"), totals, first)


def _none(docs: DataFrame) -> DataFrame:
    return docs.sparkSession.createDataFrame([], "lang string, rank int, phrase string, a long, l long, r long, n long, score long")


def scored(phrases: DataFrame, single: DataFrame, totals: DataFrame, first: int = FIRST) -> DataFrame:
    """The contract's rows from the counts of phrases (lang, phrase, m, f), of single words and of all words."""
    parts = F.split("phrase", " ")
    part_counts = phrases.select("lang", "phrase", "f").unionByName(single)
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 1)))
    cuts = cuts.withColumns({"left": F.array_join(F.slice(parts, 1, F.col("k")), " "), "right": F.array_join(F.slice(parts, F.col("k") + 1, F.col("m") - F.col("k")), " ")})
    for side, out in (("left", "l"), ("right", "r")):
        cuts = cuts.join(part_counts.withColumnsRenamed({"phrase": side, "f": out}), ["lang", side])
    cuts = cuts.join(F.broadcast(totals), "lang")
    whole = {x: F.col(x).cast("decimal(18,0)") for x in ("f", "l", "r")}
    cuts = cuts.withColumns({"__over": F.lit(1000).cast("decimal(4,0)") * whole["f"] * F.col("n").cast("decimal(14,0)"), "__under": whole["l"] * whole["r"]})
    cuts = cuts.withColumn("score", F.expr("__over div __under"))
    lowest = cuts.groupBy("lang", "phrase", "m").agg(F.min(F.struct("score", "k", F.col("f").alias("a"), "l", "r", "n")).alias("x")).select("lang", "phrase", "m", "x.*")
    # of a phrase inside a longer one with the same count, all in between have that count too
    longer = phrases.where(F.col("m") > 2).withColumn("__part", F.explode(F.array(F.array_join(F.slice(parts, F.lit(1), F.col("m") - 1), " "), F.array_join(F.slice(parts, F.lit(2), F.col("m") - 1), " "))))
    covered = longer.groupBy("lang", F.col("__part").alias("phrase")).agg(F.max("f").alias("__cover"))
    kept = lowest.join(covered, ["lang", "phrase"], "left").where(F.col("__cover").isNull() | (F.col("__cover") < F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


COLLOCATIONS_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, m, array_to_string(w[j : j + m - 1], ' ') AS phrase FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS j FROM w, range(1, 6) AS ms(m) WHERE len(w) >= m)),
f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, m, phrase, f, string_split(phrase, ' ') AS ws, unnest(range(1, m)) AS k FROM f WHERE m > 1),
s AS (
  SELECT c.lang, c.phrase, c.f AS a, k, fl.f AS l, fr.f AS r, n, ((1000::HUGEINT * c.f * n) // (fl.f::HUGEINT * fr.f))::BIGINT AS score
  FROM c JOIN t USING (lang) JOIN f AS fl ON fl.lang = c.lang AND fl.phrase = array_to_string(ws[1 : k], ' ') JOIN f AS fr ON fr.lang = c.lang AND fr.phrase = array_to_string(ws[k + 1 :], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
u AS (SELECT lang, array_to_string(ws[i : j], ' ') AS phrase, f FROM c, range(1, 6) AS i(i), range(1, 6) AS j(j) WHERE k = 1 AND i < j AND j <= m AND j - i < m - 1),
x AS (SELECT b.lang, b.phrase FROM b JOIN u USING (lang, phrase) WHERE 100 * u.f >= 100 * b.a)
SELECT lang, (row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase))::INTEGER AS rank, phrase, a, l, r, n, score
FROM b WHERE (lang, phrase) NOT IN (SELECT lang, phrase FROM x) QUALIFY rank <= 2000
"""
