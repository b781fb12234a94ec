"""Language identification with a bit-sliced Bloom filter over character n-grams.

One table of slots serves all languages: bit ``l`` of a slot belongs to language ``l``'s filter,
so that ANDing the few slots of an n-gram returns every language that contains it.  The bits are
counted by language over the whole text, the counts are corrected for each filter's false
positives, and the largest decides.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solvara.llm.common import code_points, crc32_mod4, letters, small_batches

GRAMS = (3, 4)
HASHES = 3
#: About so many documents of each language are learned from, chosen by a hash of doc_id.
TRAIN_DOCS = 2000
#: An n-gram belongs to a language if at least so many of its documents hold it, and at a rate of
#: at least this share of the rate in the language where it is commonest.
MIN_DOCS, MIN_RATE = 3, 0.1
#: Characters in one vectorised piece; longer texts are cut at white space and their counts added.
PIECE = 400_000
U64 = np.uint64


def _pieces(text: str) -> list[str]:
    """The text cut after white space into pieces of about ``PIECE`` characters; nothing is lost."""
    out, start = [], 0
    while len(text) - start > 2 * PIECE:
        end = start + PIECE
        while end < len(text) and not text[end - 1].isspace():
            end += 1
        out.append(text[start:end])
        start = end
    out.append(text[start:])
    return out


def grams(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of texts: n-gram hashes, the text that each belongs to, and letters of each text."""
    held, size = [], 0
    pieces = [(k, p) for k, t in enumerate(texts) if t for p in _pieces(t)]
    for k, piece in [*pieces, (-1, "")]:
        if held and (k < 0 or size + len(piece) > PIECE):
            yield _run(held, len(texts))
            held, size = [], 0
        held.append((k, piece.lower()))
        size += len(piece)


def _run(held: list[tuple[int, str]], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    code = code_points(" ".join(["", *(p for _, p in held), ""]))
    owner = np.repeat([k for k, _ in held], [len(p) + 1 for _, p in held])
    owner = np.concatenate([owner[:1], owner])
    letter = letters()[code]
    total = np.bincount(owner[letter], minlength=n)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one blank stands for each run of other characters
    code, owner, letter = np.where(letter, code, 32)[keep].astype(U64), owner[keep], letter[keep]
    code, owner, letter = (np.concatenate([x[:1], y]) for x, y in (([U64(32)], code), (owner, owner), ([False], letter)))
    out, own = [], []
    with np.errstate(over="ignore"):
        for g in GRAMS:
            m = max(len(code) - g + 1, 0)
            h, inside = np.full(m, g, U64), np.ones(m, bool)
            for i in range(g):
                h = (h ^ code[i : i + m]) * U64(0x9E3779B97F4A7C15)
                h ^= h >> U64(29)
                if 0 < i < g - 1:
                    inside &= letter[i : i + m]
            out.append(h[inside])
            own.append(owner[1 : m + 1][inside])
    return np.concatenate(out), np.concatenate(own), total


def train_rows(docs: DataFrame) -> DataFrame:
    """(text, lang) of about ``TRAIN_DOCS`` labelled documents of each language, none held out."""
    known = docs.where(F.col("lang").isNotNull() & (crc32_mod4(F.col("doc_id")) != 2)).select(F.col("doc_id").cast("string").alias("id"), F.col("lang").cast("string").alias("lang"), "text")
    count = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not count:
        return known.select("text", "lang")
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in count.items() for x in (lang, min(1.0, TRAIN_DOCS / n))]), F.col("lang"))
    return known.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share * 1_000_000).select("text", "lang")


def gram_rates(train: DataFrame) -> DataFrame:
    """(lang, gram, docs): documents of a language that hold an n-gram."""
    small_batches(train.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, langs = b.column(0).to_pylist(), b.column(1).to_pylist()
            names = sorted(set(langs))
            tongue = np.array([names.index(x) for x in langs], dtype=np.int64)
            count: list[Counter] = [Counter() for _ in names]
            for h, own, _ in grams(texts):
                order = np.lexsort((h, own))
                h, own = h[order], own[order]
                first = np.ones(len(h), bool)  # of an n-gram in a text
                first[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
                h, spoken = h[first], tongue[own[first]]
                for k in range(len(names)):
                    value, times = np.unique(h[spoken == k], return_counts=True)
                    count[k].update(dict(zip(value.tolist(), times.tolist())))
            for k, lang in enumerate(names):
                g = np.fromiter(count[k], U64, len(count[k])).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(g), pa.array(list(count[k].values()), pa.int64())], ["lang", "gram", "docs"])

    return train.mapInArrow(run, "lang string, gram long, docs long").groupBy("lang", "gram").agg(F.sum("docs").alias("docs"))


class LanguageBloom:
    """``table[slot, word]``: bit ``l`` of the slot's words is a bit of language ``l``'s Bloom filter."""

    def __init__(self, languages: list[str], members: dict[str, np.ndarray]):
        self.languages = languages
        most = max((len(g) for g in members.values()), default=1)
        self.slots = 1 << max(10, int(np.ceil(np.log2(max(most, 1) * HASHES / np.log(2)))))
        self.table = np.zeros((self.slots, -(-len(languages) // 64) or 1), dtype=U64)
        for k, lang in enumerate(languages):
            for slot in self._slots(members[lang]):
                np.bitwise_or.at(self.table[:, k // 64], slot, U64(1) << U64(k % 64))
        fill = np.array([((self.table[:, k // 64] >> U64(k % 64)) & U64(1)).mean() for k in range(len(languages))])
        self.false_rate = fill**HASHES

    def _slots(self, gram: np.ndarray) -> Iterator[np.ndarray]:
        step = (gram >> U64(33)) | U64(1)
        with np.errstate(over="ignore"):
            for i in range(HASHES):
                yield ((gram + U64(i) * step) & U64(self.slots - 1)).astype(np.int64)

    def masks(self, gram: np.ndarray) -> np.ndarray:
        """The languages that contain each n-gram, as bitmasks."""
        out = None
        for slot in self._slots(gram):
            out = self.table[slot] if out is None else out & self.table[slot]
        return out

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Corrected counts (text by language) and letters of each text."""
        hits, lettered, total = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64), np.zeros(len(texts))
        for h, own, seen in grams(texts):
            lettered += seen
            total += np.bincount(own, minlength=len(texts))
            mask = self.masks(h)
            for k in range(len(self.languages)):
                bit = (mask[:, k // 64] >> U64(k % 64)) & U64(1)
                hits[:, k] += np.bincount(own, weights=bit.astype(np.float64), minlength=len(texts))
        return np.maximum(hits - total[:, None] * self.false_rate, 0) / (1 - self.false_rate), lettered

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        count, lettered = self.counts(texts)
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts)
        best, total = count.argmax(1), count.sum(1)
        score = np.where(total > 0, count.max(1) / np.maximum(total, 1e-12), 0.0)
        und = lettered == 0
        return ["und" if u else self.languages[k] for u, k in zip(und, best)], np.where(und, 0.0, score).tolist()


def fit(docs: DataFrame) -> LanguageBloom:
    """Learns the filters; what reaches the driver is bounded by the sample of documents."""
    train = train_rows(docs)
    size = {r["lang"]: r["count"] for r in train.groupBy("lang").count().collect()}
    rates = gram_rates(train).where(F.col("docs") >= (MIN_DOCS if sum(size.values()) > 200 else 1)).toPandas()
    rates["rate"] = rates["docs"] / rates["lang"].map(size)
    rates = rates[rates["rate"] >= MIN_RATE * rates.groupby("gram")["rate"].transform("max")]
    members = {lang: part["gram"].to_numpy(np.int64).view(U64) for lang, part in rates.groupby("lang")}
    # ties go to the language with more documents, then by name
    languages = sorted(size, key=lambda x: (-size[x], x))
    return LanguageBloom(languages, {x: members.get(x, np.zeros(0, U64)) for x in languages})


def identify(docs: DataFrame, model: LanguageBloom | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, lang_pred, score.

    held_out: ``crc32(doc_id as text) mod 4`` is 2 (such rows are never learned from).  A null text,
    or one without a letter, is ``und`` with score 0; a text of unknown n-grams only gets the
    commonest language with score 0.  score is the share of the decided language in all corrected
    counts.  Without labelled rows all texts are ``und``; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(model or fit(docs))

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        lang, score = held.value.predict(texts.tolist())
        return pd.DataFrame({"lang_pred": lang, "score": score})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.withColumn("p", predict("text")).select("doc_id", (crc32_mod4(F.col("doc_id")) == 2).alias("held_out"), "p.lang_pred", "p.score")
