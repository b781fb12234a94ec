"""Toxicity scores: boosted trees over dense text features, calibrated by isotonic regression.

Features of a whole text are lexicon densities, closeness of second-person words to lexicon
words, capitals, punctuation and obfuscation rates.  The lexicon (words and word beginnings) is
learned from all labelled documents that aren't held out, besides a short list of common insults.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solvara.llm.common import code_points, crc32_mod4, letters, materialize, small_batches

#: Labelled documents that are learned from, chosen by a hash of doc_id; words in the lexicon.
TRAIN_ROWS, LEXICON = 20_000, 1000
#: Least documents and least likelihood ratio (G squared) of a lexicon entry.
MIN_DOCS, MIN_G2 = 4, 15.0
THRESHOLD = 0.3
STEMS = range(3, 8)
TREES, DEPTH = 20, 4

SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi vous votre vos du dich dir dein deine ihr euch usted ustedes tus ti vos os".split())
INSULTS = frozenset("idiot idiots moron morons stupid dumb loser losers scum trash pathetic worthless disgusting clown fool jerk crap bastard imbecile vermin filth".split())
WORD = re.compile(r"[^\W\d_]+")
HIDDEN = re.compile(r"[^\W\d_][\d@$!|*.\-_]+[^\W\d_]")
LEET = str.maketrans("013457@$!|", "oieastasil")
NOISE = re.compile(r"[^\w]|_")
SHOUTED = re.compile(r"[A-ZÀ-Þ]{2}")
PUNCTUATION, EXCLAIMED, DIGITS = (np.array([ord(c) for c in x]) for x in (".,;:!?'\"-", "!?", "0123456789"))
SIGNS = np.array([c for c in range(33, 127) if not chr(c).isalnum()])
MARKS = np.array([chr(c) in "0123456789@$!|*.-_" for c in range(128)])
FEATURES = (
    "log_words", "lexicon_sum", "lexicon_rate", "lexicon_max", "lexicon_kinds", "insult_rate", "insult_any", "second_rate", "second_near", "capitals",
    "shouted", "punctuation", "exclaimed", "hidden_rate", "hidden_lexicon", "repeats", "symbols", "digits",
)


class Scorer:
    """Turns texts into feature rows; remembers the entries of words it has seen."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.seen = lexicon, {}

    def entry(self, word: str) -> tuple[float, str]:
        """Weight and name of the heaviest lexicon entry of a lower-case word."""
        found = self.seen.get(word)
        if found is None:
            names = [word, *(word[:k] + "*" for k in STEMS if k <= len(word))]
            found = max(((self.lexicon[x], x) for x in names if x in self.lexicon), default=(0.0, ""))
            if len(self.seen) > 50_000:
                self.seen.clear()
            self.seen[word] = found
        return found

    def row(self, text: str | None) -> list[float]:
        text = text or ""
        low = text.lower()
        code = code_points(low)
        letter = letters()[code]
        words = np.where(letter, code, 32).astype(np.uint32).tobytes().decode("utf-32-le").split()
        n, chars = max(len(words), 1), max(len(code), 1)
        entry = self.entry
        found = [(k, *x) for k, x in enumerate(map(entry, words)) if x[0]]
        insults = sum(map(INSULTS.__contains__, words))
        second = [k for k, x in enumerate(map(SECOND_PERSON.__contains__, words)) if x]
        near = 0.0
        if found and second:
            at, you = np.array([k for k, _, _ in found]), np.array(second)
            right = np.searchsorted(you, at)
            gap = np.minimum(np.abs(you[np.minimum(right, len(you) - 1)] - at), np.abs(you[np.maximum(right - 1, 0)] - at))
            near = float(1 / (1 + gap.min()))
        hidden = [t for t in low.split() if HIDDEN.search(t)] if _veiled(code, letter) else []
        veiled = sum(bool(entry(x)[0]) or x in INSULTS for x in (NOISE.sub("", t.translate(LEET)) for t in hidden))
        own = code_points(text)
        upper = int((own != code).sum()) if len(own) == len(code) else sum(map(str.isupper, text))
        signs = np.bincount(code[code < 128], minlength=128)
        punctuation, exclaimed, digits = (int(signs[x].sum()) for x in (PUNCTUATION, EXCLAIMED, DIGITS))
        symbols = int(signs[SIGNS].sum()) - punctuation
        tripled = int((letter[2:] & (code[2:] == code[1:-1]) & (code[1:-1] == code[:-2])).sum()) if len(code) > 2 else 0
        return [
            math.log1p(len(words)),
            sum(w for _, w, _ in found) / n,
            len(found) / n,
            max((w for _, w, _ in found), default=0.0),
            float(len({x for _, _, x in found})),
            insults / n,
            float(insults > 0),
            len(second) / n,
            near,
            upper / chars,
            sum(t.isupper() for t in text.split() if len(t) > 1) / n if SHOUTED.search(text) else 0.0,
            punctuation / chars,
            exclaimed / chars,
            len(hidden) / n,
            float(veiled),
            tripled / n,
            symbols / chars,
            digits / chars,
        ]


def _veiled(code: np.ndarray, letter: np.ndarray) -> bool:
    """Whether a run of digits or marks stands between two letters anywhere."""
    mark = np.zeros(len(code) + 2, dtype=bool)
    mark[1:-1] = MARKS[np.minimum(code, 127)]
    start, end = np.flatnonzero(mark[1:-1] & ~mark[:-2]), np.flatnonzero(mark[1:-1] & ~mark[2:])
    inner = (start > 0) & (end < len(code) - 1)
    return bool((letter[start[inner] - 1] & letter[end[inner] + 1]).any())


def training_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic) of at most ``TRAIN_ROWS`` labelled documents, none held out.

    A document with several labels counts as toxic if any says so; null labels are passed over.
    """
    own = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    own = own.where(crc32_mod4(F.col("doc_id")) != 2).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialize(texts.join(F.broadcast(own), "doc_id"), "toxicity-train")


def count_entries(train: DataFrame) -> DataFrame:
    """(entry, part, toxic, clean): in how many documents of each crc part a word or word beginning stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            count: dict[int, tuple[Counter, Counter]] = {}
            for text, toxic, part in zip(*(b.column(k).to_pylist() for k in range(3))):
                distinct = set(WORD.findall((text or "").lower()))
                count.setdefault(part, (Counter(), Counter()))[toxic > 0].update({x for w in distinct for x in (w, *(w[:k] + "*" for k in STEMS if k <= len(w)))})
            for part, (clean, toxic) in count.items():
                names = list(clean.keys() | toxic.keys())
                numbers = ([part] * len(names), [toxic[x] for x in names], [clean[x] for x in names])
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array(x, pa.int64()) for x in numbers)], ["entry", "part", "toxic", "clean"])

    found = train.select("text", "toxic", crc32_mod4(F.col("doc_id")).alias("part")).mapInArrow(run, "entry string, part long, toxic long, clean long")
    found = found.groupBy("entry", "part").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # an entry that is too rare in all parts together is too rare in any of them
    wide = found.groupBy("entry").agg(F.collect_list(F.struct("part", "toxic", "clean")).alias("parts"), F.sum("toxic").alias("all"))
    return materialize(wide.where(F.col("all") >= MIN_DOCS).select("entry", F.inline("parts")), "toxicity-entries")


def learn_lexicon(entries: DataFrame, t: int, c: int, without: int | None = None) -> dict[str, float]:
    """Words and word beginnings (marked ``*``) that stand in toxic documents far more often.

    ``t`` and ``c``: toxic and clean documents that were counted; part ``without`` is left out.
    """
    if not t or not c:
        return {}
    if without is not None:
        entries = entries.where(F.col("part") != without)
    t, c = F.lit(t), F.lit(c)
    a, b = F.col("toxic"), F.col("clean")
    share = t / (t + c)
    side = lambda x, p: F.when(x > 0, x * F.log(x / ((a + b) * p))).otherwise(0.0)
    found = (
        entries.groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where((a >= MIN_DOCS) & (a * c > b * t))
        .withColumn("g2", 2 * (side(a, share) + side(b, 1 - share)))
        .withColumn("weight", F.log((a + 0.5) / (t + 1)) - F.log((b + 0.5) / (c + 1)))
        .where((F.col("g2") >= MIN_G2) & (F.col("weight") >= 1.0))
        .orderBy(F.desc("g2"), "entry")
        .limit(LEXICON)
    )
    return {r["entry"]: r["weight"] for r in found.collect()}


def add_features(df: DataFrame, text: str, out: str, lexica: dict[int, dict[str, float]], part) -> DataFrame:
    """``df`` with a feature vector; the lexicon of a row is chosen by column ``part``."""
    held = df.sparkSession.sparkContext.broadcast(lexica)
    scorers: dict[int, Scorer] = {}

    @F.pandas_udf("array<double>")
    def features(texts: pd.Series, parts: pd.Series) -> pd.Series:
        if not scorers:
            scorers.update({k: Scorer(x) for k, x in held.value.items()})
        return pd.Series([scorers[k].row(t) for t, k in zip(texts, parts)])

    return df.withColumn(out, array_to_vector(features(F.col(text).cast("string"), part)))


class Model:
    """A fitted scorer: lexicon, trees and calibration, or a constant where labels can't teach more."""

    def __init__(self, lexicon: dict[str, float], trees, isotonic, rate: float):
        self.lexicon, self.trees, self.isotonic, self.rate = lexicon, trees, isotonic, rate

    def features(self, df: DataFrame, text: str, out: str) -> DataFrame:
        return add_features(df, text, out, {0: self.lexicon}, F.lit(0))

    def score(self, df: DataFrame, text: str = "text", out: str = "score") -> DataFrame:
        """``df`` with a score column; all other columns stay (helper columns start with ``__tox``)."""
        small_batches(df.sparkSession)
        if self.trees is None:
            return df.withColumn(out, F.lit(self.rate))
        rows = self.trees.transform(self.features(df, text, "__tox_x"))
        rows = self.isotonic.transform(rows.withColumn("__tox_p", vector_to_array("__tox_probability")[1]))
        score = F.least(F.greatest(F.col("__tox_score"), F.lit(0.0)), F.lit(1.0))
        return rows.withColumn(out, score).drop("__tox_x", "__tox_p", "__tox_score", "__tox_raw", "__tox_probability", "__tox_prediction")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The lexicon learns from all training documents, trees from crc parts 0 and 1, calibration from part 3.

    Trees and calibration see each document by a lexicon learned without its crc part.  Where labels are
    few: a part whose lexicon the other parts can't teach (they lack a class) is seen by the lexicon of all
    parts; if parts 0 and 1, or part 3, lack a class, trees and calibration both learn from all three
    parts.  Only if all three together lack a class is the score a constant.
    """
    small_batches(docs.sparkSession)
    train = training_documents(docs, labels)
    part = crc32_mod4(F.col("doc_id"))
    each = {(r["part"], r["toxic"] > 0): r["count"] for r in train.groupBy(part.alias("part"), "toxic").count().collect()}
    total = lambda y, parts: sum(n for (p, z), n in each.items() if z == y and p in parts)
    both = lambda parts: total(True, parts) > 0 and total(False, parts) > 0
    learned = (0, 1, 3)
    rows = sum(each.values())
    rate = total(True, learned) / rows if rows else 0.0
    if not both(learned):
        return Model({}, None, None, float(rate))
    entries = count_entries(train)
    lexicon = learn_lexicon(entries, total(True, learned), total(False, learned))
    others = {k: [p for p in learned if p != k] for k in learned}
    folds = {k: learn_lexicon(entries, total(True, p), total(False, p), k) if both(p) else lexicon for k, p in others.items()}
    data = add_features(train, "text", "__tox_x", folds, part).select(part.alias("part"), F.col("toxic").cast("double").alias("label"), "__tox_x")
    data = materialize(data.repartition(8), "toxicity-features")
    apart = both((0, 1)) and both((3,))
    trees = GBTClassifier(
        featuresCol="__tox_x", labelCol="label", predictionCol="__tox_prediction",
        maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, minInstancesPerNode=5 if rows > 500 else 1, seed=7,
    )
    trees = trees.setProbabilityCol("__tox_probability").setRawPredictionCol("__tox_raw").fit((data.where("part <> 3") if apart else data).coalesce(4))
    scored = trees.transform(data.where("part = 3") if apart else data).withColumn("__tox_p", vector_to_array("__tox_probability")[1])
    isotonic = IsotonicRegression(featuresCol="__tox_p", labelCol="label", predictionCol="__tox_score").fit(scored.select("__tox_p", "label").coalesce(1))
    return Model(lexicon, trees, isotonic, float(rate))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted.

    held_out: ``crc32(doc_id as text) mod 4`` is 2 (such labels are never learned from).  score is
    a calibrated probability, of null (as empty) and empty texts too; predicted is 1 from
    ``threshold``.  If the labels that may be learned from lack a class, every score is their share of
    toxic ones (0 without labels).  An empty table gives no rows; lang, source and other columns are never read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = fit(docs, labels).score(rows)
    return scored.select("doc_id", (crc32_mod4(F.col("doc_id")) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents scored below ``threshold``, with their own columns, whatever these are called.

    Rows are scored by their text alone: null and empty texts, null and repeated ids too, rows of one text
    alike.  Whole texts are read, however long.  An empty table stays empty.
    """
    own = docs.columns
    renamed = docs.toDF(*(f"__own_{k}" for k in range(len(own))))
    scored = fit(docs, labels).score(renamed, f"__own_{own.index('text')}", "__tox_final")
    return scored.where(F.col("__tox_final") < threshold).select(*renamed.columns).toDF(*own)
