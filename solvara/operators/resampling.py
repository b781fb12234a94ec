"""The bootstrap of score metrics in two passes over rows sorted by score.

Rows are shuffled once, as they are: (score, label, hash of the key), whatever the number of replicates.  A task
draws the weights of all replicates for its rows as vectors and adds them up by score.  The first pass
returns each range's sums and those of the scores at its ends, which other ranges may share; carried from range to
range they are the counts before each range.  The second pass adds up what the scores inside each range give to each
metric of each replicate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solvara.sources import saved

#: Cumulative probabilities of a Poisson variable of mean 1 (fixed values).
POISSON = (0.367879441, 0.735758882, 0.919698603, 0.981011843, 0.996340153, 0.999405815)
#: Rows whose weights are drawn at once.
ROWS = 256
#: Fixed values of the hash.
_P1, _P2, _P3, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


def _hash_int(value: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """64-bit xxHash of an int, with a seed for each: what ``xxhash64`` makes of a further int column."""
    with np.errstate(over="ignore"):
        h = (seed + _P5 + np.uint64(4)) ^ (value.astype(np.uint64) * _P1)
        h = ((h << np.uint64(23)) | (h >> np.uint64(41))) * _P2 + _P3
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        return h ^ (h >> np.uint64(32))


def poisson_weights(key: np.ndarray, b: int, seed: int) -> np.ndarray:
    """Weights (rows by replicates 1 to ``b``) from the rows' key hashes."""
    h = _hash_int(np.arange(1, b + 1)[None, :], key.view(np.uint64)[:, None])
    h = _hash_int(np.array([seed]), h)
    u = ((h & np.uint64(2**30 - 1)).astype(float) + 0.5) / float(2**30)
    return np.searchsorted(POISSON, u, side="left").astype(np.int64)


def _sums(batches: Iterator[pa.RecordBatch], b: int, seed: int) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
    """(score, positives, negatives) of the scores of sorted rows, each once; the counts are vectors of replicates."""
    held: tuple[float, np.ndarray, np.ndarray] | None = None
    for batch in batches:
        score, y, key = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        for start in range(0, len(score), ROWS):
            s, one = score[start : start + ROWS], y[start : start + ROWS, None] == 1
            w = poisson_weights(np.ascontiguousarray(key[start : start + ROWS]), b, seed)
            cuts = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
            pos, neg = np.add.reduceat(w * one, cuts), np.add.reduceat(w * ~one, cuts)
            for k, cut in enumerate(cuts):
                if held is not None and held[0] == s[cut]:
                    held = held[0], held[1] + pos[k], held[2] + neg[k]
                else:
                    if held is not None:
                        yield held
                    held = float(s[cut]), pos[k], neg[k]
    if held is not None:
        yield held


def _gains(score: np.ndarray, pos: np.ndarray, neg: np.ndarray, tp0: np.ndarray, fp0: np.ndarray, P: np.ndarray, tau: float) -> np.ndarray:
    """What scores (rows, falling) give to PR area, ranked pairs, positives and negatives at ``tau``, and squared errors."""
    tp, fp = tp0 + np.cumsum(pos, axis=0), fp0 + np.cumsum(neg, axis=0)
    before_tp, before = tp - pos, (tp - pos) + (fp - neg)
    with np.errstate(divide="ignore", invalid="ignore"):
        p1 = np.where(tp + fp > 0, tp / (tp + fp), 1.0)
        p0 = np.where(before > 0, before_tp / before, 1.0)
        area = np.where(P > 0, pos / P, 0.0) * (p1 + p0) / 2
    hit = (score >= tau)[:, None]
    s = score[:, None]
    return np.stack([area.sum(axis=0), (neg * (tp - pos / 2)).sum(axis=0), (pos * hit).sum(axis=0), (neg * hit).sum(axis=0), (pos * (1 - s) ** 2 + neg * s**2).sum(axis=0)])


def bootstrap(df: DataFrame, score: str, label: str, key: str, b: int = 1000, seed: int = 42, tau: float = 0.3) -> DataFrame:
    """(metric, mean, low, high): means and 95 % intervals of PR-AUC, ROC-AUC, F2 at ``tau`` and Brier score.

    Replicates have Poisson(1) row weights from a seeded hash of the key; rows of one key have the same
    weight.  A replicate without one of the classes is passed over, and without any (an empty table) the result has
    no rows.  Rows without a score or label take no part.  Many rows of one score may lie in several ranges.
    """
    spark, width = df.sparkSession, b
    rows = df.select(F.col(score).cast("double").alias("s"), F.col(label).cast("int").alias("y"), F.xxhash64(key).alias("k")).where("s IS NOT NULL AND y IS NOT NULL AND NOT isnan(s)")
    placed = rows.repartitionByRange(F.desc("s"), "k").sortWithinPartitions(F.desc("s"), "k").withColumn("at", F.spark_partition_id())
    placed = saved(placed, "bootstrap")

    def by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[pa.RecordBatch]]]:
        """The batches of each range; a task reads whole ranges, since a range is one group of the shuffle below."""
        for batch in batches:
            at = batch.column(3).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
            for a, z in zip(cuts, cuts[1:]):
                if z > a:
                    yield int(at[a]), batch.slice(a, z - a)

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
        now, held = None, []
        for at, part in by_range(batches):
            if at != now and held:
                yield now, held
                held = []
            now = at
            held.append(part)
        if held:
            yield now, held

    # ranges stay whole and in order: files may be split or packed when they are read
    sorted_again = placed.repartition("at").sortWithinPartitions("at", F.desc("s"), "k")

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, parts in grouped(batches):
            first = last = None
            pos, neg = np.zeros(width, np.int64), np.zeros(width, np.int64)
            for x in _sums(iter(parts), width, seed):
                first, last = first or x, x
                pos, neg = pos + x[1], neg + x[2]
            rows = [("all", 0.0, pos, neg), ("first", *first)] + ([("last", *last)] if last[0] != first[0] else [])
            yield pa.RecordBatch.from_arrays(
                [pa.array([at] * len(rows), pa.int32()), pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), *(pa.array([r[k].tobytes() for r in rows], pa.binary()) for k in (2, 3))],
                ["at", "kind", "s", "pos", "neg"],
            )

    found = [(r.at, r.kind, r.s, np.frombuffer(r.pos, np.int64), np.frombuffer(r.neg, np.int64)) for r in sorted_again.mapInArrow(ends, "at int, kind string, s double, pos binary, neg binary").collect()]
    zero = np.zeros(width, np.int64)
    P, N = (sum((r[k] for r in found if r[1] == "all"), zero) for k in (3, 4))
    starts, shared, tp, fp = {}, [], zero, zero
    for at in sorted({r[0] for r in found}):
        own = {r[1]: r for r in found if r[0] == at}
        first, last, whole = own["first"], own.get("last"), own["all"]
        # scores at the ends of ranges, joined where they go on in the next range
        for r, before in ((first, (tp, fp)), (last, last and (tp + whole[3] - last[3], fp + whole[4] - last[4]))):
            if r and shared and shared[-1][0] == r[2]:
                shared[-1] = (r[2], shared[-1][1] + r[3], shared[-1][2] + r[4], shared[-1][3], shared[-1][4])
            elif r:
                shared.append((r[2], r[3], r[4], *before))
        starts[at] = (first[2], last[2] if last else first[2], tp + first[3], fp + first[4])
        tp, fp = tp + whole[3], fp + whole[4]
    total = np.zeros((5, width))
    for s, pos, neg, before_tp, before_fp in shared:
        total += _gains(np.array([s]), pos[None], neg[None], before_tp, before_fp, P, tau)
    sent = spark.sparkContext.broadcast((starts, P))

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, P = sent.value
        for at, parts in grouped(batches):
            low, high, tp, fp = starts[at]
            out, held = np.zeros((5, width)), []

            def add(held: list, tp: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                score, pos, neg = np.array([x[0] for x in held]), np.stack([x[1] for x in held]), np.stack([x[2] for x in held])
                return _gains(score, pos, neg, tp, fp, P, tau), tp + pos.sum(axis=0), fp + neg.sum(axis=0)

            for x in _sums(iter(parts), width, seed):
                if x[0] not in (low, high):
                    held.append(x)
                    if len(held) == ROWS:
                        gain, tp, fp = add(held, tp, fp)
                        out, held = out + gain, []
            if held:
                out = out + add(held, tp, fp)[0]
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([out.tobytes()], pa.binary())], ["at", "v"])

    for _, v in sorted((r.at, r.v) for r in sorted_again.mapInArrow(inner, "at int, v binary").collect()):
        total += np.frombuffer(v).reshape(5, width)
    ok = (P > 0) & (N > 0)
    area, ranked, hit_pos, hit_neg, squares = total[:, ok]
    P, N = P[ok], N[ok]
    values = {"pr_auc": area, "roc_auc": ranked / (P * N), "f2": 5.0 * hit_pos / (hit_pos + 4.0 * P + hit_neg), "brier": squares / (P + N)}
    out = [(name, float(v.mean()), *map(float, np.percentile(v, [2.5, 97.5]))) for name, v in values.items() if len(v)]
    return spark.createDataFrame(out, "metric string, mean double, low double, high double")
