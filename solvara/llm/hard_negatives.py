"""Hard negatives by score windows around positives, from STR-packed R-trees over all vectors.

Vectors are quantised to integers, so scores are exact.  They are dealt to tiles (slabs by one
coordinate, ranges of the next within them), and each tile is packed by sort-tile-recursion into
leaves and inner nodes with minimum bounding boxes.  A box gives an interval for the inner product with an anchor,
coordinate by coordinate; a best-first queue takes the box with the highest possible score next and
drops what lies outside all windows or strictly below the kth score found.  A block of anchors goes
down a tree together: a node is visited with the anchors for which it may still matter.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from solvara.llm.common import materialize, shared_dir

SCALE, FLIP, LABELS = 256, 7, 10
TOP, LOW, HIGH = 5, 80, 100
#: Vectors in a tile (one tree) and in a leaf, children of a node.
TILE, LEAF, FANOUT = 8192, 128, 8
#: Anchors searched in one pass over the tiles, and the bytes of their vectors at most.
BLOCK, BLOCK_BYTES = 8192, 32 << 20
#: Slabs of the first coordinate.
SLABS = 16
EXACT_FLOAT, EXACT_LONG = 2**53, 2**63


# ---------------------------------------------------------------- vectors


def quantised(vectors: DataFrame, scale: int = SCALE, flip: int = FLIP, labels: int = LABELS) -> DataFrame:
    """(vec_id, label, q): floor(scale * x) of each component, and labels of ids divisible by ``flip`` moved on.

    Rows with a null label, a null vector or a null or non-finite component take no part, nor do rows
    without an id, which no result could name.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").where(finite)
    moved = F.when(F.col("vec_id") % flip == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    return rows.select("vec_id", moved.alias("label"), F.transform("embedding", lambda x: _floor(x * scale)).alias("q"))


def _floor(x):
    """floor as a double; from 2**52 on every double is whole."""
    return F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows (given as doubles) of ``a`` with rows of ``b``, shorter rows padded with zeros."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if most < EXACT_FLOAT:
        return (a @ b.T).astype(np.int64)
    if most < EXACT_LONG:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = np.vectorize(int, otypes=[object])
    found = whole(a) @ whole(b).T
    if found.size and (max(found.max(), -found.min()) >= EXACT_LONG):
        raise OverflowError("an inner product doesn't fit into a long")
    return found.astype(np.int64)


def _padded(rows: list, dim: int) -> np.ndarray:
    out = np.zeros((len(rows), dim))
    for k, row in enumerate(rows):
        out[k, : len(row)] = row
    return out


def _widen(a: np.ndarray, dim: int) -> np.ndarray:
    return a if a.shape[1] >= dim else np.pad(a, ((0, 0), (0, dim - a.shape[1])))


def _matrix(column: pa.ListArray) -> np.ndarray:
    """The lists of an Arrow column as rows of one matrix, shorter ones padded with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == lengths[0]).all():
        return flat.reshape(len(lengths), lengths[0])
    return _padded(np.split(flat, np.cumsum(lengths)[:-1]), int(lengths.max(initial=0)))


# ---------------------------------------------------------------- trees


def str_order(v: np.ndarray, labels: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """Rows in the order of sort-tile-recursion: by label, then slabs of the coordinates that vary most."""
    axes = np.argsort(-v.var(axis=0), kind="stable")[:8] if v.size else np.zeros(0, int)

    def tiled(rows: np.ndarray, depth: int) -> list[np.ndarray]:
        pages = -(-len(rows) // leaf)
        if pages <= 1 or depth == len(axes):
            return [rows]
        slabs = max(2, round(pages ** (1 / (len(axes) - depth)))) if depth + 1 < len(axes) else pages
        size = -(-pages // slabs) * leaf
        rows = rows[np.argsort(v[rows, axes[depth]], kind="stable")]
        return [x for k in range(0, len(rows), size) for x in tiled(rows[k : k + size], depth + 1)]

    parts = [x for label in np.unique(labels) for x in tiled(np.flatnonzero(labels == label), 0)]
    return np.concatenate(parts) if parts else np.zeros(0, int)


@dataclass
class Tree:
    """Rows in packed order and, level by level, nodes over runs of children."""

    ids: np.ndarray
    labels: np.ndarray
    v: np.ndarray
    #: Per level, leaves first: lowest and highest corner of each box, lowest and highest label.
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    leaf: int
    fanout: int

    @classmethod
    def pack(cls, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, leaf: int = LEAF, fanout: int = FANOUT) -> Tree:
        at = str_order(v, labels, leaf)
        tree = cls(ids[at], labels[at], v[at], [], leaf, fanout)
        low, high, first, last = tree.v, tree.v, tree.labels, tree.labels
        step = leaf
        while not tree.levels or len(low) > 1:
            cuts = np.arange(0, max(len(low), 1), step)
            if not len(low):
                break
            low, high = np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)
            first, last = np.minimum.reduceat(first, cuts), np.maximum.reduceat(last, cuts)
            tree.levels.append((low, high, first, last))
            step = fanout
        return tree

    def search(self, found: Found, boxes: list[int]) -> None:
        """Best-first from the root with all queries of ``found``; ``boxes`` counts leaves read and leaves in all."""
        if not self.levels:
            return
        boxes[1] += len(self.levels[0][0])
        queue: list[tuple[float, int, int, np.ndarray]] = []

        def push(level: int, nodes: np.ndarray, active: np.ndarray) -> None:
            low, high, first, last = (x[nodes] for x in self.levels[level])
            q = found.anchors[active]
            up, down = np.maximum(q, 0), np.minimum(q, 0)
            most, least = up @ high.T + down @ low.T, up @ low.T + down @ high.T
            may = found.may(active, most, least, first, last)
            for k, node in enumerate(nodes):
                if len(rows := np.flatnonzero(may[:, k])):
                    heapq.heappush(queue, (-float(most[rows, k].max()), level, int(node), active[rows]))

        push(len(self.levels) - 1, np.arange(len(self.levels[-1][0])), np.arange(len(found.anchors)))
        while queue:
            _, level, node, active = heapq.heappop(queue)
            if level:
                push(level - 1, np.arange(node * self.fanout, min((node + 1) * self.fanout, len(self.levels[level - 1][0]))), active)
                continue
            boxes[0] += 1
            rows = slice(node * self.leaf, (node + 1) * self.leaf)
            found.add(active, _dot(found.anchors[active], self.v[rows]), self.ids[rows], self.labels[rows])


class Found:
    """The best ``top`` rows of each query so far.

    Queries belong to anchors; a query takes scores from ``low`` to ``high``, of rows with its anchor's label
    (``same``, other ids only) or with other labels.
    """

    def __init__(self, anchors: np.ndarray, ids: np.ndarray, labels: np.ndarray, of: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, top: int = TOP):
        self.anchors, self.ids, self.labels, self.same, self.top = anchors, ids, labels, same, top
        #: Queries are ordered by their anchor, so those of one anchor are a run.
        self.of, self.high = of, high
        self.kth = low.copy()
        self.first = np.searchsorted(of, np.arange(len(anchors) + 1))
        self.held = (np.zeros(0, np.int64),) * 3

    def may(self, active: np.ndarray, most: np.ndarray, least: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Whether a box may hold a row that some query of an anchor wants."""
        own = self.labels[active, None]
        fits = (first <= own) & (own <= last) if self.same else (first != own) | (last != own)
        lowest, highest = self._range(active)
        # floating bounds are widened by more than their rounding
        slack = 1e-9 * np.maximum(np.abs(most), np.abs(least)) + 1e-6
        return fits & (most + slack >= lowest[:, None]) & (least - slack <= highest[:, None])

    def _range(self, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lowest score still wanted and highest allowed over the queries of each anchor."""
        low = np.full(len(self.anchors), np.inf)
        high = np.full(len(self.anchors), -np.inf)
        np.minimum.at(low, self.of, self.kth)
        np.maximum.at(high, self.of, self.high)
        return low[active], high[active]

    def add(self, active: np.ndarray, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        own = self.labels[active, None]
        fits = (labels == own) & (ids != self.ids[active, None]) if self.same else labels != own
        lowest, highest = self._range(active)
        rows, at = np.nonzero(fits & (scores >= lowest[:, None]) & (scores <= highest[:, None]))
        if not len(rows):
            return
        # each pair of anchor and row, once for every query of the anchor
        anchor = active[rows]
        times = self.first[anchor + 1] - self.first[anchor]
        query = np.repeat(self.first[anchor] - np.cumsum(times) + times, times) + np.arange(times.sum())
        score, ident = np.repeat(scores[rows, at], times), np.repeat(ids[at], times)
        keep = (score >= self.kth[query]) & (score <= self.high[query])
        query, score, ident = (np.concatenate(x) for x in zip(self.held, (query[keep], score[keep], ident[keep])))
        order = np.lexsort((ident, -score, query))
        query, score, ident = query[order], score[order], ident[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        best = place < self.top
        self.held = query[best], score[best], ident[best]
        full = place == self.top - 1
        self.kth[query[full]] = np.maximum(self.kth[query[full]], score[full])


# ---------------------------------------------------------------- Spark


TILES = "ids binary, labels binary, dim int, v binary"


def tiles(rows: DataFrame, tile: int = TILE, slabs: int = SLABS) -> DataFrame:
    """``quantised`` rows dealt to tiles of at most ``tile`` vectors, each packed as one row in STR order.

    Slabs of the first coordinate are cut at approximate quantiles, and ranges of the second within
    them; the id parts equal vectors.  Where cuts lie changes the work, not the result.
    """
    first, second = F.coalesce(F.try_element_at("q", F.lit(1)), F.lit(0.0)), F.coalesce(F.try_element_at("q", F.lit(2)), F.lit(0.0))
    placed = rows.withColumns({"__a": first, "__b": second})
    cuts = placed.approxQuantile("__a", [k / slabs for k in range(1, slabs)], 0.01) if slabs > 1 else []
    slab = sum((F.col("__a") > c).cast("int") for c in sorted(set(cuts))) if cuts else F.lit(0)
    dealt = placed.withColumn("__slab", slab).repartitionByRange("__slab", "__b", "vec_id").select("vec_id", "label", "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        count = 0

        def packed() -> pa.RecordBatch:
            dim = max(x[2].shape[1] for x in held)
            ids, labels, v = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]), np.concatenate([_widen(x[2], dim) for x in held])
            at = str_order(v, labels)
            columns = [ids[at].tobytes()], [labels[at].tobytes()], [dim], [v[at].tobytes()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.binary(), pa.int32(), pa.binary()))], ["ids", "labels", "dim", "v"])

        for b in batches:
            for start in range(0, b.num_rows, tile):
                part = b.slice(start, tile)
                if count + part.num_rows > tile:
                    yield packed()
                    held, count = [], 0
                held.append((part.column(0).to_numpy(), part.column(1).to_numpy(), _matrix(part.column(2))))
                count += part.num_rows
        if held:
            yield packed()

    return dealt.mapInArrow(run, TILES)


def anchor_blocks(rows: DataFrame, every: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, vectors) of the rows whose id is divisible by ``every``, one bounded block after the other."""
    held: list = []
    size = 0

    def block() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array([x[0] for x in held], np.int64), np.array([x[1] for x in held], np.int64), _padded([x[2] for x in held], max(len(x[2]) for x in held))

    for vec_id, label, q in rows.where(F.col("vec_id") % every == 0).toLocalIterator():
        if held and (len(held) == BLOCK or size + 8 * len(q) > BLOCK_BYTES):
            yield block()
            held, size = [], 0
        held.append((vec_id, label, q))
        size += 8 * len(q)
    if held:
        yield block()


HITS = "query long, score long, id long, read long, boxes long"


def best(packed: DataFrame, anchors: tuple[np.ndarray, np.ndarray, np.ndarray], of: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, top: int = TOP) -> DataFrame:
    """(query, score, id, place): the ``top`` rows of each query over all tiles, one pass.

    A task carries its best rows from tile to tile and returns at most ``top`` for each query; the
    window over a query's rows keeps the first of each task before they are shuffled.
    """
    shared = packed.sparkSession.sparkContext.broadcast((anchors, of, low, high))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (ids, labels, q), of, low, high = shared.value
        found, boxes = None, [0, 0]
        for b in batches:
            for row in b.to_pylist():
                v = np.frombuffer(row["v"]).reshape(-1, row["dim"]) if row["dim"] else np.zeros((len(row["ids"]) // 8, 0))
                dim = max(v.shape[1], q.shape[1])
                if found is None:
                    found = Found(_widen(q, dim), ids, labels, of, low, high, same, top)
                elif found.anchors.shape[1] < dim:
                    found.anchors = _widen(found.anchors, dim)
                v = _widen(v, found.anchors.shape[1])
                Tree.pack(np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64), v).search(found, boxes)
        if found is not None:
            query, score, ident = found.held
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (query, score, ident, np.full(len(query), boxes[0]), np.full(len(query), boxes[1]))], ["query", "score", "id", "read", "boxes"])

    hits = packed.mapInArrow(run, HITS)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = TOP, negatives: int = TOP, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of all anchors.

    Anchors are the rows whose id is divisible by ``every``.  For each of an anchor's first
    ``positives`` rows of its label come the first ``negatives`` rows of other labels with ``low *
    positive_score <= 100 * negative_score <= high * positive_score``; higher scores first, ties by smaller
    id.  Anchors without positives, and positives without such rows (all with a score below 0), have no
    rows in the result.  Shorter vectors count as padded with zeros.  A row that repeats an id is a row of
    its own, but never its own twin's positive.  Empty tables give no rows, other columns are ignored; inner
    products beyond 64 bits raise an error.
    """
    spark: SparkSession = vectors.sparkSession
    rows = materialize(quantised(vectors), "vectors")
    packed = materialize(tiles(rows), "tiles")
    path, schema = f"{shared_dir(spark)}/solvara-negatives-{uuid.uuid4().hex}", "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], schema).write.parquet(path)
    for anchors in anchor_blocks(rows, every):
        n = len(anchors[0])
        wide = np.full(n, np.inf)
        near = best(packed, anchors, np.arange(n), -wide, wide, True, positives).select("query", "score", "id").toPandas()
        near = near[near["score"] >= 0].sort_values(["query", "score", "id"], ascending=[True, False, True])
        of, score, ident = (near[c].to_numpy(np.int64) for c in ("query", "score", "id"))
        # the least and the greatest whole score of each window
        floor = np.array([-(-low * int(s) // 100) for s in score], float)
        ceiling = np.array([high * int(s) // 100 for s in score], float)
        found = best(packed, anchors, of, floor, ceiling, False, negatives)
        pairs = spark.createDataFrame(list(zip(range(len(of)), anchors[0][of].tolist(), ident.tolist(), score.tolist())), "query long, anchor_id long, positive_id long, positive_score long")
        found = found.join(F.broadcast(pairs), "query")
        found.select("anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


NEGATIVES_SQL = """
WITH r AS (
  SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_inner_product(a.q, r.q)::BIGINT AS score
  FROM r a, r WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same AND vec_id != anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
