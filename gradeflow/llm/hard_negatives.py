"""Hard-negative mining with bounds along a spanning tree of anchors.

The anchors of a block are joined by a spanning tree of least distances. At an anchor each row's score is known, or bounded; at the
next anchor of the tree it differs by at most the length of the edge times the row's norm. Only rows whose bounds overlap
the window of scores that an anchor still asks for are scored there. Each task keeps no more rows of an anchor than the
result can have, and the windows narrow as better rows are met.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeflow.llm.common import ship, stored
from gradeflow.operators.ordering import row_index
from gradeflow.session import fresh_path

ANCHORS_EVERY = 100
POSITIVES = 5
NEGATIVES = 10
# A negative's score lies between these shares of the positive's, in hundredths.
WINDOW = (30, 90)
# Anchors of one block: their bounds, and the tree, go with one pass over all rows.
BLOCK = 1024
# Rows that a task scores at once.
ROWS = 4096
_LEAST, _MOST = -(1 << 62), 1 << 62


def quantised(rows: DataFrame, classes: int = 10, shifted: int = 7, scale: int = 256) -> DataFrame:
    """``vec_id, label, vector``: rows that take part, one per ``vec_id``, with components ``floor(scale * x)`` as 64-bit integers.

    Rows with a null in ``vec_id``, ``label`` or ``embedding``, with a null or non-finite component, or with one so large that a
    double can't hold all scores (its square times the number of components beyond 2**53) are left out. Where ``shifted`` divides ``vec_id`` the label becomes
    ``(label + 1) % classes``. Of rows that repeat a ``vec_id`` the least by label, then components, stays.
    """
    vector = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")))
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) * scale < F.lit(2.0**53)))
    exact = F.forall("vector", lambda x: x.cast("double") * x * F.size("vector") <= F.lit(2.0**53))
    label = F.when(F.col("vec_id") % shifted == 0, (F.col("label") + 1) % classes).otherwise(F.col("label"))
    whole = rows.where("vec_id is not null and label is not null and embedding is not null").where(finite)
    made = whole.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("int").alias("label"), vector.alias("vector")).where(exact)
    return made.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("row")).select("vec_id", "row.label", "row.vector")


@dataclass
class Tree:
    """Anchors in an order in which each one's parent comes before it, the root first."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    parent: np.ndarray
    edge: np.ndarray


def spanning_tree(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> Tree:
    """The spanning tree of least Euclidean distances, grown anchor by anchor from the first one."""
    n = len(ids)
    order, parent, edge = np.zeros(n, np.int64), np.full(n, -1), np.zeros(n)
    squares = (vectors * vectors).sum(axis=1)
    near = np.full(n, np.inf)
    owner, left = np.zeros(n, np.int64), np.ones(n, bool)
    at = 0
    for k in range(n):
        order[k], left[at] = at, False
        if k:
            parent[k], edge[k] = owner[at], np.sqrt(near[at])
        apart = np.maximum(squares + squares[at] - 2 * (vectors @ vectors[at]), 0)
        closer = left & (apart < near)
        near[closer], owner[closer] = apart[closer], k
        at = int(np.where(left, near, np.inf).argmin())
    return Tree(ids[order], labels[order], vectors[order], parent, edge)


class Best:
    """For each anchor and slot the ``k`` best rows met: highest scores first, ties by smaller id."""

    def __init__(self, anchors: int, slots: int, k: int) -> None:
        self.k = k
        self.scores = np.full((anchors, slots, k), _LEAST)
        self.ids = np.full((anchors, slots, k), _MOST)

    def offer(self, anchor: int, slot: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.append(self.scores[anchor, slot], scores), np.append(self.ids[anchor, slot], ids)
        best = np.lexsort((ids, -scores))[: self.k]
        self.scores[anchor, slot], self.ids[anchor, slot] = scores[best], ids[best]


def _offer_rows(tree: Tree, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, same: bool, low: np.ndarray, high: np.ndarray, best: Best) -> int:
    """Offer each anchor the rows in its windows ``low`` to ``high``, one for each slot; how many scores were worked out.

    ``same`` asks for other rows of the anchor's label, else rows of other labels are asked for.
    """
    # Distances and norms are rounded, scores are integers: half a unit more on either side keeps the bounds safe.
    norms = np.sqrt((vectors * vectors).sum(axis=1)) * (1 + 1e-9)
    lows, highs = np.empty((len(tree.ids), len(ids))), np.empty((len(tree.ids), len(ids)))
    scored = 0
    for k in range(len(tree.ids)):
        if k:
            reach = tree.edge[k] * norms + 0.5
            np.subtract(lows[tree.parent[k]], reach, out=lows[k])
            np.add(highs[tree.parent[k]], reach, out=highs[k])
            least = np.maximum(low[k], best.scores[k, :, -1])
            asked = (labels == tree.labels[k]) == same
            overlap = asked & (highs[k] >= least.min()) & (lows[k] <= high[k].max())
        else:
            least = np.maximum(low[k], best.scores[k, :, -1])
            overlap = np.ones(len(ids), bool)  # every row is scored at the root
        rows = np.flatnonzero(overlap)
        if not len(rows):
            continue
        scores = vectors[rows] @ tree.vectors[k]
        scored += len(rows)
        lows[k, rows] = highs[k, rows] = scores
        wanted = ((labels[rows] == tree.labels[k]) == same) & (ids[rows] != tree.ids[k])
        whole = scores.astype(np.int64)
        for slot in range(best.scores.shape[1]):
            found = wanted & (whole >= least[slot]) & (whole <= high[k, slot])
            if found.any():
                best.offer(k, slot, whole[found], ids[rows][found])
    return scored


def _passed(rows: DataFrame, tree: Tree, same: bool, low: np.ndarray, high: np.ndarray, k: int) -> DataFrame:
    """``anchor, slot, id, score``: the best ``k`` rows of each anchor and slot in each task's own rows, one pass over all."""
    size = tree.vectors.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(tree.ids), low.shape[1], k)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids, labels = part.column("vec_id").to_numpy(), part.column("label").to_numpy()
                _offer_rows(tree, ids, labels, _matrix(part.column("vector"), size), same, low, high, best)
        anchor, slot, place = np.nonzero(best.ids < _MOST)
        columns = [tree.ids[anchor], slot.astype(np.int32), best.ids[anchor, slot, place], best.scores[anchor, slot, place]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor", "slot", "id", "score"])

    ship(rows.sparkSession)
    return rows.mapInArrow(run, "anchor long, slot int, id long, score long")


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """Vectors as rows of doubles; components that a shorter one lacks are 0, those beyond ``size`` meet zeros."""
    counts = column.value_lengths().to_numpy().astype(np.int64)
    values = column.flatten().to_numpy().astype(np.float64)
    if (counts == size).all():
        return values.reshape(-1, size)
    row = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(values)) - np.repeat(np.cumsum(counts) - counts, counts)
    made = np.zeros((len(counts), size))
    inside = place < size
    made[row[inside], place[inside]] = values[inside]
    return made


def _firsts(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` rows of each anchor and slot; every task has sent ``k`` at most."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _block(rows: DataFrame, tree: Tree, positives: int, negatives: int, window: tuple[int, int]) -> DataFrame:
    # What the anchors, which are rows too, score among themselves is a first lower end of each window.
    n = len(tree.ids)
    own = Best(n, 1, positives)
    open_end = np.full((n, 1), float(_MOST))
    _offer_rows(tree, tree.ids, tree.labels, tree.vectors, True, np.full((n, 1), float(_LEAST)), open_end, own)
    found = _firsts(_passed(rows, tree, True, own.scores[:, :, -1].astype(float), open_end, positives), positives)
    # At most ``positives`` rows for each anchor of the block come to the driver.
    place = {int(a): k for k, a in enumerate(tree.ids)}
    ids, scores = np.full((n, positives), _MOST), np.zeros((n, positives), np.int64)
    for r in found.collect():
        ids[place[r["anchor"]], r["rank"] - 1], scores[place[r["anchor"]], r["rank"] - 1] = r["id"], r["score"]
    # 100 * negative between the two shares of the positive: whole numbers from the ceiling of one to the floor of the other.
    low, high = (-(-window[0] * scores // 100)).astype(float), (window[1] * scores // 100).astype(float)
    low[ids == _MOST], high[ids == _MOST] = _MOST, _LEAST
    own = Best(n, positives, negatives)
    _offer_rows(tree, tree.ids, tree.labels, tree.vectors, False, low, high, own)
    low = np.maximum(low, own.scores[:, :, -1])
    mined = _firsts(_passed(rows, tree, False, low, high, negatives), negatives)
    spark = rows.sparkSession
    of_anchor = [(int(a), slot, int(ids[k, slot]), int(scores[k, slot])) for k, a in enumerate(tree.ids) for slot in range(positives) if ids[k, slot] != _MOST]
    positive = spark.createDataFrame(of_anchor, "anchor long, slot int, positive_id long, positive_score long")
    return mined.join(F.broadcast(positive), ["anchor", "slot"]).select(
        F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(
    embeddings: DataFrame, every: int = ANCHORS_EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW, block: int = BLOCK
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: hard negatives of each anchor and positive.

    Rows are those of :func:`quantised` (``vec_id, label, embedding``); a score is the integer inner product, components that one of the two vectors
    lacks count as 0. Anchors are the rows whose ``vec_id`` ``every`` divides; an anchor's positives are its ``positives`` best other rows of the same
    label. For each of them the ``negatives`` best rows of other labels are returned whose score is between the shares ``window`` of the
    positive's, in hundredths. Ties go to the smaller ``vec_id``. Anchors are taken in blocks of ``block``, by label: a stated
    query set against all rows, two passes over them for each block.

    An empty table, one without anchors, and anchors without positives give no rows. Scores of 0 admit 0 alone, negative scores nothing.
    Repeated ``vec_id`` are one row (see :func:`quantised`). Other columns are ignored. A vector of any length is held whole.
    """
    spark = embeddings.sparkSession
    rows = stored(quantised(embeddings), "vectors")
    anchors = stored(row_index(rows.where(F.col("vec_id") % every == 0), ["label", "vec_id"], carry=["vector"]), "anchors")
    count = anchors.count()
    if not count:
        return spark.createDataFrame([], OUT)
    made = fresh_path(spark, "negatives")
    for first in range(0, count, block):
        own = anchors.where(F.col("index").between(first, first + block - 1)).collect()  # at most ``block`` vectors
        vectors = _matrix(pa.array([r["vector"] for r in own], pa.list_(pa.int64())), max(len(r["vector"]) for r in own))
        tree = spanning_tree(np.array([r["vec_id"] for r in own]), np.array([r["label"] for r in own]), vectors)
        _block(rows, tree, positives, negatives, window).write.parquet(f"{made}/first={first}")
    return spark.read.schema(OUT).option("recursiveFileLookup", True).parquet(made)
