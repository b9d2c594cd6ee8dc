"""Hard-negative mining with anchor spanning-tree bounds.

Anchors in blocks meet all rows in blocks. Inside a block of anchors a minimum spanning tree tells how
far an anchor is from its parent: the score of a row at the child differs from that at the parent by at
most the edge times the length of the row. Level by level, only rows whose bounds reach the window an
anchor asks for are scored; where most do, the level is one matrix product. Bounds only save work, so
results do not depend on blocks or trees.

Two rounds: the first finds each anchor's positives (window: from its last place so far upwards), the
second the negatives in the windows that the positives give. Blocks hold the best few per anchor, which
are ranked across tasks; anchors are the stated query set, never collected.

Defined results: rows without an id, label or vector, or with a null or non-finite component, take no
part. Vectors of unequal length count as filled up with zeros, an empty one scores 0. A row is never its
own positive or negative, but another row with the same id may be; equal rows stay separate. Ties go to
the smaller id. An anchor without positives or negatives in its windows has no row. Scores are exact and
compared as whole numbers of up to 38 digits, and shown as 64-bit numbers; beyond, they are held at the
end of the range. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import blocks
from .common import stored
from .vectors import EXACT, LONG, exact_ints, largest, scaled, usable

#: Anchors in a block; its spanning tree is built from all their distances.
ANCHORS = 256
#: From this share of rows in the window a level of the tree is scored as one matrix product.
DENSE = 0.2
#: Pairs that are scored at a time where few are in the window.
PAIRS = 100_000
#: Signs of so many leading components order the anchors, so that a block holds near ones.
SIGNS = 32

#: Scores on their way: whole numbers of up to 38 digits.
DIGITS, MOST = pa.decimal128(38, 0), 10**38 - 1

Level = tuple[np.ndarray, np.ndarray | None, np.ndarray | None]


def spanning_tree(anchors: np.ndarray) -> list[Level]:
    """Levels of a minimum spanning tree from the anchor nearest the mean: members, their parents, and
    the lengths of the edges between them."""
    squares = (anchors * anchors).sum(1)
    root = int(np.argmin(((anchors - anchors.mean(0)) ** 2).sum(1)))
    parent, depth = np.full(len(anchors), root), np.zeros(len(anchors), np.int64)
    near = squares + squares[root] - 2 * anchors @ anchors[root]
    outside = np.ones(len(anchors), bool)
    outside[root] = False
    for _ in range(len(anchors) - 1):
        new = int(np.argmin(np.where(outside, near, np.inf)))
        outside[new] = False
        depth[new] = depth[parent[new]] + 1
        distance = squares + squares[new] - 2 * anchors @ anchors[new]
        closer = outside & (distance < near)
        near[closer], parent[closer] = distance[closer], new
    levels: list[Level] = [(np.array([root]), None, None)]
    for level in range(1, int(depth.max()) + 1):
        members = np.flatnonzero(depth == level)
        edges = np.sqrt(((anchors[members] - anchors[parent[members]]) ** 2).sum(1))
        levels.append((members, parent[members], edges))
    return levels


def scores_in_windows(
    anchors: np.ndarray, tree: list[Level], rows: np.ndarray, least: np.ndarray, most: np.ndarray, allowed: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Scores (anchor, row) and where they are exact: at least at all allowed pairs with a score from
    ``least`` to ``most`` of the anchor."""
    if largest(anchors) * largest(rows) * max(1, anchors.shape[1]) >= EXACT:
        return exact_ints(anchors) @ exact_ints(rows).T, allowed
    lengths = np.sqrt((rows * rows).sum(1))
    low = np.empty((len(anchors), len(rows)))
    high = np.empty_like(low)
    known = np.zeros(low.shape, bool)
    for members, parents, edges in tree:
        if parents is None:
            need = np.ones((1, len(rows)), bool)
        else:
            reach = edges[:, None] * lengths * (1 + 1e-9) + 1
            low[members], high[members] = low[parents] - reach, high[parents] + reach
            need = allowed[members] & (high[members] >= least[members, None]) & (low[members] <= most[members, None])
        if need.mean() > DENSE:
            low[members] = high[members] = anchors[members] @ rows.T
            known[members] = True
            continue
        which, at = np.nonzero(need)
        which = members[which]
        for k in range(0, len(at), PAIRS):
            pair = which[k : k + PAIRS], at[k : k + PAIRS]
            low[pair] = high[pair] = np.einsum("ij,ij->i", anchors[pair[0]], rows[pair[1]])
            known[pair] = True
    return low, known & allowed


def best_places(scores: np.ndarray, wanted: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the wanted scores reach the k-th best wanted one of their row, ties included."""
    held = np.where(wanted, blocks.ordinal(scores.ravel()).reshape(scores.shape).astype(np.float64), -np.inf)
    if held.shape[1] > k:
        wanted = wanted & (held >= np.partition(held, -k, axis=1)[:, -k:][:, :1])
    return np.nonzero(wanted)


def _whole(scores: np.ndarray) -> np.ndarray:
    return scores if scores.dtype == object else scores.astype(np.int64)


def _decimals(scores: np.ndarray) -> pa.Array:
    if scores.dtype != object:
        return pa.array(scores, pa.int64()).cast(DIGITS)
    return pa.array([Decimal(max(-MOST, min(MOST, int(x)))) for x in scores], DIGITS)


def _long(score: str) -> Column:
    end = F.lit(LONG).cast("decimal(38,0)")
    return F.greatest(F.least(F.col(score), end), -end).cast("bigint").alias(score)


def _aligned(anchors: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The components that both have; the others meet zeros."""
    common = min(anchors.shape[1], rows.shape[1])
    return anchors[:, :common], rows[:, :common]


class _Block:
    """A met block of rows: ids, labels, row numbers and scaled vectors."""

    def __init__(self, row: dict, kind: str, scale: int):
        self.ids = row["id"].values.to_numpy(zero_copy_only=False)
        self.labels = row["label"].values.to_numpy(zero_copy_only=False)
        self.numbers = row["block"].as_py() * blocks.ROWS + np.arange(len(self.ids))
        self.vectors = scaled(blocks.vectors_of(row["vector"].as_py(), len(self.ids), kind), scale)


class _Anchors:
    """An asked block, with the tree for the width of the rows it meets."""

    def __init__(self, row: dict, kind: str, scale: int):
        self.numbers = row["asked_number"].values.to_numpy()
        self.labels = row["asked_label"].values.to_numpy(zero_copy_only=False)
        self.vectors = scaled(blocks.vectors_of(row["asked_vector"].as_py(), len(self.numbers), kind), scale)
        self.trees: dict[int, list[Level]] = {}

    def scores(self, block: _Block, least, most, allowed) -> tuple[np.ndarray, np.ndarray]:
        anchors, rows = _aligned(self.vectors, block.vectors)
        tree = self.trees.get(anchors.shape[1])
        if tree is None:
            tree = self.trees[anchors.shape[1]] = spanning_tree(anchors)
        return scores_in_windows(anchors, tree, rows, least, most, allowed)


def _positives(pairs: DataFrame, kind: str, scale: int, k: int, id_type: str) -> DataFrame:
    """Of every anchor in every task, the best ``k`` other rows of its label."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for first, run in blocks.per_asked_block(batches):
            anchors, best = _Anchors(first, kind, scale), blocks.RunningBest(k)
            n = len(anchors.numbers)
            least, most = np.full(n, -np.inf), np.full(n, np.inf)
            for row in run:
                block = _Block(row, kind, scale)
                allowed = (anchors.labels[:, None] == block.labels) & (anchors.numbers[:, None] != block.numbers)
                scores, known = anchors.scores(block, least, most, allowed)
                which, at = best_places(scores, known, k)
                best.add(which, _whole(scores[which, at]), block.ids[at])
                which, held, _ = best.taken()
                ends = np.cumsum(np.bincount(which, minlength=n))
                full = np.flatnonzero(np.bincount(which, minlength=n) == k)
                least[full] = held[ends[full] - 1]
            which, score, ident = best.taken()
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchors.numbers[which]), pa.array(ident, row["id"].type.value_type), _decimals(score)],
                names=["number", "positive_id", "positive_score"],
            )

    near = pairs.mapInArrow(found, f"number bigint, positive_id {id_type}, positive_score decimal(38,0)")
    order = Window.partitionBy("number").orderBy(F.desc("positive_score"), F.asc("positive_id"))
    return near.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def _negatives(
    pairs: DataFrame, kind: str, scale: int, k: int, low: int, high: int, id_type: str
) -> DataFrame:
    """Of every window of every anchor in every task, the best ``k`` rows of other labels."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for first, run in blocks.per_asked_block(batches):
            anchors, best = _Anchors(first, kind, scale), blocks.RunningBest(k)
            tops = [[int(x) for x in scores] for scores in first["asked_tops"].as_py()]
            places = max(map(len, tops))
            # a window [low * top, high * top] / 100; one that ends before it begins stays empty
            windows = [[(-(-low * t // 100), high * t // 100) for t in own] for own in tops]
            least = np.array([min((a for a, b in own if a <= b), default=np.inf) for own in windows], np.float64)
            most = np.array([max((b for a, b in own if a <= b), default=-np.inf) for own in windows], np.float64)
            for row in run:
                block = _Block(row, kind, scale)
                allowed = anchors.labels[:, None] != block.labels
                scores, known = anchors.scores(block, least, most, allowed)
                for place in range(places):
                    ends = [own[place] if place < len(own) else (1, 0) for own in windows]
                    begin, end = (np.array([e[i] for e in ends], scores.dtype)[:, None] for i in (0, 1))
                    which, at = best_places(scores, known & (scores >= begin) & (scores <= end), k)
                    best.add(which * places + place, _whole(scores[which, at]), block.ids[at])
            window, score, ident = best.taken()
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchors.numbers[window // places]), pa.array((window % places + 1).astype(np.int32)),
                 pa.array(ident, row["id"].type.value_type), _decimals(score)],
                names=["number", "place", "negative_id", "negative_score"],
            )

    near = pairs.mapInArrow(found, f"number bigint, place int, negative_id {id_type}, negative_score decimal(38,0)")
    order = Window.partitionBy("number", "place").orderBy(F.desc("negative_score"), F.asc("negative_id"))
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _anchors_of(collection: DataFrame, kind: str) -> DataFrame:
    """The anchors as rows: number, id, label, vector, and the signs of the leading components, by which
    near anchors come into one block."""
    fields = {f.name: f.dataType.elementType.simpleString() for f in collection.schema.fields if f.name in ("id", "label")}
    value = pa.float32() if kind == "<f4" else pa.float64()

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = {name: batch.column(k)[at] for k, name in enumerate(batch.schema.names)}
                which = np.flatnonzero(row["anchor"].values.to_numpy(zero_copy_only=False))
                vectors = blocks.vectors_of(row["vector"].as_py(), len(row["id"].values), kind)[which]
                signs = (vectors[:, :SIGNS] >= 0) @ (1 << np.arange(min(SIGNS, vectors.shape[1]), dtype=np.int64)[::-1])
                lengths = np.arange(len(which) + 1) * vectors.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["block"].as_py() * blocks.ROWS + which), row["id"].values.take(pa.array(which)),
                     row["label"].values.take(pa.array(which)),
                     pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(vectors.ravel(), value)),
                     pa.array(signs, pa.int64())],
                    names=["number", "id", "label", "vector", "signs"],
                )

    element = "float" if kind == "<f4" else "double"
    return collection.mapInArrow(
        taken, f"number bigint, id {fields['id']}, label {fields['label']}, vector array<{element}>, signs bigint"
    )


def mined(
    rows: DataFrame,
    id_column: str,
    label: Column,
    vector: str,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
    scale: int = 256,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``: per anchor and
    each of its best rows of the same label, the best rows of other labels whose score is ``low`` to
    ``high`` percent of the positive's. A score is the inner product of ``floor(scale * x)``."""
    taking_part = rows.filter(usable(vector)).select(
        F.col(id_column).alias("id"), label.alias("label"), F.col(vector).alias("vector"),
        F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
    ).filter(F.col("id").isNotNull() & F.col("label").isNotNull())
    id_type = taking_part.schema["id"].dataType.simpleString()
    kind = blocks.kind_of(taking_part, "vector")
    collection = stored(blocks.pack(taking_part, "vector"), blocks.FEW)
    groups = blocks.groups_of(collection)

    anchors = stored(_anchors_of(collection.select("block", "vector", "id", "label", "anchor"), kind))
    order = anchors.repartitionByRange("signs", "number").sortWithinPartitions("signs", "number")
    rows_of = collection.select("block", "rows", "vector", "id", "label")
    asked = blocks.pack(order.select("number", "label", "vector"), "vector", ANCHORS)
    best = stored(_positives(blocks.meet(asked, rows_of, groups), kind, scale, positives, id_type))

    tops = best.groupBy("number").agg(
        F.sort_array(F.collect_list(F.struct("place", "positive_score"))).alias("tops")
    ).select("number", F.col("tops.positive_score").alias("tops"))
    with_tops = order.join(tops.hint("merge"), "number").repartitionByRange("signs", "number").sortWithinPartitions("signs", "number")
    asked = blocks.pack(with_tops.select("number", "label", "vector", "tops"), "vector", ANCHORS)
    near = _negatives(blocks.meet(asked, rows_of, groups), kind, scale, negatives, low, high, id_type)
    return near.join(best.hint("merge"), ["number", "place"]).join(anchors.select("number", F.col("id").alias("anchor_id")), "number").select(
        "anchor_id", "positive_id", "rank", "negative_id", _long("positive_score"), _long("negative_score")
    )
