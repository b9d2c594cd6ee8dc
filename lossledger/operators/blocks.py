"""Rows packed into blocks, and two frames whose blocks all meet.

For a set of queries against a collection: a task is handed whole blocks, so that comparing them is one
array operation. Blocks of the collection are dealt to groups by number and every group gets a copy of
the query blocks, so the collection is shuffled once, the (smaller) query set once per group, and no
vector passes through the driver: Spark estimates the copies by one copy, so their join must be kept from
broadcasting them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    FloatType,
    IntegerType,
    StructField,
    StructType,
)

#: A block holds at most so many rows and about so many bytes of vectors.
ROWS, BYTES = 4_096, 1 << 20
#: Blocks of a collection in a group: a join holds those of a group in memory. Groups that a core is dealt of
#: a smaller collection.
GROUP, SPREAD = 48, 4
#: Parquet options for blocks: row groups and pages of a few. By default a writer looks at their size after 100
#: rows only, and a reader takes a row group's first 4,096 rows at once.
FEW = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1"}


def matrix(lists: pa.Array, kind: str) -> np.ndarray:
    """The vectors of an Arrow list column as rows of a matrix; shorter ones are filled up with zeros."""
    lengths = lists.value_lengths().fill_null(0).to_numpy()
    width = int(lengths.max(initial=0))
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    if (lengths == width).all():
        return values.reshape(len(lists), width)
    out = np.zeros((len(lists), width), kind)
    out[np.arange(width) < lengths[:, None]] = values
    return out


def kind_of(df: DataFrame, vector: str) -> str:
    """Number format in which the vectors of a column are packed."""
    return "<f4" if isinstance(df.schema[vector].dataType.elementType, FloatType) else "<f8"


def pack(df: DataFrame, vector: str, rows: int = ROWS) -> DataFrame:
    """Blocks of consecutive rows of a partition: their number ``block``, their ``rows``, the vectors as
    one binary matrix, and every other column as an array."""
    kind = kind_of(df, vector)
    others = [f for f in df.schema.fields if f.name != vector]
    schema = StructType([
        StructField("rows", IntegerType()),
        StructField(vector, BinaryType()),
        *[StructField(f.name, ArrayType(f.dataType)) for f in others],
    ])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = matrix(batch.column(vector), kind)
            size = max(1, min(rows, BYTES // max(1, vectors[:1].nbytes)))
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                columns = [pa.array([part.num_rows], pa.int32()), pa.array([vectors[at : at + size].tobytes()])]
                for field in others:
                    values = part.column(field.name)
                    columns.append(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    packed = df.select(vector, *[f.name for f in others]).mapInArrow(blocks, schema)
    return packed.withColumn("block", F.monotonically_increasing_id())


def vectors_of(packed: bytes, rows: int, kind) -> np.ndarray:
    """The matrix of a block, in ``kind``."""
    return np.frombuffer(packed, kind).reshape(rows, -1)


def groups_of(collection: DataFrame) -> int:
    """Groups in which a stored collection is met: as few as memory allows, because each gets a copy of what is
    asked, but enough for all cores."""
    count = collection.count()
    return max(1, -(-count // GROUP), min(count, SPREAD * collection.sparkSession.sparkContext.defaultParallelism))


def meet(asked: DataFrame, collection: DataFrame, groups: int | None = None) -> DataFrame:
    """Every block of ``asked`` beside every block of ``collection``; the columns of ``asked`` get the
    prefix ``asked_``. The join is sorted, so that rows of one asked block follow each other."""
    groups = groups or 2 * int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = collection.withColumn("__group", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int"))
    copies = asked.withColumnsRenamed({c: f"asked_{c}" for c in asked.columns}).withColumn(
        "__group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    )
    return copies.hint("merge").join(dealt, "__group").drop("__group")


def ordinal(values: np.ndarray) -> np.ndarray:
    """Numbers that sort like the values, whatever their type; nulls come first."""
    if values.dtype != object:
        return values
    out = np.zeros(len(values), np.int64)
    given = np.array([v is not None for v in values], bool)
    out[given] = 1 + np.unique(values[given], return_inverse=True)[1]
    return out


def best_k(query: np.ndarray, score: np.ndarray, ident: np.ndarray, k: int) -> np.ndarray:
    """Positions of the best ``k`` per query: higher scores first, ties by smaller id."""
    order = np.lexsort((ordinal(ident), -ordinal(score), query))
    if not len(order):
        return order
    queries = query[order]
    starts = np.flatnonzero(np.r_[True, queries[1:] != queries[:-1]])
    place = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return order[place < k]


class RunningBest:
    """The best ``k`` per query of one asked block, over the blocks it has met so far."""

    def __init__(self, k: int):
        self.k, self.parts, self.held, self.least = k, [], 0, 0

    def add(self, query: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        self.parts.append((query, score, ident))
        self.held += len(query)
        if self.held > 4 * self.least + 65_536:
            self.parts = [self.taken()]
            self.held = self.least = len(self.parts[0][0])

    def taken(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query places, scores and ids of the best, by query and rank."""
        query, score, ident = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        kept = best_k(query, score, ident, self.k)
        return query[kept], score[kept], ident[kept]


def per_asked_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Iterator[dict]]]:
    """Runs of rows of :func:`meet` with the same asked block: the row that begins the run, and all of
    its rows. Row values are Arrow scalars."""
    rows = (
        {name: batch.column(k)[at] for k, name in enumerate(batch.schema.names)}
        for batch in batches
        for at in range(batch.num_rows)
    )
    row = next(rows, None)
    while row is not None:
        first, after = row, []

        def run(first=first, after=after):
            yield first
            for other in rows:
                if other["asked_block"] != first["asked_block"]:
                    after.append(other)
                    return
                yield other

        of_run = run()
        yield first, of_run
        for _ in of_run:
            pass
        row = after[0] if after else None

