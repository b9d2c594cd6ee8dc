"""Nearest neighbours by cosine with multi-index hashing of learned binary codes.

Rotations learned on a bounded sample turn a vector into a binary code: the signs of its rotated
components. A block of rows holds vectors, codes, and an index per substring (byte) of the codes: the
rows in order of that byte, and where each byte value begins. Blocks of queries meet blocks of rows. If
two codes differ in at most ``radius`` bits, some byte differs in few (the pigeonhole principle): with
``radius = bytes * q + r`` at most ``q`` in one of the first ``r + 1`` bytes, or at most ``q - 1`` in
another one. So probing those byte values finds every code within the radius; what is found is checked
on whole codes, and all that remain are ranked by the cosine of the original vectors.

The radius is learned too: the distance that holds ``REACHED`` of the true nearest neighbours inside the
sample. In a larger table neighbours are nearer, so more of them are found. A query that finds fewer
than ``k`` rows asks again with a doubled radius, in the end with all rows.

The fit reads ``SAMPLE`` rows, those with the smallest hash of their id, whatever the size of the table;
every row is indexed and every query answered.

Defined results: rows without an id, with a null or zero vector or a null or non-finite component take
no part. Vectors of unequal length count as filled up with zeros. A query never finds its own row, but
another row with the same id may be found; equal rows stay separate. Ties go to the smaller id. An empty
table, or one without queries, gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import blocks
from .common import stored
from .vectors import usable

#: Bits of a code, rows the rotations and the radius are learned on, and share of true neighbours that
#: the radius holds there.
BITS, SAMPLE, REACHED = 128, 4_096, 0.975
#: Rounds of the iterative quantisation.
ROUNDS = 30
#: Queries in a block, and pairs whose cosines are worked out at a time.
QUERIES, PAIRS = 256, 100_000

#: Bits in which two bytes differ.
DIFFERENT = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8))


def in_range(vectors: np.ndarray) -> np.ndarray:
    """Vectors in double precision, divided by a power of two so that no square overflows or vanishes;
    cosines stay the same to the last bit."""
    wide = vectors.astype(np.float64)
    return np.ldexp(wide, -np.frexp(np.abs(wide).max(axis=1, initial=0, keepdims=True))[1])


def lengths_of(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors * vectors).sum(1))


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    wide = in_range(vectors)
    return wide / lengths_of(wide)[:, None]


def learned_rotations(sample: np.ndarray, bits: int = BITS, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection to ``bits`` numbers. Each rotation starts at random within the principal
    axes and is turned towards the corners it is rounded to (iterative quantisation); as many rotations
    are put side by side as the bits need."""
    random = np.random.default_rng(7)
    mean = sample.mean(0)
    centred = sample - mean
    axes = np.linalg.eigh(centred.T @ centred)[1][:, ::-1]
    placed = centred @ axes
    parts = []
    while sum(p.shape[1] for p in parts) < bits:
        turn = np.linalg.qr(random.normal(size=(axes.shape[1],) * 2))[0]
        for _ in range(rounds):
            left, _, right = np.linalg.svd(np.where(placed @ turn >= 0, 1.0, -1.0).T @ placed)
            turn = (left @ right).T
        parts.append(axes @ turn)
    return mean, np.hstack(parts)[:, :bits]


def codes_of(units: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """Codes as rows of bytes."""
    return np.packbits((units - mean) @ projection >= 0, axis=1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which every code of ``a`` differs from every one of ``b``."""
    out = np.zeros((len(a), len(b)), np.int32)
    for byte in range(a.shape[1]):
        out += DIFFERENT[a[:, byte][:, None], b[:, byte]]
    return out


def learned_radius(units: np.ndarray, codes: np.ndarray, k: int, reached: float = REACHED) -> int:
    """Smallest radius that holds a share ``reached`` of the ``k`` nearest neighbours in the sample."""
    found: list[np.ndarray] = []
    k = min(k, len(units) - 1)
    if k < 1:
        return codes.shape[1] * 8
    for at in range(0, len(units), QUERIES):
        some = slice(at, at + QUERIES)
        near = units[some] @ units.T
        near[np.arange(len(near)), np.arange(at, at + len(near))] = -np.inf
        best = np.argpartition(near, -k, axis=1)[:, -k:]
        found.append(np.bitwise_count(codes[some][:, None, :] ^ codes[best]).sum(2, dtype=np.int32).ravel())
    return int(np.ceil(np.quantile(np.concatenate(found), reached)))


def byte_reach(n_bytes: int, radius: int) -> np.ndarray:
    """How far each byte has to be probed (-1: not at all), by the pigeonhole principle."""
    each, more = divmod(radius, n_bytes)
    return np.where(np.arange(n_bytes) <= more, each, each - 1)


def byte_index(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per byte of the codes: the rows in order of its value, and where each value begins."""
    orders = np.argsort(codes, axis=0, kind="stable").T
    starts = np.stack([np.searchsorted(codes[order, byte], np.arange(257)) for byte, order in enumerate(orders)])
    return orders.astype(np.int32), starts.astype(np.int32)


def within_radius(
    asked: np.ndarray, codes: np.ndarray, orders: np.ndarray, starts: np.ndarray, radius: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (query, row) of codes that differ in at most ``radius`` bits, each once."""
    reach = byte_reach(codes.shape[1], radius)
    for byte, far in enumerate(reach):
        if far < 0:
            continue
        which, value = np.nonzero(DIFFERENT[asked[:, byte]] <= far)
        begin, size = starts[byte][value], starts[byte][value + 1] - starts[byte][value]
        filled = size > 0
        which, begin, size = which[filled], begin[filled], size[filled]
        ends = np.cumsum(size)
        done = 0
        while done < len(size):  # buckets of about so many rows at a time
            upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + 4 * PAIRS, "right")))
            sizes = size[done:upto]
            query = np.repeat(which[done:upto], sizes)
            first = np.repeat(begin[done:upto] - np.r_[0, np.cumsum(sizes)[:-1]], sizes)
            row = orders[byte][first + np.arange(len(query))]
            bits = np.bitwise_count(asked[query] ^ codes[row])
            near = bits.sum(1, dtype=np.int32) <= radius
            if byte:  # found by an earlier byte already
                near &= ~(bits[:, :byte] <= reach[:byte]).any(1)
            yield query[near], row[near]
            done = upto


def _indexed(rows: DataFrame, kind: str, mean: np.ndarray, projection: np.ndarray) -> DataFrame:
    """Blocks of rows with their codes and the index of every byte."""
    packed = blocks.pack(rows, "vector")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in packed.schema.fields)
    width = projection.shape[0]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[list[bytes]] = [[], [], []]
            for vectors, n in zip(batch.column("vector"), batch.column("rows"), strict=True):
                codes = codes_of(unit_rows(_filled(blocks.vectors_of(vectors.as_py(), n.as_py(), kind), width)), mean, projection)
                orders, starts = byte_index(codes)
                for held, array in zip(made, (codes, orders.astype(np.uint16), starts.astype(np.uint16)), strict=True):
                    held.append(array.tobytes())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array(held, pa.binary()) for held in made]],
                names=[*batch.schema.names, "codes", "orders", "starts"],
            )

    return packed.mapInArrow(index, f"{fields}, codes binary, orders binary, starts binary")


def _filled(vectors: np.ndarray, width: int) -> np.ndarray:
    """Vectors of ``width`` components; missing ones are zero."""
    if vectors.shape[1] < width:
        return np.pad(vectors, ((0, 0), (0, width - vectors.shape[1])))
    return vectors


def _search(pairs: DataFrame, kind: str, width: int, bits: int, radius: int, k: int, id_type: str) -> DataFrame:
    """Of every query in every task, the best ``k`` rows among all within the radius."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for first, run in blocks.per_asked_block(batches):
            numbers = first["asked_number"].values.to_numpy()
            queries = in_range(_filled(blocks.vectors_of(first["asked_vector"].as_py(), len(numbers), kind), width))
            query_lengths = lengths_of(queries)
            asked = np.frombuffer(b"".join(first["asked_code"].values.to_pylist()), np.uint8).reshape(len(numbers), -1)
            best = blocks.RunningBest(k)
            for row in run:
                ids = row["id"].values.to_numpy(zero_copy_only=False)
                own = row["block"].as_py() * blocks.ROWS + np.arange(len(ids))
                vectors = in_range(_filled(blocks.vectors_of(row["vector"].as_py(), len(ids), kind), width))
                lengths = lengths_of(vectors)
                codes, orders, starts = (
                    np.frombuffer(row[name].as_py(), form).reshape(shape).astype(into, copy=False)
                    for name, form, shape, into in (
                        ("codes", np.uint8, (len(ids), bits // 8), np.uint8),
                        ("orders", np.uint16, (bits // 8, len(ids)), np.int32),
                        ("starts", np.uint16, (bits // 8, 257), np.int32),
                    )
                )
                for which, at in within_radius(asked, codes, orders, starts, radius):
                    other = own[at] != numbers[which]
                    which, at = which[other], at[other]
                    for k0 in range(0, len(at), PAIRS):
                        q, r = which[k0 : k0 + PAIRS], at[k0 : k0 + PAIRS]
                        cosines = np.einsum("ij,ij->i", queries[q], vectors[r]) / (query_lengths[q] * lengths[r])
                        best.add(q, cosines, ids[r])
            which, score, ident = best.taken() if best.parts else (np.empty(0, np.int64), np.empty(0), ids[:0])
            yield pa.RecordBatch.from_arrays(
                [pa.array(numbers[which]), pa.array(ident, row["id"].type.value_type), pa.array(score)],
                names=["number", "id", "score"],
            )

    near = pairs.mapInArrow(found, f"number bigint, id {id_type}, score double")
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.asc("id"))
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest(
    rows: DataFrame,
    id_column: str,
    vector: str,
    is_query: Column,
    k: int = 5,
    bits: int = BITS,
    sample: int = SAMPLE,
) -> DataFrame:
    """``(query_id, rank, id, score)``: the ``k`` nearest other rows found for each query, by cosine."""
    taking_part = rows.filter(usable(vector) & F.exists(vector, lambda x: x != 0)).select(
        F.col(id_column).alias("id"), F.col(vector).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("query")
    ).filter(F.col("id").isNotNull())
    id_type = taking_part.schema["id"].dataType.simpleString()
    kind = blocks.kind_of(taking_part, "vector")
    fitted = taking_part.orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").toArrow()
    total, width = taking_part.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    if not total:
        return _empty(rows, id_type)
    units = unit_rows(_filled(blocks.matrix(fitted.column("vector").combine_chunks(), kind), width))
    mean, projection = learned_rotations(units, bits)
    radius = learned_radius(units, codes_of(units, mean, projection), k)

    index = stored(_indexed(taking_part, kind, mean, projection), blocks.FEW)
    queries = stored(_queries_of(index, kind, bits))
    groups = blocks.groups_of(index)
    index = index.drop("query")
    wanted, left, parts = min(k, total - 1), queries, []
    while wanted:
        asked = blocks.pack(left.select("number", "code", "vector"), "vector", QUERIES)
        found = stored(_search(blocks.meet(asked, index, groups), kind, width, bits, radius, k, id_type))
        enough = found.groupBy("number").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == wanted).select("number")
        parts.append(found.join(enough, "number", "left_semi"))
        if radius >= bits:
            break
        left = left.join(enough, "number", "left_anti")
        if left.isEmpty():
            break
        radius = min(bits, 2 * radius)
    if not parts:
        return _empty(rows, id_type)
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.join(queries.select("number", F.col("id").alias("query_id")), "number").select("query_id", "rank", "id", "score")


def _empty(rows: DataFrame, id_type: str) -> DataFrame:
    return rows.sparkSession.createDataFrame([], f"query_id {id_type}, rank int, id {id_type}, score double")


def _queries_of(index: DataFrame, kind: str, bits: int) -> DataFrame:
    """The queries as rows: number, id, code and vector."""
    id_type = index.schema["id"].dataType.elementType.simpleString()
    value, element = (pa.float32(), "float") if kind == "<f4" else (pa.float64(), "double")

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = {name: batch.column(i)[at] for i, name in enumerate(batch.schema.names)}
                n = len(row["id"].values)
                which = np.flatnonzero(row["query"].values.to_numpy(zero_copy_only=False))
                vectors = blocks.vectors_of(row["vector"].as_py(), n, kind)[which]
                codes = np.frombuffer(row["codes"].as_py(), np.uint8).reshape(n, bits // 8)[which]
                ends = np.arange(len(which) + 1) * vectors.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["block"].as_py() * blocks.ROWS + which), row["id"].values.take(pa.array(which)),
                     pa.array([c.tobytes() for c in codes], pa.binary()),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(vectors.ravel(), value))],
                    names=["number", "id", "code", "vector"],
                )

    return index.select("block", "id", "vector", "query", "codes").mapInArrow(
        taken, f"number bigint, id {id_type}, code binary, vector array<{element}>"
    )
