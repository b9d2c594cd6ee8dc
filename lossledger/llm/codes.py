"""Vector code compression: codebooks per part position by exact integer k-means on Hilbert-sorted blocks.

A vector becomes whole numbers and is cut into equal parts. The parts of every position are sorted along
a Hilbert curve and cut into flat blocks; a block holds its parts, the box around them (least and
greatest components) and the sums of their components. A round compares boxes with codebook entries: an
entry whose nearest possible distance to the box exceeds another one's greatest possible distance cannot
be nearest to any part of the block. If one entry is left, the stored sums stand for the whole block;
else only the shortlist is compared part by part, in whole numbers. A round passes the sums of each
task to Spark, which adds them; only the codebooks (positions x entries) are on the driver.

Equal parts are told apart by their row number in the sort, so copies spread over any number of blocks,
and blocks of copies are decided by their box alone.

Defined results: rows whose vector is null or has a null or non-finite component (or one that single
precision cannot hold) are dropped. Rows with a null id, and repeated rows, are coded one by one; a null
id comes last in the choice of first entries, ties by components. With fewer rows than entries there are
fewer entries. Shorter vectors, and lengths that the number of parts does not divide, are filled up with
zeros at the end. Distances to entries are exact whole numbers at any size; sums of them that do not fit
64 bits are held at the end of the range. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import blocks
from .common import stored
from .vectors import EXACT, LONG, exact_ints, largest, scaled, usable

#: Parts in a block.
BLOCK = 256
#: Greatest number that single precision can hold; beyond it a component counts as not finite.
GREATEST = 3.4028235677973366e38
#: Sums travel as four numbers of 40 bits, so that adding them up cannot overflow.
LIMBS, LIMB_BITS = 4, 40
#: Bits of a Hilbert key.
KEY_BITS = 60

Codebooks = list[list[list[int]]]


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points with whole coordinates below ``2 ** bits``: Gray-code
    rotations and swaps per bit plane, then the bits of all coordinates in turn."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for plane in range(bits - 1, 0, -1):
        q, low = 1 << plane, (1 << plane) - 1
        for axis in range(n):
            flip = (x[axis] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[axis]) & low)
            x[0] ^= np.where(flip, low, swap)
            x[axis] ^= swap
    for axis in range(1, n):
        x[axis] ^= x[axis - 1]
    turn = np.zeros_like(x[0])
    for plane in range(bits - 1, 0, -1):
        turn ^= np.where(x[n - 1] & (1 << plane), (1 << plane) - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for plane in range(bits - 1, -1, -1):
        for axis in range(n):
            key = (key << 1) | ((x[axis] >> plane) & 1)
    return key


def box_distances(least: np.ndarray, greatest: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest squared distance from any point of a box to each entry."""
    below, above = least - entries, entries - greatest
    near = np.maximum(np.maximum(below, above), 0)
    far = np.maximum(np.abs(below), np.abs(above))
    return (near * near).sum(1), (far * far).sum(1)


def nearest_entries(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each part, ties to the lower one, and the squared distance."""
    gaps = parts[:, None, :] - entries
    squares = (gaps * gaps).sum(2)
    nearest = squares.argmin(1)
    return nearest, squares[np.arange(len(parts)), nearest]


def _numbers(packed: bytes, n: int, form: str) -> np.ndarray:
    """Components of a block as 64-bit integers, or as Python integers where squares could overflow."""
    values = np.frombuffer(packed, form).reshape(n, -1)
    return exact_ints(values) if form == "<f8" else values.astype(np.int64)


def _form(values: np.ndarray) -> str:
    """The narrowest number format; whole doubles beyond 24 bits are kept as they are."""
    size = largest(values)
    return "<i2" if size < 1 << 15 else "<i4" if size < 1 << 24 else "<f8"


class Books:
    """Codebooks in the number types that a block needs."""

    def __init__(self, books: Codebooks):
        self.exact = [np.array(b, object) for b in books]
        small = all(abs(x) < 1 << 24 for b in books for e in b for x in e)
        self.plain = [np.array(b, np.int64) for b in books] if small else None

    def entries(self, part: int, form: str) -> np.ndarray:
        return self.exact[part] if form == "<f8" or self.plain is None else self.plain[part]


def shortlist(row: dict, books: Books) -> tuple[np.ndarray, np.ndarray]:
    """Entries of the row's position that may be nearest to some part of its block, and all entries."""
    entries = books.entries(row["part"], row["form"])
    box = _numbers(row["box"], 2, row["form"])
    near, far = box_distances(box[0], box[1], entries)
    return np.flatnonzero(near <= far.min()), entries


def _limbs(value: int) -> list[int]:
    """A number as :data:`LIMBS` parts, the last one signed."""
    mask = (1 << LIMB_BITS) - 1
    return [*((value >> (LIMB_BITS * k)) & mask for k in range(LIMBS - 1)), value >> (LIMB_BITS * (LIMBS - 1))]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(batch.num_rows):
            yield {name: batch.column(k)[at].as_py() for k, name in enumerate(batch.schema.names)}


def _kept(rows: DataFrame, vector: str) -> DataFrame:
    """The rows that take part, numbered and stored, so that a number stays with its row."""
    held = F.forall(vector, lambda x: F.abs(x.cast("double")) < GREATEST)
    return stored(rows.filter(usable(vector) & held).withColumn("__row", F.monotonically_increasing_id()))


def _cut(vectors: np.ndarray, n_parts: int, width: int, scale: int) -> np.ndarray:
    """Scaled vectors as (row, part, component), filled up with zeros."""
    whole = np.zeros((len(vectors), n_parts * width))
    whole[:, : vectors.shape[1]] = scaled(vectors, scale)
    return whole.reshape(len(vectors), n_parts, width)


def _ranges(kept: DataFrame, vector: str, n_parts: int, width: int, scale: int) -> list[tuple[float, float]]:
    """Where most components of each position lie: medians of low and high quantiles per batch. They
    only place the Hilbert grid."""
    kind = blocks.kind_of(kept, vector)

    def quantiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cut = _cut(blocks.matrix(batch.column(0), kind), n_parts, width, scale)
                ends = np.quantile(cut.transpose(1, 0, 2).reshape(n_parts, -1), [0.02, 0.98], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(n_parts, dtype=np.int32)), pa.array(ends[0]), pa.array(ends[1])], names=["part", "low", "high"])

    found = kept.select(vector).mapInArrow(quantiles, "part int, low double, high double").groupBy("part").agg(
        F.percentile_approx("low", 0.5).alias("low"), F.percentile_approx("high", 0.5).alias("high"))
    ends = {r["part"]: (r["low"], r["high"]) for r in found.collect()}
    return [ends[k] for k in range(n_parts)]


def _blocks(kept: DataFrame, vector: str, n_parts: int, width: int, scale: int) -> DataFrame:
    """Stored blocks of the Hilbert-sorted parts: position, row numbers, components, box and sums."""
    kind, grid = blocks.kind_of(kept, vector), _ranges(kept, vector, n_parts, width, scale)
    axes = min(width, KEY_BITS)
    bits = max(1, min(16, KEY_BITS // axes))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cut = _cut(blocks.matrix(batch.column(1), kind), n_parts, width, scale)
            for part, (low, high) in enumerate(grid):
                own = cut[:, part]
                cells = (own[:, :axes] - low) * ((1 << bits) / max(high - low, 1.0))
                keys = hilbert_keys(np.clip(cells, 0, (1 << bits) - 1), bits)
                form = _form(own)
                packed = own.astype(form)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(own), part, np.int32)), pa.array(keys), batch.column(0),
                     pa.array(np.full(len(own), int(form[2]), np.int32)), pa.array([x.tobytes() for x in packed], pa.binary())],
                    names=["part", "key", "row", "size", "x"],
                )

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def block() -> pa.RecordBatch:
            form = max((row[3] for row in held), default=2)
            form = {2: "<i2", 4: "<i4", 8: "<f8"}[form]
            values = np.concatenate([np.frombuffer(row[4], {2: "<i2", 4: "<i4", 8: "<f8"}[row[3]]).astype(form) for row in held])
            values = values.reshape(len(held), width)
            numbers = np.array([row[2] for row in held], "<i8")
            sums = [str(sum(int(x) for x in column)) for column in values.T] if form == "<f8" else [str(x) for x in values.sum(0, dtype=np.int64)]
            box = np.stack([values.min(0), values.max(0)])
            return pa.RecordBatch.from_arrays(
                [pa.array([held[0][0]], pa.int32()), pa.array([len(held)], pa.int32()), pa.array([form]), pa.array([box.tobytes()], pa.binary()),
                 pa.array([sums], pa.list_(pa.string())), pa.array([numbers.tobytes()], pa.binary()), pa.array([values.tobytes()], pa.binary())],
                names=["part", "n", "form", "box", "sums", "rows", "x"],
            )

        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if held and (held[0][0] != row[0] or len(held) == BLOCK):
                    yield block()
                    held = []
                held.append(row)
        if held:
            yield block()

    made = kept.select("__row", vector).mapInArrow(parts, "part int, key bigint, row bigint, size int, x binary")
    order = made.repartitionByRange("part", "key", "row").sortWithinPartitions("part", "key", "row")
    return stored(order.mapInArrow(
        packed, "part int, n int, form string, box binary, sums array<string>, rows binary, x binary"))


def _first_entries(kept: DataFrame, id_column: str, vector: str, n_parts: int, width: int, scale: int, entries: int) -> Codebooks:
    seeds = kept.orderBy(F.asc_nulls_last(id_column), vector).limit(entries).select(vector).toArrow()
    vectors = blocks.matrix(seeds.column(0).combine_chunks(), blocks.kind_of(kept, vector))
    cut = _cut(vectors, n_parts, width, scale)
    return [[[int(x) for x in entry] for entry in cut[:, part]] for part in range(n_parts)]


def _round(of_blocks: DataFrame, books: Codebooks) -> Codebooks:
    """Codebooks after every part went to its nearest entry; unused entries stay."""
    width = len(books[0][0])
    n_entries = len(books[0])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = Books(books), {}
        for row in _rows(batches):
            near, entries = shortlist(row, held)
            if len(near) == 1:
                groups = [(int(near[0]), row["n"], [int(x) for x in row["sums"]])]
            else:
                values = _numbers(row["x"], row["n"], row["form"])
                which, _ = nearest_entries(values, entries[near])
                groups = [(int(near[k]), int((which == k).sum()), [int(x) for x in values[which == k].sum(0)])
                          for k in np.unique(which)]
            for entry, count, added in groups:
                known = total.setdefault((row["part"], entry), [0, [0] * width])
                known[0] += count
                known[1] = [a + b for a, b in zip(known[1], added, strict=True)]
        if total:
            yield pa.RecordBatch.from_pylist([
                {"part": part, "entry": entry, "n": n, "sums": [limb for x in added for limb in _limbs(x)]}
                for (part, entry), (n, added) in total.items()
            ], pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]))

    partial = of_blocks.mapInArrow(sums, "part int, entry int, n bigint, sums array<bigint>")
    added = [F.sum(F.get("sums", F.lit(k))).alias(f"s{k}") for k in range(width * LIMBS)]
    out = [[list(entry) for entry in book] for book in books]
    for r in partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*added).alias("sums")).collect():
        whole = [sum(r["sums"][LIMBS * k + limb] << (LIMB_BITS * limb) for limb in range(LIMBS)) for k in range(width)]
        out[r["part"]][r["entry"]] = [x // r["n"] for x in whole]
    assert all(len(book) == n_entries for book in out)
    return out


def _assigned(of_blocks: DataFrame, books: Codebooks) -> DataFrame:
    """``(row, part, entry, distance)`` of every part."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Books(books)
        for row in _rows(batches):
            near, entries = shortlist(row, held)
            which, squares = nearest_entries(_numbers(row["x"], row["n"], row["form"]), entries[near])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.frombuffer(row["rows"], "<i8")), pa.array(np.full(row["n"], row["part"], np.int32)),
                 pa.array(near[which].astype(np.int32)), pa.array([min(int(x), LONG) for x in squares], pa.int64())],
                names=["__row", "part", "entry", "distance"],
            )

    return of_blocks.mapInArrow(assign, "__row bigint, part int, entry int, distance bigint")


def _long(total: Column) -> Column:
    return F.least(total, F.lit(LONG).cast("decimal(38,0)")).cast("bigint")


def compressed(
    rows: DataFrame,
    id_column: str,
    vector: str,
    n_parts: int = 8,
    entries: int = 16,
    rounds: int = 6,
    scale: int = 4096,
) -> tuple[DataFrame, Codebooks]:
    """The kept rows with their ``__codes`` (entries by part position) and ``__error``, and the final
    codebooks by part, entry and component."""
    kept = _kept(rows, vector)
    length = kept.agg(F.max(F.size(vector))).first()[0]
    if length is None:
        return kept.drop("__row").withColumns({"__codes": F.array().cast("array<int>"), "__error": F.lit(0).cast("bigint")}), []
    width = max(1, -(-length // n_parts))
    of_blocks = _blocks(kept, vector, n_parts, width, scale)
    books = _first_entries(kept, id_column, vector, n_parts, width, scale, entries)
    for _ in range(rounds):
        books = _round(of_blocks, books)
    coded = _assigned(of_blocks, books).groupBy("__row").agg(
        F.sort_array(F.collect_list(F.struct("part", "entry")))["entry"].alias("__codes"),
        _long(F.sum(F.col("distance").cast("decimal(20,0)"))).alias("__error"),
    )
    return kept.join(coded, "__row").drop("__row"), books


def codebook_digest(books: Codebooks) -> str:
    """SHA-256 of all entries' components as decimal numbers, by part, entry and place."""
    return hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()


def digests(rows: DataFrame, id_column: str, vector: str, label: str) -> DataFrame:
    """``(id, code, error, label_error, codebooks_sha256)`` of every kept row."""
    found, books = compressed(rows.select(id_column, vector, label), id_column, vector)
    coded = stored(found.select(
        id_column, label, F.array_join(F.transform("__codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "").alias("code"),
        F.col("__error").alias("error"),
    ))
    per_label = coded.groupBy(F.col(label).alias("__label")).agg(
        _long(F.sum(F.col("error").cast("decimal(20,0)"))).alias("label_error"))
    return coded.join(per_label, F.col(label).eqNullSafe(F.col("__label"))).select(
        id_column, "code", "error", "label_error", F.lit(codebook_digest(books)).alias("codebooks_sha256"))
