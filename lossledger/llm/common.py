"""Shared pieces: intermediate tables, words and hashes of text batches."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes of text that are taken apart at a time, so a task's memory does not grow with its input.
CHUNK_BYTES = 3 << 20
#: Words that a worker remembers; a speed-up only, forgotten words are worked out again.
REMEMBERED_WORDS = 300_000
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names for checkpoints; else one in the warehouse, which is shared too."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"


def stored(df: DataFrame, options: dict[str, str] | None = None) -> DataFrame:
    """``df`` written to the shared folder, with Parquet options, and read again: lineage is cut, executors may
    be lost."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def id_remainder(name: str, divisor: int) -> Column:
    """CRC-32 of the id as text, modulo ``divisor``; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")), F.lit(divisor))


def id_remainders(ids: list, divisor: int) -> np.ndarray:
    """The same for a list of ids."""
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % divisor for i in ids], np.int64)


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of a batch of about ``limit`` bytes of text, each with its texts as UTF-8 (or None)."""
    texts = batch.column(column).cast(pa.large_binary())
    ends = np.cumsum(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1][1:]
                     - np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts)]) if len(texts) else []
    begin = 0
    while begin < len(texts):
        before = int(ends[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(begin, end - begin), texts.slice(begin, end - begin).to_pylist()
        begin = end


class WordTable(dict):
    """A number per word, worked out by ``of`` at the first sight; at most ``limit`` are remembered."""

    def __init__(self, of, limit: int = REMEMBERED_WORDS):
        super().__init__()
        self.of, self.limit = of, limit

    def __missing__(self, word):
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = self.of(word)
        return value


def word_hashes() -> WordTable:
    return WordTable(xxhash.xxh3_64_intdigest)


def hashed(words: list, table: WordTable) -> np.ndarray:
    """64-bit hash of each word."""
    return np.fromiter(map(table.__getitem__, words), U64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit (the MurmurHash3 finaliser)."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def windows_of(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` numbers; empty when there are fewer."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, U64)
    out = hashes[:n].copy()
    for k in range(1, width):
        out *= U64(0x9E3779B97F4A7C15)
        out ^= out >> U64(29)
        out += hashes[k : k + n]
    return mixed(out)


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return np.ascontiguousarray(x).view(np.int64)


def list_array(values: np.ndarray, lengths, kind) -> pa.Array:
    """Arrow lists from flat values and the length of each list."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
