"""Substring dedup on a compacted de Bruijn graph of the documents' words.

An edge of the graph is a window of ``WINDOW`` consecutive words. The edges of a text are compacted
into paths at once: a path is a maximal run of windows with the same minimiser (the smallest hash of
``SEED`` consecutive words inside the window), so equal windows always lie on paths with equal
minimisers, and a text of n words has about n / 8 paths.

1. Paths are grouped by minimiser. Equal paths (minimiser and content hash) are one nonbranching
   path of the graph; its source is the first place where it stands, and it is cut everywhere else.
2. Where several different paths share a minimiser the graph may branch. Only there, and only at the
   source of each path, are single windows looked at: documents are joined with the paths to resolve,
   windows are grouped by two independent 64-bit hashes, and all but the first place are cut.
3. Cuts are joined with the documents by coordinates (document, place).

Hot groups: every task first combines the paths of its chunk, so copies leave one row per chunk.
Minimisers that are frequent in a bounded sample are dealt out by path instead, and their paths are
always resolved; which minimisers the sample finds changes the work, not the result. Places are pairs
(document id, place), compared in that order; a path is 34 bytes or so, text is shuffled once.

Defined results: null, empty or short texts have no windows and keep their words; rows that repeat an
id and a text share their places, so neither is cut for the other; rows of one id with different
texts are ordered by a hash of the text; a null id comes before all others; an empty table gives an
empty result; further columns pass through ``without_repeats`` unchanged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, chunks, hashed, mixed, signed, stored, windows_of, word_hashes

WINDOW, SEED = 20, 6
#: Documents in the sample for frequent minimisers, the share of them that makes one frequent, and
#: the most that are kept.
SAMPLE_DOCS, FREQUENT, MOST_FREQUENT = 2000, 0.01, 20_000
_LANE = U64(0xA0761D6478BD642F)
_FIRST_ID = -(2**63)
CUT, RESOLVE = 1, 2


def _keyed_id(doc_id: str) -> Column:
    """The id to order by."""
    return F.coalesce(F.col(doc_id).cast("bigint"), F.lit(_FIRST_ID))


def _keyed_text(text: str) -> Column:
    """31 bits of the text's CRC-32, to tell texts of one id apart."""
    return F.coalesce(F.crc32(F.col(text).cast("binary")).bitwiseAND(F.lit(0x7FFFFFFF)), F.lit(0).cast("bigint"))


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(_keyed_id(doc_id).alias("ord"), _keyed_text(text).alias("tx"), F.col(text).alias("text"))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive numbers."""
    reach, out = 1, x
    while 2 * reach <= width:
        out = np.minimum(out[:-reach], out[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


_POWERS = np.cumprod(np.concatenate([[U64(1)], np.full((1 << 16) - 1, U64(0xD1342543DE82EF95))]))


def paths_of(words: list, table) -> tuple[np.ndarray, ...]:
    """Begin, windows, minimiser, content hash and whether a window repeats, of every path of a text."""
    numbers = hashed(words, table)
    edges = windows_of(mixed(numbers ^ _LANE), WINDOW)
    least = _sliding_min(windows_of(numbers, SEED), WINDOW - SEED + 1)
    begin = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    length = np.diff(np.concatenate([begin, [len(edges)]]))
    rank = np.arange(len(edges)) - np.repeat(begin, length)
    content = mixed(np.add.reduceat(edges * _POWERS[rank & 0xFFFF] + rank.astype(U64), begin) + length.astype(U64))
    repeats = np.zeros(len(begin), bool)
    order = np.sort(edges)
    if (order[1:] == order[:-1]).any():
        path = np.repeat(np.arange(len(begin)), length)
        order = np.lexsort((path, edges))
        same = (edges[order][1:] == edges[order][:-1]) & (path[order][1:] == path[order][:-1])
        repeats[path[order][1:][same]] = True
    return begin, length, least[begin], content, repeats


def _first_in_chunk(a: np.ndarray, b: np.ndarray, ords: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which rows are not beaten by an earlier place (ord, place) with the same (a, b)."""
    order = np.lexsort((place, ords, b, a))
    a, b, ords, place = a[order], b[order], ords[order], place[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.empty(0, bool)
    head = np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))
    out = np.empty(len(a), bool)
    out[order] = (ords == ords[head]) & (place == place[head])
    return out


_PATHS = "g bigint, s bigint, ord bigint, pos bigint, len bigint, kind int"


def _paths(docs: DataFrame, frequent) -> DataFrame:
    """Paths of all documents; ``kind`` CUT: repeats one of the same chunk, RESOLVE: must be resolved if first."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, hot = word_hashes(), frequent.value
        for batch in batches:
            for part, texts in chunks(batch):
                found = []
                for o, t, raw in zip(part.column("ord").to_pylist(), part.column("tx").to_pylist(), texts, strict=True):
                    words = raw.split() if raw else []
                    if len(words) >= WINDOW:
                        begin, *rest = paths_of(words, table)
                        found.append((np.full(len(begin), o), begin + (t << 32), *rest))
                if not found:
                    continue
                ords, pos, length, least, content, resolve = map(np.concatenate, zip(*found, strict=True))
                first = _first_in_chunk(least, content, ords, pos)
                if len(hot):
                    is_hot = hot[np.minimum(np.searchsorted(hot, least), len(hot) - 1)] == least
                    resolve |= is_hot
                    least = np.where(is_hot, mixed(least + content), least)
                # Known cuts need no group: any number that spreads them will do.
                least = np.where(first, least, mixed(pos.astype(U64) + ords.astype(U64) * U64(0x9E3779B97F4A7C15)))
                yield pa.RecordBatch.from_arrays([
                    pa.array(signed(least)), pa.array(signed(content)), pa.array(ords), pa.array(pos), pa.array(length),
                    pa.array(np.where(first, np.where(resolve, RESOLVE, 0), CUT).astype(np.int32)),
                ], ["g", "s", "ord", "pos", "len", "kind"])

    return docs.mapInArrow(find, _PATHS)


def _frequent_minimisers(docs: DataFrame) -> np.ndarray:
    """Minimisers that stand in many documents of a sample of about ``SAMPLE_DOCS``."""
    total = docs.count()
    sampled = docs.filter(F.pmod(F.xxhash64("ord", "tx"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, SAMPLE_DOCS / max(1, total))))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_hashes()
        for batch in batches:
            for _, texts in chunks(batch):
                split = [w for w in (raw.split() if raw else [] for raw in texts) if len(w) >= WINDOW]
                per_doc = [np.unique(paths_of(w, table)[2]) for w in split]
                yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(per_doc or [np.empty(0, U64)])))], ["m"])

    least = max(8, int(FREQUENT * min(total, SAMPLE_DOCS)))
    counted = sampled.mapInArrow(find, "m bigint").groupBy("m").count().filter(F.col("count") >= least)
    rows = counted.orderBy(F.desc("count")).limit(MOST_FREQUENT).collect()
    return np.sort(np.array([r.m for r in rows], np.int64).view(U64))


def _windows(docs: DataFrame) -> DataFrame:
    """Single windows of the paths in ``todo`` (flat begins and lengths): (g, s, ord, pos, len, kind)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_hashes()
        for batch in batches:
            for part, texts in chunks(batch):
                found = []
                for o, t, raw, todo in zip(*(part.column(c).to_pylist() for c in ("ord", "tx")), texts, part.column("todo").to_pylist(), strict=True):
                    numbers = hashed(raw.split(), table)
                    spans = np.array([(x["start"], x["len"]) for x in todo], np.int64)
                    at = np.repeat(spans[:, 0] - np.cumsum(spans[:, 1]) + spans[:, 1], spans[:, 1]) + np.arange(spans[:, 1].sum())
                    found.append((np.full(len(at), o), at + (t << 32), windows_of(numbers, WINDOW)[at], windows_of(mixed(numbers ^ _LANE), WINDOW)[at]))
                ords, pos, one, two = map(np.concatenate, zip(*found, strict=True))
                first = _first_in_chunk(one, two, ords, pos)
                one = np.where(first, one, mixed(pos.astype(U64) + ords.astype(U64) * U64(0x9E3779B97F4A7C15)))
                yield pa.RecordBatch.from_arrays([
                    pa.array(signed(one)), pa.array(signed(two)), pa.array(ords), pa.array(pos),
                    pa.array(np.ones(len(pos), np.int64)), pa.array(np.where(first, 0, CUT).astype(np.int32)),
                ], ["g", "s", "ord", "pos", "len", "kind"])

    return docs.mapInArrow(find, _PATHS)


def _judged(rows: DataFrame) -> DataFrame:
    """Rows with ``kind`` CUT where an earlier place has the same (g, s), RESOLVE where ``g`` branches."""
    dealt = rows.repartition("g").sortWithinPartitions("g", "s", "ord", "pos")
    group, same = Window.partitionBy("g"), Window.partitionBy("g", "s").orderBy("ord", "pos")
    first = F.first(F.struct("ord", "pos")).over(same.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    branches = F.min("s").over(group) != F.max("s").over(group)
    return (
        dealt.withColumn("branches", branches).withColumn("first", first)
        .withColumn("kind", F.when((F.col("kind") == CUT) | (F.col("first") != F.struct("ord", "pos")), F.lit(CUT))
                    .when((F.col("kind") == RESOLVE) | F.col("branches"), F.lit(RESOLVE)).otherwise(F.lit(0)))
        .filter("kind > 0").select("ord", "pos", "len", "kind")
    )


def _by_document(rows: DataFrame, name: str) -> DataFrame:
    """Spans of each document in one list; it is bounded by the length of the text."""
    return rows.groupBy("ord", F.shiftright("pos", 32).alias("tx")).agg(
        F.collect_list(F.struct(F.col("pos").bitwiseAND(F.lit(0xFFFFFFFF)).alias("start"), "len")).alias(name))


def cuts(docs: DataFrame, keyed: DataFrame) -> DataFrame:
    """(ord, tx, cuts) of the documents with windows that stand earlier, as (start, len).

    ``keyed``: ``docs`` by (ord, tx) with all that its reader needs, so that one shuffle serves both.
    """
    plain = _keyed(docs, "doc_id", "text")
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent_minimisers(plain))
    paths = stored(_judged(_paths(plain, frequent)))
    todo = _by_document(paths.filter(F.col("kind") == RESOLVE), "todo")
    windows = _judged(_windows(keyed.join(todo, ["ord", "tx"]).select("ord", "tx", "text", "todo"))).filter(F.col("kind") == CUT)
    return _by_document(paths.filter(F.col("kind") == CUT).unionByName(windows), "cuts")


def removed(n_words: int, spans: list) -> np.ndarray:
    """Which words the spans of windows cover."""
    change = np.zeros(n_words + 1, np.int64)
    if spans:
        begin = np.array([x["start"] for x in spans], np.int64)
        end = begin + np.array([x["len"] for x in spans], np.int64) + WINDOW - 1
        np.add.at(change, begin, 1)
        np.add.at(change, end, -1)
    return np.cumsum(change[:-1]) > 0


def _kept_text(raw: bytes, gone: np.ndarray) -> str:
    """The text without its removed words; lines stay lines."""
    lines, at = [], 0
    for line in raw.split(b"\n"):
        words = line.split()
        kept = [w for w, g in zip(words, gone[at : at + len(words)], strict=True) if not g]
        at += len(words)
        if kept or not words:
            lines.append(b" ".join(kept))
    return b"\n".join(lines).decode()


def digests(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_removed and the SHA-256 of the kept words."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch):
                out = []
                for raw, spans in zip(texts, part.column("cuts").to_pylist(), strict=True):
                    words = raw.split() if raw else []
                    gone = removed(len(words), spans)
                    kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g) if spans else b" ".join(words)
                    out.append((len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
                n, r, h = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column("ord"), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(h)],
                    ["ord", "n_words", "n_removed", "kept_sha256"])

    keyed = _keyed(docs, "doc_id", "text")
    found = keyed.join(cuts(docs, keyed), ["ord", "tx"], "left")
    rows = found.mapInArrow(digest, "ord bigint, n_words bigint, n_removed bigint, kept_sha256 string")
    return rows.select(F.when(F.col("ord") != _FIRST_ID, F.col("ord")).alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def without_repeats(docs: DataFrame, length: str = "n_chars") -> DataFrame:
    """``docs`` with repeated windows cut from ``text`` and ``length`` set anew.

    Documents that lose every word go; a document that loses none keeps its text byte for byte.
    """
    schema = docs.schema

    def place(name: str) -> str:
        return f"c{schema.names.index(name)}"

    # Named by place, so that no column of the documents can clash.
    keyed = docs.toDF(*(f"c{k}" for k in range(len(schema)))).withColumns(
        {"ord": _keyed_id(place("doc_id")), "tx": _keyed_text(place("text")), "text": F.col(place("text"))}
    ).drop(place("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch):
                kept, keep = [], []
                for raw, spans in zip(texts, part.column("cuts").to_pylist(), strict=True):
                    if not spans:
                        kept.append(None if raw is None else raw.decode())
                        keep.append(True)
                        continue
                    gone = removed(len(raw.split()), spans)
                    kept.append(_kept_text(raw, gone))
                    keep.append(not gone.all())
                columns = []
                for k, name in enumerate(schema.names):
                    if name == "text":
                        columns.append(pa.array(kept, part.column("text").type))
                    elif name == length:
                        columns.append(pa.array([None if t is None else len(t) for t in kept], part.column(f"c{k}").type))
                    else:
                        columns.append(part.column(f"c{k}"))
                yield pa.RecordBatch.from_arrays(columns, schema.names).filter(pa.array(keep))

    joined = keyed.join(cuts(docs, keyed), ["ord", "tx"], "left")
    return joined.mapInArrow(cut, T.StructType([T.StructField(f.name, f.dataType, True) for f in schema]))
