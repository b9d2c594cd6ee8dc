"""Keyword, vector and combined search over described documents."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions.text import one_per_row, tokens
from . import blocks
from .lineage import stored

# Scores are added as whole millionths.
MILLION = 1_000_000
# Fraction of a point that marks a pair of a document and a term.
PAIR = 2.0**-19
# Documents and words in a block of counted documents, and documents multiplied at a time.
DOC_ROWS, DOC_WORDS, PART_ROWS = 1_024, 400_000, 256
# Query vectors in a block.
QUERY_ROWS = 256


def in_dates(docs: DataFrame, date: str, begin: str, end: str) -> DataFrame:
    """Inclusive date range, applied before scoring; documents without a date are out."""
    return docs.filter(F.col(date).between(begin, end))


def restrict_to(docs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Documents whose id is listed."""
    return docs.join(ids.select(key).distinct(), key, "left_semi")


def _ranked(scored: DataFrame, doc: str, k: int) -> DataFrame:
    """Best k documents per query; the limit is applied in every task before the shuffle."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(doc))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def bm25(
    docs: DataFrame,
    doc: str,
    text: str,
    queries: DataFrame,
    query_text: str,
    k: int = fixed.LEXICAL_DEPTH,
    allowed: Column | None = None,
    k1: float = fixed.BM25_K1,
    b: float = fixed.BM25_B,
) -> DataFrame:
    """Top k documents per query by BM25: ``(query_id, doc, score, rank)``.

    ``allowed`` restricts the documents that can be found; the word statistics stay those of
    the whole collection.

    Texts are taken apart once and kept as blocks of documents with their distinct words and counts.
    Blocks of queries meet them, and the scores of two blocks are one matrix product, so no row is made
    per query and document; of each query a task hands on its best k. The parts of a score are whole
    millionths, so a score does not depend on the order in which they are added.
    """
    may_match = F.lit(True) if allowed is None else F.coalesce(allowed, F.lit(False))
    asked = one_per_row(queries, F.array_distinct(tokens(F.col(query_text))), "term", ["query_id"])
    doc_type = docs.schema[doc].dataType.simpleString()
    query_type = queries.schema["query_id"].dataType.simpleString()
    counted = stored(_counted(docs.select(F.col(doc).alias("doc"), F.col(text).alias("text"), may_match.alias("allowed")), doc_type))
    n_docs = counted.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).scalar()
    avg_len = counted.agg(F.try_divide(F.sum("all_words").cast("double"), F.sum("n_texts"))).scalar()
    df = (
        counted.select("words", "code").mapInArrow(_document_counts, "term string, df bigint")
        .join(asked.select("term").distinct(), "term", "left_semi")
        .groupBy("term")
        .agg(F.sum("df").alias("df"))
    )
    idf = F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = asked.join(df.select("term", idf.alias("idf")), "term")
    wanted = _asked_blocks(weighted, query_type).withColumn("avg_len", avg_len)
    collection = counted.withColumn("block", F.monotonically_increasing_id())

    def best_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for first, run in blocks.per_asked_block(batches):
            ids, avg = first["asked_query_id"].values, first["asked_avg_len"].as_py()
            terms = first["asked_term"].values.dictionary_encode()
            place = terms.indices.to_numpy()
            weight = np.zeros(len(terms.dictionary))
            weight[place] = first["asked_idf"].values.to_numpy()
            asks = np.zeros((len(weight), len(ids)))
            np.add.at(asks, (place, np.repeat(np.arange(len(ids)), first["asked_terms"].values.to_numpy())), 1)
            best = blocks.RunningBest(k)
            for row in run:
                names, found = _block_points(row, terms.dictionary, weight, avg, k1, b)
                raw = np.concatenate([part @ asks for part in found]).T
                points = np.where(raw > 0, np.floor(raw), -1)
                near = points >= 0
                if len(names) > k:  # only scores up to the k-th best, ties included, are sorted
                    near &= points >= np.partition(points, -k, axis=1)[:, -k:][:, :1]
                query, at = np.nonzero(near)
                best.add(query, points[query, at], names[at])
            query, points, name = best.taken()
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(query)), pa.array(name, first["doc"].type.value_type), pa.array(points / MILLION)],
                names=["query_id", doc, "score"],
            )

    scored = blocks.meet(wanted, collection).mapInArrow(best_of_task, f"query_id {query_type}, {doc} {doc_type}, score double")
    return _ranked(scored, doc, k)


def _counted(docs: DataFrame, doc_type: str) -> DataFrame:
    """Blocks of documents (``doc, text, allowed``) with their word counts.

    A block has ``doc``, ``doc_len`` and ``allowed`` of its rows, its distinct ``words``, per row the number
    of its different words (``sizes``), and for those their places in ``words`` (``code``) and counts
    (``tf``). Equal ids lie in one block, and those of equal length are one row. ``n_rows``, ``n_texts``
    and ``all_words`` count the given rows, those with a text, and their words.
    """
    kinds = {
        "doc": doc_type, "doc_len": "int", "allowed": "boolean", "words": "string", "sizes": "int", "code": "int", "tf": "int",
    }
    totals = ("n_rows", "n_texts", "all_words")

    def block(part: pa.RecordBatch) -> pa.RecordBatch:
        ids, lists = part.column("doc"), part.column("words")
        length = lists.value_lengths().fill_null(0).to_numpy()
        rows: dict = {}
        keys = zip(ids.to_pylist(), length.tolist(), part.column("allowed").to_pylist(), strict=True)
        row = np.array([rows.setdefault(key, len(rows)) for key in keys], np.int64)
        words = lists.flatten().dictionary_encode()
        width = max(1, len(words.dictionary))
        pairs, tf = np.unique(np.repeat(row, length) * width + words.indices.to_numpy(), return_counts=True)
        names, lengths, may = zip(*rows, strict=True)
        columns = [
            pa.array(names, ids.type), pa.array(lengths, pa.int32()), pa.array(may, pa.bool_()), words.dictionary,
            *[pa.array(x.astype(np.int32)) for x in (np.bincount(pairs // width, minlength=len(rows)), pairs % width, tf)],
        ]
        counts = (len(ids), len(ids) - lists.null_count, int(length.sum()))
        return pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns] + [pa.array([n], pa.int64()) for n in counts],
            names=[*kinds, *totals],
        )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            batch = batch if held is None else pa.concat_batches([held, batch])
            ids = batch.column("doc").to_pylist()
            ends = np.cumsum(batch.column("words").value_lengths().fill_null(0).to_numpy())
            begin = 0
            while begin < len(ids):
                before = int(ends[begin - 1]) if begin else 0
                end = max(begin + 1, min(begin + DOC_ROWS, int(np.searchsorted(ends, before + DOC_WORDS, "right"))))
                while end < len(ids) and ids[end] == ids[end - 1]:
                    end += 1
                if end >= len(ids):  # the rows of the last id may go on in the next batch
                    break
                yield block(batch.slice(begin, end - begin))
                begin = end
            held = batch.slice(begin)
        if held is not None and held.num_rows:
            yield block(held)

    words = docs.repartition("doc").sortWithinPartitions("doc").select("doc", tokens(F.col("text")).alias("words"), "allowed")
    return words.mapInArrow(
        pack, ", ".join([*[f"{n} array<{kind}>" for n, kind in kinds.items()], *[f"{n} bigint" for n in totals]])
    )


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a counted block that have each of its words."""
    for batch in batches:
        for words, code in zip(batch.column("words"), batch.column("code"), strict=True):
            n = np.bincount(code.values.to_numpy(), minlength=len(words.values))
            yield pa.RecordBatch.from_arrays([words.values, pa.array(n, pa.int64())], names=["term", "df"])


def _asked_blocks(weighted: DataFrame, query_type: str) -> DataFrame:
    """Up to ``QUERY_ROWS`` queries in a row: ids, terms per query, and all terms with their weights."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, QUERY_ROWS):
                part = batch.slice(at, QUERY_ROWS)
                lists = part.column("terms")
                flat = lists.flatten()
                columns = [part.column("query_id"), lists.value_lengths(), flat.field("term"), flat.field("idf")]
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns],
                    names=["query_id", "terms", "term", "idf"],
                )

    per_query = weighted.groupBy("query_id").agg(F.collect_list(F.struct("term", "idf")).alias("terms"))
    packed = per_query.mapInArrow(
        pack, f"query_id array<{query_type}>, terms array<int>, term array<string>, idf array<double>"
    )
    return packed.withColumn("block", F.monotonically_increasing_id())


def _block_points(
    row: dict, terms: pa.Array, weight: np.ndarray, avg: float, k1: float, b: float
) -> tuple[np.ndarray, Iterator[np.ndarray]]:
    """Ids of a counted block, and for ``PART_ROWS`` of them at a time what each term adds to their scores.

    Every pair of a document and a term has a fraction ``PAIR`` besides its whole points, so that pairs
    whose points round to nothing are still found.
    """
    sizes, code, tf = (row[n].values.to_numpy() for n in ("sizes", "code", "tf"))
    names = row["doc"].values
    names = np.array(names.to_pylist(), object) if names.null_count else names.to_numpy(zero_copy_only=False)
    allowed = row["allowed"].values.to_numpy(zero_copy_only=False).astype(bool)
    term = pc.index_in(row["words"].values, value_set=terms).fill_null(-1).to_numpy()[code]
    entry = np.repeat(np.arange(len(sizes)), sizes)
    own = (term >= 0) & allowed[entry]
    entry, term, tf = entry[own], term[own], tf[own].astype(float)
    length = row["doc_len"].values.to_numpy()[entry]
    points = np.floor(weight[term] * (tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / avg))) * MILLION + 0.5) + PAIR
    # Rows of one id follow each other; of their scores the sum counts.
    first = np.r_[True, names[1:] != names[:-1]]
    at = (np.cumsum(first) - 1)[entry]

    def parts() -> Iterator[np.ndarray]:
        for begin in range(0, int(first.sum()), PART_ROWS):
            low, high = np.searchsorted(at, [begin, begin + PART_ROWS])
            rows = min(PART_ROWS, int(first.sum()) - begin)
            cells = (at[low:high] - begin) * len(terms) + term[low:high]
            yield np.bincount(cells, points[low:high], rows * len(terms)).reshape(rows, len(terms))

    return names[first], parts()


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda total, x: total + x,
    )


def _unit_rows(matrix: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, lengths, out=np.zeros_like(matrix), where=lengths > 0)


def dense_top_k(
    docs: DataFrame,
    doc: str,
    vector: str,
    queries: DataFrame,
    k: int = fixed.DENSE_DEPTH,
    threshold: float | None = None,
    cosine: bool = False,
    query_vector: str = "vector",
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """Exact top k documents per query by inner product, or by cosine: ``(query_id, doc, score, rank)``.

    ``queries`` has ``query_id`` and ``query_vector`` and any number of rows. Blocks of queries meet
    blocks of documents; the product of two blocks is one matrix product. Of each query a task hands
    on its best k, ties at the last place by id, and those are ranked across tasks. A document or
    query without a vector finds nothing; of vectors of unequal length the common part counts.
    """
    doc_type = docs.schema[doc].dataType.simpleString()
    query_type = queries.schema["query_id"].dataType.simpleString()
    kinds = blocks.kind_of(queries, query_vector), blocks.kind_of(docs, vector)
    asked = blocks.pack(
        queries.filter(F.col(query_vector).isNotNull()).select("query_id", F.col(query_vector).alias("vector")),
        "vector", query_rows,
    )
    searched = blocks.pack(
        docs.filter(F.col(vector).isNotNull()).select(F.col(doc).alias("doc"), F.col(vector).alias("vector")), "vector"
    )

    def best_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for first, run in blocks.per_asked_block(batches):
            ids = first["asked_query_id"].values
            wanted = blocks.vectors_of(first["asked_vector"].as_py(), len(ids), kinds[0]).astype(np.float64)
            if cosine:
                wanted = _unit_rows(wanted)
            best = blocks.RunningBest(k)
            for row in run:
                names = row["doc"].values.to_numpy(zero_copy_only=False)
                vectors = blocks.vectors_of(row["vector"].as_py(), len(names), kinds[1]).astype(np.float64)
                if cosine:
                    vectors = _unit_rows(vectors)
                common = min(wanted.shape[1], vectors.shape[1])
                scores = np.round(wanted[:, :common] @ vectors[:, :common].T, 6)
                near = np.ones(scores.shape, bool) if threshold is None else scores >= threshold
                if len(names) > k:  # only scores up to the k-th best, ties included, are sorted
                    near &= scores >= np.partition(scores, -k, axis=1)[:, -k:][:, :1]
                query, at = np.nonzero(near)
                best.add(query, scores[query, at], names[at])
            query, score, name = best.taken()
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(query)), pa.array(name, row["doc"].type.value_type), pa.array(score)],
                names=["query_id", doc, "score"],
            )

    near = blocks.meet(asked, searched).mapInArrow(
        best_of_task, f"query_id {query_type}, {doc} {doc_type}, score double"
    )
    return _ranked(near, doc, k)


def fuse(
    lexical: DataFrame,
    dense: DataFrame,
    doc: str,
    k: int | None = None,
    alpha: float = fixed.FUSION_LEXICAL_WEIGHT,
    c: int = fixed.FUSION_K,
    missing: int = fixed.FUSION_MISSING_RANK,
) -> DataFrame:
    """Weighted reciprocal-rank fusion of two rankings, best k per query.

    A document that one ranking lacks counts as rank ``missing`` there. The default is a fixed
    value below ``DENSE_DEPTH``; give one above both depths to have every hit beat a miss.
    """
    left = lexical.select("query_id", doc, F.col("rank").alias("lexical_rank"))
    right = dense.select("query_id", doc, F.col("rank").alias("dense_rank"))
    both = left.join(right, ["query_id", doc], "outer").fillna(
        missing, ["lexical_rank", "dense_rank"]
    )
    score = F.lit(alpha) / (c + F.col("lexical_rank")) + F.lit(1 - alpha) / (c + F.col("dense_rank"))
    fused = both.withColumn("score", F.round(score, 9))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(doc))
    ranked = fused.withColumn("rank", F.row_number().over(w))
    return ranked if k is None else ranked.filter(F.col("rank") <= k)


def cut(
    ranked: DataFrame, top_k: int | None = None, threshold: float = 0.5, default_k: int = 250
) -> DataFrame:
    """An explicit k keeps the first k. Otherwise keep scores from the threshold up, or, for
    a query where no score reaches it, the first ``default_k``."""
    if top_k is not None:
        return ranked.filter(F.col("rank") <= top_k)
    best = ranked.groupBy("query_id").agg(F.max("score").alias("__best"))
    keep = F.when(F.col("__best") >= threshold, F.col("score") >= threshold).otherwise(
        F.col("rank") <= default_k
    )
    return ranked.join(best, "query_id").filter(keep).drop("__best")


def candidates_depth(target_k: int, minimum: int = 50) -> int:
    """How many fused candidates are looked at for a target."""
    return max(2 * target_k, minimum)


def with_texts(ranked: DataFrame, docs: DataFrame, doc: str, columns: list[str]) -> DataFrame:
    """Attach text columns to ranked ids; an id without a document keeps its rank."""
    return ranked.join(docs.select(doc, *columns), doc, "left")


def keyword_overlap(
    docs: DataFrame, doc: str, short: str, long: str, query: str, k: int = 15
) -> DataFrame:
    """Rank by words of the query found in the short text (5 each) and in the long text (1
    each); words of three letters and more. When nothing is found the first k rows stand; a
    query without such words keeps every row."""
    if not any(len(w) > 2 for w in re.findall(fixed.TOKEN_PATTERN, query.lower())):
        return docs.select(doc, F.lit(0).alias("score"))
    words = F.filter(tokens(F.lit(query)), lambda t: F.length(t) > 2)

    def points(column: str, weight: int) -> Column:
        t = F.lower(F.coalesce(F.col(column), F.lit("")))
        return F.aggregate(
            words, F.lit(0), lambda total, w: total + F.when(F.contains(t, w), weight).otherwise(0)
        )

    scored = docs.withColumn("score", points(short, 5) + points(long, 1))
    found = scored.agg(F.coalesce(F.max(F.col("score") > 0), F.lit(False))).scalar()
    return (
        scored.filter((F.col("score") > 0) | ~found)
        .orderBy(F.desc("score"), F.asc(doc))
        .limit(k)
        .select(doc, "score")
    )
