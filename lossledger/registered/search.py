"""Text and vector search (I)."""

from pyspark.sql import functions as F

from ..operators import search
from .base import query


def _centroids(v):
    """One query vector per label: the mean of the label's vectors."""
    parts = v.embeddings.select("label", F.posexplode("embedding").alias("pos", "x"))
    means = parts.groupBy("label", "pos").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("x"))
    packed = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("v"))
    return packed.select(
        F.col("label").cast("bigint").alias("query_id"), F.col("v.x").alias("vector")
    )


_CENTROIDS = """
    centroids AS (SELECT label AS query_id, list(x ORDER BY pos) AS vector FROM (
        SELECT label, pos, ROUND(AVG(x), 6) AS x FROM (
            SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)
        GROUP BY 1, 2) GROUP BY 1)"""


def _queries(v):
    return v.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))


_WORDS = r"regexp_extract_all(lower({}), '[а-яёa-z0-9]+')"


def _bm25_sql(queries: str, allowed: str = "TRUE", docs: str = "documents") -> str:
    """CTEs up to ``lexical(query_id, doc_id, score)`` for a relation ``(query_id, query_text)``."""
    return f"""
    words AS (SELECT doc_id, {_WORDS.format('text')} AS w, {allowed} AS allowed FROM {docs}),
    stats AS (SELECT COUNT(*) AS n, AVG(len(w)) AS avg_len FROM words),
    asked AS (SELECT query_id, unnest(list_distinct({_WORDS.format('query_text')})) AS term FROM {queries}),
    tf AS (SELECT doc_id, doc_len, allowed, term, COUNT(*) AS tf FROM
               (SELECT doc_id, len(w) AS doc_len, allowed, unnest(w) AS term FROM words)
           WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
    idf AS (SELECT term, ln(1 + (n - COUNT(*) + 0.5::DOUBLE) / (COUNT(*) + 0.5::DOUBLE)) AS idf FROM tf, stats GROUP BY term, n),
    lexical AS (
        SELECT query_id, doc_id, SUM(CAST(ROUND(idf * (tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * doc_len / avg_len))) * 1000000) AS BIGINT))::DOUBLE / 1000000 AS score
        FROM tf JOIN asked USING (term) JOIN idf USING (term), stats WHERE allowed GROUP BY 1, 2)"""


def _rank(k: int) -> str:
    return f"ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM {{}} QUALIFY rank <= {k}"


_ALL_QUERIES = "(SELECT item_id AS query_id, text AS query_text FROM benchmark)"


@query("i1_bm25", f"""
    WITH {_bm25_sql(_ALL_QUERIES)} SELECT query_id, doc_id, score, {_rank(10).format('lexical')}""")
def bm25(v):
    return search.bm25(v.texts, "doc_id", "text", _queries(v), "query_text", k=10)


_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"
_LENGTH = "sqrt(list_sum(list_transform({a}, lambda x: x::DOUBLE * x::DOUBLE)))"


@query("i2_dense_top_k", f"""
    WITH {_CENTROIDS}, dense AS (
        SELECT query_id, vec_id AS doc_id, ROUND({_DOT.format(a='embedding', b='vector')}, 6) AS score FROM embeddings, centroids)
    SELECT query_id, doc_id AS vec_id, score, {_rank(100).format('dense')}""")
def dense_top_k(v):
    return search.dense_top_k(v.embeddings, "vec_id", "embedding", _centroids(v), k=100)


@query("i2_nearest_to_mean", f"""
    WITH mean AS (SELECT list(x ORDER BY pos) AS vector FROM (
        SELECT pos, ROUND(AVG(x), 6) AS x FROM (
            SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY 1))
    SELECT vec_id, ROUND({_DOT.format(a='embedding', b='vector')}, 6) AS score FROM embeddings, mean
    ORDER BY score DESC, vec_id LIMIT 50""")
def nearest_to_mean(v):
    parts = v.embeddings.select(F.posexplode("embedding").alias("pos", "x"))
    means = parts.groupBy("pos").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("x"))
    packed = means.agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("v"))
    asked = packed.select(F.lit(0).cast("bigint").alias("query_id"), F.col("v.x").alias("vector"))
    return search.dense_top_k(v.embeddings, "vec_id", "embedding", asked, k=50).select("vec_id", "score")


@query("i3_subset_cosine", f"""
    WITH {_CENTROIDS}, dense AS (
        SELECT query_id, vec_id AS doc_id,
               ROUND({_DOT.format(a='embedding', b='vector')} / ({_LENGTH.format(a='embedding')} * {_LENGTH.format(a='vector')}), 6) AS score
        FROM embeddings, centroids WHERE vec_id IN (SELECT doc_id FROM labels WHERE quality = 1))
    SELECT query_id, doc_id AS vec_id, score, {_rank(50).format('(SELECT * FROM dense WHERE score >= 0.4)')}""")
def subset_cosine(v):
    ids = v.labels.filter("quality = 1").select(F.col("doc_id").alias("vec_id"))
    docs = search.restrict_to(v.embeddings, ids, "vec_id")
    return search.dense_top_k(docs, "vec_id", "embedding", _centroids(v), k=50, threshold=0.4, cosine=True)


_DATED = "(SELECT d.*, strftime(o_orderdate, '%Y-%m-%d') AS day FROM documents d LEFT JOIN orders ON o_orderkey = doc_id)"


def _days(v):
    """Entry date of the incident that a document describes, as text."""
    return v.orders.select(F.col("o_orderkey").alias("doc_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


def _dated(v):
    return v.texts.join(_days(v), "doc_id", "left")


@query("i4_bm25_in_dates", f"""
    WITH {_bm25_sql(_ALL_QUERIES, "day BETWEEN '1996-01-01' AND '1998-12-31'", _DATED)}
    SELECT query_id, doc_id, score, {_rank(10).format('lexical')}""")
def bm25_in_dates(v):
    allowed = F.col("day").between("1996-01-01", "1998-12-31")
    return search.bm25(_dated(v), "doc_id", "text", _queries(v), "query_text", k=10, allowed=allowed)


@query("i4_dense_in_dates", f"""
    WITH {_CENTROIDS}, dense AS (
        SELECT query_id, vec_id AS doc_id, ROUND({_DOT.format(a='embedding', b='vector')}, 6) AS score
        FROM embeddings JOIN orders ON o_orderkey = vec_id, centroids
        WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1999-01-01')
    SELECT query_id, doc_id AS vec_id, score, {_rank(20).format('dense')}""")
def dense_in_dates(v):
    days = v.orders.select(F.col("o_orderkey").alias("vec_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    docs = search.in_dates(v.embeddings.join(days, "vec_id"), "day", "1996-01-01", "1998-12-31")
    return search.dense_top_k(docs, "vec_id", "embedding", _centroids(v), k=20)


def _fused(v, k, dates=None):
    """Both rankings of every benchmark text, fused; documents outside the dates are not ranked."""
    docs, allowed = v.texts, None
    vectors = v.embeddings.withColumnRenamed("vec_id", "doc_id")
    if dates is not None:
        docs, allowed = _dated(v), F.col("day").between(*dates)
        vectors = search.in_dates(vectors.join(_days(v), "doc_id"), "day", *dates)
    lexical = search.bm25(docs, "doc_id", "text", _queries(v), "query_text", allowed=allowed)
    dense = search.dense_top_k(vectors, "doc_id", "embedding", _centroids(v))
    return search.fuse(lexical, dense, "doc_id", k)


def _fused_sql(allowed: str = "TRUE", docs: str = "documents", vectors: str = "embeddings") -> str:
    return f"""{_CENTROIDS}, {_bm25_sql(_ALL_QUERIES, allowed, docs)},
    lex AS (SELECT query_id, doc_id, {_rank(686).format('lexical')}),
    dense AS (SELECT query_id, vec_id AS doc_id, ROUND({_DOT.format(a='embedding', b='vector')}, 6) AS score FROM {vectors}, centroids),
    den AS (SELECT query_id, doc_id, {_rank(1024).format('dense')}),
    fused AS (
        SELECT query_id, doc_id, COALESCE(lex.rank, 999) AS lexical_rank, COALESCE(den.rank, 999) AS dense_rank,
               ROUND(0.3::DOUBLE / (60 + COALESCE(lex.rank, 999)) + 0.7::DOUBLE / (60 + COALESCE(den.rank, 999)), 9) AS score
        FROM lex FULL JOIN den USING (query_id, doc_id))"""


@query("i6_rank_fusion", f"""
    WITH {_fused_sql()} SELECT query_id, doc_id, lexical_rank, dense_rank, score, {_rank(200).format('fused')}""")
def rank_fusion(v):
    return _fused(v, 200)


_DATED_VECTORS = """(SELECT e.* FROM embeddings e JOIN orders ON o_orderkey = vec_id
        WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1999-01-01')"""


@query("i5_fused_in_dates", f"""
    WITH {_fused_sql("day BETWEEN '1996-01-01' AND '1998-12-31'", _DATED, _DATED_VECTORS)}
    SELECT query_id, doc_id, score, {_rank(20).format('fused')}""")
def fused_in_dates(v):
    return _fused(v, 20, ("1996-01-01", "1998-12-31")).select("query_id", "doc_id", "score", "rank")


_COSINES = f"""{_CENTROIDS}, dense AS (
        SELECT query_id, vec_id AS doc_id,
               ROUND({_DOT.format(a='embedding', b='vector')} / ({_LENGTH.format(a='embedding')} * {_LENGTH.format(a='vector')}), 6) AS score
        FROM embeddings, centroids), ranked AS (SELECT query_id, doc_id, score, {_rank(50).format('dense')})"""


@query("i8_cut_by_threshold", f"""
    WITH {_COSINES} SELECT query_id, doc_id AS vec_id, score, rank
    FROM (SELECT *, MAX(score) OVER (PARTITION BY query_id) AS best FROM ranked)
    WHERE CASE WHEN best >= 0.62 THEN score >= 0.62 ELSE rank <= 5 END""")
def cut_by_threshold(v):
    ranked = search.dense_top_k(v.embeddings, "vec_id", "embedding", _centroids(v), k=50, cosine=True)
    return search.cut(ranked, threshold=0.62, default_k=5)


@query("i8_cut_by_count", f"""
    WITH {_COSINES} SELECT query_id, doc_id AS vec_id, score, rank FROM ranked WHERE rank <= 7""")
def cut_by_count(v):
    ranked = search.dense_top_k(v.embeddings, "vec_id", "embedding", _centroids(v), k=50, cosine=True)
    return search.cut(ranked, top_k=7)


@query("i9_keyword_overlap", """
    WITH w AS (SELECT unnest(['assistant', 'token', 'tion', 'reeaution', 'the']) AS w)
    SELECT conv_id * 1000 + turn AS message_id,
           CAST(SUM(CASE WHEN contains(lower(role), w) THEN 5 ELSE 0 END + CASE WHEN contains(lower(text), w) THEN 1 ELSE 0 END) AS BIGINT) AS score
    FROM conversations, w GROUP BY 1 HAVING score > 0 ORDER BY score DESC, message_id LIMIT 15""")
def keyword_overlap(v):
    messages = v.conversations.withColumn("message_id", F.col("conv_id") * 1000 + F.col("turn"))
    return search.keyword_overlap(
        messages, "message_id", "role", "text", "Assistant token, -tion; reeaution is of the"
    )


@query("i10_texts_of_hits", f"""
    WITH {_fused_sql()}, ranked AS (SELECT query_id, doc_id, score, {_rank(25).format('fused')})
    SELECT query_id, doc_id, score, rank, text, source FROM ranked LEFT JOIN documents USING (doc_id)""")
def texts_of_hits(v):
    return search.with_texts(
        _fused(v, 25).select("query_id", "doc_id", "score", "rank"), v.documents, "doc_id", ["text", "source"]
    )
