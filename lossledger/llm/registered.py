"""The operators as queries over the supplied tables, and SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    codes,
    decontaminate,
    language,
    maxent,
    neardup,
    negatives,
    neighbours,
    packing,
    preferences,
    quality,
    substrings,
    token_counts,
    toxicity,
)
from .common import id_remainder, stored

QUERIES: dict = {}
SQL: dict[str, str] = {}


def registered(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


@registered
def op7_quality_rules(spark: SparkSession, path: str) -> DataFrame:
    """Base counts and the verdict by distribution divergence, per document."""
    measures = quality.measured(table(spark, path, "documents").select("doc_id", "text", "lang")).drop("text")
    measures = stored(measures)
    judged = quality.judged(measures, quality.language_references(measures))
    return judged.select("doc_id", *(
        F.col(f"{quality.MEASURES}.{name}").alias(name) for name in (
            "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
            "class_distance", "word_distance")))


@registered
def op2_decontamination(spark: SparkSession, path: str) -> DataFrame:
    """Words of each document inside an occurrence of a benchmark window, and the items found."""
    found = decontaminate.marked(
        table(spark, path, "documents").select("doc_id", "text"), table(spark, path, "benchmark"))
    items = F.col(f"{decontaminate.DECISION}items")
    return found.select(
        "doc_id",
        F.col(f"{decontaminate.DECISION}n_words").alias("n_words"),
        decontaminate.hit_words().alias("n_hit"),
        F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.sort_array(items), ","), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
    )


SQL["op2_decontamination"] = r"""
WITH doc AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
    SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[k:k + least(13, len(w)) - 1], ' ') AS words
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS k FROM item WHERE len(w) > 0)
), spots AS (
    SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS words
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k
          FROM doc, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
), hits AS (
    SELECT doc_id, k, n, item_id FROM spots JOIN windows USING (n, words)
), words AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hits) GROUP BY doc_id
), items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM doc d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@registered
def op9_minhash_groups(spark: SparkSession, path: str) -> DataFrame:
    """Groups of documents whose three-word shingle sets are similar to 0.85 or more."""
    found = neardup.groups(table(spark, path, "documents").select("doc_id", "text"), width=3, threshold=85)
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


@registered
def op3_substring_dedup(spark: SparkSession, path: str) -> DataFrame:
    """Words left in each document when every 20-word window stays only where it stands first."""
    return substrings.digests(table(spark, path, "documents").select("doc_id", "text"))


SQL["op3_substring_dedup"] = r"""
WITH doc AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), spots AS (
    SELECT doc_id, k, array_to_string(w[k:k + 19], ' ') AS words
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS k FROM doc WHERE len(w) >= 20)
), later AS (
    SELECT doc_id, k FROM spots
    QUALIFY row_number() OVER (PARTITION BY words ORDER BY doc_id, k) > 1
), gone AS (
    SELECT doc_id, list(DISTINCT p) AS places FROM (SELECT doc_id, unnest(range(k, k + 20)) AS p FROM later) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(places), 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN places IS NULL THEN array_to_string(w, ' ') ELSE array_to_string(
           [w[p] FOR p IN list_sort(list_filter(range(1, len(w) + 1), lambda p: NOT list_contains(places, p)))], ' ') END) AS kept_sha256
FROM doc LEFT JOIN gone USING (doc_id)
"""


@registered
def op5_best_fit_packing(spark: SparkSession, path: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    docs = table(spark, path, "documents").select("doc_id", "text")
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"), 2048)


@registered
def op10_lm_scores(spark: SparkSession, path: str) -> DataFrame:
    """Unigram and maximum-entropy log10 probabilities of every text."""
    held_out = id_remainder("doc_id", 7) == 2
    return maxent.scores(table(spark, path, "documents").select("doc_id", "text"), ~held_out, held_out)


@registered
def op1_token_counts(spark: SparkSession, path: str) -> DataFrame:
    """Tokens of every whole text by a unigram search over a public vocabulary."""
    docs = table(spark, path, "documents").select("doc_id", "text")
    return token_counts.counted(docs, public_tokenizers.path("piece_bpe_32k.model"))


def _preference_rows(pairs: DataFrame) -> DataFrame:
    pairs = preferences.formatted(pairs)

    def spans(mask: str):
        return F.array_join(F.transform(mask, lambda s: F.concat(s["begin"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")

    return pairs.select("pair_id", F.col("prefix_turns").cast("bigint").alias("prefix_turns"), "prompt", "chosen_text", "rejected_text",
                        spans("chosen_mask").alias("chosen_mask"), spans("rejected_mask").alias("rejected_mask"), "usable")


@registered
def op8_preference_formatting(spark: SparkSession, path: str) -> DataFrame:
    """Conversations with an answer against their begin with a neighbour's answer: prompt, completions and masks."""
    return _preference_rows(preferences.neighbour_pairs(table(spark, path, "conversations")))


@registered
def op8_whole_conversations(spark: SparkSession, path: str) -> DataFrame:
    """Every whole conversation against the next one: prompt, completions and masks."""
    return _preference_rows(preferences.whole_pairs(table(spark, path, "conversations")))


SQL["op8_preference_formatting"] = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k
    FROM conversations WHERE conv_id IS NOT NULL
), answers AS (
    SELECT conv_id, max(k) AS last, max_by(text, k) AS text FROM turns WHERE role = 'assistant' GROUP BY conv_id
), pairs AS (
    SELECT a.conv_id, a.last, a.text AS chosen, b.text AS rejected, a.text = b.text AS same
    FROM answers a JOIN answers b ON b.conv_id = xor(a.conv_id, 1)
), prompts AS (
    SELECT p.conv_id, coalesce(string_agg('<|' || t.role || '|>' || chr(10) || t.text || chr(10), '' ORDER BY t.k), '') AS prompt
    FROM pairs p LEFT JOIN turns t ON t.conv_id = p.conv_id AND (t.k < p.last OR p.same AND t.k = p.last) GROUP BY p.conv_id
)
SELECT conv_id AS pair_id, CAST(last - CASE WHEN same THEN 0 ELSE 1 END AS BIGINT) AS prefix_turns, prompt,
       CASE WHEN same THEN '' ELSE '<|assistant|>' || chr(10) || chosen || chr(10) END AS chosen_text,
       CASE WHEN same THEN '' ELSE '<|assistant|>' || chr(10) || rejected || chr(10) END AS rejected_text,
       CASE WHEN same OR chosen = '' THEN '' ELSE '14-' || CAST(14 + length(chosen) AS VARCHAR) END AS chosen_mask,
       CASE WHEN same OR rejected = '' THEN '' ELSE '14-' || CAST(14 + length(rejected) AS VARCHAR) END AS rejected_mask,
       NOT same AND chosen <> '' AND rejected <> '' AS usable
FROM pairs JOIN prompts USING (conv_id)
"""


@registered
def op6_language_id(spark: SparkSession, path: str) -> DataFrame:
    """Language of every whole text by character models."""
    docs = table(spark, path, "documents").select("doc_id", "text", "lang")
    held_out = id_remainder("doc_id", 4) == 2
    found = language.identified(docs, language.trained(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


@registered
def op4_toxicity(spark: SparkSession, path: str) -> DataFrame:
    """Toxicity of every whole text by a convolutional classifier."""
    docs = table(spark, path, "documents").select("doc_id", "text")
    held_out = id_remainder("doc_id", 5) == 0
    network = toxicity.fitted(docs, table(spark, path, "labels"), ~held_out)
    return toxicity.scored(docs, network).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@registered
def op11_vector_codes(spark: SparkSession, path: str) -> DataFrame:
    """Codes and errors of every vector under codebooks fitted to all of them."""
    return codes.digests(table(spark, path, "embeddings"), "vec_id", "embedding", "label")


@registered
def op12_nearest_neighbours(spark: SparkSession, path: str) -> DataFrame:
    """The five nearest rows by cosine of every row whose id is divisible by 50."""
    found = neighbours.nearest(table(spark, path, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 50 == 0)
    return found.withColumnRenamed("id", "vec_id")


@registered
def op13_hard_negatives(spark: SparkSession, path: str) -> DataFrame:
    """For each anchor's five best rows of its label, the best rows of other labels just below them."""
    mislabelled = F.col("vec_id") % 7 == 0
    label = F.when(mislabelled, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mined(
        table(spark, path, "embeddings"), "vec_id", label, "embedding", F.col("vec_id") % 100 == 0)


SQL["op13_hard_negatives"] = r"""
WITH kept AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
           CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM kept a JOIN kept b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score QUALIFY rank <= 5
"""
