"""Fuzzy match of phrases against the value catalog, by indexes instead of all pairs.

A score is the best of four parts, and every part has an index that finds all pairs in which it reaches
the least score asked for:

* equal normal forms: a join on the form;
* one tight form inside the other: the inner one looks up its rarest letter run among the letter runs of
  the others (a run that nobody has ends the search at once);
* shared words: postings of words;
* few edits: a value is cut into one more segment than there may be edits, so at least one survives; a
  phrase looks up its own substrings of that length near the segment's place (the shift is limited by the
  edits on either side). Beyond ``MOST_EDITS`` edits, or more edits than letters, pairs of fitting lengths
  are compared.

Each part is worked out only for the pairs its own index names. Indexes are joins on plain keys, so a
catalog and a set of phrases may have any size, and a frequent key is split by the adaptive skew handling.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions import text as tx
from .aggregates import top_k_per_group
from .lineage import cut_lineage

# Letters in a run of the containment index; shorter forms are looked up whole.
RUN = 3
# Up to so many edits a pair has to share a segment.
MOST_EDITS = 12
# Scores are rounded to six places before they are compared.
HALF_STEP = 5e-7


def _forms(df: DataFrame, value: str) -> DataFrame:
    """Distinct normal forms of a text column, and what is derived from them."""
    return (
        df.select(tx.norm(F.col(value)).alias("norm"))
        .filter(F.col("norm").isNotNull())
        .distinct()
        .select("norm", tx.tight(F.col("norm")).alias("tight"), tx.token_set(F.col("norm")).alias("tokens"))
    )


def _postings(forms: DataFrame, name: str) -> DataFrame:
    """``(run, name_norm, name_tight)`` for all runs of one to ``RUN`` letters."""
    runs = F.flatten(F.transform(
        F.sequence(F.lit(1), F.least(F.lit(RUN), F.length("tight"))),
        lambda size: F.transform(
            F.sequence(F.lit(1), F.length("tight") - size + 1), lambda at: F.substring("tight", at, size)
        ),
    ))
    return (
        forms.filter(F.length("tight") > 0)
        .select(F.col("norm").alias(f"{name}_norm"), F.col("tight").alias(f"{name}_tight"), F.explode(F.array_distinct(runs)).alias("run"))
    )


def _contained(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """``(inner_norm, inner_tight, outer_norm, outer_tight)`` where the inner tight form, not empty, is
    part of the outer one."""
    postings = _postings(outer, "outer")
    frequency = postings.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    size = F.least(F.lit(RUN), F.length("tight"))
    own = F.transform(
        F.sequence(F.lit(1), F.length("tight") - size + 1), lambda at: F.substring("tight", at, size)
    )
    rarest = (
        inner.filter(F.length("tight") > 0)
        .select(F.col("norm").alias("inner_norm"), F.col("tight").alias("inner_tight"), F.explode(F.array_distinct(own)).alias("run"))
        .join(frequency, "run", "left")
        .groupBy("inner_norm", "inner_tight")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "run")).alias("best"))
        .filter("best.n > 0")
        .select("inner_norm", "inner_tight", F.col("best.run").alias("run"))
    )
    return rarest.join(postings, "run").filter(F.contains("outer_tight", F.col("inner_tight"))).drop("run")


def _of_length(inner: str, outer: str) -> Column:
    return F.length(inner) / F.length(outer)


def _sharing_words(phrases: DataFrame, entries: DataFrame) -> DataFrame:
    """Pairs with a common word and the share of their common words; a pair is kept at its first one."""
    asked = phrases.select(F.col("norm").alias("q_norm"), F.col("tokens").alias("q_tokens"), F.explode("tokens").alias("word"))
    known = entries.select(F.col("norm").alias("e_norm"), F.col("tokens").alias("e_tokens"), F.explode("tokens").alias("word"))
    shared = F.array_intersect("q_tokens", "e_tokens")
    n = F.size(shared)
    return (
        asked.join(known, "word")
        .filter(F.get(shared, F.lit(0)) == F.col("word"))
        .select("q_norm", "e_norm", (n / (F.size("q_tokens") + F.size("e_tokens") - n)).alias("share"))
    )


def _edits_allowed(least: float, a: Column, b: Column) -> Column:
    """Edits at which the similarity still reaches ``least``."""
    return F.floor(F.lit(1.0 - least + HALF_STEP) * F.greatest(a, b)).cast("int")


def _lengths_fit(q_len: Column, e_len: Column) -> Column:
    """Only forms whose lengths are near count as variants of each other."""
    return F.abs(q_len - e_len) <= F.greatest(F.lit(4), F.floor(e_len / F.lit(2)))


def _segment_start(i: Column, length: Column, edits: Column) -> Column:
    """Where segment ``i`` of ``edits + 1`` begins."""
    return F.floor(i * length / (edits + 1)).cast("int")


def _key(edits: Column, i: Column, text: Column) -> Column:
    return F.struct(edits.cast("int").alias("edits"), i.cast("int").alias("segment"), text.alias("part"))


def _anywhere() -> Column:
    """The key of pairs that no segment has to hold together."""
    return F.array(_key(F.lit(-1), F.lit(-1), F.lit("")))


def _by_segments(edits: Column, length: Column) -> Column:
    return (edits <= MOST_EDITS) & (edits < length)


def _segments(entries: DataFrame, least: float) -> DataFrame:
    """``(e_len, edits, segment, part, e_norm)``: the segments of every value, for each number of edits
    that phrases of a fitting length may have."""
    n = F.col("e_len")
    longest = F.least(n + F.greatest(F.lit(4), F.floor(n / F.lit(2))), F.floor(n / F.lit(least - HALF_STEP)))

    def cut(edits: Column) -> Column:
        return F.when(_by_segments(edits, n), F.transform(
            F.sequence(F.lit(0), edits),
            lambda i: _key(edits, i, F.substring(
                "tight", _segment_start(i, n, edits) + 1, _segment_start(i + 1, n, edits) - _segment_start(i, n, edits))),
        )).otherwise(_anywhere())

    numbers = F.sequence(_edits_allowed(least, n, n), _edits_allowed(least, longest, n))
    return (
        entries.select(F.col("norm").alias("e_norm"), "tight", F.length("tight").alias("e_len"))
        .filter("e_len > 0")
        .select("e_norm", "e_len", F.explode(F.array_distinct(F.flatten(F.transform(numbers, cut)))).alias("key"))
        .select("e_norm", "e_len", "key.*")
    )


def _substrings(phrases: DataFrame, lengths: DataFrame, least: float) -> DataFrame:
    """``(e_len, edits, segment, part, q_norm)``: for each length in the catalog, the substrings of a
    phrase that may be a surviving segment."""
    m, n = F.col("q_len"), F.col("e_len")
    fitting = F.sequence(F.ceil(m * F.lit(least - HALF_STEP)).cast("int"), F.floor(m / F.lit(least - HALF_STEP)).cast("int"))
    asked = (
        phrases.select(F.col("norm").alias("q_norm"), "tight", F.length("tight").alias("q_len"))
        .filter("q_len > 0")
        .select("*", F.explode(fitting).alias("e_len"))
        .filter((n > 0) & _lengths_fit(m, n))
        .join(lengths, "e_len", "left_semi")
        .withColumn("edits", _edits_allowed(least, m, n))
    )
    edits = F.col("edits")

    def near_segment(i: Column) -> Column:
        start = _segment_start(i, n, edits)
        size = _segment_start(i + 1, n, edits) - start
        first = F.greatest(F.lit(0), start - i, start + m - n - (edits - i))
        last = F.least(m - size, start + i, start + m - n + (edits - i))
        places = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda at: _key(edits, i, F.substring("tight", at + 1, size)))

    looked_up = F.when(
        _by_segments(edits, n), F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), edits), near_segment)))
    ).otherwise(_anywhere())
    return asked.select("q_norm", "e_len", F.explode(looked_up).alias("key")).select("q_norm", "e_len", "key.*")


def candidates(phrases: DataFrame, entries: DataFrame, least: float) -> DataFrame:
    """``(q_norm, e_norm, part, edits)``: pairs with the best part that is already known to reach
    ``least`` (0 for none), and whether they have to be compared letter by letter.

    Both frames hold distinct forms: ``norm``, ``tight``, ``tokens``.
    """
    none = F.lit(False).alias("edits")
    inside = _contained(phrases, entries).select(
        F.col("inner_norm").alias("q_norm"), F.col("outer_norm").alias("e_norm"),
        (F.lit(0.72) + F.lit(0.25) * _of_length("inner_tight", "outer_tight")).alias("part"), none,
    )
    around = _contained(entries, phrases).select(
        F.col("outer_norm").alias("q_norm"), F.col("inner_norm").alias("e_norm"),
        (F.lit(0.62) + F.lit(0.20) * _of_length("inner_tight", "outer_tight")).alias("part"), none,
    )
    words = _sharing_words(phrases, entries).select(
        "q_norm", "e_norm", (F.lit(0.55) + F.lit(0.4) * F.col("share")).alias("part"), none
    )
    equal = phrases.select(F.col("norm").alias("q_norm"), "norm").join(entries.select("norm"), "norm").select(
        "q_norm", F.col("norm").alias("e_norm"), F.lit(1.0).alias("part"), none
    )
    parts = reduce(DataFrame.unionByName, [equal, inside, around, words]).withColumn("part", F.round("part", 6))
    segments = _segments(entries, least)
    lengths = entries.select(F.length("tight").alias("e_len")).distinct()
    variants = _substrings(phrases, lengths, least).join(segments, ["e_len", "edits", "segment", "part"]).select(
        "q_norm", "e_norm", F.lit(0.0).alias("part"), F.lit(True).alias("edits")
    )
    return (
        parts.filter(F.col("part") >= least).unionByName(variants)
        .groupBy("q_norm", "e_norm")
        .agg(F.max("part").alias("part"), F.max("edits").alias("edits"))
    )


def _scored(phrases: DataFrame, entries: DataFrame, least: float) -> DataFrame:
    """``(q_norm, e_norm, score)`` of all pairs that reach ``least``."""
    q, e = tx.tight(F.col("q_norm")), tx.tight(F.col("e_norm"))
    q_len, e_len = F.length(q), F.length(e)
    near = F.when(
        F.col("edits") & _lengths_fit(q_len, e_len),
        F.round(F.lit(1.0) - F.levenshtein(q, e) / F.greatest(q_len, e_len), 6),
    )
    score = F.greatest(F.col("part"), F.coalesce(near, F.lit(0.0)))
    return candidates(phrases, entries, least).select("q_norm", "e_norm", score.alias("score")).filter(
        F.col("score") >= least
    )


def with_hits(
    asked: DataFrame,
    catalog: DataFrame,
    min_score: float = fixed.MATCH_MIN_SCORE,
    top_k: int = fixed.MATCH_TOP_K,
) -> DataFrame:
    """Add ``hits``, the ``top_k`` best matches of a phrase, and ``own``, the best one in
    ``asked_col`` if there is such a column.

    ``asked`` has ``phrase`` and perhaps ``asked_col``, and no row twice. Matches are ordered
    by score, count, column and value. The least score has to be above zero, because every pair
    reaches zero.
    """
    if min_score <= 0:
        raise ValueError(f"min_score={min_score!r}: matches need a score above zero")
    keys = asked.columns
    asked = cut_lineage(asked)
    values = cut_lineage(
        catalog.groupBy("col", "value").agg(F.max("cnt").alias("cnt")).withColumn("e_norm", tx.norm(F.col("value")))
    )
    near = _scored(cut_lineage(_forms(asked, "phrase")), cut_lineage(_forms(values, "value")), min_score)
    numbered = asked.withColumn("__asked", F.struct(*keys)).withColumn("q_norm", tx.norm(F.col("phrase")))
    order = [F.struct((-F.col("score")).alias("order"), (-F.col("cnt")).alias("order_cnt"), "col", "value").alias("hit")]
    is_own = F.col("col") == F.col("__asked.asked_col") if "asked_col" in keys else F.lit(False)
    found = cut_lineage(
        numbered.select("__asked", "q_norm").join(near, "q_norm").join(values, "e_norm").select("__asked", is_own.alias("own"), *order)
    )
    best = top_k_per_group(found, ["__asked"], [F.asc("hit")], top_k).groupBy("__asked").agg(
        F.sort_array(F.collect_list("hit")).alias("hits")
    )
    own = found.filter("own").groupBy("__asked").agg(F.min("hit").alias("own"))

    def shown(h: Column) -> Column:
        return F.struct(h["col"].alias("col"), h["value"].alias("value"), (-h["order_cnt"]).alias("cnt"), (-h["order"]).alias("score"))

    none = F.array().cast("array<struct<col:string,value:string,cnt:bigint,score:double>>")
    return (
        numbered.select("__asked").join(best, "__asked", "left").join(own, "__asked", "left").select(
            "__asked.*",
            F.coalesce(F.transform("hits", shown), none).alias("hits"),
            F.when(F.col("own").isNotNull(), shown(F.col("own"))).alias("own"),
        )
    )


def match_phrases(
    phrases: DataFrame,
    phrase: str,
    catalog: DataFrame,
    min_score: float = fixed.MATCH_MIN_SCORE,
    top_k: int = fixed.MATCH_TOP_K,
) -> DataFrame:
    """Best catalog values per distinct phrase: ``(phrase, rn, col, value, cnt, score)``."""
    asked = (
        phrases.select(F.col(phrase).alias("phrase"))
        .filter(tx.blank_to_null(F.col("phrase")).isNotNull())
        .distinct()
    )
    return (
        with_hits(asked, catalog, min_score, top_k)
        .select("phrase", F.posexplode("hits").alias("pos", "h"))
        .select("phrase", (F.col("pos") + 1).alias("rn"), "h.col", "h.value", "h.cnt", "h.score")
    )


def _asked(filters: DataFrame) -> DataFrame:
    return filters.select(F.col("col").alias("asked_col"), F.col("value").alias("phrase")).distinct()


def _first(hits: Column, condition=None) -> Column:
    return F.get(hits if condition is None else F.filter(hits, condition), F.lit(0))


def _with_best(filters: DataFrame, catalog: DataFrame, min_score: float) -> DataFrame:
    """Distinct filters with the best hit in their own column and the best of all."""
    found = with_hits(_asked(filters), catalog, min_score, top_k=1)
    return found.select("asked_col", "phrase", "own", _first(F.col("hits")).alias("best"))


def ground_filters(filters: DataFrame, catalog: DataFrame) -> DataFrame:
    """Correct ``(col, value)`` filters: move to another column when that match is better by
    more than 0.15, or is 0.85 and up while the own column is below 0.8."""
    found = _with_best(filters, catalog, fixed.MATCH_MIN_SCORE)
    own_score = F.coalesce(F.col("own.score"), F.lit(0.0))
    moves = (F.col("best.col") != F.col("asked_col")) & (
        (F.col("best.score") > own_score + 0.15)
        | ((own_score < 0.8) & (F.col("best.score") >= fixed.GROUND_STRONG))
    )
    action = (
        F.when(F.coalesce(moves, F.lit(False)), "moved")
        .when(F.col("own").isNotNull(), "fixed")
        .when(F.col("best").isNotNull(), "moved")
        .otherwise("unknown")
    )
    is_moved, is_fixed = F.col("action") == "moved", F.col("action") == "fixed"
    return found.withColumn("action", action).select(
        "asked_col",
        "phrase",
        "action",
        F.when(is_moved, F.col("best.col")).otherwise(F.col("asked_col")).alias("col"),
        F.when(is_moved, F.col("best.value"))
        .when(is_fixed, F.col("own.value"))
        .otherwise(F.col("phrase"))
        .alias("value"),
    )


def uncertain_filters(filters: DataFrame, catalog: DataFrame) -> DataFrame:
    """Filters whose best own-column match is good but not sure: score 0.85 to 0.96."""
    return (
        _with_best(filters, catalog, fixed.MATCH_MIN_SCORE)
        .filter(F.col("own.score").between(fixed.GROUND_STRONG, fixed.WARN_UPPER))
        .select("asked_col", "phrase", F.col("own.value").alias("value"), F.col("own.score").alias("score"))
    )


def diagnose_empty(filters: DataFrame, catalog: DataFrame) -> DataFrame:
    """Why filters gave no rows: the value sits in another column, is valid where it is, or
    is no category value at all. LIKE wild cards around a value are ignored.

    The search elsewhere looks at the three best hits only, own column included.
    """
    bare = filters.select(
        "col", F.regexp_replace(F.trim("value"), r"^[%\s]+|[%\s]+$", "").alias("value")
    ).filter(F.col("value") != "")

    def is_own(h: Column) -> Column:
        return h["col"] == F.col("asked_col")

    found = with_hits(_asked(bare), catalog, fixed.DIAGNOSE_ELSEWHERE, top_k=3).select(
        "asked_col",
        "phrase",
        F.coalesce(F.col("own.score") >= fixed.DIAGNOSE_OWN, F.lit(False)).alias("is_valid"),
        _first(F.col("hits"), lambda h: ~is_own(h)).alias("found"),
    )
    verdict = (
        F.when(F.col("is_valid"), "valid")
        .when(F.col("found").isNotNull(), "wrong column")
        .otherwise("not a category")
    )
    wrong = F.col("verdict") == "wrong column"
    return found.withColumn("verdict", verdict).select(
        "asked_col",
        "phrase",
        "verdict",
        F.when(wrong, F.col("found.col")).alias("found_col"),
        F.when(wrong, F.col("found.value")).alias("found_value"),
    )


def ground_texts(
    texts: DataFrame,
    key: str,
    text: str,
    catalog: DataFrame,
    abbreviations: dict[str, str] | None = None,
    word_pattern: str = fixed.WORD_PATTERN,
    max_hits: int = 10,
) -> DataFrame:
    """Confident catalog matches of the phrases in each request text, best first.

    Of the three best matches of a phrase, a code needs only the minimum score but must
    begin the value; any other phrase needs 0.85.
    """
    request = tx.expand_abbreviations(F.col(text), abbreviations or {})
    phrases = tx.one_per_row(texts, tx.request_phrases(request, word_pattern), "phrase", [key])
    code = tx.is_code(F.col("phrase"))
    near = with_hits(phrases.select("phrase").distinct(), catalog, top_k=3).select(
        "phrase",
        F.filter("hits", lambda h: code | (h["score"] >= fixed.GROUND_STRONG)).alias("near"),
    )
    sure = F.filter(
        "near", lambda h: ~code | F.startswith(F.lower(h["value"]), F.lower(F.col("phrase")))
    )
    per_text = (
        phrases.join(near.select("phrase", sure.alias("sure")), "phrase")
        .transform(tx.one_per_row, F.col("sure"), "h", [key, "phrase"])
        .select(key, "phrase", "h.col", "h.value", "h.cnt", F.round("h.score", 3).alias("score"))
    )
    order = [F.desc("score"), F.desc("cnt"), F.asc("col"), F.asc("value"), F.asc("phrase")]
    return top_k_per_group(per_text, [key], order, max_hits)
