"""Quality rules by distribution divergence, in DataFrame functions only.

A document's histogram of character classes and its histogram of common words are compared with
references of its language by Jensen-Shannon distance. The references are sums over all documents of
that language which pass the base rules, so they follow the corpus at every size; they are a few
numbers per language of ``COMMON_WORDS`` and go into the plan as literals. A histogram of a short
text is left unjudged, and a distance is allowed for the noise that a sample of that size has.

Defined results: null text has no words, and so fails the base rules; a language without a reference
(or null) is judged by the base rules alone; repeated rows are judged one by one; further columns
pass through, whatever their names (the working columns are in one struct, ``MEASURES``).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

# Frequent function words of each language, lower case.
COMMON_WORDS = {
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "ist"],
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une"],
    "it": ["di", "e", "il", "la", "che", "in", "a", "per", "un", "del"],
    "nl": ["de", "van", "het", "een", "en", "in", "is", "dat", "op", "te"],
    "pt": ["de", "a", "o", "que", "e", "do", "da", "em", "um", "para"],
}
# The symbols of the base rules, and the marks of ordinary prose.
SYMBOLS = "#*$%&|<>"
MARKS = ".,;:?'\"()-"
SHOUTS = "!"
DIGITS = "0123456789"
CLASSES = ["lower", "upper", "digit", "mark", "shout", "symbol", "other"]
BLANKS = " \t\n\x0b\x0c\r"

MEASURES = "__quality__"


@dataclass(frozen=True)
class Limits:
    """Largest distances, and the least text that a histogram is judged on."""

    class_distance: float = 0.2
    word_distance: float = 0.2
    least_chars: int = 200
    least_words: int = 100
    #: Share of the largest distance that sampling alone would give, allowed on top.
    noise: float = 0.5


def _without(text: Column, chars: str) -> Column:
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), chars, text)


def _n(x: Column) -> Column:
    return x.cast("bigint")


def _equals(value: str):
    return lambda x: x == value


def words_of(text: Column) -> Column:
    """Words between blanks; a split at one plain character needs no regular expression."""
    spaced = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(" ")), BLANKS[1:], F.coalesce(text, F.lit("")))
    return F.array_remove(F.split(spaced, " "), "")


def _repeated(grams: Column) -> Column:
    """Sorted starts of the windows whose hash stands more than once in ``grams`` (sorted structs)."""
    return F.sort_array(F.array_compact(F.transform(grams, lambda x, k: F.when(
        (F.get(grams, k - 1)["h"] == x["h"]) | (F.get(grams, k + 1)["h"] == x["h"]), x["i"]))))


def _covered(starts: Column, width: int) -> Column:
    """Words that windows with these sorted starts cover."""
    return F.aggregate(
        F.transform(starts, lambda x, k: F.least(F.lit(width), F.coalesce(F.get(starts, k + 1) - x, F.lit(width)))),
        F.lit(0).cast("bigint"), lambda a, x: a + x)


def measured(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` with the struct ``MEASURES``: base counts, class counts and common-word counts."""
    w, hashes, grams, starts, joined = (
        F.col(f"{MEASURES}{k}") for k in ("words", "hashes", "grams", "starts", "joined"))
    docs = docs.withColumn(f"{MEASURES}words", words_of(F.col(text)))
    docs = docs.withColumns({
        f"{MEASURES}joined": F.array_join(w, ""),
        f"{MEASURES}hashes": F.slice(
            F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))),
            1, F.greatest(F.size(w) - 2, F.lit(0))),
        f"{MEASURES}lines": F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"),
                                     lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0),
        f"{MEASURES}common": reduce(
            lambda rest, code: F.when(F.col(lang) == code, F.filter(w, lambda x: x.isin(COMMON_WORDS[code]))).otherwise(rest),
            COMMON_WORDS, F.array().cast("array<string>")),
    })
    # Most texts repeat no window: only the others pay for sorting windows with their places.
    docs = docs.withColumn(f"{MEASURES}grams", F.when(
        F.size(F.array_distinct(hashes)) < F.size(hashes),
        F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    docs = docs.withColumn(f"{MEASURES}starts", _repeated(grams))
    common = F.col(f"{MEASURES}common")
    chars = F.length(joined)
    counts = {
        "upper": F.length(F.regexp_replace(joined, "\\P{Lu}+", "")),
        "lower": F.length(F.regexp_replace(joined, "\\P{Ll}+", "")),
        "digit": chars - F.length(_without(joined, DIGITS)),
        "mark": chars - F.length(_without(joined, MARKS)),
        "shout": chars - F.length(_without(joined, SHOUTS)),
        "symbol": chars - F.length(_without(joined, SYMBOLS)),
    }
    lines = F.col(f"{MEASURES}lines")
    k_words = max(map(len, COMMON_WORDS.values()))
    occurring = reduce(
        lambda rest, code: F.when(F.col(lang) == code, F.array(*(
            _n(F.size(F.filter(common, _equals(word)))) for word in COMMON_WORDS[code]
        ))).otherwise(rest),
        COMMON_WORDS, F.array_repeat(F.lit(0).cast("bigint"), k_words))
    docs = docs.withColumn(MEASURES, F.struct(
        _n(F.size(w)).alias("n_words"),
        _n(chars).alias("word_chars"),
        *(_n(v).alias(k) for k, v in counts.items()),
        _n(F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
        F.coalesce(_covered(starts, 3), F.lit(0).cast("bigint")).alias("n_repeat_words"),
        _n(F.size(common)).alias("n_common"),
        occurring.alias("common"),
    ))
    return docs.drop(*(f"{MEASURES}{k}" for k in ("words", "hashes", "grams", "starts", "joined", "lines", "common")))


def _m(name: str) -> Column:
    return F.col(f"{MEASURES}.{name}")


def base_failed() -> Column:
    return (_m("n_words") < 50) | (100 * _m("n_repeat_words") > 50 * _m("n_words"))


def class_counts() -> list[Column]:
    named = [_m(k) for k in CLASSES[:-1]]
    return [*named, F.greatest(_m("word_chars") - sum(named[1:], named[0]), F.lit(0))]


def word_counts() -> list[Column]:
    """The common words' counts and, last, that of all other words."""
    k = max(map(len, COMMON_WORDS.values()))
    return [*(F.get(_m("common"), F.lit(i)) for i in range(k)), _m("n_words") - _m("n_common")]


def _sums(rows: DataFrame, lang: str) -> dict[str, tuple[list[float], list[float]]]:
    sums = (
        rows.filter(~base_failed() & F.col(lang).isin(list(COMMON_WORDS)))
        .groupBy(F.col(lang).alias("lang"))
        .agg(F.array(*map(F.sum, class_counts())).alias("classes"), F.array(*map(F.sum, word_counts())).alias("words"))
        .collect()
    )
    share = lambda counts: [c / max(1, sum(counts)) for c in counts]
    return {r.lang: (share(r.classes), share(r.words)) for r in sums}


def language_references(
    measures: DataFrame, lang: str = "lang", trim: Limits = Limits(class_distance=0.25, word_distance=0.25)
) -> dict[str, tuple[list[float], list[float]]]:
    """Class and common-word shares per language over all documents that pass the base rules.

    A second sum leaves out the documents that ``trim`` finds far from the first, so that junk does
    not shape what it is compared with. One row per language of the fixed list reaches the driver.
    """
    first = _sums(measures, lang)
    return _sums(judged(measures, first, trim, lang).filter(_m("kept")), lang) or first


def jensen_shannon(counts: Column, shares: Column) -> Column:
    """Distance (square root of the divergence in bits) of a histogram from reference shares."""

    def part(x: Column, other: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + other))).otherwise(0.0)

    total = F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, x: a + x).cast("double")
    terms = F.zip_with(F.transform(counts, lambda x: x / total), shares, lambda p, q: part(p, q) + part(q, p))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def judged(measures: DataFrame, references: dict, limits: Limits = Limits(), lang: str = "lang") -> DataFrame:
    """``measures`` with ``class_distance``, ``word_distance`` (null: unjudged) and ``kept`` in the struct."""

    def shares(which: int) -> Column:
        return reduce(
            lambda rest, code: F.when(F.col(lang) == code, F.array(*map(F.lit, references[code][which]))).otherwise(rest),
            references, F.lit(None).cast("array<double>"))

    def allowed(limit: float, bins: int, n: Column) -> Column:
        return F.lit(limit) + limits.noise * F.sqrt(F.lit(bins / 5.6) / n)

    classes, words = class_counts(), word_counts()
    known = F.col(lang).isin(list(references)) if references else F.lit(False)
    with_distances = measures.withColumn(
        f"{MEASURES}class",
        F.when(known & (_m("word_chars") >= limits.least_chars), jensen_shannon(F.array(*classes), shares(0))),
    ).withColumn(
        f"{MEASURES}word", F.when(known & (_m("n_words") >= limits.least_words), jensen_shannon(F.array(*words), shares(1))))
    far = (
        F.coalesce(F.col(f"{MEASURES}class") > allowed(limits.class_distance, len(classes), _m("word_chars")), F.lit(False))
        | F.coalesce(F.col(f"{MEASURES}word") > allowed(limits.word_distance, len(words), _m("n_words")), F.lit(False))
    )
    return with_distances.withColumn(
        MEASURES,
        F.col(MEASURES)
        .withField("n_symbols", _m("symbol"))
        .withField("class_distance", F.col(f"{MEASURES}class"))
        .withField("word_distance", F.col(f"{MEASURES}word"))
        .withField("base_failed", base_failed())
        .withField("kept", ~base_failed() & ~far),
    ).drop(f"{MEASURES}class", f"{MEASURES}word")


def passing(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The documents that the rules keep, columns unchanged."""
    # Written once: the measures serve the references and the verdict, and are worked out once.
    measures = stored(measured(docs))
    references = language_references(measures)
    return judged(measures, references, limits).filter(_m("kept")).select(*docs.columns)
