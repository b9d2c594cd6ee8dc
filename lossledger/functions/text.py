"""Text: normal forms, tokens, clean-up of repeated passages, phrase extraction."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import fixed_values as fixed


BLANKS = (
    " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    + "".join(chr(code) for code in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)
# The same characters; the regular expression engine tests a range at once and single ones in turn.
BLANK_RUN = "[ \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
# Everything but 0-9, a-z, а-я and ё, as ranges: several times quicker than the negated class.
NOT_TIGHT = "[\\x00-\\x2f\\x3a-\\x60\\x7b-\\u042f\\u0450\\u0452-\\x{10ffff}]+"


def trim_blank(c: Column) -> Column:
    """Strip every kind of white space at both ends."""
    return F.btrim(c, F.lit(BLANKS))


def blank_to_null(c: Column) -> Column:
    return F.nullif(trim_blank(c), F.lit(""))


def strip_rare_unicode(c: Column) -> Column:
    """Remove control characters and the upper Unicode range that reports cannot show."""
    return F.regexp_replace(c, fixed.RARE_UNICODE, "")


# --- ids -------------------------------------------------------------------


def canonical_id(c: Column) -> Column:
    """Trimmed id without a trailing ``.0``; exponent forms are written out in full."""
    value = trim_blank(c)
    exponent = F.when(
        value.rlike(r"^\d+(?:\.\d+)?[eE]\+\d+$"),
        value.try_cast("decimal(38,0)").cast("string"),
    )
    return F.coalesce(exponent, F.regexp_replace(value, r"^(\d+)\.0$", "$1"))


# --- normal forms ----------------------------------------------------------


def norm(c: Column) -> Column:
    """Lower case, single blanks."""
    return F.trim(F.regexp_replace(F.lower(c), BLANK_RUN, " "))


def tight(c: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(c), NOT_TIGHT, "")


def token_set(c: Column) -> Column:
    """Distinct blank-separated words of two characters or more."""
    return words_of_normal(norm(c))


def words_of_normal(normal: Column) -> Column:
    """The same of a text that is normal already."""
    return F.array_distinct(F.filter(F.split(normal, " "), lambda t: F.length(t) >= 2))


def tokens(c: Column) -> Column:
    """All words in order, lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"({fixed.TOKEN_PATTERN})"), F.lit(1))


def one_per_row(df: DataFrame, values: Column, name: str, keep: list[str]) -> DataFrame:
    """One row per array element, next to the kept columns.

    The outer form with a filter behind it: for the inner form Spark would add a filter on the
    array in front and compute the array a second time.
    """
    return df.select(*keep, F.explode_outer(values).alias(name)).filter(F.col(name).isNotNull())


# --- joining and cutting ---------------------------------------------------


def join_parts(*parts: Column) -> Column:
    """Blank-separated parts, empty parts left out."""
    return F.concat_ws(" ", *[F.when(blank_to_null(p).isNotNull(), p) for p in parts])


def numbered_parts(number: Column, labelled: list[tuple[str, Column]]) -> Column:
    """One line per non-empty part: ``label number: text``."""
    lines = [
        F.when(
            blank_to_null(part).isNotNull(),
            F.concat(F.lit(f"{label} "), number.cast("string"), F.lit(": "), part),
        )
        for label, part in labelled
    ]
    return F.concat_ws("\n", *lines)


def ellipsis(c: Column, size: int) -> Column:
    """Cut to ``size`` characters and mark the cut."""
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, size), F.lit("..."))).otherwise(c)


def logistic(c: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c))


# --- repeated passages -----------------------------------------------------


def _let(value: Column, use) -> Column:
    """Evaluate ``value`` once for an expression that mentions it several times."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _without_repeats(items: Column) -> Column:
    """Drop an element equal, after normalising, to the one before; blanks always stay."""

    def kept(keys: Column) -> Column:
        return F.filter(
            items,
            lambda _, i: (i == 0) | (F.get(keys, i) == "") | (F.get(keys, i) != F.get(keys, i - 1)),
        )

    return _let(F.transform(items, norm), kept)


def collapse_neighbours(df: DataFrame, text: str, out: str) -> DataFrame:
    """Collapse repeated neighbour lines, then repeated neighbour sentences in a line.

    Adds ``out`` and the number of collapsed passages ``out_removed``.
    """
    lines, kept, cleaned = "__lines", "__kept", "__cleaned"
    sentence_end = rf"(?<=[.!?]){BLANK_RUN}"

    def clean(line: Column) -> Column:
        def collapsed(sentences: Column) -> Column:
            return _let(
                _without_repeats(sentences),
                lambda rest: F.struct(
                    F.array_join(rest, " ").alias("line"),
                    (F.size(sentences) - F.size(rest)).alias("removed"),
                ),
            )

        untouched = F.struct(line.alias("line"), F.lit(0).alias("removed"))
        return F.when(trim_blank(line) == "", untouched).otherwise(
            _let(F.split(line, sentence_end, -1), collapsed)
        )

    # Each step is a column of its own that later steps mention more than once.
    staged = (
        df.withColumn(lines, F.split(F.col(text), "\n", -1))
        .withColumn(kept, _without_repeats(F.col(lines)))
        .withColumn(cleaned, F.transform(kept, clean))
    )
    removed_sentences = F.aggregate(
        F.col(f"{cleaned}.removed"), F.lit(0), lambda total, n: total + n
    )
    return staged.withColumns({
        out: F.array_join(F.col(f"{cleaned}.line"), "\n"),
        f"{out}_removed": F.size(lines) - F.size(kept) + removed_sentences,
    }).drop(lines, kept, cleaned)


LONGEST_CYCLE = 12


def collapse_cycles_in(text: str) -> str:
    """Keep one copy of every block of 1 to 12 lines that repeats back to back."""
    lines = text.split("\n")
    keys = [" ".join(line.split()).lower() for line in lines]
    out: list[str] = []
    at, end = 0, len(lines)
    while at < end:
        step = next(
            (
                size
                for size in range(1, min(LONGEST_CYCLE, (end - at) // 2) + 1)
                if keys[at] == keys[at + size]
                and keys[at : at + size] == keys[at + size : at + 2 * size]
                and any(keys[at : at + size])
            ),
            None,
        )
        out.extend(lines[at : at + (step or 1)])
        if step is None:
            at += 1
            continue
        block = keys[at : at + step]
        at += step
        while keys[at : at + step] == block:
            at += step
    return "\n".join(out)


@F.pandas_udf(StringType())
def collapse_cycles(texts: pd.Series) -> pd.Series:
    """Row-independent: each text is scanned on its own."""
    return texts.map(collapse_cycles_in, na_action="ignore")


def drop_repeated_sections(df: DataFrame, text: str, out: str) -> DataFrame:
    """Drop a headed section whose header has already been seen in the same text.

    A header line starts with ``#`` or with a number and a point.
    """
    # A new section starts at a line break that is followed by a header line.
    split_at = r"\n(?=(?U:[^\S\n]*)(?:#+(?U:[^\S\n]*[^\s])|\d+\.(?U:[^\S\n]*[^\s])))"

    def header_key(section: Column) -> Column:
        first_line = trim_blank(F.substring_index(section, "\n", 1))
        title = F.regexp_extract(first_line, r"^(?:#+(?U:\s*)|\d+\.(?U:\s*))(.+)$", 1)
        words = F.lower(trim_blank(F.regexp_replace(title, r"(?U)[^\w\s]", "")))
        return trim_blank(F.regexp_replace(words, r"(?U)^\d+\s*", ""))

    sections = "__sections"
    with_sections = df.withColumn(
        sections,
        F.transform(
            F.split(F.col(text), split_at, -1),
            lambda s: F.struct(s.alias("body"), header_key(s).alias("key")),
        ),
    )
    keys = F.col(f"{sections}.key")
    kept = F.filter(
        F.col(sections),
        lambda s, i: (s["key"] == "") | (F.array_position(keys, s["key"]) == i + 1),
    )
    return with_sections.withColumn(
        out, F.array_join(F.transform(kept, lambda s: s["body"]), "\n")
    ).drop(sections)


# --- phrases ---------------------------------------------------------------


def codes_in(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({fixed.CODE_PATTERN})"), F.lit(1))


def quoted_in(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(fixed.QUOTED_PATTERN), F.lit(1))


def _split_ending(word: Column, endings: tuple[str, ...]) -> tuple[Column, Column]:
    """(has an ending after a stem of 3 letters or more, the stem before the longest one)."""
    pattern = rf"(?iu)^(.{{3,}}?)(?:{'|'.join(endings)})$"
    return word.rlike(pattern), F.regexp_extract(word, pattern, 1)


def ending_variants(word: Column) -> Column:
    """The word, its adjective nominative, and the noun stem with usual endings."""

    def nominative(part: Column) -> Column:
        found, stem = _split_ending(part, fixed.ADJECTIVE_ENDINGS)
        soft = F.lower(stem).rlike(f"[{fixed.SOFT_STEM_LETTERS}]$")
        return F.when(
            found, F.concat(stem, F.when(soft, F.lit("ий")).otherwise(F.lit("ый")))
        ).otherwise(part)

    adjective = F.array_join(F.transform(F.split(word, "-", -1), nominative), "-")
    found, stem = _split_ending(word, fixed.NOUN_ENDINGS)
    nouns = F.when(
        found, F.array(*[F.concat(stem, F.lit(s)) for s in fixed.NOUN_SUFFIXES])
    ).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(word, adjective), nouns))


def request_phrases(text: Column, word_pattern: str = fixed.WORD_PATTERN) -> Column:
    """Candidate filter values in a request, distinct without regard to case."""
    words = F.regexp_extract_all(text, F.lit(f"({word_pattern})"), F.lit(1))
    pieces = F.concat(
        quoted_in(text),
        codes_in(text),
        F.split(text, "[,;]", -1),
        F.regexp_extract_all(text, F.lit(fixed.PREPOSITION_PATTERN), F.lit(1)),
        F.regexp_extract_all(text, F.lit(f"({fixed.CAPITALISED_PATTERN})"), F.lit(1)),
        F.flatten(F.transform(words, ending_variants)),
    )
    edges = r"""^[.,;:!?()"']+|[.,;:!?()"']+$"""
    cleaned = F.transform(pieces, lambda p: trim_blank(F.regexp_replace(p, edges, "")))
    stop = F.array(*[F.lit(w) for w in fixed.PHRASE_STOP_WORDS])
    return F.array_distinct(
        F.filter(
            F.transform(cleaned, F.lower),
            lambda p: (F.length(p) >= 2) & ~F.array_contains(stop, p),
        )
    )


def is_code(phrase: Column) -> Column:
    return trim_blank(phrase).rlike(f"(?i)^{fixed.CODE_PATTERN}$")


def expand_abbreviations(text: Column, names: dict[str, str]) -> Column:
    """Replace whole-word abbreviations, in any case, by their full names."""
    return reduce(
        lambda t, pair: F.regexp_replace(t, rf"(?iU)\b{pair[0]}\b", pair[1]), names.items(), text
    )
