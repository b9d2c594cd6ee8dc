"""Language identification by interpolated Kneser-Ney character models.

Per language, n-grams of characters within a word (its begin and end are characters too) give a model
of order ``ORDER`` with absolute discounts; lower orders count the different characters before. Each
order is kept as arrays sorted by n-gram hash. A text's cross-entropy per character under a language is
the sum over its words, so each different word is worked out once; the lowest is chosen, and rejected
where it is higher than nearly all training texts of that language have.

Trained on at most ``DOCS`` documents per language, those with the smallest id hash; which they are
does not depend on how the data is dealt out.

Defined results: null text, or text without a letter, is ``und`` with score 0; languages without
training text are never predicted, and with none at all every text is ``und``; ties go to the first
language in order; repeated rows are judged one by one; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import REMEMBERED_WORDS, U64, chunks, mixed

ORDER, DOCS = 5, 300
#: Characters that a never seen one is shared among.
ALPHABET = 5000
#: Characters that the certainty of a choice grows with, at most.
CERTAIN = 40
BEGIN, STOP = 1, 2


def _grams(words: list[str]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Word number of every character, hashes of the 1..ORDER-grams that end there, place in the word.

    The begin mark is at place 0; a k-gram exists from place k - 1 on (0-based), and is predicted from
    place 1 on.
    """
    lengths = np.array([len(w) + 2 for w in words])
    flat = np.frombuffer("".join(f"{chr(BEGIN)}{w}{chr(STOP)}" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64)
    word = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    one = mixed(flat + U64(0x51ED270B))
    hashes = [one]
    for _ in range(ORDER - 1):
        before = np.roll(hashes[-1], 1)
        hashes.append(mixed(before * U64(0x9E3779B97F4A7C15) + one))
    return word, hashes, place


class Model:
    """Sorted arrays of one language."""

    def __init__(self, words: list[str], counts: np.ndarray):
        word, hashes, place = _grams(words)
        weight = counts[word].astype(np.float64)
        self.grams, self.logs, self.contexts, self.backoffs = [], [], [], []
        lower = None
        for k in range(1, ORDER + 1):
            at = np.flatnonzero((place >= 1) & (place >= k - 1))
            gram, first, inverse = np.unique(hashes[k - 1][at], return_index=True, return_inverse=True)
            count = np.bincount(inverse, weight[at], len(gram))
            head = place[at][first] == k - 1  # begins with the begin mark: nothing can stand before it
            if k < ORDER:
                longer = np.flatnonzero((place >= 1) & (place >= k))
                _, once = np.unique(hashes[k][longer], return_index=True)
                before = np.bincount(np.searchsorted(gram, hashes[k - 1][longer[once]]), minlength=len(gram))
                count = np.where(head, count, before).astype(np.float64)
                count = np.maximum(count, 1)
            rare, twice = (count == 1).sum(), (count == 2).sum()
            discount = min(0.95, max(0.1, rare / max(1, rare + 2 * twice)))
            own = at[first]
            context = hashes[k - 2][own - 1] if k > 1 else np.zeros(len(own), U64)
            names, which = np.unique(context, return_inverse=True)
            total = np.bincount(which, count)
            left = discount * np.bincount(which) / total
            if k == 1:
                shorter = np.full(len(gram), 1 / ALPHABET)
            else:
                shorter = lower[1][np.searchsorted(lower[0], hashes[k - 2][own])]
            probability = np.maximum(count - discount, 0) / total[which] + left[which] * shorter
            lower = gram, probability
            self.grams.append(gram)
            self.logs.append(np.log(probability))
            self.contexts.append(names)
            self.backoffs.append(np.log(left))

    def costs(self, word: np.ndarray, hashes: list, place: np.ndarray, n: int) -> np.ndarray:
        """Negative log likelihood of each of ``n`` words."""
        at = np.flatnonzero(place >= 1)
        out, todo = np.zeros(len(place)), at
        for k in range(ORDER, 0, -1):
            here = todo[place[todo] >= k - 1]
            gram = self.grams[k - 1]
            row = np.minimum(np.searchsorted(gram, hashes[k - 1][here]), len(gram) - 1)
            hit = gram[row] == hashes[k - 1][here]
            out[here[hit]] += self.logs[k - 1][row[hit]]
            miss = here[~hit]
            names = self.contexts[k - 1]
            context = hashes[k - 2][miss - 1] if k > 1 else np.zeros(len(miss), U64)
            row = np.minimum(np.searchsorted(names, context), len(names) - 1)
            known = names[row] == context
            out[miss[known]] += self.backoffs[k - 1][row[known]]
            todo = np.sort(np.concatenate([miss, todo[place[todo] < k - 1]]))
        out[todo] += -np.log(ALPHABET)
        return -np.bincount(word, out, n)


class Models:
    """All languages, and the limits beyond which a text is rejected."""

    def __init__(self, words: pd.DataFrame, limits: dict | None = None):
        self.names = sorted(words["lang"].unique())
        self.models = []
        for name in self.names:
            own = words[words["lang"] == name].sort_values("word")
            self.models.append(Model(own["word"].tolist(), own["n"].to_numpy()))
        self.limits = limits or {}

    def costs(self, words: list[str]) -> np.ndarray:
        """Cost of each word under each language, and, last, its predicted characters."""
        word, hashes, place = _grams(words)
        columns = [m.costs(word, hashes, place, len(words)) for m in self.models]
        return np.stack([*columns, np.array([len(w) + 1 for w in words], np.float64)], 1)


class Costs:
    """Costs of texts; a row per different word is remembered, up to a bound."""

    def __init__(self, models: Models):
        self.models, self.row, self.table = models, {}, np.empty((0, len(models.names) + 1))

    def of(self, texts: list[list[str]]) -> np.ndarray:
        new = {w for words in texts for w in words}.difference(self.row)
        if new and len(self.row) + len(new) > REMEMBERED_WORDS:
            self.row, self.table = {}, self.table[:0]
            new = {w for words in texts for w in words}
        if new:
            fresh = sorted(new)
            self.row.update(zip(fresh, range(len(self.row), len(self.row) + len(fresh)), strict=True))
            self.table = np.concatenate([self.table, *(self.models.costs(fresh[k : k + 50_000]) for k in range(0, len(fresh), 50_000))])
        out = np.zeros((len(texts), self.table.shape[1]))
        for k, words in enumerate(texts):
            if words:
                out[k] = self.table[np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))].sum(0)
        return out


def _split(raw: bytes | None) -> list[str]:
    return raw.decode().lower().split() if raw else []


def _chosen(docs: DataFrame, training: Column) -> DataFrame:
    """The training documents in the sample: per language, those whose id hash is below a share."""
    mine = docs.filter(training & F.col("lang").isNotNull() & F.col("text").isNotNull())
    share = {r["lang"]: min(1.0, DOCS / r["count"]) for r in mine.groupBy("lang").count().collect()}
    if not share:
        return mine.limit(0)
    limits = F.create_map(*(F.lit(x) for lang, s in share.items() for x in (lang, int(s * (1 << 30)))))
    return mine.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < limits[F.col("lang")])


def trained(docs: DataFrame, training: Column) -> Models | None:
    """Models of every language with training text; bounded word counts reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for part, texts in chunks(batch):
                for lang, raw in zip(part.column("lang").to_pylist(), texts, strict=True):
                    seen.update((lang, w) for w in _split(raw))
        rows = [(*key, n) for key, n in seen.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "word", "n"])

    sample = _chosen(docs, training).select("lang", "text")
    words = sample.mapInArrow(count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")).toPandas()
    if not len(words):
        return None
    models = Models(words)
    broadcast = docs.sparkSession.sparkContext.broadcast(models)

    def entropy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs = Costs(broadcast.value)
        for batch in batches:
            for part, texts in chunks(batch):
                out = costs.of([_split(t) for t in texts])
                own = np.array([broadcast.value.names.index(x) for x in part.column("lang").to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [part.column("lang"), pa.array(out[np.arange(len(own)), own] / np.maximum(out[:, -1], 1))], ["lang", "h"])

    spread = sample.mapInArrow(entropy, "lang string, h double").groupBy("lang").agg(F.avg("h").alias("m"), F.stddev_pop("h").alias("s")).collect()
    models.limits = {r["lang"]: r["m"] + 4 * r["s"] for r in spread}
    return models


def identified(docs: DataFrame, models: Models | None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, lang_pred, score, cross_entropy, rejected."""
    broadcast = docs.sparkSession.sparkContext.broadcast(models)

    def identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = broadcast.value
        costs = Costs(models) if models else None
        for batch in batches:
            for part, texts in chunks(batch):
                lettered = np.array([bool(t) and any(map(str.isalpha, t.decode())) for t in texts], bool)
                n = len(texts)
                names, score, height, rejected = ["und"] * n, np.zeros(n), np.zeros(n), np.ones(n, bool)
                if models:
                    out = costs.of([_split(t) for t in texts])
                    length = np.maximum(out[:, -1:], 1)
                    h = out[:, :-1] / length
                    best = h.argmin(1)
                    certain = np.exp(-(h - h.min(1, keepdims=True)) * np.minimum(length, CERTAIN))
                    height = h[np.arange(n), best]
                    score = np.where(lettered, 1 / certain.sum(1), 0.0)
                    names = [models.names[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)]
                    rejected = ~lettered | (height > np.array([models.limits.get(models.names[b], np.inf) for b in best]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(names, pa.string()), pa.array(score), pa.array(height), pa.array(rejected)],
                    ["doc_id", "lang_pred", "score", "cross_entropy", "rejected"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        identify, "doc_id bigint, lang_pred string, score double, cross_entropy double, rejected boolean")
