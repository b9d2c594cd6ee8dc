"""Toxicity scores by a convolutional text classifier in numpy.

A word has two hashed embeddings; filters of several widths run over the words, each keeps its largest
response in the whole text, and a logistic layer joins them. Embeddings start from smoothed log odds of
their buckets, filters and output are trained by Adam on the places that won the maximum. Every labelled
training row counts: three quarters teach (log odds are counted by Spark; all parts of about ``PART_ROWS``
texts are trained from the same network for ``EPOCHS`` passes and their changes are averaged), the other
quarter sets one threshold per language. Texts move once, as the numbers of their words: a broadcast field
of bits of fixed size leaves out most texts without a label, labels meet the rest in its part. The language used for that is read off the text's common
words, never from a column. Scores are shifted so that a threshold is at 0.5.

Defined results: null and empty texts are scored as a text without words; ids with several labels count
as toxic if one says so, null labels say nothing; with labels of one kind only, every score is that
kind's share; repeated rows are scored one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import copy
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, WordTable, chunks, stored
from .quality import COMMON_WORDS

#: Texts that are trained together, hash buckets, numbers per embedding, filters per width.
PART_ROWS, BUCKETS, SIZE, FILTERS = 2000, 1 << 17, 8, 8
WIDTHS = (1, 2, 3)
EPOCHS, BATCH, RATE = 3, 32, 0.001
#: Bits that tell most unlabelled texts before they move; labels set one each.
BITS = 1 << 26
#: Changes are added as whole numbers of this size, so their order does not matter; logits are counted in steps.
GRAIN, STEP = 2.0**-36, 1 / 256
#: Training texts that a bucket must stand in before its embedding is learned.
EVIDENCE = 4
#: Standard errors taken off the log odds, and what an error on a clean text weighs in a threshold.
CAUTION, CLEAN_WEIGHT = 1.5, 3.0
LANGUAGES = [*COMMON_WORDS, "other"]
_STRIPPED = b".,;:!?\"'()[]"


def _numbers(word: bytes) -> int:
    """Both buckets of a word and, from bit 48 on, the languages that it is a common word of."""
    word = word.translate(LOWER).strip(_STRIPPED)
    h = xxhash.xxh3_64_intdigest(word)
    text = word.decode(errors="replace")
    common = sum(1 << (48 + k) for k, lang in enumerate(COMMON_WORDS) if text in COMMON_WORDS[lang])
    return (h % BUCKETS) | ((h >> 32) % BUCKETS) << 24 | common


class Texts:
    """Bucket pairs and language of texts."""

    def __init__(self):
        self.table = WordTable(_numbers)

    def of(self, texts: list) -> tuple[list[np.ndarray], np.ndarray]:
        coded = [np.fromiter(map(self.table.__getitem__, w), np.int64, len(w)) for w in (t.split() if t else [] for t in texts)]
        languages = []
        for x in coded:
            hits = [int(((x >> (48 + k)) & 1).sum()) for k in range(len(COMMON_WORDS))]
            languages.append(int(np.argmax(hits)) if max(hits) else len(COMMON_WORDS))
        return [x & ((1 << 48) - 1) for x in coded], np.array(languages)


class Network:
    """Embeddings, filters and output, and how they are run and trained."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        #: Words without evidence stay at zero, however many of them a text has.
        self.embedding = np.zeros((2, BUCKETS, SIZE), np.float32)
        self.learned = np.zeros((2, BUCKETS), bool)
        self.filters = {w: rng.normal(0, 0.05, (w * 2 * SIZE, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.bias = {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}
        for w in WIDTHS:  # the first filter adds up the log odds of its words
            self.filters[w][:, 0] = 0
            self.filters[w][:: SIZE, 0] = 1
        self.output = rng.normal(0, 0.1, len(WIDTHS) * FILTERS).astype(np.float32)
        self.output[::FILTERS] = 0.5
        self.constant = np.float32(-1.0)
        self.shift = np.zeros(len(LANGUAGES))

    def start(self, present: np.ndarray, n: np.ndarray) -> None:
        """First numbers of the embeddings: log odds of a bucket's presence in toxic texts, smoothed.
        ``present`` counts texts by side, label and bucket, ``n`` by label."""
        for side in (0, 1):
            clean, toxic = present[side] + 0.5
            odds = np.log(toxic / (n[1] + 1)) - np.log(clean / (n[0] + 1))
            error = np.sqrt(1 / toxic + 1 / clean)
            odds = np.sign(odds) * np.maximum(np.abs(odds) - CAUTION * error, 0)
            self.learned[side] = present[side].sum(0) >= EVIDENCE
            self.embedding[side, :, 0] = np.where(self.learned[side], odds, 0).clip(-3, 3)

    def layers(self) -> np.ndarray:
        """Filters, biases, output and constant in a row, filled up to whole embeddings."""
        flat = np.concatenate([*[self.filters[w].ravel() for w in WIDTHS], *[self.bias[w] for w in WIDTHS], self.output, [self.constant]])
        return np.pad(flat, (0, -len(flat) % SIZE)).reshape(-1, SIZE).astype(np.float64)

    def change(self, key: np.ndarray, by: np.ndarray) -> None:
        """Add changes to embeddings (keys from 0) and rows of :meth:`layers` (keys below 0)."""
        side, bucket = np.divmod(key[key >= 0], BUCKETS)
        self.embedding[side, bucket] += by[key >= 0].astype(np.float32)
        rows = self.layers()
        rows[-1 - key[key < 0]] += by[key < 0]
        flat = rows.ravel()
        for group in (self.filters, self.bias):
            for w in WIDTHS:
                n = group[w].size
                group[w], flat = flat[:n].reshape(group[w].shape).astype(np.float32), flat[n:]
        self.output, self.constant = flat[: len(self.output)].astype(np.float32), np.float32(flat[len(self.output)])

    def rows(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Embeddings of all words, each text followed by empty words, and where the texts begin."""
        pad = max(WIDTHS)
        lengths = np.array([len(x) + pad for x in texts])
        begin = np.cumsum(lengths) - lengths
        out = np.zeros((lengths.sum(), 2 * SIZE), np.float32)
        at = np.arange(lengths.sum()) - np.repeat(begin, lengths) < np.repeat(lengths - pad, lengths)
        flat = np.concatenate(texts) if texts else np.empty(0, np.int64)
        out[at, :SIZE] = self.embedding[0][flat & 0xFFFFFF]
        out[at, SIZE:] = self.embedding[1][flat >> 24]
        return out, begin

    def pooled(self, texts: list[np.ndarray], places: bool = False):
        """Largest response of every filter in each text, and where it is."""
        rows, begin = self.rows(texts)
        ends = np.concatenate([begin[1:], [len(rows)]])
        best, where = [], []
        for w in WIDTHS:
            n = len(rows) - w + 1
            response = sum(rows[k : k + n] @ self.filters[w][k * 2 * SIZE : (k + 1) * 2 * SIZE] for k in range(w))
            response = np.concatenate([response, np.full((w - 1, FILTERS), -np.inf, np.float32)])
            # Windows that reach into the next text are left out.
            for k in range(1, w):
                response[ends - k] = -np.inf
            top = np.maximum.reduceat(response, begin, axis=0)
            best.append(np.maximum(top + self.bias[w], 0))
            if places:
                where.append(np.array([begin[i] + np.argmax(response[begin[i] : ends[i]], axis=0) for i in range(len(texts))]))
        return np.concatenate(best, 1), where, rows, begin

    def logits(self, texts: list[np.ndarray]) -> np.ndarray:
        return self.pooled(texts)[0] @ self.output + self.constant

    def train(self, texts: list[np.ndarray], label: np.ndarray, seed: int = 11) -> None:
        """One pass of Adam over the texts."""
        rng = np.random.default_rng(seed)
        moments: dict = {}
        step = 0

        def adam(name, value, gradient):
            m, v = moments.setdefault(name, (np.zeros_like(value), np.zeros_like(value)))
            m += 0.1 * (gradient - m)
            v += 0.001 * (gradient**2 - v)
            value -= (RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)).astype(value.dtype)

        constant = np.array([self.constant])
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            own = order[at : at + BATCH]
            step += 1
            x = [texts[k] for k in own]
            pooled, where, rows, begin = self.pooled(x, places=True)
            error = (1 / (1 + np.exp(-(pooled @ self.output + constant[0]))) - label[own]) / len(own)
            back = error[:, None] * self.output * (pooled > 0)
            lengths = np.array([len(t) for t in x])
            changes = []
            for j, w in enumerate(WIDTHS):
                part = back[:, j * FILTERS : (j + 1) * FILTERS]
                windows = np.concatenate([rows[where[j] + k] for k in range(w)], axis=2)  # text x filter x numbers
                adam(("bias", w), self.bias[w], part.sum(0))
                gradient = np.einsum("tf,tfn->nf", part, windows)
                for k in range(w):
                    place = where[j] + k - begin[:, None]
                    inside = (place < lengths[:, None]) & (part != 0)
                    t, f = np.nonzero(inside)
                    part_change = part[t, f][:, None] * self.filters[w][k * 2 * SIZE : (k + 1) * 2 * SIZE, f].T
                    changes.append((np.array([x[i][place[i, g]] for i, g in zip(t, f, strict=True)], np.int64), part_change))
                adam(("filter", w), self.filters[w], gradient.astype(np.float32) + 1e-4 * self.filters[w])
            adam("output", self.output, pooled.T @ error + 1e-4 * self.output)
            adam("constant", constant, np.array([error.sum()]))
            for code, by in changes:
                for side, bucket in enumerate((code & 0xFFFFFF, code >> 24)):
                    known = self.learned[side, bucket]
                    np.subtract.at(self.embedding[side], bucket[known], (RATE * by[known, side * SIZE : (side + 1) * SIZE]).astype(np.float32))
        self.constant = constant[0]

    def calibrate(self, language: np.ndarray, step: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> None:
        """The logit per language that parts the labels best, from counts of texts per language and step of
        the logit; few texts of a language: that of all."""

        def best(own: np.ndarray) -> float:
            steps, at = np.unique(step[own], return_inverse=True)
            y, n = np.bincount(at, toxic[own]), np.bincount(at, clean[own])
            # Errors when everything from place k on is called toxic; in the middle of the best stretch.
            missed, passed = np.concatenate([[0], np.cumsum(y)]), np.concatenate([[0], np.cumsum(n)])
            wrong = missed + CLEAN_WEIGHT * (passed[-1] - passed)
            edges = STEP * np.concatenate([[steps[0] - 1], (steps[1:] + steps[:-1] + 1) / 2, [steps[-1] + 2]])
            return float(np.median(edges[wrong == wrong.min()]))

        everything = best(np.ones(len(step), bool))
        for k in range(len(LANGUAGES)):
            own = language == k
            self.shift[k] = best(own) if min(toxic[own].sum(), clean[own].sum()) >= 20 else everything

    def scores(self, texts: list[np.ndarray], language: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(texts) - self.shift[language], -30, 30)))


def _place() -> Column:
    """The bit of an id among ``BITS``."""
    return F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(BITS))


def coded(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """doc_id, words (packed) and language of the texts whose bit a label has set: all labelled ones, and few others."""
    place = marked.select(_place().alias("place"))
    bit = F.expr("shiftleft(1L, CAST(place & 63 AS INT))")
    found = place.groupBy(F.shiftright("place", 6).alias("at")).agg(F.bit_or(bit).alias("bits")).toPandas()
    bits = np.zeros(BITS // 64, np.int64)
    bits[found["at"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    noted = docs.sparkSession.sparkContext.broadcast(bits)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Texts()
        for batch in batches:
            place = batch.column("place").to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array(noted.value[place >> 6] >> (place & 63) & 1 == 1))
            for part, texts in chunks(batch):
                words, languages = coder.of(texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([zlib.compress(x.tobytes(), 1) for x in words], pa.binary()), pa.array(languages, pa.int64())],
                    ["doc_id", "words", "language"])

    own = docs.filter("doc_id IS NOT NULL").select("doc_id", "text", _place().alias("place"))
    return own.mapInArrow(code, "doc_id bigint, words binary, language bigint")


#: A text of a part.
TEXT = pa.struct([("doc_id", pa.int64()), ("toxic", pa.int32()), ("words", pa.binary()), ("language", pa.int64())])


def _back(doc_id: Column) -> Column:
    """Whether a row is held back for the thresholds."""
    return F.pmod(F.xxhash64(doc_id), F.lit(4)) == 3


def gathered(docs: DataFrame, labels: DataFrame, training: Column) -> tuple[DataFrame, np.ndarray]:
    """Every labelled training row in a row per part of about ``PART_ROWS`` that teach, and the number of rows by
    whether they are held back and label. Ids are counted first, so words move once, straight to their part."""
    marked = labels.filter(training & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marked = stored(marked.filter(F.col("toxic").isin(0, 1)).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")))
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    counts = np.zeros((2, 2), np.int64)
    for r in docs.select("doc_id").join(marked, "doc_id").groupBy(_back(F.col("doc_id")).alias("back"), "toxic").count().collect():
        counts[int(r["back"]), r["toxic"]] = r["count"]
    parts = max(1, -(-int((counts[0] if counts.all() else counts).sum()) // PART_ROWS))
    part = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(parts)).alias("part")

    def gather(texts: pa.Table, marks: pa.Table) -> pa.Table:
        toxic = dict(zip(marks.column("doc_id").to_pylist(), marks.column("toxic").to_pylist(), strict=True))
        # Texts without a label have come along by chance.
        own = [{**x, "toxic": toxic[x["doc_id"]]} for x in texts.sort_by([("doc_id", "ascending"), ("words", "ascending")]).to_pylist() if x["doc_id"] in toxic]
        return pa.table({"texts": pa.array([own] if own else [], pa.list_(TEXT))})

    return stored(
        coded(docs, marked).select(part, "doc_id", "words", "language").groupBy("part")
        .cogroup(marked.select(part, "doc_id", "toxic").groupBy("part"))
        .applyInArrow(gather, "texts array<struct<doc_id:bigint,toxic:int,words:binary,language:bigint>>")), counts


def taught(docs: DataFrame, labels: DataFrame, training: Column) -> DataFrame:
    """Every labelled training row: doc_id, toxic, its words (packed), language, and whether it is held back."""
    return gathered(docs, labels, training)[0].select(F.explode("texts").alias("t")).select("t.*").withColumn("back", _back(F.col("doc_id")))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """Words, labels and languages of each part that has texts."""
    for batch in batches:
        column = batch.column("texts")
        for k in range(len(column)):
            texts = column[k].values
            if len(texts):
                words = [np.frombuffer(zlib.decompress(w), np.int64) for w in texts.field("words").to_pylist()]
                yield words, *(np.array(texts.field(c).to_pylist(), np.int64) for c in ("toxic", "language"))


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of a task by side, label and bucket, as ``(key, n)``."""
    present = np.zeros((2, 2, BUCKETS), np.int64)
    for words, toxic, _ in _parts(batches):
        for x, y in zip(words, toxic.tolist(), strict=True):
            for side in (0, 1):
                present[side, y, np.unique((x >> (24 * side)) & 0xFFFFFF)] += 1
    key = np.flatnonzero(present)
    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(present.ravel()[key])], ["key", "n"])


def train_parts(parts: DataFrame, network: Network, n: int) -> None:
    """Train every part from ``network`` and add the mean of their changes to it."""
    broadcast = parts.sparkSession.sparkContext.broadcast(network)
    columns = [f"d{k}" for k in range(SIZE)]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, toxic, _ in _parts(batches):
            before, after = broadcast.value, copy.deepcopy(broadcast.value)
            for k in range(EPOCHS):
                after.train(words, toxic.astype(np.float64), k)
            key = np.flatnonzero((after.embedding != before.embedding).any(2))
            by = (after.embedding - before.embedding).reshape(-1, SIZE)[key].astype(np.float64)
            layers = after.layers() - before.layers()
            key, by = np.r_[key, -1 - np.arange(len(layers))], np.concatenate([by, layers])
            whole = np.rint(by * (len(words) / n) / GRAIN).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), *[pa.array(whole[:, k].copy()) for k in range(SIZE)]], ["key", *columns])

    changes = parts.mapInArrow(each, f"key bigint, {', '.join(f'{c} bigint' for c in columns)}")
    rows = changes.groupBy("key").agg(*[F.sum(c).alias(c) for c in columns]).toPandas()
    broadcast.unpersist()
    network.change(rows["key"].to_numpy(), rows[columns].to_numpy() * GRAIN)


def fitted(docs: DataFrame, labels: DataFrame, training: Column) -> Network | float:
    """The trained network; the share of toxic labels where there is one kind only."""
    parts, counts = gathered(docs, labels, training)
    if not counts.sum(0).all():
        return float(counts[:, 1].sum() / counts.sum()) if counts.sum() else 0.0
    own = held = parts
    n = counts.sum(0)
    if counts.all():
        own = parts.select(F.filter("texts", lambda t: ~_back(t["doc_id"])).alias("texts"))
        held, n = parts.select(F.filter("texts", lambda t: _back(t["doc_id"])).alias("texts")), counts[0]
    present = np.zeros(4 * BUCKETS)
    found = own.mapInArrow(_presence, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).toPandas()
    present[found["key"]] = found["n"]
    network = Network()
    network.start(present.reshape(2, 2, BUCKETS), n)
    train_parts(own, network, int(n.sum()))
    broadcast = parts.sparkSession.sparkContext.broadcast(network)

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, toxic, language in _parts(batches):
            for at in range(0, len(words), 256):
                logit = np.clip(broadcast.value.logits(words[at : at + 256]), -40, 40)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(language[at : at + 256]), pa.array(np.floor(logit / STEP).astype(np.int64)), pa.array(toxic[at : at + 256])],
                    ["language", "step", "toxic"])

    by_step = held.mapInArrow(steps, "language bigint, step bigint, toxic bigint")
    c = by_step.groupBy("language", "step").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean")).toPandas()
    network.calibrate(*(c[name].to_numpy() for name in ("language", "step", "toxic", "clean")))
    return network


def scored(docs: DataFrame, network: Network | float) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id and score."""
    broadcast = docs.sparkSession.sparkContext.broadcast(network)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Texts()
        for batch in batches:
            for part, texts in chunks(batch, limit=1 << 19):
                if isinstance(broadcast.value, float):
                    out = np.full(len(texts), broadcast.value)
                else:
                    out = broadcast.value.scores(*coder.of(texts))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out.astype(np.float64))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(score, "doc_id bigint, score double")
