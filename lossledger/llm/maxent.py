"""Language-model scores: a unigram base and a hashed maximum-entropy model.

A token's probability is that of its class times that of the word within its class; both are softmaxes
over features of the words before. Class features are the word before (w1), both words before (w2 w1)
and, skipping one, the second word before (w2); word features are w1 and w2 w1. Classes are ranges of
words by frequency. A feature has weights for what stood after it in training, over the unigram shares
as prior; of words never met after it the weight is zero, so a normaliser is the prior's plus sums over
met words, and no softmax walks over the vocabulary.

The n-gram features grow with the corpus and are never in one place. Every chunk of documents sends its
distinct (w1, w2, word) with counts, dealt by the hash of w1; a frequent w1 is one feature per bucket of
w2, as many buckets as keep each below an eighth of a part. So all features of a token but the skip are
in one part, which gradient steps train on all tokens of the part in runs of w1. The skip weights
(``ROWS`` hashed rows) are shared: every round each part trains its own features, sends its gradient
for the skip rows, and the driver takes a step with the sums. After the last round parts send the log
probability of each distinct (w1, w2, word) back to the chunks, which add them up per text.

Words of at least a count that leaves at most ``HEAD`` of them have a class and are broadcast by hash.
All others share the last class and are told apart by bits of their hash there, as many as there are
binary digits in the number of such words; words with equal bits have their smoothed relative frequency.
As features they have 31 bits. Probabilities sum to one over the training words and one unseen word per
set of bits. Base counts are exact. Other words of each document are joined with their counts, so no
frequent word is a join key and nothing that grows with the corpus is broadcast.

Defined results: null and empty texts have the end token alone; rows that repeat an id are scored one
by one; without training documents every token has probability one; an empty table gives an empty
result; further columns are not looked at.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, chunks, hashed, mixed, stored, word_hashes

#: Most words that are broadcast (by hash), classes of words, and rows of skip weights.
HEAD, CLASSES, ROWS = 200_000, 32, 2048
#: Tokens in a part, contexts that are trained at a time, bytes of text in a chunk.
PART, SLICE, CHUNK = 1 << 20, 1 << 12, 4 << 20
#: Rounds of the shared weights, steps of a part in a round, length of a step, its highest move, and the highest weight.
ROUNDS, STEPS, RATE, MOVE, HIGHEST = 2, 4, 0.6, 3.0, 9.0
#: Precision of the prior of weights: class by one word, class by two, class by skip, word by one, word by two.
RIDGES = (0.2, 0.4, 5.0, 0.05, 0.1)
#: Log probabilities are sent as whole numbers of this size, about the precision of the softmax.
GRAIN = 2.0**-16
#: The end token; no word holds a blank. The words before a text.
END, BEFORE = b" ", -1


def _words(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The different words of texts, END last; the number of each token's word, text by text; tokens per text."""
    trimmed = pc.ascii_trim_whitespace(pc.ascii_lower(texts.fill_null("")))
    split = pc.ascii_split_whitespace(trimmed)
    lengths = split.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    coded = split.flatten().dictionary_encode()
    empty = pc.binary_length(trimmed).to_numpy(zero_copy_only=False) == 0  # split into one empty word
    of = coded.indices.to_numpy(zero_copy_only=False)[~np.repeat(empty, lengths)]
    lengths = np.where(empty, 0, lengths)
    tokens = np.full(len(of) + len(lengths), len(coded.dictionary), np.int64)
    tokens[np.arange(len(of)) + np.repeat(np.arange(len(lengths)), lengths)] = of
    return [*coded.dictionary.cast(pa.binary()).to_pylist(), END], tokens, lengths + 1


def packed(x: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, compressed: the high bytes of small numbers cost nothing."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
    return len(x).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def unpacked(blob: bytes, kind) -> np.ndarray:
    n, size = int.from_bytes(blob[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(blob[8:], n * size, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).reshape(n)


def token_counts(docs: DataFrame, training: Column) -> DataFrame:
    """(word, n) over all training documents, the end token included."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flushed():
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            for part, _ in chunks(batch):
                words, tokens, _ = _words(part.column("text"))
                for word, n in zip(words, np.bincount(tokens, minlength=len(words)).tolist(), strict=True):
                    if n:
                        seen[word] += n
                if len(seen) > 500_000:
                    yield flushed()
        if seen:
            yield flushed()

    return docs.filter(training).select("text").mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """The broadcast words by hash: base, class and share in the class; totals of all words."""

    def __init__(self, number: np.ndarray, n: np.ndarray, total: int, different: int):
        order = np.lexsort((number, -n))
        number, n = number[order].astype(U64), n[order].astype(np.int64)
        self.total, self.different, self.size = total, different, len(n)
        #: Words in order of frequency; the row after them stands for all other words.
        self.n = np.append(n, total - n.sum())
        self.by_hash = np.argsort(number).astype(np.int32)
        self.number = number[self.by_hash]
        self.base = np.log10((n + 1) / (total + different + 1)) if len(n) else np.empty(0)
        root = np.sqrt(n)
        bin_ = ((CLASSES - 1) * (np.cumsum(root) - root) / max(root.sum(), 1)).astype(np.int64)
        _, of = np.unique(bin_, return_inverse=True)
        self.classes = (int(of[-1]) + 1 if len(of) else 0) + 1
        self.of = np.append(of, self.classes - 1).astype(np.int64)
        mass = np.bincount(self.of, self.n, self.classes)
        self.prior = np.log((mass + 1) / (mass.sum() + self.classes)).astype(np.float32)
        #: Bits that tell other words apart.
        self.digits = min(max(different - len(n) - 1, 0).bit_length(), 30)
        self.share = np.append(n / mass[self.of[:-1]], 0.5**self.digits)

    def ids(self, number: np.ndarray) -> np.ndarray:
        """Row of a broadcast word; above them 31 bits of the hash of another."""
        at = np.minimum(np.searchsorted(self.number, number), max(self.size - 1, 0))
        other = self.size + (number % U64((1 << 31) - self.size - 1)).astype(np.int64)
        if not self.size:
            return other.astype(np.int32)
        return np.where(self.number[at] == number, self.by_hash[at], other).astype(np.int32)

    def targets(self, ids: np.ndarray) -> np.ndarray:
        """What the model tells apart: broadcast words, and above them the bits of others."""
        return np.where(ids < self.size, ids, self.size + ((ids - self.size) & ((1 << self.digits) - 1))).astype(np.int32)

    def buckets(self, one: np.ndarray) -> np.ndarray:
        """Into how many buckets of the word before it the feature of a word is split."""
        inside = (one >= 0) & (one < self.size)
        buckets = 1 + np.where(inside, self.n[np.where(inside, one, 0)], 0) * 8 // PART
        return np.where(one == BEFORE, 1 + self.n.sum() * 8 // PART, buckets)

    def bucket(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Of a frequent word before, the bucket of the word before that: its feature is split by it."""
        return (mixed(two.astype(np.int64).view(U64)) % self.buckets(one).astype(U64)).astype(np.int64)


def vocabulary(counts: DataFrame) -> Vocabulary:
    """Totals, and the words whose count is high enough for at most ``HEAD`` to have it."""
    total, different = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    level = F.floor(F.log2("n") * 16).cast("int")  # a few hundred levels at most
    levels = sorted(((r["l"], r["count"]) for r in counts.groupBy(level.alias("l")).count().collect()), reverse=True)
    least, words = 10**6, 0
    for at, many in levels:
        if words + many > HEAD:
            break
        least, words = at, words + many

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = word_hashes()
        for batch in batches:
            own = hashed(batch.column("word").to_pylist(), hashes).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(own), batch.column("n")], ["number", "n"])

    head = counts.filter(level >= least).select("word", "n").mapInArrow(number, "number bigint, n bigint").toPandas()
    return Vocabulary(head["number"].to_numpy(np.int64).view(U64), head["n"].to_numpy(np.int64), total, different)


DOC = pa.struct([("key", pa.int64()), ("doc_id", pa.int64()), ("training", pa.bool_()), ("held_out", pa.bool_()),
                 ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64())])
TAIL = pa.struct([("key", pa.int64()), ("word", pa.binary()), ("leaf", pa.int64()), ("tf", pa.int64())])


def tokenized(docs: DataFrame, words) -> DataFrame:
    """A row per chunk of documents: ids of all tokens, and what else the scores need."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, hashes = words.value, word_hashes()
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part, texts in chunks(batch, limit=CHUNK):
                different, flat, lengths = _words(part.column("text"))
                number = vocab.ids(hashed(different, hashes))
                text, ids = np.repeat(np.arange(len(texts)), lengths), number[flat]
                inside, outside = np.flatnonzero(ids < vocab.size), np.flatnonzero(ids >= vocab.size)
                base = np.bincount(text[inside], vocab.base[ids[inside]], minlength=len(texts))
                tail, tf = np.unique(text[outside] * len(different) + flat[outside], return_counts=True)
                at, of = np.divmod(tail, len(different))
                rows = pa.StructArray.from_arrays(
                    [pa.array(key + np.arange(len(texts))), part.column("doc_id"), part.column("training"), part.column("held_out"), pa.array(lengths),
                     pa.array(np.bincount(text[inside], minlength=len(texts))), pa.array(base.astype(np.float64))], fields=list(DOC))
                others = pa.StructArray.from_arrays(
                    [pa.array(key + at), pa.array([different[k] for k in of.tolist()], pa.binary()), pa.array(vocab.targets(number[of]).astype(np.int64)),
                     pa.array(tf.astype(np.int64))], fields=list(TAIL))
                yield pa.RecordBatch.from_pydict({
                    "chunk": pa.array([key], pa.int64()), "n": pa.array([len(flat)], pa.int64()), "ids": pa.array([packed(ids)], pa.binary()),
                    "docs": pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows),
                    "tail": pa.ListArray.from_arrays(pa.array([0, len(others)], pa.int32()), others)})
                key += len(texts)

    return stored(docs.mapInArrow(take, (
        "chunk bigint, n bigint, ids binary, "
        "docs array<struct<key:bigint,doc_id:bigint,training:boolean,held_out:boolean,n_tokens:bigint,n_known:bigint,base:double>>, "
        "tail array<struct<key:bigint,word:binary,leaf:bigint,tf:bigint>>")))


class Events:
    """The distinct (w1, w2, word) of a chunk in order of part, w1, bucket, w2 and word, with training counts."""

    def __init__(self, vocab: Vocabulary, ids: np.ndarray, lengths: np.ndarray, training: np.ndarray, parts: int):
        at = np.arange(len(ids)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        # The chunk's words in order, so that three of them are one number.
        own, local = np.unique(ids, return_inverse=True)
        own, local = np.append(np.int32(BEFORE), own), local + 1
        one = np.where(at > 0, np.roll(local, 1), 0)
        two = np.where(at > 1, np.roll(local, 2), 0)
        targets, target = np.unique(vocab.targets(own[1:]), return_inverse=True)
        word = target[local - 1]
        # Features: words, frequent ones by bucket; in order of part, word and bucket.
        buckets = vocab.buckets(own)
        begin = np.cumsum(buckets) - buckets
        feature, many = begin[one], np.flatnonzero(buckets[one] > 1)
        feature[many] += (mixed(own.astype(np.int64).view(U64))[two[many]] % buckets[one[many]].astype(U64)).astype(np.int64)
        bucket = np.arange(buckets.sum()) - np.repeat(begin, buckets)
        dealt_to = (mixed(np.repeat(own, buckets).astype(np.int64).view(U64) * U64(0x9E3779B97F4A7C15) + bucket.view(U64)) % U64(parts)).astype(np.int64)
        rank = np.empty(len(dealt_to), np.int64)
        rank[np.argsort(dealt_to, kind="stable")] = np.arange(len(dealt_to))
        if len(rank) * len(own) * max(len(targets), 1) < 1 << 63:
            event = (rank[feature] * len(own) + two) * len(targets) + word
            order = np.argsort(event)
            first = _starts(event[order])
        else:  # a text of very many different words
            order = np.lexsort((word, two, rank[feature]))
            first = _starts(feature[order], two[order], word[order])
        of = np.empty(len(order), np.int64)
        #: By token, the row here.
        of[order] = np.cumsum(first) - 1
        self.of, first = of, order[first]
        self.part, self.one, self.two, self.word = dealt_to[feature[first]], own[one[first]], own[two[first]], targets[word[first]]
        self.n = np.bincount(of, np.repeat(training, lengths), minlength=len(first)).astype(np.int32)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One sortable number for two below 2^31, the first from -1."""
    return (a.astype(np.int64) << 31) + b


def _starts(*sorted_columns: np.ndarray) -> np.ndarray:
    """True where a row differs from the one before."""
    new = np.zeros(len(sorted_columns[0]), bool)
    new[:1] = True
    for x in sorted_columns:
        new[1:] |= x[1:] != x[:-1]
    return new


def _events(vocab: Vocabulary, row: dict, parts: int) -> Events:
    lengths = np.array([d["n_tokens"] for d in row["docs"]])
    training = np.array([bool(d["training"]) for d in row["docs"]], np.float64)
    return Events(vocab, unpacked(row["ids"], np.int32), lengths, training, parts)


def dealt(tokens: DataFrame, words, parts: int) -> DataFrame:
    """A row per part: its distinct events in order, counts over all chunks, and where each chunk's are."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = _events(words.value, row, parts)
                part, begin = np.unique(found.part, return_index=True)
                ends = list(zip(begin.tolist(), [*begin[1:].tolist(), len(found.part)], strict=True))
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array(part), "chunk": pa.array([row["chunk"]] * len(part), pa.int64()),
                    **{k: pa.array([packed(getattr(found, k)[a:b]) for a, b in ends], pa.binary()) for k in ("one", "two", "word", "n")}})

    def merge(table: pa.Table) -> pa.Table:
        one, two, word, n = ([unpacked(x, np.int32) for x in table.column(k).to_pylist()] for k in ("one", "two", "word", "n"))
        sizes = [len(x) for x in one]
        one, two, word, n = (np.concatenate(x) for x in (one, two, word, n))
        bucket = words.value.bucket(one, two)
        feature = _pair(one, bucket)
        order = np.lexsort((_pair(two, word), feature))
        feature, two, word = (x[order] for x in (feature, two, word))
        run = _starts(feature)
        pair = run | _starts(two)
        first = pair | _starts(word)
        of = np.empty(len(order), np.int64)
        of[order] = np.cumsum(first) - 1
        total = np.add.reduceat(n[order], np.flatnonzero(first), dtype=np.int64)
        row = np.where((two >= 0) & (two < ROWS // 2), two, ROWS // 2 + mixed(two.astype(np.int64).view(U64)) % U64(ROWS // 2))
        return pa.table({
            "part": table.column("part").slice(0, 1),
            "chunks": pa.array([table.column("chunk").to_pylist()], pa.list_(pa.int64())),
            "sizes": pa.array([sizes], pa.list_(pa.int64())),
            "at": pa.array([packed(np.diff(of, prepend=0).astype(np.int32))], pa.binary()),
            "begins": pa.array([packed((run[first].astype(np.uint8) + pair[first]).astype(np.uint8))], pa.binary()),
            "skip": pa.array([packed(row[pair].astype(np.uint16))], pa.binary()),
            "word": pa.array([packed(word[first])], pa.binary()), "n": pa.array([packed(total)], pa.binary())})

    sent = tokens.select("chunk", "ids", "docs").mapInArrow(send, "part bigint, chunk bigint, one binary, two binary, word binary, n binary")
    return stored(sent.groupBy("part").applyInArrow(merge, (
        "part bigint, chunks array<bigint>, sizes array<bigint>, at binary, begins binary, skip binary, word binary, n binary")))


class Table:
    """Logits and chances of the classes by the skip row alone."""

    def __init__(self, vocab: Vocabulary, shared: np.ndarray):
        self.logits = vocab.prior + shared
        self.chance = chances(self.logits.copy())


class Runs:
    """Whole runs of w1 out of a part: events, contexts (w2 w1) and features w1, numbered from 0."""

    def __init__(self, vocab: Vocabulary, begins: np.ndarray, skip: np.ndarray, word: np.ndarray, n: np.ndarray):
        self.vocab, self.skip, self.word, self.n, self.k = vocab, skip.astype(np.int64), word, n.astype(np.float64), vocab.classes
        self.pair = np.cumsum(begins > 0) - 1
        self.run_begin = np.flatnonzero(begins[begins > 0] == 2)
        self.run = np.cumsum(begins[begins > 0] == 2) - 1
        self.of = vocab.of[np.minimum(word, vocab.size)]
        self.counts = np.bincount(self.pair * self.k + self.of, self.n, len(self.skip) * self.k).reshape(-1, self.k).astype(np.float32)
        self.many = self.counts.sum(1, keepdims=True)

    def logits(self, table: Table, steps: int) -> np.ndarray:
        """Logarithms of the classes' weights in every context, after steps on the features w1 and w2 w1."""
        start = table.logits[self.skip]  # all weights are bounded, so no exponential overflows
        counts, summed = self.counts, np.add.reduceat(self.counts, self.run_begin)
        one, two, logits = np.zeros_like(summed), None, start
        for step in range(steps):
            expected = np.take(table.chance, self.skip, 0) if step == 0 else chances(logits)
            expected *= self.many
            one = stepped(one, summed, np.add.reduceat(expected, self.run_begin), RIDGES[0])
            two = stepped(two, counts, expected, RIDGES[1])
            logits = np.take(one, self.run, 0)
            logits += two
            logits += start
        return logits

    def classes(self, table: Table, steps: int) -> np.ndarray:
        """Log probability of each event's class."""
        logits = self.logits(table, steps)
        own = logits[self.pair, self.of].astype(np.float64)
        np.exp(logits, out=logits)
        return own - np.log(logits @ np.ones(self.k, np.float32))[self.pair]

    def expected(self, table: Table, steps: int) -> tuple[np.ndarray, np.ndarray]:
        """Skip rows, and how often they expect each class."""
        order = np.argsort(self.skip)
        begin = np.flatnonzero(_starts(self.skip[order]))
        p = chances(self.logits(table, steps))
        p *= self.many
        return self.skip[order[begin]], np.add.reduceat(p[order], begin)

    def words(self, steps: int) -> np.ndarray:
        """Log probability of each event's word within its class, after steps on the features w1 and w2 w1."""
        size, words = self.vocab.size, self.vocab.size + (1 << self.vocab.digits)
        # The words after w1, each once; classes are ranges of words, so those of a class stand together.
        met, met_of = np.unique(self.run[self.pair] * words + self.word, return_inverse=True)
        met_run, met_word = np.divmod(met, words)
        row = np.minimum(met_word, size)
        share, new = self.vocab.share[row], _starts(met_run, self.vocab.of[row])
        run_begin, run_class = np.flatnonzero(new), np.cumsum(new) - 1
        # Classes that were met in a context.
        new = _starts(self.pair, self.of)
        begin, cell = np.flatnonzero(new), np.cumsum(new) - 1
        of_run = run_class[met_of[begin]]
        cell_n, met_n = np.add.reduceat(self.n, begin), np.bincount(met_of, self.n, len(met))
        one, two = np.zeros(len(met)), np.zeros(len(self.n))
        for step in range(steps + 1):
            first = share * np.exp(one)
            own = first[met_of]
            further = own * np.expm1(two)
            norm = (1 + np.add.reduceat(first - share, run_begin))[of_run] + np.add.reduceat(further, begin)
            own += further
            if step < steps:
                per = cell_n / norm
                all_ = np.bincount(of_run, per, len(run_begin))
                per = per[cell]
                expected = first * all_[run_class] + np.bincount(met_of, further * per, len(met))
                # What was never met in training has no feature.
                one = np.where(met_n > 0, stepped(one, met_n, expected, RIDGES[3]), 0)
                two = np.where(self.n > 0, stepped(two, self.n, own * per, RIDGES[4]), 0)
        return np.log(own / norm[cell])


def chances(logits: np.ndarray) -> np.ndarray:
    """Softmax of each row, in place."""
    np.exp(logits, out=logits)
    logits /= (logits @ np.ones(logits.shape[1], logits.dtype))[:, None]
    return logits


def stepped(weight: np.ndarray | None, counted: np.ndarray, expected: np.ndarray, ridge: float) -> np.ndarray:
    """A gradient step, each weight scaled by its expected count (which bounds its curvature). Weights start at
    zero (None); ``expected`` is used up."""
    move = counted - expected
    if weight is not None:
        move -= weight * ridge
    expected += ridge
    move /= expected
    move *= RATE
    np.clip(move, -MOVE, MOVE, out=move)
    if weight is None:
        return move
    move += weight
    return np.clip(move, -HIGHEST, HIGHEST, out=move)


def runs_of(vocab: Vocabulary, row: dict) -> Iterator[Runs]:
    """A part in slices of whole runs, of about ``SLICE`` contexts."""
    begins, skip = unpacked(row["begins"], np.uint8), unpacked(row["skip"], np.uint16)
    word, n = unpacked(row["word"], np.int32), unpacked(row["n"], np.int64)
    events, pairs = np.flatnonzero(begins == 2), np.flatnonzero(begins[begins > 0] == 2)
    cut = np.flatnonzero(_starts(pairs // SLICE))
    ends = zip(cut.tolist(), [*cut[1:].tolist(), None], strict=True)
    for a, b in ends:
        e, p = slice(events[a], b and events[b]), slice(pairs[a], b and pairs[b])
        yield Runs(vocab, begins[e], skip[p], word[e], n[e])


def fit(events: DataFrame, words) -> np.ndarray:
    """Skip weights by gradient rounds over all training tokens; parts take as many steps as there were rounds before."""
    spark, k = events.sparkSession, words.value.classes
    shared, counts = np.zeros((ROWS, k), np.float32), np.zeros((ROWS, k))
    for round_ in range(ROUNDS):
        start = spark.sparkContext.broadcast(Table(words.value, shared))

        def gradient(batches: Iterator[pa.RecordBatch], start=start, steps=min(round_, STEPS)) -> Iterator[pa.RecordBatch]:
            vocab, counted, expected = words.value, np.zeros(ROWS * k), np.zeros((ROWS, k))
            for batch in batches:
                for row in batch.to_pylist():
                    if steps:  # the counts are known from the first round
                        for runs in runs_of(vocab, row):
                            at, p = runs.expected(start.value, steps)
                            expected[at] += p
                        continue
                    skip, word = unpacked(row["skip"], np.uint16), unpacked(row["word"], np.int32)
                    pair = np.cumsum(unpacked(row["begins"], np.uint8) > 0) - 1
                    counted += np.bincount(skip[pair].astype(np.int64) * k + vocab.of[np.minimum(word, vocab.size)], unpacked(row["n"], np.int64), ROWS * k)
            if not steps:  # the skip row tells all
                expected = counted.reshape(ROWS, k).sum(1, keepdims=True) * start.value.chance
            some = np.flatnonzero(expected.any(1))
            both = np.hstack([x.reshape(ROWS, k)[some] for x in (counted, expected)]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(both[:, j].copy()) for j in range(2 * k))], ["row", *(f"x{j}" for j in range(2 * k))])

        columns = [f"x{j}" for j in range(2 * k)]
        summed = (events.select("begins", "skip", "word", "n").mapInArrow(gradient, "row bigint, " + ", ".join(f"{c} float" for c in columns))
                  .groupBy("row").agg(*(F.sum(c).alias(c) for c in columns)).toPandas())
        row, both = summed["row"].to_numpy(np.int64), summed[columns].to_numpy(np.float64)
        shared = shared.copy()
        if round_ == 0:
            counts[row] = both[:, :k]
        shared[row] = stepped(shared[row], counts[row], both[:, k:], RIDGES[2])
        start.unpersist()
    return shared


def tail_sums(tokens: DataFrame, counts: DataFrame, words) -> DataFrame:
    """Per document with words that are not broadcast: base and log10 probability of these in their last
    place, and how many are known. Stored, so that its shuffle can go before the large ones come."""

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, hashes = words.value, word_hashes()
        for batch in batches:
            ids = vocab.ids(hashed(batch.column("word").to_pylist(), hashes))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vocab.targets(ids).astype(np.int64))], ["word", "n", "leaf"]).filter(pa.array(ids >= vocab.size))

    # Words with equal bits meet in one place: those of the documents (tf) and those of training (n).
    rare = counts.select("word", "n").mapInArrow(others, "word binary, n bigint, leaf bigint")
    both = tokens.select(F.explode("tail").alias("t")).select("t.leaf", "t.word", "t.key", "t.tf", F.lit(0).cast("bigint").alias("n")).unionAll(
        rare.select("leaf", "word", F.lit(0).cast("bigint"), F.lit(0).cast("bigint"), "n"))
    both = both.repartition("leaf").select(
        "key", "tf", F.max("n").over(Window.partitionBy("leaf", "word")).alias("n"),
        F.sum(F.when(F.col("tf") == 0, F.col("n") + 1).otherwise(0)).over(Window.partitionBy("leaf")).alias("size"))
    return stored(
        both.filter("tf > 0")
        .select("key", (F.col("tf") * F.log10((F.col("n") + 1) / F.lit(float(words.value.total + words.value.different + 1)))).alias("base"),
                (F.col("tf") * F.log10((F.col("n") + 1) / (F.col("size") + 1))).alias("model"), F.when(F.col("n") > 0, F.col("tf")).otherwise(0).alias("known"))
        .groupBy("key").agg(F.sum("base").alias("tail_base"), F.sum("model").alias("tail_model"), F.sum("known").alias("tail_known"))
    )


def scores(docs: DataFrame, training: Column, held_out: Column) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): counts, the base score and the model's log10 probability."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", training.alias("training"), held_out.alias("held_out"))
    counts = stored(token_counts(docs, F.col("training")))
    words = spark.sparkContext.broadcast(vocabulary(counts))
    known = words.value
    tokens = tokenized(docs, words)
    tail = tail_sums(tokens, counts, words)
    parts = (tokens.agg(F.sum("n")).first()[0] or 0) // PART + 1
    events = dealt(tokens, words, parts)
    table = spark.sparkContext.broadcast(Table(known, fit(events, words)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = []
                for runs in runs_of(words.value, row):
                    own.append(runs.classes(table.value, STEPS) + runs.words(STEPS))
                steps = np.rint(np.concatenate(own) / -GRAIN).astype(np.int32)
                found = steps[np.cumsum(unpacked(row["at"], np.int32).astype(np.int64))]
                ends = np.cumsum(row["sizes"]).tolist()
                yield pa.RecordBatch.from_pydict({
                    "chunk": pa.array(row["chunks"], pa.int64()), "part": pa.array([row["part"]] * len(ends), pa.int64()),
                    "found": pa.array([packed(found[b - s : b]) for b, s in zip(ends, row["sizes"], strict=True)], pa.binary())})

    def add(own: pa.Table, back: pa.Table) -> pa.Table:
        row = own.to_pylist()[0]
        mine = _events(words.value, row, parts)
        by_part = sorted(zip(back.column("part").to_pylist(), back.column("found").to_pylist(), strict=True))
        found = np.concatenate([unpacked(x, np.int32) for _, x in by_part])
        text = np.repeat(np.arange(len(row["docs"])), [d["n_tokens"] for d in row["docs"]])
        model = np.bincount(text, found[mine.of], len(row["docs"])) * (-GRAIN / math.log(10))
        return pa.table({"key": pa.array([d["key"] for d in row["docs"]], pa.int64()), "model": pa.array(model)})

    back = events.mapInArrow(score, "chunk bigint, part bigint, found binary")
    model = tokens.select("chunk", "ids", "docs").groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(add, "key bigint, model double")

    zero = F.lit(0.0)
    return tokens.select(F.explode("docs").alias("d")).select("d.*").join(model, "key").join(tail, "key", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(known.total).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("tail_base", zero)).alias("base_score"),
        (F.col("model") + F.coalesce("tail_model", zero)).alias("score"),
    )
