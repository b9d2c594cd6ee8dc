"""Benchmark decontamination: prefix-filtered join of document shingles with benchmark windows.

Each benchmark item gives its windows of ``width`` consecutive words (a shorter item is one window).
A window is a set of word shingles. Its shingles are ordered by rarity in the documents; because a
match must contain the window whole, the necessary prefix is its one rarest shingle. Documents look
their shingles up among the prefixes; a hit at a position fixes where the window would have to begin,
so positions before the text or a window longer than the rest are dropped; what is left is compared
word by word. No window is found by hash alone.

The benchmark is the stated query set. It is cut into blocks of at most ``BLOCK_WORDS`` words by window
hash; the size of a block is checked before it is broadcast, a larger one is halved again, and the items
of a window that very many share are dealt to several rows and blocks, whose hits are united. Every block
goes over the documents, which stay in place: nothing but counts of benchmark shingles is shuffled.

Defined results: null or empty text has no words, no hits, and is not contaminated; items without
words have no windows; items without an id are ignored; rows of the same item id are one item; empty
tables give empty or hit-free results; repeated documents are judged row by row; further columns pass
through, the decision is in columns named ``DECISION`` + name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, list_array, stored

#: Lower-case letters and digits, and all beyond ASCII, make words; the rest of ASCII parts them.
_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Words of the windows in one broadcast block.
BLOCK_WORDS = 6_500_000
#: The item ids of one row of windows are at most about this part of a block.
SLICES_OF_BLOCK = 16
#: Parts that the windows are cut into at most; rows that fall together even then have equal hashes.
MOST_PARTS = 1 << 40
DECISION = "__benchmark__"


def words_of(text: bytes | None) -> list[bytes]:
    """Words of lower-cased UTF-8 text."""
    return text.translate(_WORDS).split() if text else []


def benchmark_windows(items: DataFrame, width: int, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """A row per different window: its words, joined by blanks, and the ids of its items; several rows for
    a window of so many items that their ids would fill a good part of a block."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch):
                ids, windows = [], []
                for i, raw in zip(part.column("item_id").to_pylist(), texts, strict=True):
                    words = words_of(raw)
                    found = {b" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else ()
                    ids.extend([i] * len(found))
                    windows.extend(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.string()), pa.array(windows, pa.binary()).cast(pa.string())], ["item_id", "window"])

    rows = items.select(F.col(item_id).cast("string").alias("item_id"), F.col(text).alias("text")).filter("item_id IS NOT NULL")
    # The items of a window that very many share are dealt to several rows.
    n_slices = 1 + rows.count() // max(1, BLOCK_WORDS // SLICES_OF_BLOCK)
    return (
        rows.mapInArrow(cut, "item_id string, window string")
        .groupBy("window", F.pmod(F.xxhash64("item_id"), F.lit(n_slices)).alias("slice"))
        .agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    )


class Block:
    """Windows of one block as word numbers, with their shingles of up to ``shingle`` words."""

    def __init__(self, windows: list[bytes], items: list[list[str]], shingle: int):
        split = [w.split(b" ") for w in windows]
        self.number = {w: k + 1 for k, w in enumerate(sorted({w for words in split for w in words}))}
        self.items, self.shingle = items, shingle
        #: By length: row numbers of the windows and their words, one window a row.
        self.by_length = {}
        for n in sorted({len(w) for w in split}):
            rows = np.array([k for k, w in enumerate(split) if len(w) == n], np.int64)
            self.by_length[n] = rows, np.array([[self.number[x] for x in split[k]] for k in rows], np.int64)
        self.sizes = sorted({min(n, shingle) for n in self.by_length})

    def keys(self, words: np.ndarray, size: int) -> np.ndarray:
        """A number per shingle of ``size`` words along the last axis; 0 if a word is in no window."""
        base = np.uint64(len(self.number) + 1)
        n = words.shape[-1] - size + 1
        if n <= 0:
            return np.zeros((*words.shape[:-1], 0), np.uint64)
        out, known = np.zeros((*words.shape[:-1], n), np.uint64), np.ones((*words.shape[:-1], n), bool)
        for k in range(size):  # word numbers are below 2**21, so three fit exactly
            out = out * base + words[..., k : k + n].astype(np.uint64)
            known &= words[..., k : k + n] > 0
        return np.where(known, out, np.uint64(0))

    def shingles(self) -> dict[int, np.ndarray]:
        """The different shingles of the windows, sorted, by shingle size."""
        found = {size: [] for size in self.sizes}
        for n, (_, words) in self.by_length.items():
            found[min(n, self.shingle)].append(np.unique(self.keys(words, min(n, self.shingle))))
        return {size: np.unique(np.concatenate(x)) for size, x in found.items()}

    def ordered(self, frequency: dict[int, np.ndarray]) -> None:
        """Pick each window's rarest shingle (ties: the smaller key, then the first place) as its prefix."""
        shingles = self.shingles()
        self.prefix = {}
        for n, (rows, words) in self.by_length.items():
            size = min(n, self.shingle)
            keys = self.keys(words, size)
            rank = np.empty(len(shingles[size]), np.int64)
            rank[np.lexsort((shingles[size], frequency[size]))] = np.arange(len(rank))
            place = np.argmin(rank[np.searchsorted(shingles[size], keys)], axis=1)
            key = keys[np.arange(len(keys)), place]
            order = np.argsort(key, kind="stable")
            self.prefix[n] = size, key[order], place[order], words[order], rows[order]

    def numbers(self, words: list[bytes]) -> np.ndarray:
        get = self.number.get
        return np.fromiter((get(w, 0) for w in words), np.int64, len(words))

    def found(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin, length and row number of every window occurrence in a text."""
        begins, lengths, rows = [], [], []
        keys = {}
        for n, (size, prefix, place, words, row) in self.prefix.items():
            if len(numbers) < n:  # length bound
                continue
            if size not in keys:
                all_keys = self.keys(numbers, size)
                at = np.flatnonzero(all_keys)
                keys[size] = at, all_keys[at]
            at, key = keys[size]
            low = np.searchsorted(prefix, key, "left")
            many = np.searchsorted(prefix, key, "right") - low
            if not many.any():
                continue
            candidate = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
            begin = np.repeat(at, many) - place[candidate]
            inside = (begin >= 0) & (begin + n <= len(numbers))  # positional bound
            begin, candidate = begin[inside], candidate[inside]
            same = np.ones(len(begin), bool)
            for k in range(n):  # exact containment, word by word
                same &= numbers[begin + k] == words[candidate, k]
            begins.append(begin[same])
            lengths.append(np.full(same.sum(), n))
            rows.append(row[candidate[same]])
        if not begins:
            return (np.empty(0, np.int64),) * 3
        return np.concatenate(begins), np.concatenate(lengths), np.concatenate(rows)


def _frequencies(docs: DataFrame, block, block_sizes: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """How often each benchmark shingle occurs in the documents: one count per shingle reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block.value
        shingles = b.shingles()
        sums = {size: np.zeros(len(x), np.int64) for size, x in shingles.items()}
        for batch in batches:
            for _, texts in chunks(batch):
                for raw in texts:
                    numbers = b.numbers(words_of(raw))
                    for size, known in shingles.items():
                        keys = b.keys(numbers, size)
                        keys = keys[keys > 0]
                        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                        at = at[known[at] == keys]
                        sums[size] += np.bincount(at, minlength=len(known))
        for size, x in sums.items():
            at = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), size), pa.int32()), pa.array(at, pa.int64()), pa.array(x[at], pa.int64())],
                ["size", "at", "n"])

    out = {size: np.zeros(len(x), np.int64) for size, x in block_sizes.items()}
    counted = docs.select("text").mapInArrow(count, "size int, at bigint, n bigint").groupBy("size", "at").agg(F.sum("n").alias("n"))
    for r in counted.toPandas().itertuples():
        out[r.size][r.at] = r.n
    return out


def _blocks(docs: DataFrame, items: DataFrame, width: int, shingle: int, item_id: str, text: str) -> Iterator:
    """Broadcast blocks of windows, each checked to be within the bound and ordered by rarity."""
    spark = docs.sparkSession
    windows = stored(benchmark_windows(items, width, item_id, text))
    words = F.size(F.split("window", " ")) + F.size("items")
    total = windows.agg(F.sum(words)).first()[0] or 0
    n_blocks = 1 + 2 * total // BLOCK_WORDS if total > BLOCK_WORDS else 1
    row = F.xxhash64("window", "slice")
    todo = [(n_blocks, k) for k in reversed(range(n_blocks if total else 0))]
    while todo:
        n, k = todo.pop()
        part = windows.filter(F.pmod(row, F.lit(n)) == k)
        if n_blocks > 1:
            size, many = part.agg(F.coalesce(F.sum(words), F.lit(0)), F.count(F.lit(1))).first()
            if size > BLOCK_WORDS and many > 1 and n < MOST_PARTS:  # halved until it fits; a row alone is bounded by its slice
                todo += [(2 * n, k + n), (2 * n, k)]
                continue
        rows = part.collect()
        if not rows:
            continue
        block = Block([r["window"].encode() for r in rows], [r["items"] for r in rows], shingle)
        first = spark.sparkContext.broadcast(block)
        frequency = _frequencies(docs, first, block.shingles())
        first.unpersist()
        block.ordered(frequency)
        yield spark.sparkContext.broadcast(block)


def marked(
    docs: DataFrame, items: DataFrame, width: int = 13, shingle: int = 3, text: str = "text",
    item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """``docs`` with three columns: words, hit spans (flat begins and ends, merged) and ids of items found."""
    names = {k: f"{DECISION}{k}" for k in ("n_words", "spans", "items")}
    docs = docs.withColumns({
        names["n_words"]: F.lit(0).cast("bigint"),
        names["spans"]: F.array().cast("array<bigint>"),
        names["items"]: F.array().cast("array<string>"),
    })
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema])

    def mark(block) -> Callable:
        def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            b = block.value if block is not None else None
            for batch in batches:
                for part, texts in chunks(batch, text):
                    before = [part.column(names[k]).to_pylist() for k in ("spans", "items")]
                    n_words, spans, items = [], [], []
                    for raw, old_spans, old_items in zip(texts, *before, strict=True):
                        words = words_of(raw)
                        n_words.append(len(words))
                        begin, length, row = b.found(b.numbers(words)) if b and words else (np.empty(0, np.int64),) * 3
                        if len(begin):
                            old = np.array(old_spans, np.int64)
                            old_spans = merged(np.concatenate([old[::2], begin]), np.concatenate([old[1::2], begin + length]))
                            old_items = sorted({*old_items, *(i for k in np.unique(row) for i in b.items[k])})
                        spans.append(old_spans)
                        items.append(old_items)
                    new = {
                        names["n_words"]: pa.array(n_words, pa.int64()),
                        names["spans"]: list_array(np.concatenate([np.asarray(s, np.int64) for s in spans]) if spans else np.empty(0, np.int64), list(map(len, spans)), pa.int64()),
                        names["items"]: pa.array(items, pa.list_(pa.string())),
                    }
                    yield pa.RecordBatch.from_arrays([new.get(n, part.column(k)) for k, n in enumerate(part.schema.names)], part.schema.names)

        return over

    blocks = list(_blocks(docs.select(F.col(text).alias("text")), items, width, shingle, item_id, item_text))
    for block in blocks or [None]:
        docs = docs.mapInArrow(mark(block), schema)
    return docs


def merged(begins: np.ndarray, ends: np.ndarray) -> list[int]:
    """Union of half-open spans as one flat list of begins and ends."""
    order = np.argsort(begins, kind="stable")
    begins, ends = begins[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], begins[1:] > ends[:-1]])
    last = np.concatenate([new[1:], [True]])
    return np.stack([begins[new], ends[last]], 1).ravel().tolist()


def hit_words() -> Column:
    """Words within the hit spans."""
    spans = F.col(f"{DECISION}spans")
    return F.aggregate(spans, F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-1).cast("bigint").alias("sign")),
                       lambda a, x: F.struct((a["n"] + a["sign"] * x).alias("n"), (-a["sign"]).alias("sign")), lambda a: a["n"])


def contaminated() -> Column:
    hit = hit_words()
    return (hit > 0) & (20 * hit >= F.col(f"{DECISION}n_words"))


def clean(docs: DataFrame, items: DataFrame, width: int = 13) -> DataFrame:
    """The documents that are not contaminated, columns unchanged."""
    kept = marked(docs, items, width).filter(~contaminated())
    return kept.drop(*(c for c in kept.columns if c.startswith(DECISION)))
