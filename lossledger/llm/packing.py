"""Best-fit packing by a configuration linear program over the histogram of piece lengths.

Documents become token ids and an end id; only longer ones are cut into pieces of ``capacity``. The
histogram of lengths (at most ``capacity`` numbers) is all that the driver sees. A configuration is a
multiset of lengths that fits a sequence; the program asks for the fewest sequences that hold every
length as often as it occurs. It is solved by multiplicative weights: in each step a knapsack by
dynamic programming, over prices near the lengths, gives the best configuration around every length;
each step covers an equal share of the demand, and lengths that stay uncovered rise in price. The
solution is rounded down; what is left is packed by integer steps of the same kind and best fit.

Places: a piece's rank among those of its length (counted per slice, so a frequent length is not one
task's work) says by arithmetic which copy of which configuration holds it and at what offset.

Defined results: null text is empty and gives its end id alone; rows that repeat an id are packed one
by one; ties in rank are between equal rows; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import string
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordTable, chunks, stored

#: Steps of the multiplicative weights and how much an uncovered length rises in a step.
STEPS, RISE = 24, 0.02
#: Words and parts of words whose ids a worker remembers (about 200 bytes each).
REMEMBERED = 1_000_000
#: Parts of words that are encoded in one text.
TOGETHER = 2_000
#: ASCII signs that follow a word's letters.
SIGNS_TEXT = string.punctuation
SIGNS = SIGNS_TEXT.encode()
#: Letters before this one, but for the dotted capital I, are their own composed form and are lowered one by one.
FIRST_OTHER, DOTTED = "\u0250", "\u0130"
#: Pieces in a slice, about; a slice of one length is ranked by one task.
SLICE = 50_000


class WordIds(WordTable):
    """Ids of a word as little-endian bytes; new words are encoded together, by :meth:`ids_of`.

    Most words are letters and signs behind them, in some spelling with capitals. Where the tokenizer
    lowers letters and cuts there (:func:`part_ends`), texts are lowered first, and only distinct cores and
    endings are encoded, many in one text, which its part-ending tokens tell apart again. Words of another
    form are encoded as they are.
    """

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        super().__init__(lambda word: self.encoded([word])[0], REMEMBERED)
        self.ends = part_ends(tokenizer_file)
        self[b""] = b""

    def words(self, text: bytes) -> list[bytes]:
        """The words of a text; lowered where that changes no id (a special token's mark stays as it is)."""
        return (text if self.ends is None or b"<|" in text else text.lower()).split()

    def encoded(self, words: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def encoded_together(self, parts: list[bytes]) -> list[bytes]:
        """The same as :meth:`encoded`, for parts that the tokenizer does not cut."""
        ids = np.frombuffer(self.encoded([b" ".join(parts)])[0], "<u4")
        ends = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        if len(ends) != len(parts):
            return self.encoded(parts)
        raw = ids.tobytes()
        return [raw[x:y] for x, y in zip([0, *ends[:-1]], ends, strict=True)]

    def learn_parts(self, parts: list[bytes]) -> None:
        for at in range(0, len(parts), TOGETHER):
            some = parts[at : at + TOGETHER]
            self.update(zip(some, self.encoded_together(some), strict=True))

    def learn(self, new: set[bytes]) -> None:
        if len(self) + len(new) > self.limit:
            self.clear()
            self[b""] = b""
        rest = new
        if self.ends is not None:
            cut = [(word, core_and_signs(word)) for word in new]
            rest = [word for word, found in cut if not found]
            composed = [(word, found) for word, found in cut if found and found[0] != word]
            parts = {found[0] for _, found in cut if found}.union(found[1] for _, found in composed)
            self.learn_parts(list(parts.difference(self)))
            self.update((word, self[found[0]] + self[found[1]]) for word, found in composed)
        rest = list(rest)
        self.update(zip(rest, self.encoded(rest), strict=True))

    def ids_of(self, texts: list[list[bytes]]) -> list[bytes]:
        """Ids of texts that are given as words; each word is looked up once, unknown ones are learned together."""
        found = [list(map(self.get, words)) for words in texts]
        whole = [None not in ids for ids in found]
        self.learn({
            word for words, ids, known in zip(texts, found, whole, strict=True) if not known
            for word, i in zip(words, ids, strict=True) if i is None
        })
        return [
            b"".join(ids if known else [self[word] if i is None else i for word, i in zip(words, ids, strict=True)])
            for words, ids, known in zip(texts, found, whole, strict=True)
        ]


def core_and_signs(word: bytes) -> tuple[bytes, bytes] | None:
    """The lowered letters of a word and the ASCII signs behind them; None for words of another form, or
    with letters that are normalised in other ways than by lowering them one by one."""
    if word.isalpha() and word.islower():
        return word, b""
    if word.isascii():
        low = word.lower()
        core = low.rstrip(SIGNS)
        return (core, low[len(core) :]) if core.isalpha() else None
    text = word.decode()
    if max(text) >= FIRST_OTHER or DOTTED in text:
        return None
    low = text.lower()
    core = low.rstrip(SIGNS_TEXT)
    return (core.encode(), low[len(core) :].encode()) if core.isalpha() else None


def part_ends(tokenizer_file: str) -> np.ndarray | None:
    """Which tokens end a part, for a tokenizer that lowers letters, drops white space, and takes a run of
    letters and a run of signs as one part each; None for any other."""
    with open(tokenizer_file, "rb") as f:
        told = json.load(f)
    cuts = (told.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    choices = ((cuts[0].get("pattern") or {}).get("Regex") or "").split("|")
    suffix = told["model"].get("end_of_word_suffix")
    steps = [n["type"] for n in (told.get("normalizer") or {}).get("normalizers", [])]
    runs = {r"[\p{L}]+", r"[^\s\p{L}\p{N}]+"} <= set(choices) and cuts[0].get("behavior") == "Removed"
    if not (suffix and runs and steps == ["NFC", "Replace", "Lowercase"]):
        return None
    numbers = told["model"]["vocab"]
    ends = np.zeros(max([*numbers.values(), *(t["id"] for t in told.get("added_tokens", []))]) + 1, bool)
    ends[[number for token, number in numbers.items() if token.endswith(suffix)]] = True
    return ends


@cache
def word_ids(tokenizer_file: str) -> WordIds:
    """One tokenizer and word memory per worker and file; later tasks of the worker know the words."""
    return WordIds(tokenizer_file)


def pieces(docs: DataFrame, tokenizer_file: str, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document.

    The tokenizer drops white space and no token spans it, so words are encoded one by one.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_ids(tokenizer_file)
        for batch in batches:
            for part, texts in chunks(batch):
                split = [table.words(t) if t else [] for t in texts]
                rows, ids = [], []
                for k, doc in enumerate(table.ids_of(split)):
                    doc += b"\0\0\0\0"
                    for piece, at in enumerate(range(0, len(doc), 4 * capacity)):
                        own = doc[at : at + 4 * capacity]
                        rows.append((k, piece, at // 4, len(own) // 4, zlib.crc32(own)))
                        ids.append(own)
                row, *columns = (np.array(c, np.int64) for c in zip(*rows, strict=True))
                arrays = [part.column("doc_id").take(pa.array(row)), pa.array(columns[0].astype(np.int32)), *map(pa.array, columns[1:])]
                if with_ids:
                    arrays.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(cut, schema)


def knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> np.ndarray:
    """Per capacity up to ``capacity``, the length to take first for the highest total price (0: none)."""
    value, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    order = np.argsort(lengths)
    lengths, prices = lengths[order], prices[order]
    for room in range(1, capacity + 1):
        k = np.searchsorted(lengths, room, "right")
        if k:
            total = value[room - lengths[:k]] + prices[:k]
            best = int(np.argmax(total))
            value[room], choice[room] = total[best], lengths[best]
    return choice


def _around(length: int, choice: np.ndarray, capacity: int) -> tuple[tuple[int, int], ...]:
    """The best configuration that holds ``length``: (length, how often), longest first."""
    held, room = defaultdict(int), capacity - length
    held[length] += 1
    while room > 0 and choice[room]:
        held[int(choice[room])] += 1
        room -= int(choice[room])
    return tuple(sorted(held.items(), reverse=True))


def _cover(demand: np.ndarray, prices: np.ndarray, capacity: int, whole: bool, found: dict) -> None:
    """Take configurations around every length, longest first, as often as ``demand`` allows; it shrinks."""
    lengths = np.flatnonzero(demand > 0)
    choice = knapsack(lengths, prices[lengths], capacity)
    for length in lengths[::-1].tolist():
        if demand[length] <= 0:
            continue
        held = _around(length, choice, capacity)
        often = min(demand[x] // n if whole else demand[x] / n for x, n in held)
        if often > 0:
            found[held] += often
            for x, n in held:
                demand[x] -= often * n


def best_fit(counts: np.ndarray, capacity: int) -> dict:
    """Best fit of the longest first, for whole groups of equal sequences at a time."""
    rooms: dict[int, dict] = defaultdict(lambda: defaultdict(int))
    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        while left:
            room = min((r for r, x in rooms.items() if r >= length and x), default=None)
            if room is None:
                rooms[capacity - length][((length, 1),)] += left
                break
            held, many = next(iter(rooms[room].items()))
            take = min(left, many)
            rooms[room][held] -= take
            if not rooms[room][held]:
                del rooms[room][held]
            more = dict(held)
            more[length] = more.get(length, 0) + 1
            rooms[room - length][tuple(sorted(more.items(), reverse=True))] += take
            left -= take
    out: dict = defaultdict(int)
    for group in rooms.values():
        for held, many in group.items():
            out[held] += many
    return out


def configurations(counts: np.ndarray, capacity: int) -> dict:
    """How often each configuration is used; ``counts[l]`` pieces of length l are all held."""
    counts = counts.astype(np.int64)
    prices = np.arange(capacity + 1) / capacity
    fractional: dict = defaultdict(float)
    left = np.zeros(capacity + 1)
    for _ in range(STEPS):
        share = counts / STEPS
        left += share
        _cover(left, prices, capacity, False, fractional)
        uncovered = np.divide(left, share, out=np.zeros_like(left), where=share > 0)
        prices = prices * np.exp(RISE * np.clip(uncovered - uncovered[share > 0].mean() if share.any() else 0, -1, 1))
    out: dict = defaultdict(int)
    rest = counts.copy()

    def waste(held) -> int:
        return capacity - sum(x * n for x, n in held)

    # Rounded down, and never more than what is left; full sequences first.
    for held in sorted(fractional, key=lambda h: (waste(h), -fractional[h], h)):
        often = min([int(fractional[held] + 1e-6), *(int(rest[x]) // n for x, n in held)])
        if often > 0 and waste(held) <= capacity // 256:
            out[held] += often
            for x, n in held:
                rest[x] -= often * n
    # Integer steps of full sequences; best fit takes over after the step that gives the fewest.
    plain = np.arange(capacity + 1) / capacity
    steps: list[dict] = []
    closings = [best_fit(rest, capacity)]
    for _ in range(4 * STEPS):
        full: dict = defaultdict(int)
        _cover(rest.copy(), plain, capacity, True, full)
        step = {held: int(often) for held, often in full.items() if waste(held) == 0}
        if not step:
            break
        for held, often in step.items():
            for x, n in held:
                rest[x] -= often * n
        steps.append(step)
        closings.append(best_fit(rest, capacity))
        used = np.divide(counts - rest, counts, out=np.zeros(capacity + 1), where=counts > 0)
        plain = np.arange(capacity + 1) / capacity * (1 - 0.01 * used)
    totals = [sum(sum(s.values()) for s in steps[:k]) + sum(c.values()) for k, c in enumerate(closings)]
    stop = totals.index(min(totals))
    for step in [*steps[:stop], closings[stop]]:
        for held, often in step.items():
            out[held] += often
    return out


class Slots:
    """Where the r-th piece of a length goes."""

    def __init__(self, used: dict, capacity: int):
        next_rank, base, rows = np.zeros(capacity + 1, np.int64), 0, []
        for held, often in sorted(used.items(), reverse=True):
            offset = 0
            for length, n in held:
                rows.append((length << 44 | int(next_rank[length]), n, base, offset))
                next_rank[length] += often * n
                offset += length * n
            base += often
        self.sequences = base
        table = np.array(sorted(rows), np.int64).reshape(-1, 4)
        self.begin, self.n, self.base, self.offset = table.T.copy()

    def places(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces of the given lengths and ranks."""
        key = (length << 44) | rank
        row = np.searchsorted(self.begin, key, "right") - 1
        within = key - self.begin[row]
        return self.base[row] + within // self.n[row], self.offset[row] + within % self.n[row] * length


def packed(docs: DataFrame, tokenizer_file: str, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """The pieces of ``docs`` (doc_id, text) with sequence_id and offset."""
    cut = stored(pieces(docs, tokenizer_file, capacity, with_ids))
    histogram = cut.groupBy("length").count().collect()
    counts = np.zeros(capacity + 1, np.int64)
    for r in histogram:
        counts[r["length"]] = r["count"]
    slots = docs.sparkSession.sparkContext.broadcast(Slots(configurations(counts, capacity), capacity))

    slices = int(counts.sum()) // SLICE + 16
    sliced = cut.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(slices)))
    per_slice = sliced.groupBy("length", "slice").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slice.select("length", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "slice").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        sliced.withColumn("rank", F.row_number().over(own)).join(offsets, ["length", "slice"])
        .withColumn("rank", F.col("rank") - 1 + F.col("before"))
    )

    names = cut.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            sequence, offset = slots.value.places(length, rank)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id bigint, offset bigint"
    return ranked.select(*names, "rank").mapInArrow(place, schema)
