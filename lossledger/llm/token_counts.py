"""Token counts by a count-only Viterbi search over a unigram vocabulary.

Pieces and scores come from a public tokenizer file. An Aho-Corasick automaton enumerates the pieces in
a text; dynamic programming over their ends carries the best score and its number of pieces, nothing
else. Ties follow the ``tokenizers`` library's unigram model: of equal scores the earlier begin wins; a
character that is no piece may be taken as unknown, at 10 below the lowest score, and then counts the
bytes it falls back to (or, with the characters next to it, one unknown piece if the file has no
bytes). Pieces hold the blank mark at their begin only, so texts are cut before it and each different
part is searched once.

Defined results: null and empty texts have no tokens; a text gets one blank mark in front; repeated
rows are counted one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordTable, chunks

MARK = "▁"
UNKNOWN_PENALTY = 10.0


def vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a SentencePiece file, control and unknown pieces left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(k), model.get_score(k)) for k in range(model.get_piece_size())
            if not (model.is_control(k) or model.is_unknown(k) or model.is_unused(k))]


class Counter:
    """Best score and number of pieces of texts."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        names = {piece for piece, _ in pieces}
        self.bytes = all(f"<0x{k:02X}>" in names for k in range(256))
        # Where no piece goes on across the mark (or a line's end), parts are independent.
        inner = any(MARK in piece.lstrip(MARK) for piece in names)
        line = any("\n" in piece and len(piece) > 1 for piece in names)
        part = f"[^{MARK}]" if line else f"[^{MARK}\n]"
        self.parts = re.compile("(?s:.+)" if inner or not self.bytes else f"{MARK}+{part}*|{part}+|\n")

    def search(self, text: str) -> tuple[float, int]:
        """Dynamic programming over the ends of the pieces in ``text``."""
        n = len(text)
        best, count, unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        done = 0

        def fall_back(end: int, found: bool, single: bool) -> None:
            if single:
                return
            score = best[end - 1] + self.unknown
            if not found or score > best[end]:
                best[end], unknown[end] = score, True
                count[end] = count[end - 1] + (len(text[end - 1].encode()) if self.bytes else not unknown[end - 1])

        found = single = False
        for last, (length, own) in self.automaton.iter(text):
            end = last + 1
            if end != done:
                if done:
                    fall_back(done, found, single)
                for gap in range(done + 1, end):
                    fall_back(gap, False, False)
                done, found, single, begin_of_best = end, False, False, 0
            begin = end - length
            score = best[begin] + own
            if not found or score > best[end] or (score == best[end] and begin < begin_of_best):
                best[end], count[end], begin_of_best, unknown[end] = score, count[begin] + 1, begin, False
            found, single = True, single or length == 1
        if done:
            fall_back(done, found, single)
        for gap in range(done + 1, n + 1):
            fall_back(gap, False, False)
        return best[n], count[n]

    def marked(self, text: str) -> str:
        return MARK + text.replace(" ", MARK) if text else ""


@cache
def counter(path: str) -> Counter:
    """One automaton per worker and vocabulary file."""
    return Counter(vocabulary(path))


def counted(docs: DataFrame, path: str) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_tokens and the best segmentation's score."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = counter(path)
        table = WordTable(model.search)
        for batch in batches:
            for part, texts in chunks(batch):
                out = np.zeros((2, len(texts)))
                for k, raw in enumerate(texts):
                    if raw:
                        found = [table[p] for p in model.parts.findall(model.marked(raw.decode()))]
                        out[:, k] = np.array(found).sum(0)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(out[1].astype(np.int64)), pa.array(out[0])], ["doc_id", "n_tokens", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        count, "doc_id bigint, n_tokens bigint, score double")
