"""Ids of words that are learned together, against the tokenizer itself."""

import random

import public_tokenizers
import pytest

from lossledger.llm import packing

WORDS = [
    "'s", "''s", "IT'S", "it'", "it's.", "\x01", "a\x01b", "\x1c", "a\x7fb", "<|endoftext|>", "a<|endoftext|>", "<|ENDOFTEXT|>", "x<|",
    "a_", "a_b", "12.5%", "a1b", "Été,", "ªº", "µ!", "ŉ", "ǅ", "İ", "ı", "ß", "Σς", "é", "́", "²", "×", "ɐb", "한국", "😀!", "﻿", "a" * 3000,
]


def texts(seed):
    rnd = random.Random(seed)
    made = ["".join(rnd.choice("abcdéßÑ") for _ in range(rnd.randrange(1, 6))) + rnd.choice(["", "", ",", "!!", "'", "3"]) for _ in range(400)]
    every = [w.title() if rnd.random() < 0.3 else w for w in made] + WORDS
    return [" ".join(rnd.choice(every) for _ in range(rnd.randrange(0, 60))) for _ in range(60)] + WORDS + ["", " \n"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("limit", [20, 100_000])
def test_words_learned_together_have_the_ids_of_each_alone(name, limit):
    table = packing.WordIds(public_tokenizers.path(name))
    table.limit = limit  # with a small memory words are forgotten between batches
    for seed in range(3):
        own = [t.encode() for t in texts(seed)]
        got = table.ids_of([table.words(t) for t in own])
        assert got == [b"".join(table.encoded(t.split())) for t in own]


def test_only_a_tokenizer_that_cuts_at_signs_is_taken_apart():
    assert packing.part_ends(public_tokenizers.path("word_bpe_49k.json")) is not None
    assert packing.part_ends(public_tokenizers.path("byte_bpe_50k.json")) is None
