"""Words of any length are merged as the libraries merge them, in time that grows with the length."""

import random
import time

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from weftgraph.llm import merge_rounds
from weftgraph.llm.sentence_pieces import Encoder, PieceTable
from weftgraph.llm.token_counts import WordBpe

LETTERS = {"all": "abcdefghijklmnopqrstuvwxyz", "dna": "ACGT", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "few": "aab", "wide": "aé漢字ß"}


def texts(rng, n):
    for letters in LETTERS.values():
        yield "".join(rng.choice(letters) for _ in range(n))
    for unit in ("ab", "the", "aaaaab", "ation", "q", "inging", "-", "=="):
        yield unit * (n // len(unit))
    yield "".join(rng.choice(["the", "ing", "er", "in", "th", "ations", "xq", "aaa"]) for _ in range(n // 3))


@pytest.fixture(scope="module")
def pieces():
    path = public_tokenizers.path("piece_bpe_32k.model")
    return Encoder(PieceTable.load(path)), sentencepiece.SentencePieceProcessor(model_file=path)


@pytest.mark.parametrize("rounds", [250, 3, 0])
def test_long_words_as_the_library(pieces, monkeypatch, rounds):
    monkeypatch.setattr(merge_rounds, "LONG_ROUNDS", rounds)
    monkeypatch.setattr(merge_rounds, "LONG", 20)
    ours, library = pieces
    rng = random.Random(rounds)
    for n in (25, 60, 300, 3000):
        for _ in range(4):
            for text in texts(rng, n):
                ours.memo.clear()
                assert ours.ids(text) == library.encode(text), text[:80]


def test_long_words_of_the_other_library(monkeypatch):
    import json

    monkeypatch.setattr(merge_rounds, "LONG", 20)
    path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        ours = WordBpe(json.load(f))
    library = Tokenizer.from_file(path)
    rng = random.Random(9)
    for n in (25, 300, 2000):
        for text in texts(rng, n):
            assert ours.count([text])[0][0] == len(library.encode(text, add_special_tokens=False).ids), text[:80]


def test_a_word_of_a_million_characters(pieces):
    ours, library = pieces
    rng = np.random.default_rng(4)
    for letters in ("ACGT", LETTERS["base64"], LETTERS["all"]):
        word = "".join(np.array(list(letters))[rng.integers(0, len(letters), 1_000_000)])
        began = time.time()
        assert ours.ids(word) == library.encode(word)
        assert time.time() - began < 30
