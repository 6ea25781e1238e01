"""Ids of pieces by the last letter, words screened by their letters, one memory at a time."""

import random

import pytest

from ruleweave.llm import memories, toxicity
from ruleweave.llm.queries import BYTE_BPE, WORD_BPE, public_tokenizer
from ruleweave.llm.tokens import Encoder


def test_marks_after_every_letter():
    enc = Encoder(public_tokenizer(WORD_BPE))
    skip = [(0x3400, 0x9FFF), (0xAC00, 0xD7A4), (0xD800, 0xE000), (0x20000, 0x110000)]
    letters = [chr(c) for c in range(0x20000) if not any(a <= c < b for a, b in skip)]
    for start in range(0, len(letters), 50):
        text = " ".join(f"{x}{c}{mark}" for c in letters[start : start + 50] for mark in ".," for x in ("", "x"))
        assert enc.encode(text) == enc.whole(text)


def test_random_pieces_equal_the_library():
    enc, rng = Encoder(public_tokenizer(WORD_BPE), remembered=200), random.Random(4)
    pool = "aàİςΣ.,'é़́क़日本   \n<|endoftext|>12Åﬁ"
    for _ in range(3000):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 30)))
        assert enc.encode(text) == enc.whole(text)
    long = "x" * 5000 + ". " + "ab" * 3000
    assert enc.encode(long) == enc.whole(long) and all(len(p) <= 201 for p in enc.known)


def test_tokenizers_that_keep_white_space_are_refused():
    with pytest.raises(ValueError):
        Encoder(public_tokenizer(BYTE_BPE))


def test_the_screen_misses_no_misspelling():
    rng = random.Random(9)
    letters = "abcdeéñ"
    terms = list({"".join(rng.choice(letters) for _ in range(rng.randint(4, 13))) for _ in range(80)})
    lexicon = toxicity.Lexicon([toxicity.Entry(t, False, 3 + rng.random()) for t in terms])
    words = []
    for _ in range(1500):
        word = list(rng.choice(terms))
        for _ in range(rng.randint(0, 3)):
            at, kind = rng.randrange(len(word) + 1), rng.randrange(4)
            if kind == 0:
                word.insert(at, rng.choice(letters))
            elif kind == 1 and at < len(word) > 1:
                del word[at]
            elif kind == 2 and at < len(word):
                word[at] = rng.choice(letters)
            elif at + 1 < len(word):
                word[at], word[at + 1] = word[at + 1], word[at]
        words.append("".join(word))
    near = lexicon.candidates(words)
    for first in (False, True):
        for i, word in enumerate(words):
            assert lexicon.match(word, first, near.get(i, 0)) == lexicon.match(word, first)


def test_one_memory_at_a_time():
    gone = []
    for owner in ("a", "a", "b", "a"):
        memories.claim(owner, lambda owner=owner: gone.append(owner))
    assert gone == ["a", "b"]
    memories.claim("end", lambda: None)
