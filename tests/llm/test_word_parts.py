"""Word ids by parts: every part is merged once, whatever stands around it, and ids are the tokenizer's own."""

import random

import numpy as np

from inkmesh.llm import packing


def encoder():
    return packing.WordEncoder(packing.tokenizer_path(packing.WORD_VOCABULARY))


class Counted:
    """A tokenizer that counts what it is given."""

    def __init__(self, merges):
        self.merges, self.parts = merges, 0

    def encode(self, text, **more):
        self.parts += text.count(" ") + 1
        return self.merges.encode(text, **more)


def test_many_different_words_are_merged_once():
    own = encoder()
    own.merges = Counted(own.merges)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [a + b + c + d for a in letters for b in letters for c in letters for d in letters[:8]]
    texts = [" ".join(words[k : k + 2000]) for k in range(0, len(words), 2000)]
    own.encode(texts)
    for change in (str.upper, str.title, lambda t: t.replace(" ", ", "), str):
        for k in range(0, len(texts), 7):
            own.encode(list(map(change, texts[k : k + 7])))
    assert len(words) > 140_000 and own.merges.parts <= len(words) + 1  # and the comma


def test_ids_of_odd_texts_are_the_tokenizers():
    own, rng = encoder(), random.Random(3)
    some = ["'", "'s", "'S", "s", "t", "'t", "'re", "'rE", "'ve", "'m", "'ll", "'LL", "'l", "'d", "''s", ",'s", "re", "r", "a", "Bc", "dé", "É", "ß", "×", "÷", "ª", "µ", "²", "¾", "12", "7", ".", "!!", " ", "  ", "\n", "\t", "\x0b", "\x85", "\xa0", "\x1c", "\u2003", "\u3000", "’", "’s", "я", "H̱", "İ", "Σ", "中", "<", "|", "<|", "<|endoftext|>", "<|ENDOFTEXT|>", "\0"]
    texts = ["".join(rng.choices(some, k=rng.randint(0, 12))) for _ in range(6000)]
    latin = [s for s in some if s.isascii() or max(s) <= "\xff"]
    texts += ["".join(rng.choices(latin, k=rng.randint(0, 12))) for _ in range(6000)] + ["x" * 5000, " " * 5000, "", "don't", "'", "s", "'l", "l", "'r", "e"]
    for t, got in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == own.whole.encode(t, add_special_tokens=False).ids, t
    assert own.encode([]) == [] and own.encode(["", ""]) == [b"", b""]
