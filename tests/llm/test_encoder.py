"""The encoder of operator 10 against the tokenizer."""

import random

import numpy as np
import tokenizers

from quarry.llm import packing


class Spy:
    """A tokenizer that remembers what goes through it whole."""

    def __init__(self, path):
        self.own, self.seen = OWN.from_file(path), []
        Spy.last = self

    from_file = classmethod(lambda cls, path: cls(path))

    def __getattr__(self, name):
        return getattr(self.own, name)

    def encode_batch_fast(self, texts, **options):
        self.seen += texts
        return self.own.encode_batch_fast(texts, **options)


OWN = tokenizers.Tokenizer


def test_encoder_is_the_tokenizer_and_merges_runs_once(monkeypatch):
    monkeypatch.setattr(tokenizers, "Tokenizer", Spy)
    encode = packing.encoder(packing.tokenizer_path(), 0, most_words=300)
    r = random.Random(1)
    parts = [" ", "  ", "\n", "\n\n", "\t", "\r", "'s", "'", "\u2019", "a", "Z\u00e9", "\u024f", "\u0250", "9", "12", "\u00b2", "\u2167", "\u0663", "_", "...", "<|", "|>", "\u4e2d", "\u00a0", "\u0301", "\U0001f600", "\u00d7", "\u00f7", "\u00aa", "it's", "$5", " .", "\x0b", "\x7f", "\x1e", "\u0100", "<|endoftext|>"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(4000)]
    got = [ids for i in range(0, len(texts), 100) for ids in encode(texts[i : i + 100])]
    assert got == [np.array([*e.ids, 0], "<u4").tobytes() for e in OWN.from_file(packing.tokenizer_path()).encode_batch(texts, add_special_tokens=False)]
    Spy.last.seen.clear()
    encode(["Some words, and some more; words.\nNext (line) \u00e9t\u00e9 42!"])
    assert not Spy.last.seen
