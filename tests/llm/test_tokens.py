import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from riverstone.llm import hashing, tokens
from riverstone.llm.tokens import WordTokenizer


def ids(blob):
    return [int.from_bytes(blob[i : i + 4], "little") for i in range(0, len(blob), 4)]


def test_ids_are_the_tokenizers():
    """All Latin-1 characters in random company, other scripts, combining marks, special tokens; a cache that turns over all the time."""
    rng = random.Random(0)
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    words = WordTokenizer("word_bpe_49k.json", cache_parts=50)
    latin = [chr(c) for c in range(256)] + list("abcdeABC'' .,stdlmrve") * 8
    wide = latin + list("ΣσςİıĀ漢字é 　Kﬁ¼٣") * 6
    texts = ["".join(rng.choice(latin) for _ in range(rng.randrange(60))) for _ in range(1500)]
    texts += ["".join(rng.choice(wide) for _ in range(rng.randrange(60))) for _ in range(1500)]
    texts += ["a<|endoftext|>b C", "<|STARTOFTEXT|>", "", "don't I'll THEY'RE 'S", "x\x1cy"]
    for at in range(0, len(texts), 100):
        some = texts[at : at + 100]
        assert [ids(x) for x in words.encode(some)] == [e.ids for e in model.encode_batch(some, add_special_tokens=False)]


def thue_morse(n, letters):
    return "".join(letters[bin(k).count("1") % 2] for k in range(n))


def test_words_that_polynomial_hashes_confuse():
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["x " + thue_morse(1024, "ab") + " y", "x " + thue_morse(1024, "ba") + " y", thue_morse(1024, "ba")]
    words = WordTokenizer("word_bpe_49k.json")
    assert [ids(x) for t in texts for x in words.encode([t])] == [e.ids for e in model.encode_batch(texts, add_special_tokens=False)]
    assert [ids(x) for x in words.encode(texts)] == [e.ids for e in model.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("kinds", [1, 7])
def test_equal_hashes_dont_decide(monkeypatch, kinds):
    """With a hash of few values, batches and caches are full of collisions, and ids are still the tokenizer's."""
    monkeypatch.setattr(tokens, "segment_hashes", lambda data, begin, end: data[begin].astype("u8") % kinds)
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    words = WordTokenizer("word_bpe_49k.json")
    for texts in (["a b"], ["a"], ["the cat sat on the mat"], ["h"], ["a", "the", "hat"]):
        assert [ids(x) for x in words.encode(texts)] == [e.ids for e in model.encode_batch(texts, add_special_tokens=False)]


def test_a_very_long_text():
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    text = " ".join(f"word{k % 977} and" for k in range(200_000))
    assert ids(WordTokenizer("word_bpe_49k.json").encode([text])[0]) == model.encode(text, add_special_tokens=False).ids


def test_segments():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 99, 5000).astype(np.uint8)
    begin = rng.integers(0, 4000, 3000)
    end = begin + rng.integers(0, 12, 3000) * rng.choice([1, 1, 1, 80], 3000)
    h = hashing.segment_hashes(data, begin, end)
    raw = [data[i:j].tobytes() for i, j in zip(begin, np.minimum(end, 5000), strict=True)]
    held = {}
    assert all(held.setdefault(r, x) == x for r, x in zip(raw, h.tolist(), strict=True)) and len(set(h.tolist())) == len(held)
    other = rng.permutation(3000)
    n = np.minimum(end - begin, end[other] - begin[other])
    want = [data[i : i + k].tobytes() == data[j : j + k].tobytes() for i, j, k in zip(begin, begin[other], n, strict=True)]
    assert hashing.equal_segments(data, begin, data, begin[other], n).tolist() == want
