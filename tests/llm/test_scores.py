"""Scores of the quality and toxicity models worked out a second time, byte by byte and pair by pair."""

import math
import random
import re

import numpy as np
import pytest

from borewatch.llm import quality_model, toxicity
from borewatch.llm.terms import PRIME

MOD = 1 << 32


def bucket(h, salt, bits):
    h = ((h ^ (salt * 0x85EBCA6B & 0xFFFFFFFF)) * 0x9E3779B1) % MOD
    h ^= h >> 15
    return ((h * 0x2C1B3C6D) % MOD) >> (32 - bits)


def word_hash(word):
    return sum((c + 1) * pow(int(PRIME), k + 1, MOD) for k, c in enumerate(word)) % MOD


def begun(word):
    h = 0
    for c in word:
        h = (h * int(PRIME) + c + 1) % MOD
    return h


def texts():
    rng = random.Random(3)
    words = ["you", "ARE", "idiot", "naïve", "Stones", "river's", "x", "42", "über-lang", "people", "those"]
    out = [" ".join(rng.choices(words, k=rng.randrange(1, 40))) for _ in range(40)]
    out += ["", " \t\n", "word word word", "a", "é", "one\ttwo\r\nthree", "idiot" * 50, " lead and trail ", "x" * 9]
    return [t.encode() for t in out]


def toxic_terms(text):
    found = set()
    for word in re.findall(rb"[a-z\x80-\xff]+", text.lower() if text.isascii() else bytes(c + 32 if 65 <= c < 91 else c for c in text)):
        found.add(bucket(word_hash(word), 1, toxicity.BITS))
        for n in toxicity.BEGINNINGS:
            if len(word) >= n:
                found.add(bucket(begun(word[:n]), n + 1, toxicity.BITS))
    return found


def test_toxicity_is_the_sum_over_pairs():
    some = texts()
    every = sorted(set().union(*(toxic_terms(t) for t in some)))
    chosen = np.array(every[::2])
    rng = np.random.default_rng(1)
    slots = np.full(1 << toxicity.BITS, -1, dtype=np.int16)
    slots[chosen] = np.arange(len(chosen))
    w, v, w0 = rng.normal(0, 0.2, len(chosen)), rng.normal(0, 0.3, (len(chosen), toxicity.FACTORS)), -0.3
    got = toxicity.score_texts(some, slots, w0, w, v)
    place = {int(b): i for i, b in enumerate(chosen)}
    for text, score in zip(some, got):
        own = sorted(place[b] for b in toxic_terms(text) if b in place)
        z = w0 + sum(w[i] for i in own)
        z += sum(float(v[i] @ v[j]) for a, i in enumerate(own) for j in own[a + 1 :])
        assert score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)


def quality_features(text):
    bits = quality_model.BITS
    words = re.findall(rb"[^\x20\x09-\x0D]+", text)
    found = [bucket(word_hash(w), 1, bits) for w in words]
    found += [0 for a, b in zip(words, words[1:]) if a == b]
    data = b" " + text + b" "
    white = [c in b" \t\n\x0b\f\r" for c in data]
    codes = [33 if s else c + 1 for c, s in zip(data, white)]
    for n in quality_model.NGRAMS:
        for i in range(len(data) - n + 1):
            inside = white[i + 1 : i + n - 1]
            if any(inside) or (n == 2 and white[i] and white[i + 1]):
                continue
            h = 0
            for c in codes[i : i + n]:
                h = (h * int(PRIME) + c) % MOD
            found.append(bucket(h, n, bits))
    return found


def test_quality_is_the_mean_over_words_and_grams():
    some = texts()
    scores = np.random.default_rng(2).normal(0, 2, 1 << quality_model.BITS).astype(np.float32)
    got = quality_model.score_texts(some, scores, 0.4)
    for text, score in zip(some, got):
        own = quality_features(text)
        mean = sum(float(scores[b]) for b in own) / len(own) if own else 0.0
        assert score == pytest.approx(1 / (1 + math.exp(-(mean + 0.4))), abs=1e-6)


def test_training_separates_by_mean_vectors():
    """The trained table is the softmax of the mean vector: scores of a text follow from shares of its features."""
    some = [b"good clear prose of a river", b"zz qq zz qq xx"] * 6
    y = np.array([1, 0] * 6)
    scores, constant = quality_model.train(some, y, 0.5)
    odds = [sum(float(scores[b]) for b in quality_features(t)) / len(quality_features(t)) + constant for t in some]
    assert all((z > 0) == bool(k) for z, k in zip(odds, y))
    shares = quality_model.counted(some[:1])[0]
    assert float(shares[1].sum()) == pytest.approx(1, abs=1e-5)
    assert float(shares[1] @ scores[shares[0]]) == pytest.approx(odds[0] - constant, abs=1e-4)
