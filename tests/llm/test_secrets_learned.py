"""Formats of secrets are learned from all values, however many there are."""

import random
import zlib

import numpy as np
import pytest

from borewatch.llm import secrets


@pytest.fixture(scope="module")
def lists():
    """More distinct values than were once learned from; some are long, some repeat."""
    rng = random.Random(5)
    parts = ["river", "stone", "win", "garden", "let", "un", "cloud", "ing", "er", "ab", "to", "ness"]
    words = {"".join(rng.choices(parts, k=5)) + rng.choice(["", "s", "=", "9"]) for _ in range(4000)}
    words = sorted(w for w in words if len(w) >= secrets.CANDIDATE) + ["lorem_" + "ipsum-" * 300]
    marks = ["".join(rng.choices("0123456789abcdef", k=rng.choice([24, 40]))) for _ in range(200)]
    return {"hex": [m.encode() for m in marks], secrets.ORDINARY: [w.encode() for w in words]}


@pytest.fixture(scope="module")
def texts(spark, lists):
    values = [v.decode() for v in lists["hex"] + lists[secrets.ORDINARY]]
    rows = [(i, " . ".join(values[i::40] + values[:2]), None) for i in range(40)] + [(99, None, "x"), (None, "", "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, kind string").repartition(3)


def test_all_values_are_learned_from(texts, lists):
    assert len(set(lists[secrets.ORDINARY])) > 3000
    got, want = secrets.learned(texts), secrets.infer(lists)
    assert got.automata.keys() == want.automata.keys() == {"hex", secrets.ORDINARY}
    for kind, machine in want.automata.items():
        assert np.array_equal(got.automata[kind].log_p, machine.log_p)
        seen = machine.log_p[:, : secrets.STOP] > machine.log_p.min(axis=1, keepdims=True)
        assert np.array_equal(got.automata[kind].follow[seen], machine.follow[seen])
    assert got.thresholds == pytest.approx(want.thresholds) and got.floors == pytest.approx(want.floors)


def test_rare_continuations_are_counted_too(texts, lists, monkeypatch):
    monkeypatch.setattr(secrets, "RESOLVED", 20)
    for kind, machine in secrets.learned(texts).automata.items():
        counts = np.zeros(machine.log_p.shape)
        for value in {v for v in lists[kind] if zlib.crc32(v) % 5}:
            state = 0
            for c in value:
                counts[state, secrets.CODE[c]] += 1
                state = machine.follow[state, secrets.CODE[c]]
            counts[state, secrets.STOP] += 1
        p = counts + secrets.SMOOTH
        assert np.allclose(machine.log_p, np.log(p / p.sum(axis=1, keepdims=True)))
