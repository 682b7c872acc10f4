"""Toxicity by a factorization machine over hashed terms.

A text is the set of its terms: words in lower case, and their beginnings, hashed. The machine scores
w0 + sum w_i + sum over pairs <v_i, v_j>, so that two terms can weigh more together than their own weights add up to.
Terms are chosen by their chi-square with the label in a bounded sample, and weights and factors are learned there by
adaptive stochastic gradient descent in numpy, in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from borewatch.llm.common import carried
from borewatch.llm.terms import (
    IS_LETTER, PRIME, TO_LOWER, bucket, fold_rows, labelled_sample, share_of_ones, strips, word_hashes, words_of,
)
from borewatch.session import ship_package

BITS = 22
#: Lengths in bytes of the beginnings that are terms besides the whole word.
BEGINNINGS = (4, 5, 6, 7)
#: Labelled rows of each class learned from; terms kept, and the least texts of the sample that hold one.
SAMPLE, TERMS, LEAST_TEXTS, LEAST_CHI = 4000, 4096, 4, 8.0
FACTORS, EPOCHS, RATE, SHRINK = 4, 20, 0.1, 1e-3


def terms(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the text, bucket) of the words and beginnings, strip by strip."""
    for data, owner in strips(texts):
        data = TO_LOWER[data]
        starts, ends = words_of(IS_LETTER[data])
        own = owner[starts]
        yield own, bucket(word_hashes(data, starts, ends), 1, BITS)
        h = np.zeros(len(starts), dtype=np.uint32)
        for k in range(max(BEGINNINGS)):
            longer = ends - starts > k
            starts, ends, own, h = starts[longer], ends[longer], own[longer], h[longer]
            h = h * PRIME + data[starts + k] + np.uint32(1)
            if k + 1 in BEGINNINGS:
                yield own, bucket(h, k + 2, BITS)


def sets(texts: list[bytes], slots: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, term), sorted by text. slots: numbers of the chosen terms by bucket, -1 for the others."""
    keys = [np.zeros(0, dtype=np.int64)]
    for owner, found in terms(texts):
        if slots is not None:
            found = slots[found]
            there = found >= 0
            owner, found = owner[there], found[there]
        keys.append(np.unique((owner.astype(np.int64) << BITS) | found))
    keys = np.unique(np.concatenate(keys))
    return keys >> BITS, keys & ((1 << BITS) - 1)


def choose(text_of: np.ndarray, term: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The chosen buckets: the largest chi-squares."""
    size = 1 << BITS
    both = np.bincount(term, minlength=size)
    ones = np.bincount(term, y[text_of], minlength=size)
    n, n1 = len(y), y.sum()
    there = np.flatnonzero(both >= LEAST_TEXTS)
    a, t = ones[there], both[there]
    expected = t * n1 / n
    chi = (a - expected) ** 2 / np.maximum(expected, 1e-9) + (a - expected) ** 2 / np.maximum(t - expected, 1e-9)
    order = np.argsort(-chi, kind="stable")[:TERMS]
    return np.sort(there[order[chi[order] >= LEAST_CHI]])


def train(text_of: np.ndarray, slot: np.ndarray, y: np.ndarray, n_terms: int, prior: float):
    """Constant, weights and factors. Classes weigh alike; the constant restores the share `prior` of class 1."""
    rng = np.random.default_rng(11)
    w, v, w0 = np.zeros(n_terms), rng.normal(0, 0.02, (n_terms, FACTORS)), 0.0
    gw, gv, g0 = np.full(n_terms, 1e-2), np.full((n_terms, FACTORS), 1e-2), 1e-2
    border = np.searchsorted(text_of, np.arange(len(y) + 1))
    weight = len(y) / (2 * np.maximum(np.bincount(y, minlength=2), 1))
    for _ in range(EPOCHS):
        for i in rng.permutation(len(y)):
            idx = slot[border[i] : border[i + 1]]
            vi = v[idx]
            total = vi.sum(axis=0)
            z = w0 + w[idx].sum() + 0.5 * (total @ total - (vi * vi).sum())
            e = weight[y[i]] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[i])
            g0 += e * e
            w0 -= RATE * e / g0**0.5
            if len(idx):
                g = e + SHRINK * w[idx]
                gw[idx] += g * g
                w[idx] -= RATE * g / np.sqrt(gw[idx])
                g = e * (total - vi) + SHRINK * vi
                gv[idx] += g * g
                v[idx] -= RATE * g / np.sqrt(gv[idx])
    return w0 + np.log(prior / (1 - prior)), w, v


def _train_in_task(prior: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (str(r["id"]), r["body"]))
        y = np.array([r["y"] for r in rows], dtype=np.int64)
        if len(set(y.tolist())) < 2:
            return
        parts = [sets([r["body"] for r in rows[k : k + 200]]) for k in range(0, len(rows), 200)]
        text_of = np.concatenate([p[0] + 200 * k for k, p in enumerate(parts)])
        term = np.concatenate([p[1] for p in parts])
        chosen = choose(text_of, term, y)
        kept = np.isin(term, chosen)
        w0, w, v = train(text_of[kept], np.searchsorted(chosen, term[kept]), y, len(chosen), prior)
        columns = [pa.array([x.tobytes()]) for x in (chosen.astype("<i8"), w.astype("<f8"), v.astype("<f8"))]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([float(w0)])], ["terms", "w", "v", "w0"])

    return run


def score_texts(texts: list[bytes], slots: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray) -> np.ndarray:
    text_of, slot = sets(texts, slots)
    n = len(texts)
    z = w0 + np.bincount(text_of, w[slot], minlength=n)
    for f in range(v.shape[1]):
        z += 0.5 * (np.bincount(text_of, v[slot, f], minlength=n) ** 2 - np.bincount(text_of, v[slot, f] ** 2, minlength=n))
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _score(model):
    held = {}

    def run(texts: list[bytes]) -> np.ndarray:
        if not held:
            chosen = np.frombuffer(model["terms"], dtype="<i8")
            slots = np.full(1 << BITS, -1, dtype=np.int16)
            slots[chosen] = np.arange(len(chosen))
            w = np.frombuffer(model["w"], dtype="<f8")
            held["m"] = slots, model["w0"], w, np.frombuffer(model["v"], dtype="<f8").reshape(len(w), FACTORS)
        return score_texts(texts, *held["m"])

    return run


def score(
    docs: DataFrame,
    labels: DataFrame,
    *,
    text: str = "text",
    doc_id: str = "doc_id",
    label: str = "toxic",
    fold: tuple[int, int] = (5, 0),
    sample: int = SAMPLE,
    carry: bool = False,
) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (and `carried`, the whole row).

    Rows whose crc32(doc_id) modulo fold[0] is fold[1] are held out: no label of theirs is learned from. At most `sample`
    labelled rows of each class are learned from. Null and empty texts have no terms and score the constant. Null ids
    are not held out. Rows that repeat an id are scored one by one. Without labels of both classes all texts score the
    share of ones. Empty tables give no rows; other columns are not looked at.
    """
    ship_package(docs.sparkSession)
    parts, hold = fold
    out_of = F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == hold
    prior = share_of_ones(labels, label=label, held_out=out_of)
    rows = labelled_sample(docs, labels, label=label, text=text, doc_id=doc_id, held_out=out_of, most=sample)
    found = rows.repartition(1).mapInArrow(_train_in_task(prior), "terms binary, w binary, v binary, w0 double").first()
    if found is None:
        found = {"terms": b"", "w": b"", "v": b"", "w0": float(np.log(prior / (1 - prior)))}
    model = {k: bytes(found[k]) if k != "w0" else found[k] for k in ("terms", "w", "v", "w0")}
    extra = carried(docs)[:1] if carry else []
    return fold_rows(docs, _score(model), text=text, doc_id=doc_id, held_out=out_of, extra=extra)


def clean(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that are not predicted toxic, with the columns of `docs`."""
    return score(docs, labels, carry=True, **options).where("predicted = 0").select("carried.*")
