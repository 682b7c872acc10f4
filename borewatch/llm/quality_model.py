"""Quality classifier by supervised subword embeddings.

Words, character n-grams and repetitions of a word in a text are hashed to learned vectors; their mean goes through a softmax. The vectors and
the output layer are trained by stochastic gradient descent in numpy, in one task, on a sample of labelled rows whose
size is a parameter. Scoring needs only what each vector adds to the difference of the two outputs, one number a bucket,
so a text costs one table look-up per feature.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from borewatch.llm.terms import IS_SPACE, PRIME, bucket, fold_rows, labelled_sample, share_of_ones, strips, word_hashes, words_of
from borewatch.session import ship_package

BITS, DIM, EPOCHS, RATE = 17, 10, 12, 0.5
NGRAMS = (2, 3, 4)
#: Labelled rows of each class learned from, at most.
SAMPLE = 2500


def features(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the text, bucket) of each feature, strip by strip: words, words after themselves, and n-grams that
    cross no white space but at their ends."""
    for data, owner in strips(texts):
        space = IS_SPACE[data]
        starts, ends = words_of(~space)
        hashes, own = word_hashes(data, starts, ends), owner[starts]
        found = [(own, bucket(hashes, 1, BITS))]
        # a word after itself is a pair of words like any other such pair, so all of them share one vector
        again = own[1:][(hashes[1:] == hashes[:-1]) & (own[1:] == own[:-1])]
        found.append((again, np.zeros(len(again), dtype=np.uint32)))
        codes = data.astype(np.uint32) + np.uint32(1)
        codes[space] = 33
        h, crossed = codes, np.zeros(len(codes), dtype=bool)
        for n in range(2, max(NGRAMS) + 1):
            h = h[:-1] * PRIME + codes[n - 1 :]
            # white space strictly inside
            crossed = crossed[:-1] | space[n - 2 : -1] if n > 2 else space[:-1] & space[1:]
            if n in NGRAMS:
                ok = ~crossed
                found.append((owner[: len(h)][ok], bucket(h[ok], n, BITS)))
        for pair in found:
            yield pair


def counted(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets and shares of each text."""
    parts = list(features(texts))
    owner = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, dtype=np.int64)
    found = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, dtype=np.uint32)
    keys, n = np.unique((owner.astype(np.int64) << BITS) | found, return_counts=True)
    border = np.searchsorted(keys, np.arange(len(texts) + 1) << BITS)
    mask = (1 << BITS) - 1
    return [
        (keys[a:b] & mask, (n[a:b] / max(1, n[a:b].sum())).astype(np.float32))
        for a, b in zip(border[:-1], border[1:], strict=True)
    ]


def train(texts: list[bytes], y: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """What each bucket adds to the log-odds of class 1, and the constant. Classes weigh alike in training; the constant
    restores the share `prior` that class 1 has among all labels."""
    rng = np.random.default_rng(7)
    table = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, 2), dtype=np.float32), np.zeros(2, dtype=np.float32)
    rows = [r for k in range(0, len(texts), 100) for r in counted(texts[k : k + 100])]
    counts = np.bincount(y, minlength=2)
    weight = len(y) / (2 * np.maximum(counts, 1))
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(len(rows)):
            idx, share = rows[i]
            hidden = share @ table[idx]
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            grad = (rate * weight[y[i]] * p).astype(np.float32)
            back = out @ grad
            out -= np.outer(hidden, grad)
            bias -= grad
            # mean features have small gradients; shares relative to the largest keep the step of a text alike
            table[idx] -= np.outer(share / max(float(share.max()), 1e-6), back)
    scores = table @ (out[:, 1] - out[:, 0])
    return scores.astype(np.float32), float(bias[1] - bias[0] + np.log(prior / (1 - prior)))


def _train_in_task(prior: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (str(r["id"]), r["body"]))
        y = np.array([r["y"] for r in rows], dtype=np.int64)
        if len(set(y.tolist())) < 2:
            return
        scores, constant = train([r["body"] for r in rows], y, prior)
        yield pa.RecordBatch.from_arrays([pa.array([scores.tobytes()]), pa.array([constant])], ["scores", "constant"])

    return run


def score_texts(texts: list[bytes], scores: np.ndarray, constant: float) -> np.ndarray:
    sums, n = np.zeros(len(texts)), np.zeros(len(texts))
    for owner, found in features(texts):
        sums += np.bincount(owner, scores[found], minlength=len(texts))
        n += np.bincount(owner, minlength=len(texts))
    return 1 / (1 + np.exp(-np.clip(sums / np.maximum(n, 1) + constant, -40, 40)))


def classify(
    docs: DataFrame,
    labels: DataFrame,
    *,
    text: str = "text",
    doc_id: str = "doc_id",
    label: str = "quality",
    fold: tuple[int, int] = (3, 1),
    sample: int = SAMPLE,
) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Rows whose crc32(doc_id) modulo fold[0] is fold[1] are held out: no label of theirs is learned from. At most
    `sample` labelled rows of each class are learned from. Null and empty texts have no features and score the constant.
    Null ids are not held out. Rows that repeat an id are scored one by one. Without labels of both classes all texts
    score the share of ones. Empty tables give no rows; other columns are not looked at.
    """
    ship_package(docs.sparkSession)
    parts, hold = fold
    out_of = F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == hold
    prior = share_of_ones(labels, label=label, held_out=out_of)
    rows = labelled_sample(docs, labels, label=label, text=text, doc_id=doc_id, held_out=out_of, most=sample)
    model = rows.repartition(1).mapInArrow(_train_in_task(prior), "scores binary, constant double").first()
    if model is None:
        model = {"scores": bytes(4 << BITS), "constant": float(np.log(prior / (1 - prior)))}
    return fold_rows(docs, _score(model), text=text, doc_id=doc_id, held_out=out_of)


def _score(model):
    table, constant = model["scores"], model["constant"]

    def run(texts: list[bytes]) -> np.ndarray:
        return score_texts(texts, np.frombuffer(table, dtype=np.float32), constant)

    return run
