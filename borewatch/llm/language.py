"""Language identification by a linear-chain conditional random field over words.

Each word's score for a language sums learned weights of its hashed features: its beginning and ending, its character
n-grams, and the word itself as a lexicon entry. Learned transitions tie neighbouring words, and forward-backward gives
every word a distribution over the languages, so that a text that switches is labelled piece by piece. Labels of words
are those of their documents; training splices stretches of documents of different languages, so that the transitions
also see switches. A document's language is the one with most of its words' probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from borewatch.llm.common import hexed_share, materialise
from borewatch.llm.terms import IS_LETTER, PRIME, STRIP, TO_LOWER, bucket, strips, word_hashes, words_of
from borewatch.session import ship_package

BITS = 18
NGRAMS, AFFIXES = (2, 3), (1, 2, 3, 4)
#: Documents learned from for each language, on average; documents of all languages, which with many languages leave each
#: fewer, but LEAST_SAMPLE on average; the words in a training chain and in each of its stretches.
SAMPLE, SAMPLE_OF_ALL, LEAST_SAMPLE, CHAIN, STRETCH = 300, 9_600, 20, 48, 16
#: Weights of the feature table: with more than 64 languages it has fewer buckets.
WEIGHTS = 1 << 24
#: Bytes of text whose features are held together in training.
BLOCK_BYTES = 1 << 24
BATCH, EPOCHS, RATE = 128, 2, 0.3
UNKNOWN = "und"
#: Words times languages whose chains run together.
TOGETHER = 1_000_000


def bits_for(n_langs: int) -> int:
    return min(BITS, max(10, (WEIGHTS // max(n_langs, 1)).bit_length() - 1))


def strip_for(n_langs: int) -> int:
    """Bytes of a strip: scores take memory for each word and language."""
    return STRIP if n_langs <= 16 else max(1 << 12, STRIP * 16 // n_langs)


def read(texts: list[bytes], n_langs: int = 1) -> Iterator[tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """Strip by strip: the text of each word, and (word, bucket) of its features in groups. Words are runs of letters."""
    bits = bits_for(n_langs)
    for data, owner in strips(texts, strip_for(n_langs)):
        data = TO_LOWER[data]
        starts, ends = words_of(IS_LETTER[data])
        if not len(starts):
            continue
        word = np.arange(len(starts))
        sizes = ends - starts
        found = [(word, bucket(word_hashes(data, starts, ends), 1, bits))]
        for side, salt in ((1, 10), (-1, 20)):
            h = np.zeros(len(starts), dtype=np.uint32)
            for k in range(max(AFFIXES)):
                at = starts + k if side > 0 else ends - 1 - k
                h = h * PRIME + data[np.clip(at, 0, len(data) - 1)] + np.uint32(1)
                if k + 1 in AFFIXES:
                    own = np.flatnonzero(sizes > k)
                    found.append((own, bucket(h[own], salt + k, bits)))
        codes = data.astype(np.uint32) + np.uint32(1)
        letter = IS_LETTER[data]
        of = np.cumsum(np.bincount(starts, minlength=len(data))) - 1
        h, inside = codes, letter
        for n in range(2, max(NGRAMS) + 1):
            h, inside = h[:-1] * PRIME + codes[n - 1 :], inside[:-1] & letter[n - 1 :]
            if n in NGRAMS:
                at = np.flatnonzero(inside)
                found.append((of[at], bucket(h[at], 30 + n, bits)))
        yield owner[starts], found


def emissions(found: list[tuple[np.ndarray, np.ndarray]], n_words: int, table: np.ndarray) -> np.ndarray:
    """Scores (word, language)."""
    out = np.zeros((n_words, table.shape[1]), dtype=np.float32)
    for word, feature in found:
        if len(word):
            rows = table[feature]
            if len(word) == n_words and word[-1] == n_words - 1:
                out += rows
            else:
                first = np.flatnonzero(np.diff(word, prepend=-1))
                out[word[first]] += np.add.reduceat(rows, first, axis=0)
    return out


def forward_backward(scores: np.ndarray, lengths: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, ...]:
    """Scaled forward and backward messages and likelihoods (word, language) of chains laid one after another.

    move: transition weights exp(t), from row to column. Chains advance together, longest first, so a step touches only
    those that are still running.
    """
    n, s = scores.shape
    order = np.argsort(-lengths, kind="stable")
    first = (np.cumsum(lengths) - lengths)[order]
    size = lengths[order]
    likely = np.exp(scores - scores.max(axis=1, keepdims=True))
    alpha, beta = np.empty((n, s), dtype=np.float32), np.ones((n, s), dtype=np.float32)
    running = np.searchsorted(-size, -np.arange(size[0]), "left") if len(size) else []
    now = likely[first].copy()
    now /= now.sum(axis=1, keepdims=True)
    alpha[first] = now
    for t in range(1, len(running)):
        k = running[t]
        at = first[:k] + t
        now = (now[:k] @ move) * likely[at]
        now /= now.sum(axis=1, keepdims=True)
        alpha[at] = now
    for t in range(len(running) - 1, 0, -1):
        k = running[t]
        at = first[:k] + t
        back = (likely[at] * beta[at]) @ move.T
        beta[at - 1] = back / back.sum(axis=1, keepdims=True)
    return alpha, beta, likely


def posteriors(scores: np.ndarray, lengths: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Probabilities (word, language)."""
    alpha, beta, _ = forward_backward(scores, lengths, move)
    both = alpha * beta
    return both / both.sum(axis=1, keepdims=True)


def _gather(texts: list[bytes], langs: np.ndarray, n_langs: int):
    """(language of each word, features in the order of words, where each word's features begin); none without a word."""
    features, labels, n_words = [], [], 0
    for k in range(0, len(texts), 200):
        for owner, found in read(texts[k : k + 200], n_langs):
            features += [(w + n_words, f) for w, f in found]
            labels.append(langs[owner + k])
            n_words += len(owner)
    if not n_words:
        return None
    gold = np.concatenate(labels)
    word = np.concatenate([f[0] for f in features])
    feature = np.concatenate([f[1] for f in features]).astype(np.int64)
    by_word = np.argsort(word, kind="stable")
    word, feature = word[by_word], feature[by_word]
    border = np.searchsorted(word, np.arange(n_words + 1))
    return gold, feature, border


def _blocks(texts: list[bytes], rng) -> list[np.ndarray]:
    """Numbers of texts in blocks of BLOCK_BYTES, dealt out so that each has all languages; one block if they fit."""
    sizes = np.array([len(x) for x in texts], dtype=np.int64)
    n = int(-(-sizes.sum() // BLOCK_BYTES))
    return [np.arange(len(texts))] if n <= 1 else np.array_split(rng.permutation(len(texts)), n)


def train(texts: list[bytes], langs: np.ndarray, n_langs: int):
    """Feature table and transition weights: likelihood ascent with adaptive steps."""
    rng = np.random.default_rng(5)
    table = np.zeros((1 << bits_for(n_langs), n_langs), dtype=np.float32)
    power = np.full((1 << bits_for(n_langs), n_langs), 1e-2, dtype=np.float32)
    moves, m_power = np.zeros((n_langs, n_langs)), np.full((n_langs, n_langs), 1.0)
    blocks = _blocks(texts, rng)
    found = None
    for _ in range(EPOCHS):
        for block in blocks:
            if found is None or len(blocks) > 1:
                found = _gather([texts[i] for i in block], langs[block], n_langs)
            if found is None:
                continue
            gold, feature, border = found
            n_words = len(gold)
            stretches = np.arange(0, n_words - STRETCH + 1, STRETCH) if n_words >= STRETCH else np.array([0])
            width = min(STRETCH, n_words)
            per_chain = CHAIN // STRETCH
            dealt = rng.permutation(stretches)
            dealt = dealt[: max(per_chain, len(dealt) // per_chain * per_chain)]
            if len(dealt) < per_chain:
                dealt = np.resize(dealt, per_chain)
            chains = dealt.reshape(-1, per_chain)
            for k in range(0, len(chains), BATCH):
                own = (chains[k : k + BATCH, :, None] + np.arange(width)).reshape(len(chains[k : k + BATCH]), -1)
                flat = own.ravel()
                sizes = border[flat + 1] - border[flat]
                inner = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                f = feature[np.repeat(border[flat], sizes) + inner]
                of = np.repeat(np.arange(len(flat)), sizes)
                scores = np.stack([np.bincount(of, table[f, s], minlength=len(flat)) for s in range(n_langs)], axis=1)
                move = np.exp(moves)
                length = np.full(len(own), own.shape[1])
                alpha, beta, likely = forward_backward(scores.astype(np.float32), length, move.astype(np.float32))
                miss = alpha * beta
                miss /= miss.sum(axis=1, keepdims=True)
                miss[np.arange(len(flat)), gold[flat]] -= 1
                used, place = np.unique(f, return_inverse=True)
                grad = np.stack([np.bincount(place, miss[of, s], minlength=len(used)) for s in range(n_langs)], axis=1)
                power[used] += grad**2
                table[used] -= RATE * grad / np.sqrt(power[used])
                # pairs of neighbours: expected against seen
                a, b = (x.reshape(len(own), -1, n_langs) for x in (alpha, likely * beta))
                y = gold[flat].reshape(len(own), -1)
                left, right = a[:, :-1].reshape(-1, n_langs), b[:, 1:].reshape(-1, n_langs)
                whole = ((left @ move) * right).sum(axis=1, keepdims=True)
                seen = np.bincount(y[:, :-1].ravel() * n_langs + y[:, 1:].ravel(), minlength=n_langs**2).reshape(n_langs, n_langs)
                g = (move * ((left / whole).T @ right) - seen) / y.size
                m_power += g**2
                moves -= RATE * g / np.sqrt(m_power)
    return table, np.exp(moves)


def _train_in_task(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (str(r["id"]), r["body"]))
        langs = np.array([names.index(r["lang"]) for r in rows], dtype=np.int64)
        table, move = train([r["body"] for r in rows], langs, len(names))
        columns = [pa.array([x.astype("<f4").tobytes()]) for x in (table, move)]
        yield pa.RecordBatch.from_arrays(columns, ["features", "move"])

    return run


def word_probabilities(texts: list[bytes], table: np.ndarray, move: np.ndarray):
    """Yields (text of each word, probabilities of its languages), word by word in order, for runs of whole strips.

    A text longer than a strip is a chain for each of its strips.
    """
    held, n = [], 0
    for owner, found in read(texts, table.shape[1]):
        held.append((owner, emissions(found, len(owner), table)))
        n += len(owner)
        if n * table.shape[1] >= TOGETHER:
            yield _run(held, move)
            held, n = [], 0
    if held:
        yield _run(held, move)


def _run(held, move):
    owner = np.concatenate([o for o, _ in held])
    border = np.flatnonzero(np.diff(owner, prepend=-1))
    lengths = np.diff(np.append(border, len(owner)))
    return owner, posteriors(np.concatenate([e for _, e in held]), lengths, move)


def label_texts(texts: list[bytes], table: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Summed word probabilities (text, language)."""
    out = np.zeros((len(texts), table.shape[1]))
    for owner, p in word_probabilities(texts, table, move):
        for s in range(table.shape[1]):
            out[:, s] += np.bincount(owner, p[:, s], minlength=len(texts))
    return out


def has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def learn(
    docs: DataFrame, *, text: str, doc_id: str, lang: str, held_out, sample: int, sample_of_all: int
) -> tuple[list[str], dict]:
    """Languages and model from about `sample` documents of each language outside the held-out fold, drawn by a hash of id
    and text.

    All languages are learned, from one document at least; where there are many, from fewer documents of each.
    """
    usable = docs.where(~F.coalesce(held_out, F.lit(True)) & F.col(lang).isNotNull())
    counts = usable.groupBy(F.col(lang).alias("lang")).agg(F.count("*").alias("n"))
    counts = counts.collect()
    names = sorted(r["lang"] for r in counts)
    if not names:
        return [UNKNOWN], {"features": b"", "move": b""}
    sample = min(sample, max(LEAST_SAMPLE, sample_of_all // len(names)))
    # a row for each language
    chances = usable.sparkSession.createDataFrame([(r["lang"], min(1.0, sample / r["n"])) for r in counts], "lang string, chance double")
    body = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    every = usable.select(F.col(doc_id).alias("id"), F.col(lang).alias("lang"), body.alias("body"))
    # by id and text: rows that share an id are drawn apart, equal rows count once
    every = every.withColumn("draw", hexed_share(F.concat_ws(":", "id", F.md5("body")), "language"))
    drawn = every.join(F.broadcast(chances), "lang").where("draw < chance")
    rows = materialise(drawn.groupBy("lang", "id", "draw").agg(F.min_by("body", F.xxhash64("body")).alias("body")))
    missing = sorted(set(names) - {r["lang"] for r in rows.select("lang").distinct().collect()})
    if missing:
        least = every.where(F.col("lang").isin(missing)).groupBy("lang").agg(F.min_by(F.struct("id", "draw", "body"), "draw").alias("r"))
        rows = rows.unionByName(least.select("lang", "r.*"))
    rows = rows.drop("draw")
    model = rows.repartition(1).mapInArrow(_train_in_task(names), "features binary, move binary").first()
    if model is None:
        return names, {"features": b"", "move": b""}
    return names, {k: bytes(model[k]) for k in ("features", "move")}


def _predict(names: list[str], model: dict):
    def arrays():
        s = len(names)
        if not model["features"]:
            return np.zeros((1 << bits_for(s), s), dtype=np.float32), np.ones((s, s), dtype=np.float32)
        table, move = (np.frombuffer(model[k], dtype="<f4") for k in ("features", "move"))
        return table.reshape(-1, s), move.reshape(s, s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = arrays()
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                texts = part.column("body").to_pylist()
                sums = label_texts(texts, *own)
                total = sums.sum(axis=1)
                best = sums.argmax(axis=1)
                known = [t > 0 and has_letter(x) for t, x in zip(total.tolist(), texts, strict=True)]
                share = np.where(known, sums[np.arange(len(texts)), best] / np.maximum(total, 1e-9), 0.0)
                found = [names[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), known, strict=True)]
                kept = [c for c in part.schema.names if c != "body"]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in kept), pa.array(found, pa.string()), pa.array(np.clip(share, 0.0, 1.0))],
                    [*kept, "lang_pred", "score"],
                )

    return run


def identify(
    docs: DataFrame,
    *,
    text: str = "text",
    doc_id: str = "doc_id",
    lang: str = "lang",
    fold: tuple[int, int] = (4, 2),
    sample: int = SAMPLE,
    sample_of_all: int = SAMPLE_OF_ALL,
) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (the share of its words' probability).

    Documents whose crc32(doc_id) modulo fold[0] is fold[1] are held out and not learned from; of the others, about
    `sample` of each language are, or fewer where that makes more than `sample_of_all`, but every language is learned.
    Null texts, and texts without a letter, are `und` with score 0. Null ids are not held out and not learned from. Rows
    that repeat an id are labelled one by one. With nothing to learn from, all are `und`. Empty tables give no rows;
    other columns are not looked at.
    """
    ship_package(docs.sparkSession)
    parts, hold = fold
    out_of = F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == hold
    names, model = learn(docs, text=text, doc_id=doc_id, lang=lang, held_out=out_of, sample=sample, sample_of_all=sample_of_all)
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.coalesce(out_of, F.lit(False)).alias("held_out"),
        F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("body"),
    )
    schema = rows.drop("body").schema.add("lang_pred", T.StringType()).add("score", T.DoubleType())
    return rows.mapInArrow(_predict(names, model), schema)
