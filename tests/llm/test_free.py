"""The other operators and the pipeline: brute force, round trips, held-out accuracy."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash

import corpus_pipeline
from borewatch.llm import language, packing, quality_model, simhash, toxicity, vectors
from borewatch.llm.common import components

FILE = public_tokenizers.path("word_bpe_49k.json")


def fingerprint(text):
    lower = (text or "").encode().lower()
    found = lower.split()
    shingles = [b" ".join(found[i : i + 3]) for i in range(max(1, len(found) - 2))] if found else []
    bits = 0
    for b in range(64):
        if 2 * sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) > len(shingles):
            bits |= 1 << b
    return bits


def grouped(prints):
    """Smallest index reachable by links of 3 bits, by brute force."""
    root = list(range(len(prints)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [top(i) for i in range(len(prints))]


def test_simhash_against_brute_force(docs, rows, no_docs):
    out = simhash.near_duplicates(docs)
    prints = [fingerprint(r.text) for r in rows]
    root = grouped(prints)
    least = defaultdict(list)
    for r, g in zip(rows, root, strict=True):
        least[g].append(r.doc_id)
    want = Counter(
        (r.doc_id, f"{p:016x}", min((i for i in least[g] if i is not None), default=None))
        for r, p, g in zip(rows, prints, root, strict=True)
    )
    assert Counter(map(tuple, out.collect())) == want
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(root))
    assert simhash.near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("few", [32, 0])
def test_links_of_every_distance(spark, monkeypatch, few):
    """Clouds of fingerprints around centres; few = 0 sends all meetings the way of the large ones."""
    monkeypatch.setattr(simhash, "FEW", few)
    rng = random.Random(1)
    prints = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        prints.add(centre)
        for _ in range(25):
            prints.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))))
    prints = sorted(prints)
    root = grouped(prints)
    out = simhash.groups(spark.createDataFrame([(simhash.signed(p),) for p in prints], "fp long")).collect()
    comp = {r.fp: r.comp for r in out}
    assert len(comp) == len(prints)
    pairs = {(root[i], comp[simhash.signed(p)]) for i, p in enumerate(prints)}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 102), (7, 7), (101, 100)]
    got = {r.node: r.component_id for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(51), 0), 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pack_round_trip(docs, rows, no_docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(FILE)
    out = packing.pack(docs, tokenizer=FILE, with_ids=True).collect()
    by_doc = defaultdict(list)
    places = defaultdict(list)
    for r in out:
        assert r.length == len(r.ids) <= 4096
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
        by_doc[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    want = Counter((r.doc_id, tuple(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + (1,)) for r in rows)
    for (doc_id, ids), n in want.items():
        own = sorted((r for r in by_doc[doc_id]), key=lambda r: (r.piece, r.start))
        if doc_id is None:
            continue
        for k in range(0, len(ids), 4096):
            same = [r for r in own if r.piece == k // 4096]
            assert len(same) == n and all(r.ids == list(ids[k : k + 4096]) and r.start == k for r in same)
    assert len(out) == sum(n * -(-len(ids) // 4096) for (_, ids), n in want.items())
    assert packing.pack(no_docs, tokenizer=FILE).count() == 0



def test_runs_of_letters_are_encoded_without_rules_of_case_and_white_space():
    ids, plain = packing.Ids(FILE), packing.PlainIds(FILE)
    assert ids.letters.normalizer is None and ids.tokenizer.normalizer is not None
    texts = ["Pump PUMP pump. Grün, GRÜN grün straße, ñandú Œuvre x2 don't a.b", "À la Façade, ÿ þ Ð.", "", "ab " * 3000]
    assert ids.of(texts) == plain.of(texts) and ids.of(texts[::-1]) == plain.of(texts[::-1])


def test_memory_of_ids_is_the_tokenizer():
    ids = packing.Ids(FILE)
    texts = ["İstanbul Σας ΣΑΣ x\x1cy <|endoftext|> don't 'll ﬁ é", "Ñandú, µ. ..", "", " ", "x\u0301y ＡＢ ǅ.", "a\u00a0b\u3000c"]
    want = [np.array(ids.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert ids.of(texts) == want == ids.of(texts)


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_everything(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 65, 400) if seed else np.array([1])
    counts = dict(zip(*map(np.ndarray.tolist, np.unique(lengths, return_counts=True)), strict=True))
    table, n = packing.plan(counts, 64)
    # a third of these lengths leave no room for another, so the sum alone is no bound that a plan can reach
    assert -(-int(lengths.sum()) // 64) <= n <= sum(k for _, k in packing.best_fit(counts, 64)) + 2
    used, numbers = defaultdict(int), defaultdict(list)
    for length, c in counts.items():
        own = table[table[:, 0] == length]
        for r in range(c):
            row = own[np.searchsorted(own[:, 1], r, "right") - 1]
            inside = r - row[1]
            numbers[row[3] + inside // row[2]].append((row[4] + inside % row[2] * length, length))
    for places in numbers.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert len(numbers) == n and not used


def learnable(spark):
    """English against a made-up tongue; insults make a text toxic only together with a group; rows of signs are poor."""
    rng = random.Random(9)
    en, xx = "the of and river stone winter garden letter".split(), "ola mik tran dova sel pirin kuto".split()
    rows, labels = [], []
    for i in range(900):
        words = rng.choices(en if i % 2 else xx, k=40)
        insult, group, poor = rng.random() < 0.5, rng.random() < 0.5, rng.random() < 0.3
        words += ["rotten"] * insult + ["northerners"] * group
        rng.shuffle(words)
        words = [w + "###" for w in words] if poor else words
        rows.append((i, " ".join(words), "en" if i % 2 else "xx"))
        labels.append((i, 0 if poor else 1, int(insult and group)))
    rows += [(1000, None, "en"), (1001, "", None), (1002, "12 34", "xx"), (None, "the river", "en"), (1, rows[1][1], "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'z' AS score", "1 AS id", "2 AS y")
    labels += [(5, None, None), (None, 1, 1)]
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {r[0]: r for r in labels if r[0] is not None and r[1] is not None}


@pytest.fixture(scope="module")
def taught(spark):
    return learnable(spark)


def test_length_of_shingles(spark):
    """The same shingles of two words in another order: equal by two words, apart by five."""
    texts = ["x a x b x c x d x", "x b x a x d x c x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    apart = {k: len({r.fingerprint for r in simhash.near_duplicates(docs, shingle=k).collect()}) for k in (2, 5)}
    assert apart == {2: 1, 5: 2}
    assert [simhash.deduplicated(docs, shingle=k).count() for k in (2, 5)] == [1, 2]


@pytest.mark.parametrize("which", ["quality", "toxic"])
def test_models_on_held_out_rows(taught, which):
    docs, labels, truth = taught
    parts, hold = ((3, 1) if which == "quality" else (5, 0))
    call = quality_model.classify if which == "quality" else toxicity.score
    out = call(docs, labels).collect()
    assert len(out) == docs.count()
    right = []
    for r in out:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % parts == hold)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        if r.held_out and r.doc_id in truth:
            right.append(r.predicted == truth[r.doc_id][1 if which == "quality" else 2])
    assert len(right) > 100 and np.mean(right) > 0.95
    again = call(docs.repartition(5), labels).collect()
    assert Counter((r.doc_id, round(r.score, 9)) for r in out) == Counter((r.doc_id, round(r.score, 9)) for r in again)
    assert call(docs.limit(0), labels).count() == 0
    assert {round(r.score, 6) for r in call(docs.limit(3), labels.limit(0)).collect()} == {0.5}


def test_language(taught):
    docs, _, _ = taught
    out = {r.doc_id: r for r in language.identify(docs).collect()}
    held = [i for i in range(900) if out[i].held_out]
    assert held == [i for i in range(900) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([out[i].lang_pred == ("en" if i % 2 else "xx") for i in held]) > 0.95
    assert [out[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and out[None].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in out.values())
    assert language.identify(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in language.identify(docs.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")).collect()} == {"und"}


def test_words_of_switched_text_are_labelled():
    texts = [b"the river and stone winter garden " * 20, b"ola mik tran dova sel pirin " * 20] * 10
    table, move = language.train(texts, np.array([0, 1] * 10), 2)
    mixed = [b"the river and stone winter ola mik tran dova sel pirin garden the stone"]
    (owner, p), = language.word_probabilities(mixed, table, move)
    assert p.argmax(axis=1).tolist() == [0] * 5 + [1] * 6 + [0] * 3 and set(owner) == {0}
    assert move[0, 0] > move[0, 1] and np.allclose(p.sum(axis=1), 1, atol=1e-5)


def test_forward_backward_sums_over_all_paths():
    rng = np.random.default_rng(2)
    scores, move = rng.normal(size=(5, 3)).astype(np.float32), np.exp(rng.normal(size=(3, 3))).astype(np.float32)
    import itertools

    want = np.zeros((5, 3))
    for path in itertools.product(range(3), repeat=5):
        weight = np.exp(sum(scores[t, s] for t, s in enumerate(path))) * np.prod([move[a, b] for a, b in itertools.pairwise(path)])
        want[np.arange(5), path] += weight
    got = language.posteriors(np.concatenate([scores, scores[:2]]), np.array([5, 2]), move)
    assert np.allclose(got[:5], want / want.sum(axis=1, keepdims=True), atol=1e-5)


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 64))
    rows = []
    for i in range(700):
        c = centres[i % 30]
        v = c + rng.normal(size=64) * rng.choice([0.02, 0.1, 0.14, 0.3])
        rows.append((i, v.tolist(), int(i % 3)))
    rows += [(700 + i, rows[5][1], rows[5][2]) for i in range(40)]
    odd = [(900, None, 1), (901, [0.0] * 64, 1), (902, [float("nan")] * 64, 1), (903, [None] + [1.0] * 63, 1), (904, [], 1),
           (905, rows[0][1], None), (906, [1.0, 0.0], 0), (None, rows[0][1], 0), (907, [float("inf")] + [1.0] * 63, 1)]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS n", "2 AS rid")
    out = {r.vec_id: r for r in vectors.near_duplicates(frame).collect()}
    assert len(out) == len(rows) + len(odd)
    x = np.array([r[1] for r in rows] + [rows[0][1]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows] + [0])
    ids = [r[0] for r in rows] + [None]
    close = (x @ x.T >= 0.98 - 1e-12) & (label[:, None] == label[None, :])
    np.fill_diagonal(close, False)
    assert close.sum() > 500
    wrong = sum(out[i].n_links != n for i, n in zip(ids, close.sum(axis=1), strict=True))
    assert wrong == 0
    for i in (900, 901, 902, 903, 904, 905, 907):
        assert out[i].n_links == 0 and out[i].component_id == i and out[i].kept
    reach = {i: {i} for i in range(len(ids))}
    for a, b in zip(*np.nonzero(close), strict=True):
        if reach[a] is not reach[b]:
            reach[a] |= reach[b]
            for k in reach[b]:
                reach[k] = reach[a]
    for i, own in reach.items():
        assert out[ids[i]].component_id == min(ids[k] for k in own if ids[k] is not None)
    assert vectors.near_duplicates(frame.limit(0)).count() == 0


def test_pipeline_stages(spark, docs, tmp_path):
    folder = str(tmp_path)
    rng = random.Random(6)
    stems = "the of and to a in that river stone winter garden letter cloud road house tree was is on by".split()
    prose = [(200 + i, ". ".join(" ".join(rng.choices(stems, k=9)) for _ in range(12)), "en", "s0") for i in range(30)]
    prose += [(300, prose[0][1], "en", "s1"), (301, " ".join(["same"] * 80), "en", "s1")]
    plain = spark.createDataFrame(prose, "doc_id long, text string, lang string, source string")
    docs = docs.unionByName(plain, allowMissingColumns=True)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, folder)
        assert now.columns == docs.columns
    out = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in now.collect()}
    kept = {r.doc_id for r in out.collect()}
    assert kept >= set(range(200, 230)) and not kept & {300, 301, 102, 103}


def test_every_language_is_learned(spark):
    """More languages than were learned once, each with words of its own."""
    rng = random.Random(12)
    tongues = [["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 8))) for _ in range(12)] for _ in range(70)]
    rows = [(i, " ".join(rng.choices(tongues[i % 70], k=40)), f"l{i % 70:02}") for i in range(70 * 24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in language.identify(docs).collect()}
    held = [i for i in out if out[i].held_out]
    assert {out[i].lang_pred for i in held} == {f"l{k:02}" for k in range(70)}
    assert np.mean([out[i].lang_pred == f"l{i % 70:02}" for i in held]) > 0.95


def test_training_in_blocks(monkeypatch):
    texts = [b"the river and stone winter garden " * 20, b"ola mik tran dova sel pirin " * 20] * 10
    monkeypatch.setattr(language, "BLOCK_BYTES", 2_000)
    table, move = language.train(texts, np.array([0, 1] * 10), 2)
    (_, p), = language.word_probabilities([b"the river and stone ola mik tran dova"], table, move)
    assert p.argmax(axis=1).tolist() == [0] * 4 + [1] * 4
