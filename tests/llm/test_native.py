"""Mixing, quality rules, sharding and URL filters against plain Python."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from borewatch.llm import mixing, quality_rules, sharding, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def found(text):
    return WORD.findall(text or "")


def test_mix_targets_and_epochs(docs, rows):
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    sizes = Counter()
    for r in rows:
        sizes[r.source] += len(found(r.text))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    # the rule as stated: share by weight, cut, share the excess anew
    budget, cut = 1.5 * sum(sizes.values()), {}
    while True:
        left = {s: w for s, w in weights.items() if s not in cut}
        rest = budget - sum(cut.values())
        shares = {s: rest * w / sum(left.values()) for s, w in left.items()}
        over = [s for s in left if shares[s] >= 2 * sizes[s]]
        if not over:
            break
        cut |= {s: 2.0 * sizes[s] for s in over}
    want = cut | shares
    taken = Counter()
    for r in out:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert r.taken == r.copies * r.size <= 2 * r.size
        taken[r.source] += r.taken
    for s in order:
        largest = max(r.size for r in out if r.source == s)
        assert abs(taken[s] - want[s]) <= largest / 2 + 1
        copies = [r.copies for r in out if r.source == s]
        assert max(copies) - min(copies) <= 1, "whole epochs come first"
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(docs).collect()))


def test_mixed_rows_keep_their_columns(docs, no_docs):
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    copies = Counter((r.doc_id, r.text) for r in out.collect())
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r.doc_id] += r.copies
    got = Counter()
    for (doc_id, _), n in copies.items():
        got[doc_id] += n
    assert got == +want
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed(no_docs).count() == 0


def base(text):
    w = found(text)
    at = defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i : i + 3])].append(i)
    repeated = {k for places in at.values() if len(places) > 1 for i in places for k in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if found(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated)


def test_quality_base_rules(docs, rows):
    got = Counter()
    for r in quality_rules.assess(docs).collect():
        got[(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)] += 1
        assert not (r.base_failed and r.kept)
    want = Counter()
    for r in rows:
        b = base(r.text)
        want[(r.doc_id, *b, b[0] < 50 or 100 * b[4] > 50 * b[0])] += 1
    assert got == want


def test_quality_divergence(spark, no_docs):
    import random

    rng = random.Random(3)
    stems = "the of and to a in that river stone winter garden letter cloud road house tree".split()
    rows = [(i, ". ".join(" ".join(rng.choices(stems, k=12)).capitalize() for _ in range(8)), "en") for i in range(40)]
    rows.append((100, " ".join(f"{w}$$$###" for w in rng.choices(stems, k=90)), "en"))
    rows.append((101, " ".join(w.upper() + "!!" for w in rng.choices(stems, k=90)), "en"))
    out = {r.doc_id: r for r in quality_rules.assess(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(out[i].kept for i in range(40))
    assert not out[100].kept and not out[100].base_failed and not out[101].kept

    def hist(text):
        n = [0] * 7
        for c in text:
            if not c.isspace():
                n[0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if c in ".,;:'\"()-" else 4 if c in "!?" else 5 if c in "#*$%&|<>@^~_=+\\/{}[]" else 6] += 1
        return [x / sum(n) for x in n]

    usable = [hist(t) for i, t, _ in rows if not out[i].base_failed]
    ref = [sum(h[k] for h in usable) / len(usable) for k in range(7)]
    for i, text, _ in rows:
        p = hist(text)
        js = sum(x * math.log2(2 * x / (x + y)) for x, y in zip(p, ref, strict=True) if x) + sum(
            y * math.log2(2 * y / (x + y)) for x, y in zip(p, ref, strict=True) if y
        )
        assert out[i].class_distance == pytest.approx(math.sqrt(js / 2), abs=1e-9)
    assert quality_rules.assess(no_docs).count() == 0


def sentences(rng, words, n):
    return ". ".join(" ".join(rng.choices(words, k=12)).capitalize() for _ in range(n)) + "."


def test_quality_word_soup(spark):
    import random

    rng = random.Random(4)
    rare = [f"{a}{b}" for a in ("river", "stone", "winter", "cloud", "garden") for b in ("y", "er", "let", "ing", "ful", "less")]
    common = "the of and to a in that is was for it with as on be at".split()
    rows = [(i, sentences(rng, common * 3 + rare, 8 + i), "en") for i in range(60)]
    rows += [(100 + k, sentences(rng, rare, 8 + 10 * k), "en") for k in range(4)]
    out = {r.doc_id: r for r in quality_rules.assess(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(out[i].kept for i in range(60))
    for i in range(100, 104):
        assert not out[i].base_failed and out[i].class_distance < 0.2 and not out[i].kept

    # the words' half a second time: common words by the share of each text, distances, the bare one, the limit
    mass = Counter()
    split = {i: found(t) for i, t, _ in rows}
    for w in split.values():
        if len(w) >= 50:
            for x in w:
                mass[x] += 10**9 // len(w)
    listed = sorted((x for x in mass if len(x.encode()) <= 24 and re.search("[^\\W\\d_]", x)), key=lambda x: (-mass[x], x))[:16]

    def shares(w):
        n = Counter(w)
        return [n[x] / len(w) for x in listed] + [sum(k for x, k in n.items() if x not in listed) / len(w)]

    def js(p, q):
        return math.sqrt(max(0.0, sum(a * math.log2(2 * a / (a + b)) for x, y in zip(p, q) for a, b in ((x, y), (y, x)) if a) / 2))

    usable = [shares(w) for i, w in split.items() if not out[i].base_failed and sum(map(len, w)) >= 100]
    ref = [sum(u[k] for u in usable) / len(usable) for k in range(17)]
    bare = js([0.0] * 16 + [1.0], ref)
    for i, w in split.items():
        distance = js(shares(w), ref)
        assert out[i].word_distance == pytest.approx(distance, abs=1e-9)
        too_far = distance**2 > (0.6 * bare) ** 2 + 16 / (8 * math.log(2) * len(w))
        assert out[i].kept == (not out[i].base_failed and not too_far and out[i].class_distance <= 0.3)


def test_quality_of_other_languages(spark):
    """Languages without any list beforehand, a script without case, and no language; soup of each, and a rare tongue."""
    import random

    rng = random.Random(5)
    latin = "ja on ei se että hän oli mutta niin kun mitä sitä tai vain jos sen".split()
    rare = [f"{a}{b}" for a in ("talo", "kivi", "joki", "pilvi", "metsä") for b in ("ssa", "lla", "n", "t", "sta", "lle")]
    arabic = "في من على أن إلى كان هذا التي عن مع قد لم هو بعد ما كل".split()
    nouns = [a + b for a in ("كتاب", "نهر", "بيت", "شجرة", "طريق") for b in ("نا", "هم", "كم", "ها", "ية", "ون")]
    rows = []
    for i in range(40):
        rows.append((i, sentences(rng, latin * 3 + rare, 10 + i), "fi"))
        rows.append((100 + i, sentences(rng, arabic * 3 + nouns, 10 + i), "ar"))
        rows.append((200 + i, sentences(rng, latin * 3 + rare, 10 + i), None))
        rows.append((300 + i, sentences(rng, arabic * 3 + nouns, 10 + i), None))
    rows += [(400 + i, sentences(rng, arabic, 10), "rare") for i in range(3)]
    rows += [(500, sentences(rng, rare, 40), "fi"), (501, sentences(rng, nouns, 40), "ar")]
    rows += [(502, " ".join(w + "$$$###" for w in rng.choices(latin, k=200)), None)]
    out = {r.doc_id: r for r in quality_rules.assess(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(r.kept for i, r in out.items() if i < 500)
    assert out[400].class_distance is None and out[200].word_distance is None
    assert not any(out[i].kept or out[i].base_failed for i in (500, 501, 502))


def test_kept_rows_keep_their_columns(docs):
    assert quality_rules.kept(docs).columns == docs.columns


def test_shards(docs, rows, no_docs):
    out = sharding.shards(docs, n_shards=4).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == want
    total, largest = sum(r.size for r in out), max(r.size for r in out)
    for shard in range(4):
        own = [r for r in out if r.shard == shard]
        assert abs(sum(r.size for r in own) - total / 4) <= largest
        assert sorted(r.slot for r in own) == list(range(len(own)))
    assert sharding.shards(no_docs).count() == 0


def test_shards_with_a_hot_text(spark):
    rows = [(i, "one text that a third of all rows share" if i % 3 == 0 else f"text number {i}") for i in range(3000)]
    out = sharding.shards(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sizes = Counter()
    for r in out:
        sizes[r.shard] += r.size
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r.size for r in out)


def test_written_shards(docs, rows, tmp_path, spark):
    plan = sharding.write_shards(docs, str(tmp_path / "out"), n_shards=3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((r.doc_id, r.text) for r in rows)
    assert {(r.shard, r.slot) for r in back.collect()} == {(r.shard, r.slot) for r in plan.collect()}


PAGES = [
    (1, "https://Example.COM/en/x?q=/fr/"), (2, "http://www.example.com/en/"), (3, "http://a.example.com/de/1#top"),
    (4, "http://x.net/es/1"), (5, "http://x.net/fr"), (6, None), (7, "no scheme /en/"), (8, "http://m.casino-win.example.org/1"),
    (9, "http://notcasino.org/"), (10, "http://com"), (11, "http://example.com:80/en/"), (12, "http://a.org/search?x=1&q=2"),
    (8, "http://m.casino-win.example.org/1"), (None, "http://free-bets.org"), (13, "a://b.net/es/c://d.com/en/"), (14, "http://o.org/a.zip"),
]


def judged(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        host = host.translate({c: c + 32 for c in range(65, 91)})
    fits = [(len(h + p), h + p, v) for h, p, v in urls.HOST_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        _, rule, verdict = max(fits)
        return host, path, rule, verdict
    hit = next((p for p in urls.PATTERNS if url and re.search(p.regex, url.lower())), None)
    return host, path, None, hit.verdict if hit else "allow"


def test_urls(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string").selectExpr("*", "'x' AS host", "1 AS rule", "'y' AS token")
    got = Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages).collect())
    assert got == Counter((i, *judged(u)) for i, u in PAGES)
    assert urls.judge(pages.limit(0)).count() == 0


def test_patterns_hold_their_literals():
    urls_held = ["http://x.casino.com/", "http://free-bets.org", "http://a.org/p?aff_id=1", "http://a.org/p?affiliate_id=1",
                 "http://a.org/search?q=1", "http://cheap-pills-x.de", "http://a.org/cart/add/", "http://a.org/checkout/step?",
                 "http://a.org/x.zip", "http://a.org/x.7z?a"]
    hit = set()
    for url in urls_held:
        tokens = set(re.split("[^a-z0-9]+", url))
        for p in urls.PATTERNS:
            if re.search(p.regex, url):
                hit.add(p.name)
                assert any(set(w) <= tokens for w in p.ways)
    assert {"cart", "archive", "affiliate-link", "search-page"} <= hit


def test_rules_from_a_table_run_where_their_token_stands(spark):
    n = 3000
    rows = [(i, f"brand{i}", rf"://([^/?#]*[.\-])?brand{i}-(shop|store)[.\-]", "block", [[f"brand{i}", "shop"], [f"brand{i}", "store"]])
            for i in range(n)]
    rules = spark.createDataFrame(rows, urls.RULES).withColumn("note", F.lit("x"))
    found = [f"http://brand{i}-{'shop' if i % 2 else 'store'}.example.org/p{i}" for i in range(0, n, 7)]
    found += [f"http://shop.org/store/brand{i}" for i in range(0, n, 11)] + ["http://shop.org/", "nothing", None]
    pages = spark.createDataFrame(list(enumerate(found)), "page_id long, url string")
    out = {r.page_id: r for r in urls.judge(pages, patterns=rules, host_rules=()).collect()}
    for i, url in enumerate(found):
        name = re.search(r"//(brand\d+)-(?:shop|store)\.", url or "")
        assert out[i].pattern == (name[1] if name else None) and out[i].verdict == ("block" if name else "allow")
    distinct = pages.where("url is not null").select("url").distinct()
    run = urls.candidates(distinct, urls.pattern_index(distinct, urls.pattern_table(spark, rules)))
    per_url = Counter(r.url for r in run.collect())
    assert max(per_url.values()) == 1, "one of 3,000 expressions runs on a URL"
    for bad in ([], [["a"], []], None):
        with pytest.raises(ValueError, match="without a literal"):
            urls.judge(pages, patterns=spark.createDataFrame([(1, "all", ".", "block", bad)], urls.RULES))
