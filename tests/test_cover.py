"""Stems against published pairs and a letter by letter form; cover density against all spans."""

import itertools
import random

import pytest

from borewatch.functions.stem import stem_of, with_stems
from borewatch.operators import cover
from borewatch.operators.retrieval import lexical_limit

# Published pairs of the algorithm.
PAIRS = """consign consign consigned consign consignment consign consistency consist consisting consist consolation consol
consolatory consolatori consolidating consolid conspiracy conspiraci constable constabl constancy constanc knack knack
knackeries knackeri knaves knave kneeling kneel knightly knight knitting knit knots knot knowingly know happy happi
sky sky skies sky dying die news news inning inning proceed proceed exceeding exceed generate generat general general
generically generic generous generous communism communism arsenal arsenal agreed agre feed feed hopping hop hoping hope
falling fall luxuriated luxuri cries cri ties tie gas gas gaps gap kiwis kiwi say say cry cri by by relational relat
conditional condit rational ration operator oper feudalism feudal hopefulness hope triplicate triplic electrical electr
adoption adopt controlling control rolling roll probate probat pumps pump pumping pump pumped pump monitored monitor
beautifully beauti replacement replac analogi analog youth youth boy boy boyish boyish bliss bliss at at""".split()


def by_letters(word):
    """The same algorithm, letter by letter."""
    whole = dict(zip("skis skies dying lying tying idly gently ugly early only singly sky news howe atlas cosmos bias andes".split(),
                     "ski sky die lie tie idl gentl ugli earli onli singl sky news howe atlas cosmos bias andes".split()))
    if word in whole:
        return whole[word]
    if len(word) <= 2:
        return word
    w = list(word)
    for i, c in enumerate(w):
        if c == "y" and (i == 0 or w[i - 1] in "aeiouy"):
            w[i] = "Y"
    w = "".join(w)
    vowel = set("aeiouy")

    def region(start):
        for i in range(start + 1, len(w)):
            if w[i] not in vowel and w[i - 1] in vowel and i - 1 >= start:
                return i + 1
        return len(w)

    p1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None) or region(0)
    p2 = region(p1)

    def short(s):
        if len(s) == 2:
            return s[0] in vowel and s[1] not in vowel
        return len(s) > 2 and s[-3] not in vowel and s[-2] in vowel and s[-1] not in vowel and s[-1] not in "wxY"

    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in vowel for c in w[:-2]):
        w = w[:-1]
    if w in ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"):
        return w
    for s in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if w.endswith(s):
            stem = w[: -len(s)]
            if s in ("eedly", "eed"):
                w = stem + "ee" if len(stem) >= p1 else w
            elif any(c in vowel for c in stem):
                if stem.endswith(("at", "bl", "iz")):
                    w = stem + "e"
                elif stem[-2:] in ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"):
                    w = stem[:-1]
                else:
                    w = stem + "e" if p1 >= len(stem) and short(stem) else stem
            break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in vowel:
        w = w[:-1] + "i"
    two = dict(tional="tion", enci="ence", anci="ance", abli="able", entli="ent", izer="ize", ization="ize", ational="ate",
               ation="ate", ator="ate", alism="al", aliti="al", alli="al", fulness="ful", ousli="ous", ousness="ous",
               iveness="ive", iviti="ive", biliti="ble", bli="ble", fulli="ful", lessli="less", ogi="og", li="")
    three = dict(tional="tion", ational="ate", alize="al", icate="ic", iciti="ic", ical="ic", ful="", ness="", ative="")
    four = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()
    for s in sorted(two, key=len, reverse=True):
        if w.endswith(s):
            before = w[: -len(s)][-1:]
            if len(w) - len(s) >= p1 and (s != "ogi" or before == "l") and (s != "li" or (before and before in "cdeghkmnrt")):
                w = w[: -len(s)] + two[s]
            break
    for s in sorted(three, key=len, reverse=True):
        if w.endswith(s):
            if len(w) - len(s) >= (p2 if s == "ative" else p1):
                w = w[: -len(s)] + three[s]
            break
    for s in sorted(four, key=len, reverse=True):
        if w.endswith(s):
            if len(w) - len(s) >= p2 and (s != "ion" or w[: -len(s)][-1:] in ("s", "t")):
                w = w[: -len(s)]
            break
    if w.endswith("e") and (len(w) - 1 >= p2 or (len(w) - 1 >= p1 and not short(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= p2:
        w = w[:-1]
    return w.replace("Y", "y")


def stems(spark, words):
    df = with_stems(spark.createDataFrame([(w,) for w in words], "word string"), "word")
    return {r["word"]: r["stem"] for r in df.collect()}


def test_published_stems(spark):
    pairs = dict(zip(PAIRS[::2], PAIRS[1::2]))
    assert stems(spark, list(pairs)) == pairs
    assert {w: by_letters(w) for w in pairs} == pairs


def test_stems_of_random_words(spark):
    rng = random.Random(1)
    ends = "s ies ied sses us eed eedly ing ingly ed edly y ational ization li ogi bli alize ative ful ness ement ion e l ll".split()
    words = {"".join(rng.choices("aeioubcdglmnprsty", k=rng.randrange(1, 7))) + "".join(rng.sample(ends, rng.randrange(0, 3))) for _ in range(4000)}
    words |= {"a-b", "well-7/3", "15_9-f-12", "y", "yy", "ayay", "crying", "1ying"}
    assert stems(spark, sorted(words)) == {w: by_letters(w) for w in words}
    assert stems(spark, [None, ""]) == {None: None, "": ""}


def covers(places, terms):
    """Score from every span that holds all terms and no smaller one that does."""
    entries = sorted(places)
    spans = []
    for i, j in itertools.combinations_with_replacement(range(len(entries)), 2):
        if {t for _, t in entries[i : j + 1]} == set(range(terms)):
            spans.append((i, j))
    least = [s for s in spans if not any(o != s and s[0] <= o[0] and o[1] <= s[1] for o in spans)]
    return round(sum(0.1 / (1 + entries[j][0] - entries[i][0] - (j - i)) for i, j in least), 9)


def test_cover_density_equals_all_spans(spark):
    rng = random.Random(3)
    words = "pump pumps pumping pressure pressures drop drops water well wells failing failed the of gauge".split()
    texts = [" ".join(rng.choices(words, k=rng.randrange(1, 40))) for _ in range(80)] + ["", "the of"]
    chunks = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "document_id long, chunk_index int, content string")
    asks = [(1, "Pumped pressure"), (2, "pump"), (3, "failed pumps of the wells dropping"), (4, "the of"),
            (5, "pressure zebra unheard"), (6, "Pumped pressure"), (7, ""), (8, "gauges gauge")]
    queries = spark.createDataFrame(asks, "query_id long, query string")
    index = cover.positional_index(chunks.repartition(3))
    out = cover.cover_density_top_k(queries, index, 1000).collect()
    stem = {w: by_letters(w) for w in words} | {w: by_letters(w) for w in "pumped dropping gauges".split()}

    def wanted(level, terms):
        found = {}
        for i, t in enumerate(texts):
            entries = [(p, terms.index(stem[w])) for p, w in enumerate(t.split()) if stem[w] in terms]
            if {e[1] for e in entries} == set(range(len(terms))):
                found[i] = (level, covers(entries, len(terms)))
        return found

    got = {q: {} for q, _ in asks}
    for r in out:
        got[r["query_id"]][r["document_id"]] = (r["level"], r["score"])
    assert got[1] == got[6] == wanted(0, ["pump", "pressur"])
    assert got[2] == wanted(0, ["pump"])
    assert got[3] == (wanted(0, ["fail", "pump", "well", "drop"]) or got[3])
    assert got[4] == got[7] == {}
    # no chunk has all words, none the longest ("unheard"): the next that any chunk holds is asked for alone
    assert got[5] == wanted(2, ["pressur"])
    assert got[8] == wanted(0, ["gaug"])
    ranks = sorted((r["rank"], -r["score"]) for r in out if r["query_id"] == 1)
    assert [s for _, s in ranks] == sorted(s for _, s in ranks)
    best = cover.cover_density_top_k(queries, index, 3).where("query_id = 1").collect()
    assert sorted(r["rank"] for r in best) == [1, 2, 3]
    assert lexical_limit(3) == 27


def test_first_terms_has_a_form_without_limit(spark):
    words = [f"term{i}x" for i in range(20)]
    chunks = spark.createDataFrame([(1, 0, " ".join(words)), (2, 0, " ".join(words[:14]))], "document_id long, chunk_index int, content string")
    queries = spark.createDataFrame([(1, " ".join([*words, "q7"]))], "query_id long, query string")
    index = cover.positional_index(chunks)
    cut = cover.cover_density_top_k(queries, index, 10).collect()
    whole = cover.cover_density_top_k(queries, index, 10, first_terms=None).collect()
    assert sorted((r["document_id"], r["level"]) for r in cut) == [(1, 1), (2, 1)]
    assert [(r["document_id"], r["level"]) for r in whole] == [(1, 1)]


@pytest.mark.parametrize("entries, terms, score", [([(0, 0)], 1, 0.1), ([(0, 0), (1, 1)], 2, 0.1), ([(0, 0), (5, 1)], 2, 0.02)])
def test_spans_by_hand(entries, terms, score):
    assert covers(entries, terms) == pytest.approx(score)


def test_stems_of_single_words_are_those_of_the_column(spark):
    draw = random.Random(3)
    ends = "ational tional izer fulli ogi logi li ousli ative ical ness ion sion ement ate e ll le s ies ied eed eedly ing ingly ed y yes".split()
    words = {"".join(draw.choices("abeilnorsty", k=draw.randint(0, 6))) + draw.choice(ends) for _ in range(3000)} | set(PAIRS) | {"a1-b_s", "x/y"}
    rows = with_stems(spark.createDataFrame([(w,) for w in sorted(words)], "term string"), "term").collect()
    assert all(stem_of(r["term"]) == r["stem"] for r in rows)


def test_places_are_shuffled_only_for_shared_keys(spark):
    schema = "document_id STRING, chunk_index INT, content STRING"
    rows = [("a", 0, "Pumps the pumping sand"), ("b", 0, None), ("c", 0, "the")]
    index = cover.positional_index(spark.createDataFrame(rows, schema))
    assert "Exchange" not in index._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in index.collect()) == [("a", 0, "pump", [0, 2]), ("a", 0, "sand", [3])]
    rows += [("d", 0, "sand pump"), ("d", 0, "pump sand pumped"), (None, 0, "gas"), (None, 0, "gas")]
    both = {(r[0], r[2], tuple(r[3])) for r in cover.positional_index(spark.createDataFrame(rows, schema).repartition(4)).collect()}
    assert {x for x in both if x[0] not in ("a",)} == {("d", "pump", (0, 1, 2)), ("d", "sand", (0, 1)), (None, "gas", (0, 0))}
