"""English stems by the published second Porter algorithm, as column expressions.

Meant for a vocabulary, one row per distinct word, rather than for every occurrence.  `stem_of` is the same for a single
word, for tasks that read whole texts and remember the words they have met.
Words are lower-case; digits, hyphens and letters outside a-z count as non-vowels.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Suffixes of steps 2, 3 and 4, longest first, with what replaces them, and whole words apart from the rules.
STEP_2 = (
    ("ational", "ate"), ("ization", "ize"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"),
    ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"),
    ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"),
    ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"),
    ("bli", "ble"), ("ogi", "og"), ("li", ""),
)
STEP_3 = (
    ("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""),
    ("ical", "ic"), ("ness", ""), ("ful", ""),
)
STEP_4 = (
    "ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion",
    "al", "er", "ic",
)
WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe",
    "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
AFTER_PLURALS = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
REGION_WORDS = "gener|commun|arsen"
SHORT_END = "([^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$"


def _cut(word: Column, n: int, put: str = "") -> Column:
    rest = F.left(word, F.length(word) - n)
    return F.concat(rest, F.lit(put)) if put else rest


def _behind(word: Column, suffix: str, start: Column) -> Column:
    """The suffix lies in the region that begins at `start`."""
    return F.length(word) - len(suffix) >= start


def _regions(word: Column) -> tuple[Column, Column]:
    """Lengths of what stands before the two regions: up to the first non-vowel behind a vowel, and again behind that."""
    pair = "^.*?[aeiouy][^aeiouy]"
    known = F.length(F.regexp_extract(word, f"^({REGION_WORDS})", 0))
    found = F.length(F.regexp_extract(word, pair, 0))
    first = F.when(known > 0, known).when(found > 0, found).otherwise(F.length(word))
    more = F.length(F.regexp_extract(F.substring(word, first + 1, F.length(word)), pair, 0))
    return first, F.when(more > 0, first + more).otherwise(F.length(word))


def _plurals(w: Column) -> Column:
    return (
        F.when(w.endswith("sses"), _cut(w, 2))
        .when(w.rlike("(ied|ies)$"), F.when(F.length(w) > 4, _cut(w, 2)).otherwise(_cut(w, 1)))
        .when(w.rlike("(us|ss)$"), w)
        .when(w.rlike("[aeiouy].+s$"), _cut(w, 1))
        .otherwise(w)
    )


def _past(w: Column, p1: Column) -> Column:
    def mended(stem: Column) -> Column:
        return (
            F.when(stem.rlike("(at|bl|iz)$"), F.concat(stem, F.lit("e")))
            .when(stem.rlike("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), _cut(stem, 1))
            .when((p1 >= F.length(stem)) & stem.rlike(SHORT_END), F.concat(stem, F.lit("e")))
            .otherwise(stem)
        )

    out = F.when(w.endswith("eedly"), F.when(_behind(w, "eedly", p1), _cut(w, 3)).otherwise(w)).when(
        w.endswith("eed"), F.when(_behind(w, "eed", p1), _cut(w, 1)).otherwise(w)
    )
    for suffix in ("ingly", "edly", "ing", "ed"):
        stem = _cut(w, len(suffix))
        out = out.when(w.endswith(suffix), F.when(stem.rlike("[aeiouy]"), mended(stem)).otherwise(w))
    return out.otherwise(w)


def _longest(w: Column, rules, allowed) -> Column:
    """Replace the longest suffix of the rules where `allowed(suffix)` holds; a suffix that fails ends the search."""
    def rule(suffix: str, put: str) -> Column:
        return F.when(allowed(suffix), _cut(w, len(suffix), put)).otherwise(w)

    (first, put), *others = rules
    out = F.when(w.endswith(first), rule(first, put))
    for suffix, put in others:
        out = out.when(w.endswith(suffix), rule(suffix, put))
    return out.otherwise(w)


def with_stems(words: DataFrame, word: str, out: str = "stem") -> DataFrame:
    """Add the stem of a column of lower-case words; null stays null."""
    given, w = F.col(word), F.col("_w")
    marked = F.regexp_replace(F.regexp_replace(given, "^y", "Y"), "([aeiouy])y", "$1Y")
    p1, p2 = F.col("_p1"), F.col("_p2")
    first, second = _regions(w)
    steps = words.withColumn("_w", marked).withColumns({"_p1": first, "_p2": second})
    steps = steps.withColumn("_w", _plurals(w)).withColumn("_plain", w)
    steps = steps.withColumn("_w", _past(w, p1))
    steps = steps.withColumn("_w", F.when(w.rlike("^.+[^aeiouy][yY]$"), _cut(w, 1, "i")).otherwise(w))

    def second_step(suffix: str) -> Column:
        fits = _behind(w, suffix, p1)
        before = F.substring(w, F.length(w) - len(suffix), F.lit(1))
        if suffix == "ogi":
            fits = fits & (before == "l")
        if suffix == "li":
            fits = fits & before.isin(*"cdeghkmnrt")
        return fits

    def fourth_step(suffix: str) -> Column:
        fits = _behind(w, suffix, p2)
        return fits & F.substring(w, F.length(w) - 3, F.lit(1)).isin("s", "t") if suffix == "ion" else fits

    steps = steps.withColumn("_w", _longest(w, STEP_2, second_step))
    steps = steps.withColumn("_w", _longest(w, STEP_3, lambda s: _behind(w, s, p2 if s == "ative" else p1)))
    steps = steps.withColumn("_w", _longest(w, [(s, "") for s in STEP_4], fourth_step))
    shorter = _cut(w, 1)
    last = (
        F.when(
            w.endswith("e") & (_behind(w, "e", p2) | (_behind(w, "e", p1) & ~shorter.rlike(SHORT_END))), shorter
        )
        .when(w.endswith("ll") & _behind(w, "l", p2), shorter)
        .otherwise(w)
    )
    whole = F.create_map(*[F.lit(x) for pair in WHOLE.items() for x in pair])[given]
    stem = (
        F.when(whole.isNotNull(), whole)
        .when(F.length(given) <= 2, given)
        .when(F.col("_plain").isin(*AFTER_PLURALS), F.col("_plain"))
        .otherwise(F.translate(last, "Y", "y"))
    )
    return steps.withColumn(out, stem).drop("_w", "_p1", "_p2", "_plain")


_FIND_PAIR = re.compile("^.*?[aeiouy][^aeiouy]").match
_FIND_REGION = re.compile(f"^({REGION_WORDS})").match
_HAS_VOWEL = re.compile("[aeiouy]").search
_MARK_Y = re.compile("([aeiouy])y").sub
_PLURAL = re.compile("[aeiouy].+s$").search
_ENDS_IN_Y = re.compile("^.+[^aeiouy][yY]$").search
_SHORT = re.compile(SHORT_END).search
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")


def _shortened(w: str, rules, allowed) -> str:
    for suffix, put in rules:
        if w.endswith(suffix):
            return w[: len(w) - len(suffix)] + put if allowed(w, suffix) else w
    return w


def stem_of(word: str) -> str:
    """The stem of one lower-case word, as `with_stems` has it."""
    if word in WHOLE:
        return WHOLE[word]
    if len(word) <= 2:
        return word
    w = _MARK_Y(r"\1Y", "Y" + word[1:] if word[0] == "y" else word)
    found = _FIND_REGION(w) or _FIND_PAIR(w)
    p1 = found.end() if found else len(w)
    found = _FIND_PAIR(w[p1:])
    p2 = p1 + found.end() if found else len(w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif not w.endswith(("us", "ss")) and _PLURAL(w):
        w = w[:-1]
    if w in AFTER_PLURALS:
        return w
    w = _without_past(w, p1)
    if _ENDS_IN_Y(w):
        w = w[:-1] + "i"

    def behind(w: str, suffix: str, start: int) -> bool:
        return len(w) - len(suffix) >= start

    def second(w: str, suffix: str) -> bool:
        before = w[-len(suffix) - 1 : -len(suffix)]
        fits = behind(w, suffix, p1)
        return fits and (before == "l" if suffix == "ogi" else suffix != "li" or before in tuple("cdeghkmnrt"))

    w = _shortened(w, STEP_2, second)
    w = _shortened(w, STEP_3, lambda w, s: behind(w, s, p2 if s == "ative" else p1))
    w = _shortened(w, [(s, "") for s in STEP_4], lambda w, s: behind(w, s, p2) and (s != "ion" or w[-4:-3] in ("s", "t")))
    if w.endswith("e") and (len(w) - 1 >= p2 or (len(w) - 1 >= p1 and not _SHORT(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= p2:
        w = w[:-1]
    return w.replace("Y", "y")


def _without_past(w: str, p1: int) -> str:
    if w.endswith("eedly"):
        return w[:-3] if len(w) - 5 >= p1 else w
    if w.endswith("eed"):
        return w[:-1] if len(w) - 3 >= p1 else w
    for suffix in ("ingly", "edly", "ing", "ed"):
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            if not _HAS_VOWEL(stem):
                return w
            if stem.endswith(("at", "bl", "iz")) or (p1 >= len(stem) and not stem.endswith(_DOUBLES) and _SHORT(stem)):
                return stem + "e"
            return stem[:-1] if stem.endswith(_DOUBLES) else stem
    return w
