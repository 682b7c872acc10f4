"""Quality rules by distribution divergence. DataFrame functions only.

A document is compared with its language: the histogram of its character classes and the histogram of its common
words, each by Jensen-Shannon distance (square root of the divergence in base 2, so 0 to 1) from the reference of the
language. A reference is the mean histogram of all documents of the language that pass the base rules and are long
enough, and the common words of a language are those with most share in its documents; languages are the values of the
column. Documents of no language are compared by characters alone, with the mean of all whose script has case, or of all
whose script has none. Where too few documents make a reference, there is none, and nothing is rejected by distance.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from borewatch.llm.common import WHITE, carried, join_counted, let, materialise, words

#: Character classes besides small letters, each a pattern; a last class takes what none of them does.
CLASSES = (
    r"\p{Lu}+",
    r"\p{Nd}+",
    r"[.,;:'\"()-]+",
    r"[!?]+",
    r"[#*$%&|<>@^~_=+\\/{}\[\]]+",
)
N_CLASSES = len(CLASSES) + 2
#: Common words of a language, the longest (in bytes) that is looked at, and the parts that a document's words share.
N_COMMON, LONGEST_COMMON, PARTS = 16, 24, 10**9
#: References of documents without a language; those of languages begin with "=".
CASE, NO_CASE = "case", "no case"
#: The least documents that make a reference.
LEAST_DOCS = 20
#: The farthest distances that are kept, and the least characters at which classes are looked at. By words, the limit is
#: a share of the language's bare distance, which a text without any common word has, and what chance adds to it.
MOST_CLASS, MOST_WORD = 0.3, 0.6
LEAST_CHARS = 100
#: Base rules.
MIN_WORDS, MOST_REPEATED_PERCENT = 50, 50
SYMBOLS = r"[#*$%&|<>]"


def class_counts(n_chars: Column, rest: Column) -> Column:
    """Characters by class. rest: the text without white space and small letters, which is most of a text gone."""
    marked = F.array(*(F.length(rest) - F.length(F.regexp_replace(rest, p, "")) for p in CLASSES))
    other = let(marked, lambda c: F.concat(c, F.array(F.length(rest) - F.aggregate(c, F.lit(0), lambda a, x: a + x))))
    return F.concat(F.array(n_chars - F.length(rest)), other)


def common_words(docs: DataFrame, *, text: str, lang: str) -> DataFrame:
    """A row for each language: ref, listed (N_COMMON words with a letter, filled up with empty ones), longest in bytes.

    Every document counts alike, however long; only those with too few words for the base rules are left out. Sums of
    whole parts don't depend on order, and each task ranks its own words before they are dealt out by language.
    """
    read = docs.where(F.col(lang).isNotNull()).select(ref_of(lang).alias("ref"), words(F.col(text)).alias("w"))
    read = read.where(F.size("w") >= MIN_WORDS)
    each = read.select("ref", F.expr(f"{PARTS} div size(w)").alias("part"), F.explode("w").alias("word"))
    each = each.where(F.octet_length("word") <= LONGEST_COMMON)
    mass = each.groupBy("ref", "word").agg(F.sum("part").alias("mass"))
    mass = mass.where(F.col("word").rlike(r"\p{L}"))
    order = Window.partitionBy("ref").orderBy(F.desc("mass"), "word")
    best = mass.withColumn("at", F.row_number().over(order)).where(F.col("at") <= N_COMMON)
    lists = best.groupBy("ref").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("best"))
    listed = F.transform("best", lambda x: x["word"])
    return lists.select(
        "ref",
        F.concat(listed, F.array_repeat(F.lit(""), F.lit(N_COMMON) - F.size(listed))).alias("listed"),
        F.array_max(F.transform(listed, lambda w: F.octet_length(w))).alias("longest"),
    )


def ref_of(lang: str) -> Column:
    """The language's own reference; null where there is no language."""
    return F.concat(F.lit("="), F.col(lang).cast("string"))


def common_counts(found: Column, listed: Column, longest: Column) -> Column:
    """How often each listed word is among the words; the last entry is all others. Nothing without a list."""

    def tally(hits: Column) -> Column:
        each = F.transform(listed, lambda w: F.size(hits) - F.size(F.array_remove(hits, w)))
        return F.concat(each, F.array(F.size(found) - F.size(hits)))

    hits = F.filter(found, lambda w: (F.octet_length(w) <= longest) & F.array_contains(listed, w))
    return F.when(listed.isNull(), F.array().cast("array<int>")).otherwise(let(hits, tally))


def repeated_words(found: Column) -> Column:
    """Words inside the 3-word windows that occur at least twice in the text, their first occurrence included.

    Windows are hashed; where all hashes differ, none repeats. Else the hashes are sorted with their places, and windows
    whose neighbour has the same hash and the same words are the repeated ones; each covers three words, less what the
    next one covers as well.
    """

    def covered(at: Column) -> Column:
        gaps = F.zip_with(
            F.slice(at, 2, F.size(at)), at, lambda b, a: F.when(b.isNull(), F.lit(0)).otherwise(F.least(b - a, F.lit(3)))
        )
        return F.when(F.size(at) == 0, F.lit(0)).otherwise(F.aggregate(gaps, F.lit(3), lambda total, x: total + x))

    def same(a: Column, b: Column) -> Column:
        words_equal = [F.get(found, a["i"] + k) == F.get(found, b["i"] + k) for k in range(3)]
        return F.coalesce((a["h"] == b["h"]) & words_equal[0] & words_equal[1] & words_equal[2], F.lit(False))

    def in_order(placed: Column) -> Column:
        twice = F.filter(placed, lambda x, i: same(F.get(placed, i - 1), x) | same(F.get(placed, i + 1), x))
        return let(F.sort_array(F.transform(twice, lambda x: x["i"])), covered)

    def count(shown: Column) -> Column:
        placed = F.sort_array(F.transform(shown, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(shown)) == F.size(shown), F.lit(0)).otherwise(let(placed, in_order))

    def windows(h: Column) -> Column:
        joined = F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)))
        return F.slice(joined, 1, F.size(h) - 2)

    hashed = F.transform(found, lambda w: F.xxhash64(w))
    return F.when(F.size(found) < 3, F.lit(0)).otherwise(let(let(hashed, windows), count))


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.length(F.btrim(line, F.lit(WHITE))) > 0)
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def shares(counts: Column) -> Column:
    """Counts as shares of their sum; nulls where the sum is 0."""
    return let(
        F.transform(counts, lambda x: x.cast("double")),
        lambda c: let(
            F.aggregate(c, F.lit(0.0), lambda a, x: a + x),
            lambda n: F.transform(c, lambda x: F.when(n > 0, x / n)),
        ),
    )


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms of shares; null where one is null or the lengths differ."""

    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).when(a.isNotNull() & b.isNotNull(), F.lit(0.0))

    terms = F.zip_with(p, q, lambda a, b: (part(a, b) + part(b, a)) / 2)
    total = F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)
    return let(total, lambda t: F.when(t.isNotNull(), F.sqrt(F.greatest(t, F.lit(0.0)))))


def features(docs: DataFrame, *, text: str, doc_id: str, lang: str, carry: bool) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    read = docs.select(
        F.col(doc_id).alias("doc_id"),
        body.alias("body"),
        words(F.col(text)).alias("w"),
        ref_of(lang).alias("ref"),
        *(carried(docs)[:1] if carry else []),
    )
    lists = materialise(common_words(docs, text=text, lang=lang))
    read = join_counted(read, lists, ["ref"]).withColumn("dense", F.array_join("w", ""))
    read = read.withColumn("rest", F.regexp_replace("dense", r"\p{Ll}+", ""))
    return read.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length("dense").cast("long").alias("word_chars"),
        F.regexp_count("rest", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        repeated_lines(F.col("body")).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("w")).cast("long").alias("n_repeat_words"),
        "ref",
        class_counts(F.length("dense"), F.col("rest")).alias("classes"),
        common_counts(F.col("w"), F.col("listed"), F.col("longest")).alias("common"),
        *(["carried"] if carry else []),
    )


def any_of(classes: Column) -> Column:
    """The reference of documents without a language: by whether most letters have case. Letters without case are in
    the last class."""
    return F.when(F.get(classes, F.lit(N_CLASSES - 1)) > F.get(classes, F.lit(0)) + F.get(classes, F.lit(1)), NO_CASE).otherwise(CASE)


def references(seen: DataFrame) -> DataFrame:
    """A row for each language, and one for each kind of script: mean shares of classes and common words, and the bare
    distance; none from fewer than LEAST_DOCS documents."""
    long_enough = seen.where((~F.col("base_failed")) & (F.col("word_chars") >= LEAST_CHARS))
    classes, common = F.col("class_shares"), F.col("common_shares")

    def means(rows: DataFrame, ref: Column) -> DataFrame:
        found = rows.groupBy(ref.alias("ref")).agg(
            F.array(*(F.avg(F.get(classes, F.lit(i))) for i in range(N_CLASSES))).alias("class_ref"),
            F.array(*(F.avg(F.get(common, F.lit(i))) for i in range(N_COMMON + 1))).alias("common_ref"),
            F.count("*").alias("n"),
        )
        return found.where(F.col("n") >= LEAST_DOCS).drop("n")

    own = means(long_enough.where(F.col("has_lang")), F.col("ref"))
    bare = F.lit([0.0] * N_COMMON + [1.0])
    both = own.unionByName(means(long_enough, any_of(classes)))
    return both.withColumn("bare", distance(bare, F.col("common_ref")))


def too_far_by_words(most_word: float) -> Column:
    """Squared distances add up: the share of the bare distance, and the mean distance of as many words drawn from the
    reference by chance, which narrows with length. Where chance alone reaches the bare distance, none is too far."""
    chance = N_COMMON / (8 * math.log(2) * F.col("n_words"))
    return F.pow("word_distance", F.lit(2)) > F.pow(most_word * F.col("bare"), F.lit(2)) + chance


def assess(
    docs: DataFrame,
    *,
    text: str = "text",
    doc_id: str = "doc_id",
    lang: str = "lang",
    most_class: float = MOST_CLASS,
    most_word: float = MOST_WORD,
    carry: bool = False,
) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, kept, class_distance, word_distance.

    Base rules: at least 50 words, at most half of them in repeated windows. The verdict on the others: kept unless the
    class distance is above `most_class` in a text of LEAST_CHARS characters or more, or the word distance above
    `most_word` of what a text without common words has, with room for chance in short texts. Null and empty texts have no words, so the base rules reject them.
    A null language has no word distance, and its class distance is from all texts whose letters have case, or have none.
    With fewer than LEAST_DOCS usable documents there is no reference, the distances are null and nothing of that
    language is rejected beyond the base rules. Repeated rows are judged alike; ids are not
    looked at, so they may be null or repeat; empty tables give no rows. `carry` adds the whole row as `carried`.
    """
    seen = features(docs, text=text, doc_id=doc_id, lang=lang, carry=carry)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    seen = seen.withColumns(
        {
            "base_failed": failed,
            "class_shares": shares(F.col("classes")),
            "common_shares": shares(F.col("common")),
            "has_lang": F.col("ref").isNotNull(),
        }
    ).drop("classes", "common")
    seen = seen.withColumn("ref", F.coalesce("ref", any_of(F.col("class_shares"))))
    seen = materialise(seen)
    out = join_counted(seen, materialise(references(seen)), ["ref"]).withColumns(
        {
            "class_distance": distance(F.col("class_shares"), F.col("class_ref")),
            "word_distance": distance(F.col("common_shares"), F.col("common_ref")),
        }
    )
    far = ((F.col("word_chars") >= LEAST_CHARS) & (F.col("class_distance") > most_class)) | (
        F.col("has_lang") & too_far_by_words(most_word)
    )
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~F.coalesce(far, F.lit(False))).alias("kept"),
        "class_distance", "word_distance",
        *(["carried"] if carry else []),
    )


def kept(docs: DataFrame, **options) -> DataFrame:
    """The documents that pass, with the columns of `docs`."""
    return assess(docs, carry=True, **options).where("kept").select("carried.*")
