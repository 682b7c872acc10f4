"""Many names in many texts: an index by the rarest gram of each name, then a check.

A name is filed under the one of its three-letter grams that is rarest in the texts.  Texts are walked gram by gram; only
grams under which a name is filed go on, and only there the name itself is compared.  A name one of whose grams no text
holds is out at once.  Nothing grows with the number of names times texts, and no text is turned into its substrings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from borewatch.operators.ordering import small_side
from borewatch.session import spread, stored_once

GRAM = 3
# Letters of a text that are walked together; substrings of a short piece are cheap to reach.
PIECE = 512


def names_in_texts(names: DataFrame, texts: DataFrame, name: str, keys: list[str], text: str) -> DataFrame:
    """(name, keys) of every name that a text holds as a substring, whatever the case.

    Empty and null names and texts hold nothing.  Texts may be of any length: they are cut into pieces that overlap by the
    longest name.
    """
    wanted = names.select(F.col(name).alias("_given"), F.lower(name).alias("_name")).filter(F.length("_name") > 0)
    wanted = stored_once(wanted.distinct())
    facts = wanted.agg(
        F.max(F.length("_name")).alias("longest"), F.collect_set(F.least(F.length("_name"), F.lit(GRAM))).alias("grams")
    ).first()  # at most three lengths of grams
    if not facts["longest"]:
        return texts.select(F.lit(None).cast("string").alias(name), *keys).limit(0)
    margin = facts["longest"]
    pieces = spread(_pieces(texts, keys, text, max(PIECE, margin), margin))
    seen = _grams(pieces, sorted(facts["grams"]))

    # every gram of every name, and how often the texts hold it
    spelled = wanted.select("_name").distinct()
    size = F.least(F.length("_name"), F.lit(GRAM))
    grams = F.transform(
        F.sequence(F.lit(0), F.length("_name") - size), lambda i: F.struct(F.substring("_name", i + 1, size).alias("_gram"), i.alias("_at"))
    )
    filed = stored_once(spelled.select("_name", F.explode(grams).alias("_g")).select("_name", "_g.*"))
    # names share their grams, so that those are few even where names are many
    kinds = stored_once(filed.select("_gram").distinct())
    frequency = seen.join(small_side(kinds, kinds.count()), "_gram", "left_semi").groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    # a gram that no text holds rules its name out
    rarest = Window.partitionBy("_name").orderBy(F.col("_n").asc_nulls_first(), "_gram", "_at")
    index = (
        filed.join(frequency, "_gram", "left").withColumn("_nth", F.row_number().over(rarest))
        .filter((F.col("_nth") == 1) & F.col("_n").isNotNull()).select("_gram", "_at", "_name")
    )
    index = stored_once(index)

    start = F.col("_place") - F.col("_at")
    found = (
        seen.join(small_side(index, index.count()), "_gram")
        .filter((start >= 1) & (F.substring("_around", start, F.length("_name")) == F.col("_name")))
        .select(*keys, "_name").distinct()
    )
    return found.join(wanted.hint("merge"), "_name").select(F.col("_given").alias(name), *keys)


def _pieces(texts: DataFrame, keys: list[str], text: str, size: int, margin: int) -> DataFrame:
    """Keys, `_around` (a piece with `margin` letters before and behind it), `_before` and `_own`, the lengths of the first
    two parts."""
    cut = F.regexp_extract_all(F.lower(text), F.lit(f"(?s)(.{{1,{size}}})"), F.lit(1))
    rows = texts.select(*keys, cut.alias("_cut")).select(*keys, "_cut", F.posexplode("_cut").alias("_no", "_piece"))
    left = F.coalesce(F.right(F.get("_cut", F.col("_no") - 1), F.lit(margin)), F.lit(""))
    right = F.coalesce(F.left(F.get("_cut", F.col("_no") + 1), F.lit(margin)), F.lit(""))
    return rows.select(
        *keys, F.concat(left, "_piece", right).alias("_around"), F.length(left).alias("_before"), F.length("_piece").alias("_own")
    )


def _grams(pieces: DataFrame, sizes: list[int]) -> DataFrame:
    """Every gram that begins in a piece's own part, with its place in `_around`."""
    places = F.sequence(F.col("_before") + 1, F.col("_before") + F.col("_own"))
    walked = pieces.select("*", F.explode(places).alias("_place"))
    each: Column = F.explode(F.array(*[F.lit(n) for n in sizes]))
    sized = walked.select("*", each.alias("_size")) if len(sizes) > 1 else walked.withColumn("_size", F.lit(sizes[0]))
    gram = F.substring("_around", F.col("_place"), F.col("_size"))
    return sized.withColumn("_gram", gram).filter(F.length("_gram") == F.col("_size")).drop("_size", "_before", "_own")
