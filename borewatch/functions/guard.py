"""Scan for instruction overrides in text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from borewatch.functions.fixed import (
    ALLOWED_MARK,
    ALLOWED_PHRASES,
    CRITICAL_WORDS,
    INJECTION_PATTERNS,
    REDACTION,
    REPEAT_WORDS,
)
from borewatch.functions.text import short_hash

# Case-insensitive, Unicode classes, and a dot that stops at line feeds only.
_FLAGS = "(?idU)"


def mask_allowed(text: Column) -> Column:
    """Replace operational phrases, so that they neither count nor hide an attack."""
    for phrase in ALLOWED_PHRASES:
        text = F.regexp_replace(text, f"(?iu)\\Q{phrase}\\E", ALLOWED_MARK)
    return text


def _found(masked: Column, pattern: str) -> Column:
    """What each match captured: the match, its group, or its groups as a tuple."""
    groups = re.compile(pattern).groups
    expression = _FLAGS + pattern
    if groups <= 1:
        return F.regexp_extract_all(masked, F.lit(expression), F.lit(groups))
    parts = [F.regexp_extract_all(masked, F.lit(expression), F.lit(g)) for g in range(1, groups + 1)]
    return F.transform(
        F.arrays_zip(*[p.alias(f"g{i}") for i, p in enumerate(parts)]),
        lambda z: F.concat(F.lit("('"), F.concat_ws("', '", *[z[f"g{i}"] for i in range(groups)]), F.lit("')")),
    )


def severity(masked: Column, matches: Column) -> Column:
    low = F.lower(masked)

    def has(words: list[str]) -> Column:
        found = F.lit(False)
        for word in words:
            found = found | low.contains(word)
        return found

    combined = (low.contains("forget everything") & low.contains("new instructions")) | (
        low.contains("repeat everything") & has(REPEAT_WORDS)
    )
    return (
        F.when(matches == 0, "NONE")
        .when(has(CRITICAL_WORDS), "CRITICAL")
        .when(matches >= 3, "HIGH")
        .when(combined, "HIGH")
        .otherwise("LOW")
    )


def scan(df: DataFrame, text: str) -> DataFrame:
    """Add is_clean, match_count, matches, sanitised_text, guard_severity, input_hash.

    Patterns are counted on the masked text; redaction works on the original, and only with the
    patterns that were found.
    """
    masked = df.withColumn("_masked", mask_allowed(F.col(text)))
    counts = F.array(*[F.regexp_count("_masked", F.lit(_FLAGS + p)) for p in INJECTION_PATTERNS])
    total = F.aggregate("_counts", F.lit(0), lambda a, c: a + c)
    # One generated row per input row: later filters cannot pull the patterns in a second time.
    verdict = F.struct(total.alias("match_count"), severity(F.col("_masked"), total).alias("guard_severity"))
    judged = masked.withColumn("_counts", counts).withColumn("_verdict", F.explode(F.array(verdict)))
    patterns = F.array(*[F.lit(_FLAGS + p) for p in INJECTION_PATTERNS])
    present = F.filter(patterns, lambda p, i: F.col("_counts")[i] > 0)
    captured = F.flatten(F.array(*[_found(F.col("_masked"), p) for p in INJECTION_PATTERNS]))
    match_count = F.col("_verdict.match_count")
    return judged.withColumns(
        {
            "match_count": match_count,
            "guard_severity": F.col("_verdict.guard_severity"),
            "is_clean": match_count == 0,
            "matches": F.when(match_count > 0, captured).otherwise(F.array().cast("array<string>")),
            "sanitised_text": F.aggregate(present, F.col(text), lambda t, p: F.regexp_replace(t, p, F.lit(REDACTION))),
            "input_hash": short_hash(F.col(text)),
        }
    ).drop("_masked", "_counts", "_verdict")


def sanitise_chunks(chunks: DataFrame, text: str = "content") -> tuple[DataFrame, DataFrame]:
    """(chunks safe to show, findings): critical chunks are dropped, others redacted."""
    scanned = scan(chunks, text)
    safe = (
        scanned.filter(F.col("guard_severity") != "CRITICAL")
        .withColumn(text, F.when(F.col("is_clean"), F.col(text)).otherwise(F.col("sanitised_text")))
        .select(*chunks.columns)
    )
    findings = scanned.filter(~F.col("is_clean")).select(
        F.concat_ws(":", "document_id", "chunk_index").alias("chunk_id"), "guard_severity", "match_count", "input_hash"
    )
    return safe, findings
