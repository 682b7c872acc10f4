"""Text of documents and queries: ids, titles, sections, chunks, tokens, overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from borewatch.functions.fixed import (
    DESTINATIONS,
    DOCUMENT_TYPES,
    FIELD_NAMES,
    PEAK_ROW_PATTERN,
    STOPWORDS,
    TOKEN_PATTERN,
    WELL_COUNT_PATTERN,
    WELL_ID_PATTERNS,
)

CHUNK_WORDS = 640
OVERLAP_WORDS = 112
FIRST_HEADING = "Introduction"

_LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\u0085  ]"
_SPACE = r"(?U)[\s\x1c-\x1f]+"


def short_hash(column: Column) -> Column:
    """First 16 hex digits of SHA-256: document ids and audit hashes."""
    return F.substring(F.sha2(column, 256), 1, 16)


def lines(text: Column) -> Column:
    return F.split(text, _LINE_BREAK)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def title(text: Column, fallback: Column) -> Column:
    """First level-1 or level-2 heading, else the fallback."""
    stripped = F.transform(lines(text), strip)
    heading = F.get(F.filter(stripped, lambda s: s.startswith("# ") | s.startswith("## ")), F.lit(0))
    return F.coalesce(strip(F.regexp_replace(heading, r"^#{1,2} ", "")), fallback)


def sections(text: Column) -> Column:
    """Array of (heading, body), cut at level-2 headings.

    A heading with no line before the next one leaves no section.
    """
    unix = F.regexp_replace(text, _LINE_BREAK, "\n")
    pieces = F.split(unix, r"(?m)^## ")

    def section(piece: Column, i: Column) -> Column:
        at = F.locate("\n", piece)
        head = F.when(i == 0, F.lit(FIRST_HEADING)).otherwise(
            strip(F.when(at > 0, F.substring(piece, F.lit(1), at - 1)).otherwise(piece))
        )
        rest = F.when(i == 0, piece).when(at > 0, F.substring(piece, at + 1, F.length(piece))).otherwise(F.lit(""))
        return F.struct(
            head.alias("heading"), F.regexp_replace(rest, r"\n\z", "").alias("body"), (rest != "").alias("kept")
        )

    return F.transform(
        F.filter(F.transform(pieces, section), lambda s: s["kept"]),
        lambda s: F.struct(s["heading"].alias("heading"), s["body"].alias("body")),
    )


def words(text: Column) -> Column:
    return F.filter(F.split(text, _SPACE), lambda w: w != "")


def chunk_starts(n: Column, size: int = CHUNK_WORDS, overlap: int = OVERLAP_WORDS) -> Column:
    """0-based first words of the chunks of n words; the last chunk is the first to reach the end."""
    step = size - overlap
    last = F.when(n <= size, F.lit(0)).otherwise(F.ceil((n - size) / F.lit(step)).cast("int"))
    return F.transform(F.sequence(F.lit(0), last), lambda i: i * step)


def _cut(w: Column, size: int, overlap: int, **extra: Column) -> Column:
    """Chunks of an array of words.  `w` must be a column or lambda variable: it is read per chunk."""
    return F.transform(
        chunk_starts(F.size(w), size, overlap),
        lambda s: F.struct(
            *[c.alias(n) for n, c in extra.items()],
            F.array_join(F.slice(w, s + 1, F.lit(size)), " ").alias("content"),
            F.least(F.lit(size), F.size(w) - s).alias("token_count"),
        ),
    )


def explode_chunks(
    df: DataFrame, text: str, keep: list[str], size: int = CHUNK_WORDS, overlap: int = OVERLAP_WORDS, by_section: bool = True
) -> DataFrame:
    """One row per chunk: the kept columns, chunk_index, section, content, token_count.

    Texts are split into words once, in a column of their own; the outer generator keeps the
    optimizer from evaluating the split a second time for a size check.
    """
    if by_section:
        parts = F.transform(sections(F.col(text)), lambda s: F.struct(s["heading"].alias("heading"), words(s["body"]).alias("words")))
    else:
        parts = F.array(F.struct(F.lit(None).cast("string").alias("heading"), words(F.col(text)).alias("words")))
    cut = F.flatten(
        F.transform(
            F.filter("_parts", lambda p: F.size(p["words"]) > 0), lambda p: _cut(p["words"], size, overlap, section=p["heading"])
        )
    )
    return (
        df.select(*keep, parts.alias("_parts"))
        .select(*keep, F.posexplode_outer(cut).alias("chunk_index", "_c"))
        .filter(F.col("chunk_index").isNotNull())
        .select(*keep, "chunk_index", "_c.section", "_c.content", "_c.token_count")
    )


def well_id(text: Column, head_chars: int | None = None) -> Column:
    """Well id by the first pattern that matches, else null; in the whole text, or its first `head_chars` characters."""
    head = text if head_chars is None else F.substring(text, 1, head_chars)
    found = [F.nullif(F.regexp_extract(head, f"(?U){p}", 1), F.lit("")) for p in WELL_ID_PATTERNS]
    return F.coalesce(*found)


def field_name(text: Column, head_chars: int | None = None) -> Column:
    """First known field named in the whole text, or in its first `head_chars` characters, else null."""
    head = F.lower(text if head_chars is None else F.substring(text, 1, head_chars))
    return F.coalesce(*[F.when(head.contains(name.lower()), F.lit(name)) for name in FIELD_NAMES])


def document_type(path: Column) -> Column:
    return F.coalesce(*[F.when(path.contains(part), F.lit(kind)) for part, kind in DOCUMENT_TYPES.items()], F.lit("Document"))


def destination_folder(name: Column) -> Column:
    return F.coalesce(*[F.when(name.startswith(p), F.lit(d)) for p, d in DESTINATIONS.items()], F.lit("reference"))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)/*$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def slug(well: Column) -> Column:
    return F.replace(F.replace(strip(well), F.lit("/"), F.lit("-")), F.lit(" "), F.lit("_"))


def embedding_text(content: Column, document_title: Column, field: Column, well: Column) -> Column:
    """Chunk text below the header lines that name document, field and well."""

    def line(label: str, value: Column) -> Column:
        return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{label}: "), value))

    header = F.concat_ws("\n", line("Document", document_title), line("Field", field), line("Well", well))
    return F.when(header == "", content).otherwise(F.concat(header, F.lit("\n\n"), content))


def tokens(text: Column) -> Column:
    """Lower-case tokens in order, with repetitions."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN_PATTERN})"), F.lit(1))


def is_stopword(token: Column) -> Column:
    """A long IN list, which Spark turns into a hash lookup."""
    return token.isin(list(dict.fromkeys(STOPWORDS)))


def meaningful_tokens(text: Column) -> Column:
    """Tokens in order, with repetitions, without stopwords."""
    return F.filter(tokens(text), lambda t: ~is_stopword(t))


def substantive_tokens(text: Column) -> Column:
    """Distinct tokens of three characters or more that are no stopwords, in order."""
    return F.array_distinct(F.filter(tokens(text), lambda t: (F.length(t) >= 3) & ~is_stopword(t)))


def share_contained(terms: Column, lowered: Column) -> Column:
    """Share of the terms that occur as substrings; 0 without terms."""
    hits = F.size(F.filter(terms, lambda t: lowered.contains(t)))
    return F.coalesce(F.try_divide(hits.cast("double"), F.size(terms).cast("double")), F.lit(0.0))


def coverage_terms(query: Column) -> Column:
    """Terms for coverage: substantive tokens, else plain words of four characters or more."""
    plain = F.filter(words(F.lower(query)), lambda w: (F.length(w) >= 4) & ~is_stopword(w))
    main = substantive_tokens(query)
    return F.when(F.size(main) > 0, main).otherwise(plain)


def source_coverage(terms: Column, context: Column) -> Column:
    """Share of coverage terms found in the retrieved text; 1 if there are none."""
    return F.when(F.size(terms) == 0, F.lit(1.0)).otherwise(share_contained(terms, F.lower(context)))


def rrf(rank: Column, k: int = 60) -> Column:
    return 1.0 / (F.lit(k) + rank)


def _any(text: Column, *needles: str) -> Column:
    found = F.lit(False)
    for needle in needles:
        found = found | text.contains(needle)
    return found


def is_field_total_query(query: Column) -> Column:
    """Asks for totals or counts over wells."""
    q = F.lower(query)
    about_wells = _any(q, "wells", "well ") | F.regexp_like(q, F.lit(r"(?U)well\s*\z"))
    summarising = _any(q, "workbook", "enumerat", "enumeration", "summar")
    return (
        (_any(q, "how many", "what number of") & about_wells)
        | (summarising & about_wells)
        | _any(q, "field overview", "pooled across all wells", "total producing")
        | (summarising & q.contains("volve") & (q.contains("producer") | about_wells))
    )


def is_overview_query(query: Column) -> Column:
    """Asks across wells, so the field overview should come first."""
    q = F.lower(query)
    well = _any(q, "well", "producer")
    peak = _any(q, "which", "what", "whose") & well & _any(q, "peak", "bopd", "oil rate", "daily oil")
    extreme = (
        _any(q, "highest", "lowest", "maximum", "minimum", "max ") & well & _any(q, "peak", "oil", "bopd")
    )
    comparison = _any(q, "compare", "rank", "versus", " vs ") & well
    return is_field_total_query(query) | peak | extreme | comparison


def overview_bonus(query: Column, chunk_title: Column, content: Column) -> Column:
    """Extra rerank score of substantial overview chunks for overview queries."""
    q, body = F.lower(query), F.coalesce(content, F.lit(""))
    base = F.least(F.length(body), F.lit(520)) / 900.0
    counting = q.contains("how many") & q.contains("well")
    counts = F.when(
        counting,
        F.when(F.regexp_like(body, F.lit(f"(?iU){WELL_COUNT_PATTERN}")), 0.95).otherwise(0.0)
        + F.when(_any(F.lower(body), "producer", "wells represented"), 0.35).otherwise(0.0),
    ).otherwise(0.0)
    extreme = _any(q, "peak", "bopd") & _any(q, "highest", "maximum", "max ", "lowest", "minimum")
    peaks = F.when(extreme & (F.regexp_count(body, F.lit(f"(?iU){PEAK_ROW_PATTERN}")) >= 2), 1.05).otherwise(0.0)
    applies = is_overview_query(query) & F.lower(F.coalesce(chunk_title, F.lit(""))).contains("overview")
    return F.when(applies, base + counts + peaks).otherwise(F.lit(0.0))


def titled(chunk_title: Column, content: Column, clip: int | None = None) -> Column:
    """ "[Source: title]" above the body, clipped to a number of characters (P10)."""
    head, body = strip(F.coalesce(chunk_title, F.lit(""))), strip(F.coalesce(content, F.lit("")))
    text = F.when(head != "", F.concat(F.lit("[Source: "), head, F.lit("]\n"), body)).otherwise(body)
    return F.substring(text, 1, clip) if clip else text


def incident_query(description: Column, features: Column) -> Column:
    return F.concat(F.lit("production anomaly incident "), F.array_join(features, ", "), F.lit(": "), description)
