"""Documents, chunks, tokens and the override scan over whole texts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from borewatch.functions import guard
from borewatch.functions import text as tx
from borewatch.functions.fixed import (
    ALLOWED_MARK,
    ALLOWED_PHRASES,
    INJECTION_PATTERNS,
    REDACTION,
    STOPWORDS,
    TOKEN_PATTERN,
)
from borewatch.operators.metrics import ratio
from borewatch.operators.retrieval import hashed_embedding
from borewatch.plans.catalogue import query
from borewatch.plans.roles import CORPUS_SQL, PROMPTS_SQL, corpus, prompts, table, texts
from borewatch.schema import GUARD_SEVERITIES, rank_of
from borewatch.sources.documents import as_chunks, as_documents
from borewatch.sources.tables import insert_absent, table_counts, upsert

STOP_SQL = "[" + ", ".join(f"'{w}'" for w in dict.fromkeys(STOPWORDS)) + "]"


def tokens_sql(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '{TOKEN_PATTERN}')"


def substantive_sql(text: str) -> str:
    """Distinct substantive tokens in order of first occurrence."""
    kept = f"list_filter({tokens_sql(text)}, lambda t: len(t) >= 3 AND NOT list_contains({STOP_SQL}, t))"
    return f"list_filter({kept}, lambda t, i: list_position({kept}, t) = i)"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return as_documents(corpus(spark, folder), F.lit("2024-01-01").cast("timestamp"))


@query(
    "registered_documents",
    f"""WITH {CORPUS_SQL},
t AS (SELECT document_id, CAST(count(*) AS INTEGER) AS total_chunks FROM chunk_rows GROUP BY 1)
SELECT document_id, title, doc_type, well_id, field_name, path AS source_path, t.total_chunks FROM registered JOIN t USING (document_id)""",
)
def registered_documents(spark: SparkSession, folder: str) -> DataFrame:
    found = documents(spark, folder)
    totals = as_chunks(found).groupBy("document_id").agg(F.count(F.lit(1)).cast("int").alias("total_chunks"))
    return found.join(totals, "document_id").select(
        "document_id", "title", "doc_type", "well_id", "field_name", "source_path", "total_chunks"
    )


@query(
    "document_chunks",
    f"""WITH {CORPUS_SQL}
SELECT document_id, chunk_index, section, token_count, md5(content) AS content_md5,
       md5('Document: ' || title || coalesce(chr(10) || 'Field: ' || field_name, '') || coalesce(chr(10) || 'Well: ' || well_id, '') || chr(10) || chr(10) || content) AS embedding_md5
FROM chunk_rows""",
)
def document_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return as_chunks(documents(spark, folder)).select(
        "document_id", "chunk_index", "section", "token_count", F.md5("content").alias("content_md5"),
        F.md5("embedding_text").alias("embedding_md5"),
    )


@query(
    "document_upsert",
    """WITH old AS (SELECT doc_id, source AS title, n_chars AS stamp FROM documents WHERE lang <> 'de'),
new AS (SELECT doc_id, 'new ' || source AS title, n_chars + 1 AS stamp FROM documents WHERE lang <> 'fr'
        UNION ALL SELECT doc_id, 'newer ' || source, n_chars + 2 FROM documents WHERE lang = 'es')
SELECT doc_id, title FROM old WHERE doc_id NOT IN (SELECT doc_id FROM new)
UNION ALL SELECT doc_id, arg_max(title, stamp) FROM new GROUP BY doc_id""",
)
def document_upsert(spark: SparkSession, folder: str) -> DataFrame:
    base = table(spark, folder, "documents")
    old = base.filter("lang <> 'de'").select("doc_id", F.col("source").alias("title"), F.col("n_chars").alias("stamp"))
    new = base.filter("lang <> 'fr'").select("doc_id", F.concat(F.lit("new "), "source").alias("title"), (F.col("n_chars") + 1).alias("stamp"))
    newer = base.filter("lang = 'es'").select("doc_id", F.concat(F.lit("newer "), "source").alias("title"), (F.col("n_chars") + 2).alias("stamp"))
    return upsert(old, new.unionByName(newer), ["doc_id"], "stamp").select("doc_id", "title")


@query(
    "inserted_if_absent",
    """SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""",
)
def inserted_if_absent(spark: SparkSession, folder: str) -> DataFrame:
    """Orders that no line item mentions."""
    known = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return insert_absent(known, table(spark, folder, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"])


@query(
    "store_totals",
    f"""WITH {CORPUS_SQL} SELECT 'documents' AS "table", count(*) AS "rows" FROM registered UNION ALL SELECT 'document_chunks', count(*) FROM chunk_rows""",
)
def store_totals(spark: SparkSession, folder: str) -> DataFrame:
    found = documents(spark, folder)
    return table_counts({"documents": found, "document_chunks": as_chunks(found)})


@query(
    "substantive_tokens",
    f"""WITH t AS (SELECT doc_id, unnest({tokens_sql("text")}) AS term, generate_subscripts({tokens_sql("text")}, 1) AS i FROM documents),
k AS (SELECT doc_id, term, min(i) AS i FROM t WHERE len(term) >= 3 AND NOT list_contains({STOP_SQL}, term) GROUP BY 1, 2)
SELECT d.doc_id, coalesce(md5(string_agg(term, ' ' ORDER BY i)), md5('')) AS tokens_md5, CAST(count(term) AS INTEGER) AS n
FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id GROUP BY d.doc_id""",
)
def substantive_tokens(spark: SparkSession, folder: str) -> DataFrame:
    found = texts(spark, folder, "documents").withColumn("_t", tx.substantive_tokens(F.col("text")))
    return found.select("doc_id", F.md5(F.array_join("_t", " ")).alias("tokens_md5"), F.size("_t").alias("n"))


@query(
    "query_overlap",
    f"""WITH q AS (SELECT item_id, text, {substantive_sql("text")} AS terms FROM benchmark),
n AS (SELECT a.item_id, b.text AS other, a.terms FROM q a JOIN q b ON b.item_id = a.item_id + 1)
SELECT item_id, round(CASE WHEN len(terms) = 0 THEN 0.0 ELSE len(list_filter(terms, lambda t: contains(lower(other), t))) / len(terms) END, 6) AS overlap,
       round(CASE WHEN len(terms) = 0 THEN 1.0 ELSE len(list_filter(terms, lambda t: contains(lower(other), t))) / len(terms) END, 6) AS coverage FROM n""",
)
def query_overlap(spark: SparkSession, folder: str) -> DataFrame:
    base = table(spark, folder, "benchmark")
    following = base.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    terms = tx.substantive_tokens(F.col("text"))
    return base.join(following, "item_id").select(
        "item_id",
        F.round(tx.share_contained(terms, F.lower("other")), 6).alias("overlap"),
        F.round(tx.source_coverage(tx.coverage_terms(F.col("text")), F.col("other")), 6).alias("coverage"),
    )


def embedding_sql(source: str, key: str, text: str, size: int = 64) -> str:
    """CTE `embedded` (key, v): unit vectors of signed token counts."""
    return f"""tok AS (SELECT {key}, unnest({tokens_sql(text)}) AS term FROM {source}),
buckets AS (SELECT {key}, CAST('0x' || substr(md5(term), 1, 6) AS BIGINT) % {size} AS d,
  sum(CASE WHEN CAST('0x' || substr(md5(term), 7, 1) AS BIGINT) < 8 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS v FROM tok GROUP BY 1, 2),
norms AS (SELECT {key}, sqrt(sum(v * v)) AS norm FROM buckets GROUP BY 1 HAVING sum(v * v) > 0),
embedded AS MATERIALIZED (SELECT n.{key}, list(coalesce(b.v, 0.0) / norm ORDER BY i) AS v FROM norms n CROSS JOIN range({size}) AS r(i)
  LEFT JOIN buckets b ON b.{key} = n.{key} AND b.d = r.i GROUP BY n.{key})"""


@query(
    "hashed_embeddings",
    f"""WITH {embedding_sql("documents", "doc_id", "text")}
SELECT doc_id, CAST(unnest(range(64)) AS INTEGER) AS pos, round(unnest(v), 6) AS value FROM embedded""",
)
def hashed_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    vectors = hashed_embedding(texts(spark, folder, "documents"), ["doc_id"], "text")
    return vectors.select("doc_id", F.posexplode("embedding").alias("pos", "value")).withColumn("value", F.round("value", 6))


def mask_sql(text: str) -> str:
    for phrase in ALLOWED_PHRASES:
        text = f"regexp_replace({text}, '{phrase}', '{ALLOWED_MARK}', 'gi')"
    return text


def guard_sql(source: str, keys: str, text: str = "text") -> str:
    """CTE `scanned`: keys, text, masked, match counts per pattern, severity, sanitised."""
    counts = ", ".join(f"len(regexp_extract_all(masked, '{p}', 0, 'i')) AS c{i}" for i, p in enumerate(INJECTION_PATTERNS))
    total = " + ".join(f"c{i}" for i in range(len(INJECTION_PATTERNS)))
    steps = []
    for i, p in enumerate(INJECTION_PATTERNS):
        steps.append(f"g{i} AS (SELECT * REPLACE (CASE WHEN c{i} > 0 THEN regexp_replace(safe, '{p}', '{REDACTION}', 'gi') ELSE safe END AS safe) FROM {'g' + str(i - 1) if i else 'counted'})")
    return f"""masked AS (SELECT {keys}, {text} AS original, {mask_sql(text)} AS masked FROM {source}),
counted AS (SELECT *, original AS safe, {counts} FROM masked), {", ".join(steps)},
scanned AS (SELECT *, {total} AS match_count, lower(masked) AS low FROM g{len(INJECTION_PATTERNS) - 1}),
judged AS (SELECT *, CASE WHEN match_count = 0 THEN 'NONE'
  WHEN contains(low, 'ignore previous') OR contains(low, 'system prompt') OR contains(low, 'override safety') OR contains(low, 'bypass') THEN 'CRITICAL'
  WHEN match_count >= 3 THEN 'HIGH' WHEN contains(low, 'forget everything') AND contains(low, 'new instructions') THEN 'HIGH'
  WHEN contains(low, 'repeat everything') AND (contains(low, 'know') OR contains(low, 'told') OR contains(low, 'prompt') OR contains(low, 'instructions') OR contains(low, 'api keys')) THEN 'HIGH'
  ELSE 'LOW' END AS guard_severity FROM scanned)"""


def _matches_sql() -> str:
    parts = []
    for p in INJECTION_PATTERNS:
        groups = re.compile(p).groups
        if groups <= 1:
            parts.append(f"regexp_extract_all(masked, '{p}', {groups}, 'i')")
        else:
            every = [f"regexp_extract_all(masked, '{p}', {g}, 'i')" for g in range(1, groups + 1)]
            joined = " || ''', ''' || ".join(f"coalesce({e}[j], '')" for e in every)
            parts.append(f"list_transform(range(1, len({every[0]}) + 1), lambda j: '(''' || {joined} || ''')')")
    return "array_to_string(" + " || ".join(parts) + ", ';')"


@query(
    "guard_scan",
    f"""WITH {PROMPTS_SQL}, {guard_sql("prompts", "conv_id, turn, role")}
SELECT conv_id, turn, match_count = 0 AS is_clean, CAST(match_count AS INTEGER) AS match_count, guard_severity, {_matches_sql()} AS matches,
       md5(safe) AS sanitised_md5, substr(sha256(original), 1, 16) AS input_hash FROM judged""",
)
def guard_scan(spark: SparkSession, folder: str) -> DataFrame:
    return guard.scan(prompts(spark, folder), "text").select(
        "conv_id", "turn", "is_clean", "match_count", "guard_severity", F.array_join("matches", ";").alias("matches"),
        F.md5("sanitised_text").alias("sanitised_md5"), "input_hash",
    )


@query(
    "guard_scan_documents",
    f"""WITH {guard_sql("documents", "doc_id")} SELECT doc_id, CAST(match_count AS INTEGER) AS match_count, guard_severity FROM judged""",
)
def guard_scan_documents(spark: SparkSession, folder: str) -> DataFrame:
    return guard.scan(texts(spark, folder, "documents"), "text").select("doc_id", "match_count", "guard_severity")


@query(
    "sanitised_chunks",
    f"""WITH {PROMPTS_SQL}, {guard_sql("prompts", "conv_id, turn, role")}
SELECT CAST(conv_id AS VARCHAR) AS document_id, turn AS chunk_index, md5(CASE WHEN match_count = 0 THEN original ELSE safe END) AS content_md5
FROM judged WHERE guard_severity <> 'CRITICAL'""",
)
def sanitised_chunks(spark: SparkSession, folder: str) -> DataFrame:
    chunks = prompts(spark, folder).select(
        F.col("conv_id").cast("string").alias("document_id"), F.col("turn").alias("chunk_index"), F.col("text").alias("content")
    )
    safe, _ = guard.sanitise_chunks(chunks)
    return safe.select("document_id", "chunk_index", F.md5("content").alias("content_md5"))


@query(
    "guard_expectations",
    f"""WITH {PROMPTS_SQL}, {guard_sql("prompts", "conv_id, turn, role")},
e AS (SELECT role, guard_severity, match_count, role <> 'system' AND (conv_id + turn) % 6 <> 1 AS expected,
       list_position(['NONE', 'LOW', 'HIGH', 'CRITICAL'], guard_severity) AS r FROM judged)
SELECT role, count(*) AS total, count(*) FILTER (WHERE (match_count > 0) = expected) AS detection_correct,
       count(*) FILTER (WHERE (match_count > 0) = expected AND (NOT expected OR r >= 3)) AS passed,
       round(count(*) FILTER (WHERE (match_count > 0) = expected AND (NOT expected OR r >= 3)) / count(*), 6) AS pass_rate FROM e GROUP BY role""",
)
def guard_expectations(spark: SparkSession, folder: str) -> DataFrame:
    """Every planted line but the harmless one should be found, with severity HIGH or more."""
    expected = (F.col("role") != "system") & ((F.col("conv_id") + F.col("turn")) % 6 != 1)
    scanned = guard.scan(prompts(spark, folder), "text").withColumn("expected", expected)
    right = ~F.col("is_clean") == F.col("expected")
    severe = rank_of(F.col("guard_severity"), GUARD_SEVERITIES) >= rank_of(F.lit("HIGH"), GUARD_SEVERITIES)
    passed = right & (~F.col("expected") | severe)
    return (
        scanned.groupBy("role")
        .agg(
            F.count(F.lit(1)).alias("total"), F.count_if(right).alias("detection_correct"), F.count_if(passed).alias("passed")
        )
        .withColumn("pass_rate", F.round(ratio(F.col("passed"), F.col("total")), 6))
    )


@query(
    "corpus_names",
    """SELECT url, regexp_extract(url, '([^/]+)/*$', 1) AS base, replace(replace(trim(url), '/', '-'), ' ', '_') AS slug,
CASE WHEN url LIKE 'http://m.%' OR url LIKE 'https://m.%' THEN 'x' ELSE 'y' END = 'x' AS mobile FROM pages""",
)
def corpus_names(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select(
        "url", tx.base_name(F.col("url")).alias("base"), tx.slug(F.col("url")).alias("slug"),
        F.regexp_like("url", F.lit("^https?://m\\.")).alias("mobile"),
    )
