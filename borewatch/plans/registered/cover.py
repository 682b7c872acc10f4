"""Stems of the corpus and retrieval by cover density: every `benchmark` passage asks the whole corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from borewatch.functions import text as tx
from borewatch.operators import cover, retrieval
from borewatch.plans.catalogue import query
from borewatch.plans.registered.retrieval import CHUNKS_SQL, asked, chunks
from borewatch.session import stored_once

# The SQL has its own lists: the words of the published algorithm, and the stopwords and token form of this library.
_STOP_SQL = "['" + "','".join(
    (
        "a an the and or but if as at by for from in into of on onto with to too do does did during how what when where "
        "which who whom whose why is are was were be been being it its this that these those than then there their they "
        "them we you your he she his her not no nor any each every both few more most other some such same so can could "
        "should would will just about over under again further once here all my our i me mine ours yours yourself "
        "yourselves himself herself itself themselves"
    ).split()
) + "']"


def _cases(pairs: str, start: str, special: dict[str, str] | None = None) -> str:
    whens = []
    for pair in pairs.split():
        suffix, _, put = pair.partition(":")
        n = len(suffix)
        fits = f"length(w) - {n} >= {start}" if suffix not in (special or {}) else special[suffix]
        whens.append(f"WHEN ends_with(w, '{suffix}') THEN CASE WHEN {fits} THEN w[1:length(w) - {n}] || '{put}' ELSE w END")
    return "CASE " + " ".join(whens) + " ELSE w END"


def stems_sql(source: str) -> str:
    """CTE `stems` (term, stem) over the distinct words of `source` (term)."""
    short = "'([^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$'"

    def mended(n: int) -> str:
        s = f"w[1:length(w) - {n}]"
        return (
            f"CASE WHEN NOT regexp_matches({s}, '[aeiouy]') THEN w WHEN regexp_matches({s}, '(at|bl|iz)$') THEN {s} || 'e' "
            f"WHEN regexp_matches({s}, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN w[1:length(w) - {n + 1}] "
            f"WHEN p1 >= length(w) - {n} AND regexp_matches({s}, {short}) THEN {s} || 'e' ELSE {s} END"
        )

    two = (
        "ational:ate ization:ize fulness:ful ousness:ous iveness:ive tional:tion biliti:ble lessli:less entli:ent ation:ate "
        "alism:al aliti:al ousli:ous iviti:ive fulli:ful enci:ence anci:ance abli:able izer:ize ator:ate alli:al bli:ble ogi:og li:"
    )
    three = "ational:ate tional:tion alize:al icate:ic iciti:ic ative: ical:ic ness: ful:"
    four = "ement: ance: ence: able: ible: ment: ant: ent: ism: ate: iti: ous: ive: ize: ion: al: er: ic:"
    whole = "skis:ski skies:sky dying:die lying:lie tying:tie idly:idl gently:gentl ugly:ugli early:earli only:onli singly:singl "
    whole += "sky:sky news:news howe:howe atlas:atlas cosmos:cosmos bias:bias andes:andes"
    exceptions = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in (p.split(":") for p in whole.split()))
    ogi = "length(w) - 3 >= p1 AND w[length(w) - 3] = 'l'"
    li = "length(w) - 2 >= p1 AND contains('cdeghkmnrt', w[length(w) - 2]) AND length(w) > 2"
    ion = "length(w) - 3 >= p2 AND w[length(w) - 3] IN ('s', 't')"
    return f"""vocabulary AS (SELECT DISTINCT term FROM {source}),
st0 AS (SELECT term, regexp_replace(regexp_replace(term, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') AS w FROM vocabulary),
st1 AS (SELECT *, CASE WHEN regexp_matches(w, '^(gener|arsen)') THEN 5 WHEN starts_with(w, 'commun') THEN 6
  WHEN regexp_matches(w, '[aeiouy][^aeiouy]') THEN length(regexp_extract(w, '^.*?[aeiouy][^aeiouy]')) ELSE length(w) END AS p1 FROM st0),
st2 AS (SELECT *, CASE WHEN regexp_matches(w[p1 + 1:], '[aeiouy][^aeiouy]') THEN p1 + length(regexp_extract(w[p1 + 1:], '^.*?[aeiouy][^aeiouy]'))
  ELSE length(w) END AS p2 FROM st1),
st3 AS (SELECT term, p1, p2, CASE WHEN ends_with(w, 'sses') THEN w[1:length(w) - 2]
  WHEN regexp_matches(w, '(ied|ies)$') THEN CASE WHEN length(w) > 4 THEN w[1:length(w) - 2] ELSE w[1:length(w) - 1] END
  WHEN regexp_matches(w, '(us|ss)$') THEN w WHEN regexp_matches(w, '[aeiouy].+s$') THEN w[1:length(w) - 1] ELSE w END AS w FROM st2),
st4 AS (SELECT term, p1, p2, w AS plain, CASE
  WHEN ends_with(w, 'eedly') THEN CASE WHEN length(w) - 5 >= p1 THEN w[1:length(w) - 3] ELSE w END
  WHEN ends_with(w, 'eed') THEN CASE WHEN length(w) - 3 >= p1 THEN w[1:length(w) - 1] ELSE w END
  WHEN ends_with(w, 'ingly') THEN {mended(5)} WHEN ends_with(w, 'edly') THEN {mended(4)}
  WHEN ends_with(w, 'ing') THEN {mended(3)} WHEN ends_with(w, 'ed') THEN {mended(2)} ELSE w END AS w FROM st3),
st5 AS (SELECT term, p1, p2, plain, CASE WHEN regexp_matches(w, '^.+[^aeiouy][yY]$') THEN w[1:length(w) - 1] || 'i' ELSE w END AS w FROM st4),
st6 AS (SELECT term, p1, p2, plain, {_cases(two, "p1", {"ogi": ogi, "li": li})} AS w FROM st5),
st7 AS (SELECT term, p1, p2, plain, {_cases(three, "p1", {"ative": "length(w) - 5 >= p2"})} AS w FROM st6),
st8 AS (SELECT term, p1, p2, plain, {_cases(four, "p2", {"ion": ion})} AS w FROM st7),
st9 AS (SELECT term, plain, CASE
  WHEN ends_with(w, 'e') AND (length(w) - 1 >= p2 OR (length(w) - 1 >= p1 AND NOT regexp_matches(w[1:length(w) - 1], {short}))) THEN w[1:length(w) - 1]
  WHEN ends_with(w, 'll') AND length(w) - 1 >= p2 THEN w[1:length(w) - 1] ELSE w END AS w FROM st8),
stems AS MATERIALIZED (SELECT term, CASE term {exceptions} ELSE CASE WHEN length(term) <= 2 THEN term
  WHEN plain IN ('inning', 'outing', 'canning', 'herring', 'earring', 'proceed', 'exceed', 'succeed') THEN plain
  ELSE replace(w, 'Y', 'y') END END AS stem FROM st9)"""


def _tokens_sql(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '[a-z0-9][a-z0-9\\-_/]*')"


@query(
    "word_stems",
    f"""WITH words AS (SELECT unnest({_tokens_sql("text")}) AS term FROM documents), {stems_sql("words")}
SELECT stem, count(*) AS words, min(term) AS first_word FROM stems GROUP BY stem""",
)
def word_stems(spark: SparkSession, folder: str) -> DataFrame:
    """Every stem of the corpus with the number of words that share it."""
    words = spark.read.parquet(f"{folder}/documents.parquet").select(F.explode(tx.tokens(F.col("text"))).alias("term"))
    return cover.vocabulary(words).groupBy("stem").agg(
        F.count(F.lit(1)).alias("words"), F.min("term").alias("first_word")
    )


@query(
    "cover_density_top_k",
    f"""WITH {CHUNKS_SQL},
placed AS (SELECT document_id, chunk_index, unnest(t) AS term, generate_subscripts(t, 1) AS place FROM (
  SELECT document_id, chunk_index, {_tokens_sql("content")} AS t FROM chunks)),
asks AS (SELECT item_id, unnest(t) AS term, generate_subscripts(t, 1) AS i FROM (SELECT item_id, {_tokens_sql("text")} AS t FROM benchmark)),
words AS (SELECT term FROM placed UNION ALL SELECT term FROM asks), {stems_sql("words")},
qterm AS (SELECT item_id, term, min(i) AS i FROM asks WHERE NOT list_contains({_STOP_SQL}, term) GROUP BY 1, 2),
main AS (SELECT item_id, term, row_number() OVER (PARTITION BY item_id ORDER BY i) AS no,
  row_number() OVER (PARTITION BY item_id ORDER BY length(term) DESC, i) AS long_no, count(*) OVER (PARTITION BY item_id) AS m FROM qterm WHERE length(term) >= 3),
rungs AS (SELECT item_id, 0 AS level, term FROM qterm UNION ALL SELECT item_id, 1, term FROM main WHERE m >= 2 AND no <= 14
  UNION ALL SELECT item_id, CAST(1 + long_no AS INTEGER), term FROM main),
rung AS MATERIALIZED (SELECT DISTINCT item_id, level, stem FROM rungs JOIN stems USING (term)),
need AS (SELECT item_id, level, count(*) AS n_terms FROM rung GROUP BY 1, 2),
occurrence AS MATERIALIZED (SELECT document_id, chunk_index, place, stem FROM placed JOIN stems USING (term)
  WHERE NOT list_contains({_STOP_SQL}, term) AND stem IN (SELECT stem FROM rung)),
held AS (SELECT DISTINCT document_id, chunk_index, stem FROM occurrence),
whole AS (SELECT item_id, level, document_id, chunk_index, any_value(n_terms) AS n_terms FROM rung JOIN held USING (stem) JOIN need USING (item_id, level)
  GROUP BY 1, 2, 3, 4 HAVING count(*) = any_value(n_terms)),
good AS MATERIALIZED (SELECT * FROM whole QUALIFY level = min(level) OVER (PARTITION BY item_id)),
entry AS MATERIALIZED (SELECT g.item_id, g.level, g.document_id, g.chunk_index, n_terms, place, o.stem,
  row_number() OVER (PARTITION BY g.item_id, g.document_id, g.chunk_index ORDER BY place) AS at
  FROM good g JOIN rung r USING (item_id, level) JOIN occurrence o ON o.document_id = g.document_id AND o.chunk_index = g.chunk_index AND o.stem = r.stem),
latest AS (SELECT r.item_id, r.level, r.document_id, r.chunk_index, r.n_terms, r.place AS q, r.at AS q_at, b.stem, max(b.place) AS p, max(b.at) AS p_at
  FROM entry r JOIN entry b ON r.item_id = b.item_id AND r.document_id = b.document_id AND r.chunk_index = b.chunk_index AND b.at <= r.at
  GROUP BY ALL),
span AS (SELECT item_id, level, document_id, chunk_index, q, q_at, min(p) AS p, min(p_at) AS p_at FROM latest
  GROUP BY 1, 2, 3, 4, 5, 6 HAVING count(*) = any_value(n_terms)),
cover AS (SELECT item_id, level, document_id, chunk_index, p, min(q) AS q, min(q_at) AS q_at, any_value(p_at) AS p_at FROM span GROUP BY 1, 2, 3, 4, 5),
scored AS (SELECT item_id AS query_id, document_id, chunk_index, level, round(sum(0.1::DOUBLE / (1 + (q - p) - (q_at - p_at))), 9) AS score
  FROM cover GROUP BY 1, 2, 3, 4)
SELECT query_id, document_id, chunk_index, level, round(score, 6) AS score,
  CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id, chunk_index) AS INTEGER) AS "rank"
FROM scored QUALIFY "rank" <= 192""",
)
def cover_density_top_k(spark: SparkSession, folder: str) -> DataFrame:
    index = stored_once(cover.positional_index(stored_once(chunks(spark, folder))))
    limit = retrieval.lexical_limit(retrieval.pool_size(16))
    return cover.cover_density_top_k(asked(spark, folder), index, limit).withColumn("score", F.round("score", 6))
