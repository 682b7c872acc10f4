"""Reports, golden questions and reference documents from whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from borewatch.plans import corpus
from borewatch.plans.catalogue import query
from borewatch.plans.registered.telemetry import daily
from borewatch.plans.roles import DAILY_SQL, settled_sql

FACTS_SQL = DAILY_SQL + """,
peaks AS (SELECT *, row_number() OVER (PARTITION BY well_id ORDER BY oil_rate_bopd DESC, "timestamp", water_cut_pct, gas_oil_ratio) AS a,
          row_number() OVER (PARTITION BY well_id ORDER BY water_cut_pct DESC, "timestamp", oil_rate_bopd, gas_oil_ratio) AS b FROM daily WHERE is_producing),
facts AS MATERIALIZED (SELECT well_id, 'Volve_RealDaily_' || replace(replace(trim(well_id), '/', '-'), ' ', '_') || '.md' AS doc, count(*) AS days, max(oil_rate_bopd) AS peak,
  avg(water_cut_pct) AS wct, avg(gas_oil_ratio) AS gor, coalesce(avg(bhp_psi) FILTER (WHERE bhp_psi > 0), 0) AS bhp, avg(oil_rate_bopd) AS oil, max(water_cut_pct) AS pwct,
  strftime(min("timestamp"), '%Y-%m-%d') AS d0, strftime(max("timestamp"), '%Y-%m-%d') AS d1,
  max(CASE WHEN a = 1 THEN strftime("timestamp", '%Y-%m-%d') END) AS po_day, max(CASE WHEN a = 1 THEN water_cut_pct END) AS po_wct, max(CASE WHEN a = 1 THEN gas_oil_ratio END) AS po_gor,
  max(CASE WHEN b = 1 THEN strftime("timestamp", '%Y-%m-%d') END) AS pc_day, max(CASE WHEN b = 1 THEN oil_rate_bopd END) AS pc_oil FROM peaks GROUP BY well_id),
tot AS (SELECT strftime(min("timestamp"), '%Y-%m-%d') AS d0, strftime(max("timestamp"), '%Y-%m-%d') AS d1, count(*) AS n, count(DISTINCT well_id) AS w FROM daily)"""


def _one(x: str) -> str:
    return f"printf('%.1f', {settled_sql(x, 1)})"


def _none(x: str) -> str:
    return f"printf('%.0f', {settled_sql(x, 0)})"


GOLDEN_SQL = f"""{FACTS_SQL},
cases AS (
  SELECT 'field_overview' AS category, '' AS well_id, 1 AS no, 'Between which calendar dates does the VOLVE field overview summarise daily production excerpts?' AS question,
    'VOLVE overview excerpts summarise data from **' || d0 || '** through **' || d1 || '**.' AS truth, '{corpus.FIELD_DOCUMENT}' AS sources, d0 || ', ' || d1 AS topics FROM tot
  UNION ALL SELECT 'field_overview', '', 2, 'How many VOLVE wells are enumerated in workbook-derived production summaries?', 'The VOLVE ingestion enumerates **' || w || '** producer wells.', '{corpus.FIELD_DOCUMENT}', 'well' FROM tot
  UNION ALL SELECT 'field_overview', '', 3, 'Which VOLVE well shows the highest peak daily oil in the excerpts, and roughly what magnitude?', 'Highest workbook peak belongs to **' || well_id || '** at about **' || {_one('peak')} || ' BOPD**.',
    '{corpus.FIELD_DOCUMENT},' || doc, 'peak, BOPD' FROM (SELECT * FROM facts ORDER BY peak DESC, well_id LIMIT 1)
  UNION ALL SELECT 'field_overview', '', 4, 'How many producing-day observations were pooled across all wells before chunking?', 'The workbook extract pools **' || n || '** producing-day observations across wells.', '{corpus.FIELD_DOCUMENT}', 'rows' FROM tot
  UNION ALL SELECT 'production_metrics', well_id, 1, 'What peak daily oil rate (BOPD) appears for VOLVE producer ' || well_id || ' in the workbook-backed summary?',
    'Peak oil for ' || well_id || ' is ' || {_one('peak')} || ' BOPD on ' || po_day || ', water cut roughly ' || {_one('po_wct')} || ' %.', doc || ',{corpus.FIELD_DOCUMENT}', 'BOPD, peak, oil' FROM facts
  UNION ALL SELECT 'production_metrics', well_id, 2, 'What producing-day date range covers well ' || well_id || ' in ingested VOLVE excerpts?', well_id || ' has producing-day excerpts from ' || d0 || ' through ' || d1 || '.',
    doc || ',{corpus.FIELD_DOCUMENT}', d0 || ', ' || d1 FROM facts
  UNION ALL SELECT 'production_metrics', well_id, 3, 'What average water-cut percentage appears across producing rows summarised for ' || well_id || '?',
    'Average producing-day water cut for ' || well_id || ' is about ' || {_one('wct')} || '% over ' || days || ' summarised producing rows.', doc, 'water cut' FROM facts
  UNION ALL SELECT 'production_metrics', well_id, 4, 'What maximum water-cut percentage is summarised for producer ' || well_id || ' and on what date did it occur?',
    'Highest summarised water cut for ' || well_id || ' is roughly ' || {_one('pwct')} || '% on ' || pc_day || ', with oil rate about ' || {_one('pc_oil')} || ' BOPD.', doc, 'water cut' FROM facts
  UNION ALL SELECT 'production_metrics', well_id, 5, 'What mean gas-oil ratio (scf/bbl) summarises producer ' || well_id || ' in the VOLVE workbook-derived text?',
    'Mean GOR across producing rows for ' || well_id || ' is roughly ' || {_none('gor')} || ' scf/bbl.', doc, 'GOR, scf/bbl' FROM facts
  UNION ALL SELECT 'production_metrics', well_id, 6, 'What approximate mean bottom-hole pressure (psi) summary exists for producer ' || well_id || '?',
    'Mean reporting BHP among producing rows summarised for ' || well_id || ' is about ' || {_none('bhp')} || ' psi.', doc, 'BHP' FROM facts WHERE bhp > 0),
golden AS MATERIALIZED (SELECT 'VGT-' || lpad(CAST(no AS VARCHAR), CAST(greatest(3, len(CAST(no AS VARCHAR))) AS INTEGER), '0') AS id, * EXCLUDE (no) FROM (
  SELECT row_number() OVER (ORDER BY category, well_id, no) AS no, category, question, topics, truth, sources FROM cases))"""


@query("golden_cases", f"WITH {GOLDEN_SQL} SELECT id, category, question, topics AS expected_topics, truth AS ground_truth, sources AS document_sources FROM golden")
def golden_cases(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.golden_cases(daily(spark, folder)).withColumns(
        {"expected_topics": F.array_join("expected_topics", ", "), "document_sources": F.array_join("document_sources", ",")}
    )


@query(
    "well_reports",
    f"""WITH {FACTS_SQL},
m AS (SELECT well_id, date_trunc('month', "timestamp") AS m, count(*) AS days, avg(oil_rate_bopd) AS o, avg(water_cut_pct) AS w FROM daily WHERE is_producing GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY well_id ORDER BY m DESC) AS back FROM m),
t AS (SELECT well_id, string_agg('| ' || strftime(m, '%Y-%m') || ' | ' || days || ' | ' || {_one('o')} || ' | ' || {_one('w')} || ' |', chr(10) ORDER BY m) AS months FROM r WHERE back <= 48 GROUP BY 1),
f AS (SELECT well_id, min(field_name) AS field FROM daily WHERE is_producing GROUP BY 1)
SELECT doc AS name, months, '| Peak oil BOPD | ' || {_one('peak')} || ' |' AS peak_line, '- **Field:** ' || field AS field_line,
  '- Peak oil **' || {_one('peak')} || ' BOPD** on ' || po_day || ' (WCT ~' || {_one('po_wct')} || ' %, GOR ~' || {_none('po_gor')} || ' scf/bbl).' AS extreme_line FROM facts JOIN t USING (well_id) JOIN f USING (well_id)""",
)
def well_reports(spark: SparkSession, folder: str) -> DataFrame:
    """The varying parts of each report."""
    lines = F.split("text", "\n")

    def first(prefix: str):
        return F.filter(lines, lambda s: s.startswith(prefix))[0]

    table = F.regexp_extract("text", r"(?s)\|-------\|-----:\|--------------:\|-----------:\|\n(.*?)\n\n", 1)
    return corpus.well_reports(daily(spark, folder)).select(
        "name", table.alias("months"), first("| Peak oil BOPD").alias("peak_line"), first("- **Field:**").alias("field_line"),
        first("- Peak oil").alias("extreme_line"),
    )


@query(
    "field_overview",
    f"""WITH {FACTS_SQL},
b AS (SELECT well_id, '- **' || well_id || '**: ' || d0 || ' → ' || d1 || ' — peak oil ' || {_none('peak')} || ' BOPD, avg WCT ' || {_one('wct')} || ' %' AS line, row_number() OVER (ORDER BY well_id) AS n, count(*) OVER () AS c FROM facts),
t AS (SELECT string_agg(line, chr(10) ORDER BY n) FILTER (WHERE n <= 20) || CASE WHEN max(c) > 20 THEN chr(10) || '- … +' || (max(c) - 20) || ' further wells' ELSE '' END AS bullets FROM b)
SELECT bullets, '**Coverage:** ' || d0 || ' → ' || d1 || '.' AS coverage_line,
  'The table holds **' || n || '** day rows of **' || w || '** wells.' AS total_line FROM t, tot""",
)
def field_overview(spark: SparkSession, folder: str) -> DataFrame:
    lines = F.split("text", "\n")

    def first(prefix: str):
        return F.filter(lines, lambda s: s.startswith(prefix))[0]

    bullets = F.regexp_extract("text", r"(?s)## Wells represented\n\n(.*?)\n\n", 1)
    return corpus.field_overview(daily(spark, folder)).select(
        bullets.alias("bullets"), first("**Coverage").alias("coverage_line"), first("The table holds").alias("total_line")
    )


@query(
    "reference_documents",
    f"""WITH {GOLDEN_SQL},
u AS (SELECT g.*, unnest(string_split(sources, ',')) AS name FROM golden g),
f AS (SELECT *, substr(id, 5)::BIGINT AS place, substr(id, 5)::BIGINT = min(substr(id, 5)::BIGINT) OVER (PARTITION BY name, truth) AS is_first FROM u),
blocks AS (SELECT name, place, '### ' || id || ' (' || category || ')' || chr(10) || chr(10) || '**Question:** ' || question || chr(10) || chr(10) || '**Topics:** ' || topics || chr(10) || chr(10)
    || CASE WHEN is_first THEN truth || chr(10) || chr(10) ELSE '' END || '---' || chr(10) AS text FROM f
  UNION ALL SELECT DISTINCT name, -1, '# ' || replace(replace(name, '.md', ''), '_', ' ') || chr(10) || chr(10) || 'Questions whose answers name **' || name || '** as a source.' || chr(10) || chr(10)
    || '## Questions and answers' || chr(10) FROM u)
SELECT name, 'reference' AS folder, row_number() OVER (PARTITION BY name ORDER BY place) AS block_no, md5(text) AS text_md5 FROM blocks""",
)
def reference_documents(spark: SparkSession, folder: str) -> DataFrame:
    blocks = corpus.reference_lines(corpus.golden_cases(daily(spark, folder)))
    return blocks.select("name", "folder", "block_no", F.md5("text").alias("text_md5"))
