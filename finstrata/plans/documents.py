"""Queries of the document operators, and of groupings over several levels."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finstrata.functions import classify, money
from finstrata.functions.text import LANGUAGE_HINTS
from finstrata.operators import documents, rows
from finstrata.plans.text import _CURRENCY_SQL, _MEANINGS_SQL, _MONEY_SQL, _TIMES, _any, _scale_sql
from finstrata.plans.validate import _kind
from finstrata.runtime import table


def document_metadata(spark: SparkSession, d: str) -> DataFrame:
    first = table(spark, d, "parsed_pages").where(F.col("page_number") == 1).select("document_id", documents.first_company_line(F.col("text")).alias("line"), documents.document_period(F.col("text")).alias("period"))
    docs = table(spark, d, "report_documents").join(first, F.col("id") == F.col("document_id"), "left")
    return docs.select("id", documents.hint_or(F.col("company_name"), F.col("line")).alias("company"), documents.hint_or(F.col("fiscal_period"), F.col("period")).alias("period"), F.array_join(documents.blank_fields(["fiscal_period", "reported_total", "currency", "scale"]), ",").alias("blank"))


def page_kind_flags(spark: SparkSession, d: str) -> DataFrame:
    return documents.page_flags(table(spark, d, "parsed_pages"))


def page_excerpts(spark: SparkSession, d: str) -> DataFrame:
    return documents.excerpts(table(spark, d, "parsed_pages"))


def normalised_rows(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "report_documents").select(F.col("id").alias("document_id"), F.col("currency").alias("doc_currency"), F.col("scale").alias("doc_scale"))
    return documents.normalised_rows(table(spark, d, "segment_rows"), docs)


def classification_defaults(spark: SparkSession, d: str) -> DataFrame:
    return documents.with_classification(table(spark, d, "segment_rows")).select("id", "row_type", "segment_type", "segment_name_normalized", "language")


def next_page_lead(spark: SparkSession, d: str) -> DataFrame:
    return documents.with_next_page(table(spark, d, "parsed_pages"))


def findings_by_name(spark: SparkSession, d: str) -> DataFrame:
    findings = table(spark, d, "prepared_rows").select("row_id", "document_id", F.col("segment_name").alias("name")).withColumnRenamed("row_id", "finding_id")
    return documents.by_last_name(findings, table(spark, d, "segment_rows").select("id", "document_id", "segment_name"), "document_id").select("finding_id", "row_id", "level")


def rerun_keeps_reviewers(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "segment_rows").select(F.col("id").alias("segment_id"), F.col("segment_type").alias("code"), F.when(F.col("extraction_method") == "manual", "reviewer").otherwise("auto").alias("source"))
    new = s.where(F.col("segment_id").endswith("5") | F.col("segment_id").endswith("0")).select("segment_id", F.lit("rerun").alias("code"), F.lit("model").alias("source"))
    return documents.rerun_selections(s, new, "segment_id")


def elapsed_times(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "report_documents").select("id", documents.elapsed_seconds(F.col("created_at"), F.col("updated_at")).alias("seconds"))


def evidence_bundle(spark: SparkSession, d: str) -> DataFrame:
    return documents.evidence_bundles(table(spark, d, "prepared_rows"), "document_id", "page_number", "evidence_text")


def denominator_cascade(spark: SparkSession, d: str) -> DataFrame:
    return documents.denominators(table(spark, d, "report_documents").select("id", "reported_total"), table(spark, d, "segment_rows").select("document_id", "id", "row_type", "normalized_value"))


def failure_from_notes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gold_rows").select("gold_id", documents.failure_of_note(F.col("notes")).alias("failure"))


def selection_or_top(spark: SparkSession, d: str) -> DataFrame:
    """The reviewer's last stated name of a segment, else its own."""
    e = rows.latest_by(table(spark, d, "review_events").where((F.col("field_changed") == "segment_name") & F.col("segment_id").isNotNull()).select("segment_id", "new_value", "event_at", "id").distinct(), ["segment_id"], ["event_at", "id"]).select("segment_id", "new_value")
    s = table(spark, d, "segment_rows").select("id", "segment_name").join(e, F.col("id") == F.col("segment_id"), "left")
    return s.select("id", F.coalesce("new_value", "segment_name").alias("shown_name"), F.when(F.col("new_value").isNotNull(), "reviewer").otherwise("own").alias("origin"))


def status_by_type_cube(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "segment_rows").select(F.coalesce("status", F.lit("?")).alias("status"), F.coalesce("row_type", F.lit("?")).alias("row_type"))
    return s.cube("status", "row_type").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("long").alias("level"))


def value_by_year_rollup(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "segment_rows").select(F.coalesce("currency", F.lit("?")).alias("currency"), F.coalesce(money.latest_year(F.coalesce("period_label", F.lit(""))), F.lit(0)).alias("year"), F.col("normalized_value").cast("decimal(28,6)").alias("v"))
    return s.rollup("currency", "year").agg(F.sum("v").cast("decimal(38,6)").alias("total"), F.count("v").alias("n"))


QUERIES = {
    f.__name__: f for f in (
        document_metadata, page_kind_flags, page_excerpts, normalised_rows, classification_defaults, next_page_lead, findings_by_name, rerun_keeps_reviewers, elapsed_times, evidence_bundle, denominator_cascade,
        failure_from_notes, selection_or_top, status_by_type_cube, value_by_year_rollup,
    )
}

_LINES = "list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '')"
_YEAR = "list_max(list_transform(list_filter(regexp_extract_all({}, '\\d+'), lambda x: regexp_full_match(x, '(19|20)\\d{{2}}')), lambda x: CAST(x AS INT)))"
_FOLD = "trim(regexp_replace(lower(regexp_replace(strip_accents({}), '[^\\x00-\\x7F]', '', 'g')), '\\s+', ' ', 'g'))"
_M = _MEANINGS_SQL.replace("segment_name_original", "segment_name")


def _cur(column: str) -> str:
    return re.sub(r"\bs\b(?=[,)])", column, _CURRENCY_SQL)


SQL = {
    "document_metadata": f"""WITH p AS (SELECT document_id, {_LINES}[1:20] AS ls, lower(coalesce(text, '')) AS low FROM parsed_pages WHERE page_number = 1),
f AS (SELECT document_id, list_filter(ls, lambda x: regexp_matches(x, '(?i)\\b(plc|inc|ltd|se|ag|s\\.p\\.a|a/s|n\\.v|s\\.a|gmbh)\\b') AND length(x) BETWEEN 3 AND 90 AND NOT regexp_matches(lower(x), 'report|copyright|page'))[1] AS line,
'FY' || coalesce(nullif(regexp_extract(low, 'year ended[^\\n]{{0,40}}?((?:19|20)\\d{{2}})', 1), ''), nullif(regexp_extract(low, 'annual report[^\\n]{{0,40}}?((?:19|20)\\d{{2}})', 1), ''), CAST({_YEAR.format('low')} AS VARCHAR)) AS period FROM p)
SELECT id, coalesce(nullif(trim(company_name), ''), line) AS company, coalesce(nullif(trim(fiscal_period), ''), period) AS period, array_to_string(list_filter([CASE WHEN coalesce(trim(fiscal_period), '') = '' THEN 'fiscal_period' END, CASE WHEN reported_total IS NULL THEN 'reported_total' END, CASE WHEN coalesce(trim(currency), '') = '' THEN 'currency' END, CASE WHEN coalesce(trim(scale), '') = '' THEN 'scale' END], lambda x: x IS NOT NULL), ',') AS blank FROM report_documents LEFT JOIN f ON document_id = id""",
    "page_kind_flags": f"""WITH p AS (SELECT id, coalesce(text, '') AS t, {_FOLD.format("coalesce(text, '')")} AS f, list_transform({_LINES}[1:5], lambda x: lower(x)) AS h, tables.tables AS tb FROM parsed_pages)
SELECT id, len(list_filter(h, lambda x: x IN ('consolidated financial statements', 'financial statements') OR starts_with(x, 'financial statements') OR ends_with(x, 'financial statements'))) > 0 AS is_statement, {_any('f', list(documents.UPDATES))} AS is_update, {_any('f', list(documents.PRODUCTS_OR_PLACES))} AS is_breakdown,
coalesce(len(tb), 0) > 0 AND coalesce(list_sum(list_transform(tb, lambda x: list_sum(list_transform(x.rows, lambda r: len(r))))), 0) >= 12 AND len(regexp_extract_all(t, '\\d[\\d,]*')) >= 6 AS has_structure FROM p""",
    "page_excerpts": f"SELECT id, substr(coalesce({_LINES}[1], ''), 1, 160) AS heading, substr(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')), 1, 900) AS excerpt, array_to_string(list_transform(coalesce(tables.tables[1:2], []), lambda x: array_to_string(list_transform(x.rows[1:4], lambda r: array_to_string(list_transform(r, lambda c: coalesce(c, '')), ' | ')), chr(10))), chr(10) || '--' || chr(10)) AS table_text FROM parsed_pages",
    "normalised_rows": f"""WITH mo AS ({_MONEY_SQL}), j AS (SELECT s.id, revenue_raw, s.currency AS c0, s.scale AS s0, r.currency AS c1, r.scale AS s1, period_label, page_ref, coalesce(mo.amount, CAST(revenue_value AS DECIMAL(38,6))) AS v FROM segment_rows s LEFT JOIN report_documents r ON r.id = s.document_id LEFT JOIN mo ON mo.id = s.id),
k AS (SELECT *, coalesce({_cur('revenue_raw')}, {_cur('c0')}) AS oc, {_cur('c1')} AS dc, coalesce({_scale_sql('revenue_raw')}, {_scale_sql('s0')}) AS os, {_scale_sql('s1')} AS ds, trim(regexp_replace(coalesce(period_label, ''), '\\s+', ' ', 'g')) AS t, {_YEAR.format("coalesce(period_label, '')")} AS y, CAST(nullif(regexp_extract(page_ref, '(\\d+)', 1), '') AS INT) AS pg FROM j)
SELECT id, coalesce(oc, dc) AS currency, coalesce(os, ds) AS scale, CASE WHEN period_label IS NULL OR t = '' THEN NULL WHEN y IS NOT NULL THEN 'FY' || y ELSE t END AS period, pg AS page, CAST(v * {_TIMES.format(s="coalesce(os, ds)", e='NULL')} AS DECIMAL(38,6)) AS value,
array_to_string(list_filter([CASE WHEN v IS NULL THEN 'value missing' END, CASE WHEN oc IS NULL AND dc IS NOT NULL THEN 'currency inferred' END, CASE WHEN oc IS NULL AND dc IS NULL THEN 'currency missing' END, CASE WHEN os IS NULL AND ds IS NOT NULL THEN 'scale inferred' END, CASE WHEN os IS NULL AND ds IS NULL THEN 'scale missing' END, CASE WHEN y IS NULL THEN 'period missing' END, CASE WHEN pg IS NULL THEN 'page missing' END], lambda x: x IS NOT NULL), '; ') AS warnings FROM k""",
    "classification_defaults": f"""WITH m AS (SELECT *, {_M} AS m, trim(regexp_replace(lower(strip_accents(segment_name)), '\\s+', ' ', 'g')) AS p FROM segment_rows)
SELECT id, coalesce(nullif(trim(row_type), ''), {_kind('m', 'normalized_value')}) AS row_type, coalesce(nullif(trim(segment_type), ''), CASE WHEN m IN ('', 'other', 'others', 'miscellaneous') THEN 'mixed_or_unclear' WHEN {_any('m', classify.GEOGRAPHIES)} THEN 'geographic_segment' WHEN {_any('m', classify.CUSTOMERS)} THEN 'customer_segment' WHEN {_any("(' ' || m || ' ')", classify.MIXED)} THEN 'multi_activity' WHEN {_any('m', classify.PRODUCTS)} AND NOT {_any('m', classify.ACTIVITIES)} THEN 'product_segment' WHEN {_any('m', classify.ACTIVITIES)} THEN 'single_activity' ELSE 'mixed_or_unclear' END) AS segment_type,
coalesce(nullif(trim(segment_name_normalized), ''), m) AS segment_name_normalized, coalesce(nullif(trim(language), ''), CASE WHEN m = '' THEN NULL {" ".join(f"WHEN {_any('p', h)} THEN '{c}'" for c, h in LANGUAGE_HINTS)} ELSE 'en' END) AS language FROM m""",
    "next_page_lead": "SELECT id, CASE WHEN lead(page_number) OVER w = page_number + 1 THEN lead(id) OVER w END AS next_id FROM parsed_pages WINDOW w AS (PARTITION BY document_id ORDER BY page_number, id)",
    "findings_by_name": "WITH l AS (SELECT document_id, lower(segment_name) AS n, max(id) AS row_id FROM segment_rows GROUP BY 1, 2) SELECT p.row_id AS finding_id, l.row_id, CASE WHEN l.row_id IS NULL THEN 'document' ELSE 'row' END AS level FROM prepared_rows p LEFT JOIN l ON l.document_id = p.document_id AND l.n = lower(p.segment_name)",
    "rerun_keeps_reviewers": "SELECT id AS segment_id, CASE WHEN extraction_method = 'manual' THEN segment_type WHEN right(id, 1) IN ('0', '5') THEN 'rerun' ELSE segment_type END AS code, CASE WHEN extraction_method = 'manual' THEN 'reviewer' WHEN right(id, 1) IN ('0', '5') THEN 'model' ELSE 'auto' END AS source FROM segment_rows",
    "elapsed_times": "SELECT id, greatest(0.0, (epoch_us(updated_at) - epoch_us(created_at)) / 1000000.0) AS seconds FROM report_documents",
    "evidence_bundle": "WITH e AS (SELECT DISTINCT document_id, coalesce(page_number, 0) AS p, evidence_text AS t FROM prepared_rows WHERE trim(evidence_text) <> '') SELECT document_id, coalesce((SELECT string_agg(CAST(p AS VARCHAR), ',' ORDER BY p) FROM (SELECT DISTINCT p FROM e x WHERE x.document_id = e.document_id AND p > 0)), '') AS pages, substr(string_agg('Page ' || p || ': ' || t, ' ' ORDER BY p, t), 1, 4000) AS bundle FROM e GROUP BY document_id",
    "denominator_cascade": "WITH s AS (SELECT document_id, arg_min(normalized_value, id) FILTER (row_type = 'total' AND normalized_value IS NOT NULL) AS stated, sum(CAST(normalized_value AS DECIMAL(28,6))) FILTER (row_type = 'business_segment' AND normalized_value > 0) AS parts FROM segment_rows GROUP BY 1) SELECT id, CAST(coalesce(CASE WHEN reported_total > 0 THEN reported_total END, stated, parts) AS DECIMAL(38,6)) AS denominator, CASE WHEN reported_total > 0 THEN 'reported' WHEN stated IS NOT NULL THEN 'stated' WHEN parts IS NOT NULL THEN 'parts' ELSE 'none' END AS origin FROM report_documents LEFT JOIN s ON document_id = id",
    "failure_from_notes": "SELECT gold_id, CASE " + " ".join(f"WHEN {_any(chr(108) + 'ower(coalesce(notes, ' + chr(39) * 2 + '))', n)} THEN '{k}'" for k, n in documents.NOTE_FAILURES) + " END AS failure FROM gold_rows",
    "selection_or_top": "WITH e AS (SELECT segment_id, new_value FROM (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY event_at DESC, id DESC) AS k FROM (SELECT DISTINCT segment_id, new_value, event_at, id FROM review_events WHERE field_changed = 'segment_name' AND segment_id IS NOT NULL)) WHERE k = 1) SELECT s.id, coalesce(new_value, segment_name) AS shown_name, CASE WHEN new_value IS NOT NULL THEN 'reviewer' ELSE 'own' END AS origin FROM segment_rows s LEFT JOIN e ON segment_id = s.id",
    "status_by_type_cube": "SELECT status, row_type, count(*) AS n, CAST(grouping_id(status, row_type) AS BIGINT) AS level FROM (SELECT coalesce(status, '?') AS status, coalesce(row_type, '?') AS row_type FROM segment_rows) GROUP BY CUBE (status, row_type)",
    "value_by_year_rollup": f"SELECT currency, year, CAST(sum(v) AS DECIMAL(38,6)) AS total, count(v) AS n FROM (SELECT coalesce(currency, '?') AS currency, coalesce({_YEAR.format(chr(99) + 'oalesce(period_label, ' + chr(39) * 2 + ')')}, 0) AS year, CAST(normalized_value AS DECIMAL(28,6)) AS v FROM segment_rows) GROUP BY ROLLUP (currency, year)",
}
