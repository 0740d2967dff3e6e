"""Queries of the row-set operators: latest wins, preference, greedy choice, bundles and neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finstrata.functions import money, text
from finstrata.operators import rows
from finstrata.runtime import table


def latest_status_per_key(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "review_events").where(F.col("segment_id").isNotNull() & (F.col("action") != "")).dropDuplicates(["id"])
    return rows.latest_by(events.select("segment_id", "action", "event_at", "id"), ["segment_id"], ["event_at", "id"]).select("segment_id", "action", "id")


def latest_note_per_segment(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "review_events").where(F.col("segment_id").isNotNull() & (F.trim("note") != "")).select("segment_id", "note", "event_at", "id").distinct()
    return rows.latest_by(events, ["segment_id"], ["event_at", "id"]).select("segment_id", "note")


def latest_record_by_format(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "parsed_pages").withColumn("notation", F.lower("language"))
    return rows.latest_by(pages.select("notation", "id", "created_at"), ["notation"], ["created_at", "id"]).select("notation", "id")


def first_occurrence_flag(spark: SparkSession, d: str) -> DataFrame:
    segments = table(spark, d, "segment_rows").select("id", "document_id", text.alnum_words(F.col("segment_name")).alias("name"), money.period_key(F.col("period_label")).alias("period"))
    return rows.first_occurrences(segments, ["document_id", "name", "period"], "id").select("id", F.col("occurrence").cast("long").alias("occurrence"), "first_seen")


def latest_year_rows(spark: SparkSession, d: str) -> DataFrame:
    prepared = table(spark, d, "prepared_rows").select("row_id", "document_id", money.latest_year(F.coalesce("fiscal_period", F.lit(""))).alias("year"))
    return rows.keep_latest_year(prepared, "document_id", "year")


def primary_group_filter(spark: SparkSession, d: str) -> DataFrame:
    segments = table(spark, d, "segment_rows").select("id", F.substring("document_id", 1, 11).alias("doc_group"), (F.substring("id", -3, 3).cast("int") % 4).alias("page"), F.col("row_type"), F.col("metric_basis"), F.col("currency").alias("period"))
    metric = text.fold_ascii(F.coalesce("metric_basis", F.lit("")))
    priority = (
        F.when(metric.startswith("external customers"), 1).when(metric.isin("total income", "total operating income", "total revenues"), 10)
        .when(metric.isin("revenue", "revenues", "net revenues"), 9).when(metric.contains("revenue") | metric.contains("income"), 5).otherwise(0)
    )
    page = F.when(F.col("page") > 0, F.col("page"))
    return rows.keep_primary_group(segments.withColumn("page", page), "doc_group", "page", "period", F.col("row_type") == "business_segment", priority, min_rows=3).select("id", "doc_group", "page", "period")


def tier_preference_filter(spark: SparkSession, d: str) -> DataFrame:
    low = text.fold_ascii(F.col("text"))
    tier = F.when(text.contains_any(low, ["segment reporting", "segmentberichterstattung"]), 3).when(text.contains_any(low, ["external revenue", "aussenumsatz"]), 2).when(text.contains_any(low, ["revenue", "umsatz", "ricavi"]), 1).otherwise(0)
    pages = table(spark, d, "parsed_pages").select("id", "document_id", "text")
    return rows.keep_best_tier(pages, "document_id", tier).select("id", "document_id")


def greedy_dedup_band(spark: SparkSession, d: str) -> DataFrame:
    prepared = table(spark, d, "prepared_rows").where(F.col("page_number").isNotNull()).select(F.col("row_id"), "document_id", text.alnum_words(F.col("segment_name")).alias("name"), "page_number")
    return rows.dedup_neighbouring(prepared, ["document_id", "name"], "page_number", "row_id")


def gaps_islands_bundles(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "parsed_pages").where(F.col("has_text"))
    return rows.consecutive_bundles(pages, "document_id", "page_number", 3)


def fixed_batches(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "parsed_pages").select("id", "document_id", "page_number")
    return rows.fixed_batches(pages, "document_id", ["page_number", "id"], 40).select("id", "batch")


def neighbour_context(spark: SparkSession, d: str) -> DataFrame:
    segments = table(spark, d, "segment_rows").select(F.col("id").alias("row_id"), "document_id", money.page_of(F.col("page_ref")).alias("page_number"))
    found = rows.neighbour_context(segments, table(spark, d, "parsed_pages"), "row_id", "document_id", "page_number", "text")
    return found.select("row_id", F.length("context").cast("long").alias("chars"), F.md5("context").alias("digest"))


def near_page_semi(spark: SparkSession, d: str) -> DataFrame:
    segments = table(spark, d, "segment_rows").select("document_id", money.page_of(F.col("page_ref")).alias("page_number"))
    return rows.near_pages(table(spark, d, "parsed_pages").select("id", "document_id", "page_number"), segments, "document_id", "page_number").select("id")


def _scored_pages(spark: SparkSession, d: str) -> DataFrame:
    numbers = F.regexp_count(F.col("text"), F.lit(r"\d[\d,]*"))
    return table(spark, d, "parsed_pages").select("document_id", "page_number", (F.least(numbers, F.lit(40)) / 8).cast("double").alias("score"))


def greedy_candidate_pages(spark: SparkSession, d: str) -> DataFrame:
    return rows.select_with_neighbours(_scored_pages(spark, d), "document_id", "page_number", "score", limit=15, threshold=4.0)


def topk_pages(spark: SparkSession, d: str) -> DataFrame:
    return rows.top_k(_scored_pages(spark, d), ["document_id"], [F.desc("score"), F.asc("page_number")], 8).select("document_id", "page_number", F.col("rank").cast("long").alias("rank"))


QUERIES = {
    f.__name__: f for f in (
        latest_status_per_key, latest_note_per_segment, latest_record_by_format, first_occurrence_flag, latest_year_rows, primary_group_filter, tier_preference_filter,
        greedy_dedup_band, gaps_islands_bundles, fixed_batches, neighbour_context, near_page_semi, greedy_candidate_pages, topk_pages,
    )
}

_YEARS = "list_transform(list_filter(regexp_extract_all(coalesce({}, ''), '\\d+'), lambda x: regexp_full_match(x, '(19|20)\\d{{2}}')), lambda x: CAST(x AS INT))"
_PERIOD_KEY = "CASE WHEN regexp_matches(lower(trim(coalesce({0}, ''))), '(19|20)\\d{{2}}') THEN regexp_extract(lower(trim(coalesce({0}, ''))), '((?:19|20)\\d{{2}})', 1) ELSE regexp_replace(lower(trim(coalesce({0}, ''))), '[^a-z0-9]+', '', 'g') END"
_WORDS = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
_FOLD = "trim(regexp_replace(lower(regexp_replace(strip_accents({}), '[^\\x00-\\x7F]', '', 'g')), '\\s+', ' ', 'g'))"
_SCORED = "SELECT document_id, page_number, least(len(regexp_extract_all(text, '\\d[\\d,]*')), 40) / 8.0 AS score FROM parsed_pages"
SQL = {
    "latest_status_per_key": "SELECT segment_id, action, id FROM (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY event_at DESC, id DESC) AS k FROM (SELECT DISTINCT segment_id, action, event_at, id FROM review_events WHERE segment_id IS NOT NULL AND action <> '')) WHERE k = 1",
    "latest_note_per_segment": "SELECT segment_id, note FROM (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY event_at DESC, id DESC) AS k FROM (SELECT DISTINCT segment_id, note, event_at, id FROM review_events WHERE segment_id IS NOT NULL AND trim(note) <> '')) WHERE k = 1",
    "latest_record_by_format": "SELECT notation, id FROM (SELECT lower(language) AS notation, id, row_number() OVER (PARTITION BY lower(language) ORDER BY created_at DESC, id DESC) AS k FROM parsed_pages) WHERE k = 1",
    "first_occurrence_flag": f"WITH a AS (SELECT id, document_id, {_WORDS.format('segment_name')} AS n, {_PERIOD_KEY.format('period_label')} AS p FROM segment_rows) SELECT id, row_number() OVER (PARTITION BY document_id, n, p ORDER BY id) AS occurrence, min(id) OVER (PARTITION BY document_id, n, p) AS first_seen FROM a",
    "latest_year_rows": f"WITH a AS (SELECT row_id, document_id, list_max({_YEARS.format('fiscal_period')}) AS year FROM prepared_rows), b AS (SELECT document_id, max(year) AS y, count(DISTINCT year) AS n FROM a GROUP BY 1) SELECT row_id, document_id, CAST(year AS INT) AS year FROM a JOIN b USING (document_id) WHERE n < 2 OR year IS NULL OR year = y",
    "primary_group_filter": f"""WITH a AS (SELECT id, substr(document_id, 1, 11) AS doc_group, nullif(CAST(right(id, 3) AS INT) % 4, 0) AS page, row_type, {_FOLD.format("coalesce(metric_basis, '')")} AS m, currency AS period FROM segment_rows),
g AS (SELECT doc_group, page, period, count(*) AS n, max(CASE WHEN starts_with(m, 'external customers') THEN 1 WHEN m IN ('total income', 'total operating income', 'total revenues') THEN 10 WHEN m IN ('revenue', 'revenues', 'net revenues') THEN 9 WHEN contains(m, 'revenue') OR contains(m, 'income') THEN 5 ELSE 0 END) AS pr FROM a WHERE page IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 3 AND bool_or(coalesce(row_type = 'business_segment', false))),
b AS (SELECT doc_group, page AS bp, period AS bq FROM (SELECT *, row_number() OVER (PARTITION BY doc_group ORDER BY n / 2.0 + 5 + pr DESC, page, coalesce(period, '') DESC) AS k, count(*) OVER (PARTITION BY doc_group) AS c FROM g) WHERE k = 1 AND c >= 2)
SELECT id, doc_group, page, period FROM a LEFT JOIN b USING (doc_group) WHERE NOT EXISTS (SELECT 1 FROM b x WHERE x.doc_group = a.doc_group) OR coalesce(page = bp, false) OR period IS DISTINCT FROM bq""",
    "tier_preference_filter": f"WITH a AS (SELECT id, document_id, {_FOLD.format('text')} AS t FROM parsed_pages), b AS (SELECT id, document_id, CASE WHEN contains(t, 'segment reporting') OR contains(t, 'segmentberichterstattung') THEN 3 WHEN contains(t, 'external revenue') OR contains(t, 'aussenumsatz') THEN 2 WHEN contains(t, 'revenue') OR contains(t, 'umsatz') OR contains(t, 'ricavi') THEN 1 ELSE 0 END AS k FROM a) SELECT id, document_id FROM b QUALIFY k = max(k) OVER (PARTITION BY document_id)",
    "greedy_dedup_band": f"""WITH a AS (SELECT row_id, document_id, {_WORDS.format('segment_name')} AS name, page_number AS p FROM prepared_rows WHERE page_number IS NOT NULL),
g AS (SELECT document_id, name, list(p ORDER BY row_id) AS ps, list(row_id ORDER BY row_id) AS rs FROM a GROUP BY 1, 2),
k AS (SELECT document_id, name, list_reduce(list_prepend(CAST([] AS STRUCT(r VARCHAR, p INT)[]), list_transform(range(1, len(ps) + 1), lambda i: [{{'r': rs[i], 'p': ps[i]}}])), lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: abs(y.p - x[1].p) <= 1)) > 0 THEN acc ELSE list_concat(acc, x) END) AS kept FROM g)
SELECT document_id, name, u.r AS row_id, u.p AS page_number FROM (SELECT document_id, name, unnest(kept) AS u FROM k)""",
    "gaps_islands_bundles": "WITH a AS (SELECT DISTINCT document_id, page_number FROM parsed_pages WHERE has_text AND page_number IS NOT NULL), b AS (SELECT *, page_number - row_number() OVER (PARTITION BY document_id ORDER BY page_number) AS i FROM a) SELECT document_id, page_number, min(page_number) OVER (PARTITION BY document_id, i) AS run, CAST((row_number() OVER (PARTITION BY document_id, i ORDER BY page_number) - 1) // 3 AS INT) AS bundle FROM b",
    "fixed_batches": "SELECT id, CAST((row_number() OVER (PARTITION BY document_id ORDER BY page_number, id) - 1) // 40 AS INT) AS batch FROM parsed_pages",
    "neighbour_context": "WITH s AS (SELECT id AS row_id, document_id, CAST(nullif(regexp_extract(page_ref, '(\\d+)', 1), '') AS INT) AS p FROM segment_rows), c AS (SELECT row_id, substr(string_agg(coalesce(t.text, ''), chr(10) ORDER BY t.page_number, t.text), 1, 8000) AS context FROM s JOIN parsed_pages t ON t.document_id = s.document_id AND t.page_number BETWEEN s.p - 2 AND s.p + 2 GROUP BY row_id) SELECT row_id, length(context) AS chars, md5(context) AS digest FROM c",
    "near_page_semi": "WITH s AS (SELECT document_id, CAST(nullif(regexp_extract(page_ref, '(\\d+)', 1), '') AS INT) AS p FROM segment_rows) SELECT id FROM parsed_pages t WHERE EXISTS (SELECT 1 FROM s WHERE s.document_id = t.document_id AND t.page_number BETWEEN s.p - 1 AND s.p + 1)",
    "topk_pages": f"SELECT document_id, page_number, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, page_number) AS k FROM ({_SCORED})) WHERE k <= 8",
    "greedy_candidate_pages": f"""WITH p AS (SELECT * FROM ({_SCORED}) WHERE score > 0),
r AS (SELECT p.*, CAST(p.score >= 4 AND EXISTS (SELECT 1 FROM p b WHERE b.document_id = p.document_id AND b.page_number = p.page_number - 1) AS INT) AS l, CAST(p.score >= 4 AND EXISTS (SELECT 1 FROM p b WHERE b.document_id = p.document_id AND b.page_number = p.page_number + 1) AS INT) AS g FROM p),
a AS (SELECT document_id, list([page_number, l, g] ORDER BY score DESC, page_number) AS xs FROM r GROUP BY 1),
c AS (SELECT document_id, list_reduce(list_prepend(CAST([] AS INT[]), xs), lambda acc, x: CASE WHEN len(acc) >= 15 OR list_contains(acc, x[1]) THEN acc ELSE
  list_slice(list_concat(list_append(acc, x[1]), list_concat(CASE WHEN x[2] = 1 AND NOT list_contains(acc, x[1] - 1) THEN [x[1] - 1] ELSE CAST([] AS INT[]) END, CASE WHEN x[3] = 1 AND NOT list_contains(acc, x[1] + 1) THEN [x[1] + 1] ELSE CAST([] AS INT[]) END)), 1, 15) END) AS chosen FROM a)
SELECT document_id, CAST(unnest(chosen) AS INT) AS page_number FROM c""",
}
