"""Queries of classification, validation and the taxonomy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finstrata.functions import classify, money
from finstrata.functions.text import alnum_words
from finstrata.operators import taxonomy, validate
from finstrata.runtime import table


def reconcile_totals(spark: SparkSession, d: str) -> DataFrame:
    return validate.reconcile(table(spark, d, "orders"), table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", "o_totalprice", "l_extendedprice").select(
        "o_orderkey", F.col("target_total").cast("decimal(18,2)").alias("target_total"), F.col("part_sum").cast("decimal(18,2)").alias("part_sum"), F.col("difference").cast("decimal(18,2)").alias("difference"), "status"
    )


def reported_vs_explicit_total(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "segment_rows").withColumn("kind", classify.row_type(F.col("segment_name"), F.col("normalized_value")))
    parts = rows.select(F.col("document_id").alias("id"), F.when(F.col("kind") == "business_segment", F.col("normalized_value")).alias("part"), F.when(F.col("kind") == "total", F.col("normalized_value")).alias("stated"))
    return validate.reconcile(table(spark, d, "report_documents"), parts, "id", "reported_total", "part", "stated")


def row_type_classify(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "segment_rows", spread=True)
    return s.select("id", classify.row_type(F.col("segment_name_original"), F.col("normalized_value")).alias("row_kind"), classify.is_total(F.col("segment_name_original")).alias("total_label"))


def segment_type_classify(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "segment_rows", spread=True).select("id", classify.segment_type(F.col("segment_name_original"), F.col("metric_basis")).alias("segment_kind"))


def validation_issues(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "segment_rows")
    tests = [
        ("missing_value", "error", F.col("normalized_value").isNull()), ("missing_page", "warning", F.col("page_ref").isNull()), ("missing_currency", "warning", F.col("currency").isNull()),
        ("missing_period", "warning", F.col("period_label").isNull()), ("updated_before_created", "warning", F.col("updated_at") < F.col("created_at")),
        ("negative_total", "error", (classify.row_type(F.col("segment_name")) == "total") & (F.col("normalized_value") < 0)),
    ]
    return validate.row_issues(s, ["id", "document_id"], tests)


def document_inconsistencies(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "segment_rows").withColumn("fiscal_year", money.latest_year(F.coalesce("period_label", F.lit(""))))
    return validate.inconsistent(s, "document_id", ["currency", "scale", "fiscal_year"])


def missing_declared_segments(spark: SparkSession, d: str) -> DataFrame:
    declared = table(spark, d, "prepared_rows").select("document_id", "segment_name")
    extracted = table(spark, d, "segment_rows").select("document_id", "segment_name")
    return validate.missing_names(declared, extracted, "document_id", "segment_name", alnum_words(F.col("segment_name")))


def row_confidence(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "segment_rows")
    absent = lambda c, w: F.when(F.col(c).isNull(), w).otherwise(0.0)
    missing = absent("revenue_value", 0.35) + absent("currency", 0.2) + absent("scale", 0.2) + absent("period_label", 0.15)
    penalty = F.when(F.col("needs_review"), 0.45).otherwise(0.0) + F.when(F.col("status") == "needs_review", 0.15).otherwise(0.0)
    matched = F.when(F.col("row_type") == "business_segment", 1.0).otherwise(0.5)
    return s.select("id", validate.row_confidence(F.col("confidence"), F.col("page_ref").isNotNull(), F.col("section_ref").isNotNull(), missing, penalty, F.lit(None).cast("double"), matched).alias("row_confidence"))


def taxonomy_paths(spark: SparkSession, d: str) -> DataFrame:
    n = taxonomy.with_paths(table(spark, d, "nace_nodes"))
    return n.select("node_code", F.size("path_codes").cast("long").alias("depth"), F.element_at("path_codes", 1).alias("root"), F.element_at("path_names", -1).alias("leaf"))


def taxonomy_orphans(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "nace_nodes")
    return taxonomy.orphans(nodes.where(F.col("section_code") != "B").unionByName(nodes.where((F.col("section_code") == "B") & (F.col("level") != "division")))).select("node_key", "parent_key")


def code_or_division_lookup(spark: SparkSession, d: str) -> DataFrame:
    return taxonomy.lookup_with_ancestor(table(spark, d, "gold_rows").select("gold_id", "nace_code"), table(spark, d, "nace_nodes"), "nace_code")


def taxonomy_candidates_topk(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "gold_rows").select("gold_id", "nace_code", "segment_name")
    return taxonomy.candidates(items, table(spark, d, "nace_nodes"), "gold_id", "nace_code", "segment_name").select("gold_id", "node_code", "score", F.col("rank").cast("long").alias("rank"))


def hint_union_max(spark: SparkSession, d: str) -> DataFrame:
    found = taxonomy_candidates_topk(spark, d).select("gold_id", "node_code", "score")
    nodes = table(spark, d, "nace_nodes").where(F.col("level") == "class").select("node_code", "division_code")
    hinted = table(spark, d, "gold_rows").select("gold_id", F.regexp_extract("nace_code", r"^(\d{2})\.", 1).alias("division_code")).join(nodes, "division_code").select("gold_id", "node_code", F.lit(0.6).cast("decimal(6,4)").alias("score"))
    return taxonomy.merge_candidates(found, hinted, ["gold_id", "node_code"], "score")


def ranked_backfill(spark: SparkSession, d: str) -> DataFrame:
    found = taxonomy_candidates_topk(spark, d).select("gold_id", "node_code", "rank")
    chosen = found.where((F.col("rank") % 3) == 0)
    return taxonomy.ranked_backfill(chosen, found, "gold_id", "node_code", "rank").select("gold_id", "node_code", F.col("position").cast("long").alias("position"), "origin")


QUERIES = {
    f.__name__: f for f in (
        reconcile_totals, reported_vs_explicit_total, row_type_classify, segment_type_classify, validation_issues, document_inconsistencies, missing_declared_segments, row_confidence,
        taxonomy_paths, taxonomy_orphans, code_or_division_lookup, taxonomy_candidates_topk, hint_union_max, ranked_backfill,
    )
}

from finstrata.plans.text import _MEANINGS_SQL, _STOP_SQL  # noqa: E402

_FOLD = "trim(regexp_replace(lower(regexp_replace(strip_accents({}), '[^\\x00-\\x7F]', '', 'g')), '\\s+', ' ', 'g'))"


def _in(terms: list[str]) -> str:
    return "(" + ", ".join(f"'{t}'" for t in terms) + ")"


def _any(c: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, '{t}')" for t in terms) + ")"


def _meaning(column: str) -> str:
    return _MEANINGS_SQL.replace("segment_name_original", column)


def _kind(m: str, value: str) -> str:
    ends = " OR ".join(f"starts_with({m}, '{t}') OR ends_with({m}, '{t}')" for t in classify.TOTAL_ENDS)
    return f"CASE WHEN {m} IN {_in(classify.UNKNOWN)} THEN 'unknown' WHEN {m} IN {_in(classify.TOTALS)} OR {ends} THEN 'total' WHEN {_any(m, classify.ELIMINATIONS)} THEN 'elimination' WHEN {_any(m, classify.SUBTOTALS)} THEN 'subtotal' WHEN {_any(m, classify.RECONCILIATIONS)} OR coalesce({value} < 0, false) THEN 'other_reconciliation' ELSE 'business_segment' END"


_TOKENS = "list_distinct(list_filter(string_split(trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) > 2 AND w NOT IN (" + _STOP_SQL + ")))"
_D8 = "CAST({} AS DECIMAL(12,8))"
_CANDIDATES = f"""i AS (SELECT gold_id, regexp_replace(lower(coalesce(nace_code, '')), '[^a-z0-9]+', ' ', 'g') AS nx, regexp_replace(lower(concat_ws(' ', nace_code, segment_name)), '[^a-z0-9]+', ' ', 'g') AS qx FROM gold_rows),
it AS (SELECT gold_id, {_TOKENS.format('nx')} AS nt, {_TOKENS.format('qx')} AS qt, list_filter(string_split(trim(nx), ' '), lambda w: length(w) > 2 AND w NOT IN ({_STOP_SQL})) AS nlist FROM i),
n AS (SELECT node_code, level, level_depth, source_row_number, {_TOKENS.format('node_name')} AS lt, list_filter(string_split(trim(regexp_replace(lower(node_name), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) > 2 AND w NOT IN ({_STOP_SQL})) AS llist, {_TOKENS.format("replace(hierarchy_path_names, '|', ' ') || ' ' || node_name")} AS pt FROM nace_nodes WHERE level IN ('section', 'division', 'group', 'class')),
j AS (SELECT gold_id, node_code, level, level_depth, source_row_number, len(list_intersect(qt, pt)) AS ov, len(qt) AS q, len(list_intersect(nt, lt)) AS lo, len(lt) AS l, array_to_string(nlist, ' ') AS ns, array_to_string(llist, ' ') AS ls FROM it, n),
s AS (SELECT gold_id, node_code, level_depth, source_row_number, CAST(round(least({_D8.format('ov / greatest(q, 1)')} * 0.52 + {_D8.format('lo / greatest(l, 1)')} * 0.28 + CASE WHEN ns = ls THEN 0.30 WHEN ns <> '' AND contains(ls, ns) THEN 0.12 ELSE 0.0 END + CASE level WHEN 'division' THEN 0.03 WHEN 'group' THEN 0.05 WHEN 'class' THEN 0.07 ELSE 0.0 END, 1), 4) AS DECIMAL(6,4)) AS score FROM j WHERE ov > 0),
cand AS (SELECT gold_id, node_code, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY gold_id ORDER BY score DESC, level_depth DESC, source_row_number) AS rank FROM s) WHERE rank <= 30)"""
_PLACE = "CAST({} AS DECIMAL(10,6))"
SQL = {
    "reconcile_totals": "WITH s AS (SELECT l_orderkey AS k, sum(CAST(l_extendedprice AS DECIMAL(28,6))) AS p FROM lineitem GROUP BY 1), a AS (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(28,6)) AS t, p FROM orders LEFT JOIN s ON k = o_orderkey) SELECT o_orderkey, CAST(t AS DECIMAL(18,2)) AS target_total, CAST(p AS DECIMAL(18,2)) AS part_sum, CAST(p - t AS DECIMAL(18,2)) AS difference, CASE WHEN t IS NULL OR p IS NULL THEN 'not_available' WHEN abs(p - t) <= greatest(1, abs(t) * 0.005) THEN 'matched' ELSE 'failed' END AS status FROM a",
    "reported_vs_explicit_total": f"""WITH m AS (SELECT document_id, normalized_value AS v, {_meaning('segment_name')} AS m FROM segment_rows), k AS (SELECT document_id, v, {_kind('m', 'v')} AS k FROM m),
s AS (SELECT document_id, sum(CASE WHEN k = 'business_segment' THEN CAST(v AS DECIMAL(28,6)) END) AS p, max(CASE WHEN k = 'total' THEN v END) AS e FROM k GROUP BY 1),
a AS (SELECT id, nullif(e, 0) AS e, coalesce(nullif(e, 0), reported_total) AS t, p FROM report_documents LEFT JOIN s ON document_id = id)
SELECT id, CAST(t AS DECIMAL(38,6)) AS target_total, CASE WHEN e IS NOT NULL THEN 'explicit' WHEN t IS NOT NULL THEN 'reported' ELSE 'none' END AS total_source, CAST(p AS DECIMAL(38,6)) AS part_sum, CAST(p - t AS DECIMAL(38,6)) AS difference, CASE WHEN t IS NULL OR p IS NULL THEN 'not_available' WHEN abs(p - t) <= greatest(1, abs(CAST(t AS DOUBLE)) * 0.005) THEN 'matched' ELSE 'failed' END AS status FROM a""",
    "row_type_classify": f"WITH m AS (SELECT id, normalized_value AS v, {_meaning('segment_name_original')} AS m, {_FOLD.format('segment_name_original')} AS f FROM segment_rows) SELECT id, {_kind('m', 'v')} AS row_kind, f IN ('total', 'total revenue', 'total revenues', 'total income', 'grand total', 'group total') OR starts_with(f, 'total ') OR ends_with(f, ' total') AS total_label FROM m",
    "segment_type_classify": f"""WITH m AS (SELECT id, {_meaning('segment_name_original')} AS m, {_meaning('metric_basis')} AS e FROM segment_rows), b AS (SELECT id, m, concat_ws(' ', m, e) AS c FROM m)
SELECT id, CASE WHEN m IN ('', 'other', 'others', 'miscellaneous') THEN 'mixed_or_unclear' WHEN {_any('m', classify.GEOGRAPHIES)} THEN 'geographic_segment' WHEN {_any('m', classify.CUSTOMERS)} THEN 'customer_segment' WHEN {_any("(' ' || m || ' ')", classify.MIXED)} THEN 'multi_activity' WHEN {_any('m', classify.PRODUCTS)} AND NOT {_any('m', classify.ACTIVITIES)} THEN 'product_segment' WHEN {_any('c', classify.ACTIVITIES)} THEN 'single_activity' ELSE 'mixed_or_unclear' END AS segment_kind FROM b""",
    "validation_issues": f"""WITH m AS (SELECT *, {_meaning('segment_name')} AS m FROM segment_rows)
SELECT id, document_id, 'missing_value' AS issue_type, 'error' AS severity FROM m WHERE normalized_value IS NULL UNION ALL SELECT id, document_id, 'missing_page', 'warning' FROM m WHERE page_ref IS NULL UNION ALL SELECT id, document_id, 'missing_currency', 'warning' FROM m WHERE currency IS NULL
UNION ALL SELECT id, document_id, 'missing_period', 'warning' FROM m WHERE period_label IS NULL UNION ALL SELECT id, document_id, 'updated_before_created', 'warning' FROM m WHERE updated_at < created_at UNION ALL SELECT id, document_id, 'negative_total', 'error' FROM m WHERE {_kind('m', 'NULL')} = 'total' AND normalized_value < 0""",
    "document_inconsistencies": "WITH a AS (SELECT document_id, currency, scale, CAST(list_max(list_transform(list_filter(regexp_extract_all(coalesce(period_label, ''), '\\d+'), lambda x: regexp_full_match(x, '(19|20)\\d{2}')), lambda x: CAST(x AS INT))) AS VARCHAR) AS fy FROM segment_rows), u AS (SELECT document_id, 'currency' AS field, currency AS v FROM a UNION SELECT document_id, 'scale', scale FROM a UNION SELECT document_id, 'fiscal_year', fy FROM a) SELECT document_id, field, string_agg(v, ', ' ORDER BY v) AS found FROM u WHERE v IS NOT NULL AND v <> '' GROUP BY 1, 2 HAVING count(*) > 1",
    "missing_declared_segments": "WITH n AS (SELECT document_id, segment_name, trim(regexp_replace(lower(segment_name), '[^a-z0-9]+', ' ', 'g')) AS k FROM prepared_rows), e AS (SELECT document_id, trim(regexp_replace(lower(segment_name), '[^a-z0-9]+', ' ', 'g')) AS k FROM segment_rows) SELECT DISTINCT document_id, segment_name FROM n WHERE k <> '' AND NOT EXISTS (SELECT 1 FROM e WHERE e.document_id = n.document_id AND e.k = n.k)",
    "row_confidence": f"""WITH a AS (SELECT id, {_PLACE.format('coalesce(confidence, 0.5)')} AS c, {_PLACE.format('CASE WHEN page_ref IS NOT NULL AND section_ref IS NOT NULL THEN 1.0 WHEN page_ref IS NOT NULL OR section_ref IS NOT NULL THEN 0.5 ELSE 0 END')} AS e,
{_PLACE.format('greatest(0, 1 - (CASE WHEN revenue_value IS NULL THEN 0.35 ELSE 0 END + CASE WHEN currency IS NULL THEN 0.2 ELSE 0 END + CASE WHEN scale IS NULL THEN 0.2 ELSE 0 END + CASE WHEN period_label IS NULL THEN 0.15 ELSE 0 END))')} AS n,
{_PLACE.format("greatest(0, 1 - (CASE WHEN needs_review THEN 0.45 ELSE 0 END + CASE WHEN status = 'needs_review' THEN 0.15 ELSE 0 END))")} AS v, {_PLACE.format("CASE WHEN row_type = 'business_segment' THEN 1.0 ELSE 0.5 END")} AS r FROM segment_rows)
SELECT id, CAST(round(c * 0.40 + e * 0.18 + n * 0.17 + v * 0.15 + CAST(0.5 AS DECIMAL(10,6)) * 0.05 + r * 0.05, 4) AS DECIMAL(6,4)) AS row_confidence FROM a""",
    "taxonomy_paths": "SELECT node_code, CAST(len(string_split(hierarchy_path_codes, '|')) AS BIGINT) AS depth, trim(string_split(hierarchy_path_codes, '|')[1]) AS root, trim(string_split(hierarchy_path_names, '|')[-1]) AS leaf FROM nace_nodes WHERE level IN ('section', 'division', 'group', 'class') AND trim(node_code) <> ''",
    "taxonomy_orphans": "WITH n AS (SELECT * FROM nace_nodes WHERE NOT (section_code = 'B' AND level = 'division')) SELECT node_key, parent_key FROM n WHERE parent_key IS NOT NULL AND parent_key NOT IN (SELECT node_key FROM n)",
    "code_or_division_lookup": "SELECT gold_id, nace_code, coalesce(a.node_name, b.node_name) AS node_name, CASE WHEN a.node_name IS NOT NULL THEN 'code' WHEN b.node_name IS NOT NULL THEN 'division' ELSE 'none' END AS resolved FROM gold_rows LEFT JOIN nace_nodes a ON a.node_code = nace_code LEFT JOIN nace_nodes b ON b.node_code = nullif(regexp_extract(nace_code, '^(\\d{2})', 1), '')",
    "taxonomy_candidates_topk": f"WITH {_CANDIDATES} SELECT gold_id, node_code, score, rank FROM cand",
    "hint_union_max": f"""WITH {_CANDIDATES}, h AS (SELECT g.gold_id, c.node_code, CAST(0.6 AS DECIMAL(6,4)) AS score FROM gold_rows g JOIN nace_nodes c ON c.level = 'class' AND c.division_code = regexp_extract(g.nace_code, '^(\\d{{2}})\\.', 1)),
u AS (SELECT gold_id, node_code, score, 1 AS h FROM h UNION ALL SELECT gold_id, node_code, score, 0 FROM cand) SELECT gold_id, node_code, score, h = 1 AS hinted FROM (SELECT *, row_number() OVER (PARTITION BY gold_id, node_code ORDER BY score DESC, h DESC) AS k FROM u) WHERE k = 1""",
    "ranked_backfill": f"""WITH {_CANDIDATES}, u AS (SELECT gold_id, node_code, rank, CASE WHEN rank % 3 = 0 THEN 0 ELSE 1 END AS src FROM cand)
SELECT gold_id, node_code, k AS position, CASE WHEN src = 0 THEN 'chosen' ELSE 'backfill' END AS origin FROM (SELECT *, row_number() OVER (PARTITION BY gold_id ORDER BY src, rank, node_code) AS k FROM u) WHERE k <= 5""",
}
