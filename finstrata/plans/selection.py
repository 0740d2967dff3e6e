"""Queries of choosing pages and rows, of what a match is worth, and of how far an effect may go."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finstrata.functions import classify, json_text, money, text
from finstrata.operators import documents, evaluate, pages, rows, scoring
from finstrata.plans import pages as page_plans
from finstrata.plans import review, validate
from finstrata.runtime import table


def candidate_page_scores(spark: SparkSession, d: str) -> DataFrame:
    """The pages of each report that are worth reading, by their relevance and that of the page beside them."""
    parsed = table(spark, d, "parsed_pages", spread=True)
    scored = pages.page_scores(parsed).select("id", F.col("relevance_score").cast("double").alias("relevance")).join(parsed.select("id", "document_id", "page_number"), "id")
    return rows.chosen_with_neighbours(scored, "document_id", "page_number", "relevance").withColumn("place", F.col("place").cast("long"))


def row_rejections(spark: SparkSession, d: str) -> DataFrame:
    segments = table(spark, d, "segment_rows").select("id", "document_id", "segment_name", "metric_basis", "section_ref", money.page_of(F.col("page_ref")).alias("page_number"))
    parsed = table(spark, d, "parsed_pages").select("document_id", "page_number", F.col("text").alias("page"))
    beside = segments.join(parsed, ["document_id", "page_number"], "left")
    return beside.select("id", documents.rejection(F.col("segment_name"), F.col("metric_basis"), F.lit(None).cast("string"), F.col("section_ref"), F.col("page")).alias("rejection"))


def repeated_facts(spark: SparkSession, d: str) -> DataFrame:
    """Second and later rows of a name and period in a document; totals may be repeated."""
    segments = table(spark, d, "segment_rows").select("id", "document_id", "segment_name", text.alnum_words(F.col("segment_name")).alias("name"), money.period_key(F.col("period_label")).alias("period"))
    return rows.first_occurrences(segments, ["document_id", "name", "period"], "id", classify.is_total(F.col("segment_name"))).where("occurrence > 1").select("id", "first_seen")


def limited_effects(spark: SparkSession, d: str) -> DataFrame:
    """Confidence against the middle as an effect, held within what the row's confidence allows."""
    segments = table(spark, d, "segment_rows")
    effect = F.round(F.col("confidence") * 2 - 1, 6)
    return segments.select("id", scoring.limited_by_confidence(effect, F.col("confidence"), F.col("needs_review")).alias("effect"))


def answer_values(spark: SparkSession, d: str) -> DataFrame:
    """Rows as JSON answers, and what is wrong with their values."""
    answer = F.to_json(F.struct("confidence", "segment_name", "section_ref"))
    return table(spark, d, "segment_rows").select("id", F.array_join(json_text.value_errors(answer, ["confidence"], ["segment_name", "section_ref"]), "; ").alias("errors"))


def match_quality(spark: SparkSession, d: str) -> DataFrame:
    """What the matched rows get right, how often reviewers edit, and how reports fare."""
    segments = table(spark, d, "segment_rows")
    matches = evaluate.greedy_matches(review._pairs(spark, d), "document_id").join(segments.select(F.col("id").alias("pred_id"), F.col("normalized_value").isNotNull().alias("has_value")), "pred_id")
    status = validate.reported_vs_explicit_total(spark, d).select("id", F.when(F.col("status") != "not_available", F.col("status") == "matched").alias("reconciled"))
    issues = segments.groupBy(F.col("document_id").alias("id")).agg(F.count_if("needs_review").alias("n"))
    reports = table(spark, d, "report_documents").select("id", documents.elapsed_seconds(F.col("created_at"), F.col("updated_at")).alias("seconds"))
    known = reports.join(status, "id", "left").join(issues, "id", "left").select("reconciled", F.coalesce("n", F.lit(0)).alias("issues"), "seconds")
    return evaluate.quality(matches, segments.select((F.lower("status") == "edited").alias("edited")), known)


QUERIES = {f.__name__: f for f in (candidate_page_scores, row_rejections, repeated_facts, limited_effects, answer_values, match_quality)}

_FOLD = "trim(regexp_replace(lower(regexp_replace(strip_accents({}), '[^\\x00-\\x7F]', '', 'g')), '\\s+', ' ', 'g'))"
_WORDS = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
_PERIOD = "CASE WHEN regexp_matches(lower(trim(coalesce({0}, ''))), '(19|20)\\d{{2}}') THEN regexp_extract(lower(trim(coalesce({0}, ''))), '((?:19|20)\\d{{2}})', 1) ELSE regexp_replace(lower(trim(coalesce({0}, ''))), '[^a-z0-9]+', '', 'g') END"
_GENERIC = "n IN (" + ", ".join(f"'{x}'" for x in documents.GENERIC_REVENUE) + ")"
_OTHER = "(" + " OR ".join(f"contains(t, '{x}')" for x in documents.NOT_SEGMENTS) + ")"
_HAS = lambda x: "AND (n = {0} OR {0} = '' OR contains({0}, 'not a segment') OR contains({0}, 'not segment') OR contains({0}, 'consolidated revenue'))".format(x)
SQL: dict[str, str] = {
    "candidate_page_scores": f"""WITH sc AS ({page_plans.SQL["page_relevance_score"]}),
p AS (SELECT document_id, CAST(page_number AS INT) AS page_number, max(CAST(relevance_score AS DOUBLE)) AS score FROM parsed_pages JOIN sc USING (id) WHERE page_number IS NOT NULL GROUP BY 1, 2),
r AS (SELECT p.*, CAST(p.score >= 4 AND coalesce(b.score > 0, false) AS INT) AS l, CAST(p.score >= 4 AND coalesce(c.score > 0, false) AS INT) AS g FROM p LEFT JOIN p b ON b.document_id = p.document_id AND b.page_number = p.page_number - 1 LEFT JOIN p c ON c.document_id = p.document_id AND c.page_number = p.page_number + 1 WHERE p.score > 0),
a AS (SELECT document_id, list([[page_number, l], [g, 0]] ORDER BY score DESC, page_number) AS xs FROM r GROUP BY 1),
c AS (SELECT document_id, list_reduce(list_prepend(CAST([] AS INT[][]), xs), lambda acc, x: CASE WHEN len(acc) >= 15 OR len(list_filter(acc, lambda y: y[1] = x[1][1])) > 0 THEN acc ELSE
  list_slice(list_concat(list_append(acc, [x[1][1], NULL]), list_concat(CASE WHEN x[1][2] = 1 AND len(list_filter(acc, lambda y: y[1] = x[1][1] - 1)) = 0 THEN [[x[1][1] - 1, x[1][1]]] ELSE CAST([] AS INT[][]) END, CASE WHEN x[2][1] = 1 AND len(list_filter(acc, lambda y: y[1] = x[1][1] + 1)) = 0 THEN [[x[1][1] + 1, x[1][1]]] ELSE CAST([] AS INT[][]) END)), 1, 15) END) AS chosen FROM a),
u AS (SELECT document_id, generate_subscripts(chosen, 1) AS place, unnest(chosen) AS x FROM c)
SELECT u.document_id, x[1] AS page_number, CAST(place AS BIGINT) AS place, x[2] AS beside, round(greatest(o.score, coalesce(round(s.score * 0.35, 3), o.score)), 3) AS score FROM u JOIN p o ON o.document_id = u.document_id AND o.page_number = x[1] LEFT JOIN p s ON s.document_id = u.document_id AND s.page_number = x[2]""",
    "row_rejections": f"""WITH a AS (SELECT s.id, {_FOLD.format("coalesce(segment_name, '')")} AS n, {_FOLD.format("coalesce(metric_basis, '')")} AS m, {_FOLD.format("concat_ws(' ', coalesce(segment_name, ''), '', section_ref, t.text)")} AS t
FROM segment_rows s LEFT JOIN parsed_pages t ON t.document_id = s.document_id AND t.page_number = CAST(nullif(regexp_extract(s.page_ref, '(\\d+)', 1), '') AS INT))
SELECT id, CASE WHEN {_GENERIC} {_HAS("m")} THEN 'generic_revenue' WHEN {_GENERIC} {_HAS("t")} THEN 'generic_revenue' WHEN {_OTHER} AND NOT regexp_matches(t, '{documents.SEGMENT_NOTES}') THEN 'other_disclosure' END AS rejection FROM a""",
    "repeated_facts": f"""WITH a AS (SELECT id, document_id, {_WORDS.format("segment_name")} AS n, {_PERIOD.format("period_label")} AS p, {_FOLD.format("segment_name")} AS f FROM segment_rows),
b AS (SELECT id, row_number() OVER (PARTITION BY document_id, n, p ORDER BY id) AS k, min(id) OVER (PARTITION BY document_id, n, p) AS first_seen FROM a WHERE NOT coalesce(f IN ('total', 'total revenue', 'total revenues', 'total income', 'grand total', 'group total') OR starts_with(f, 'total ') OR ends_with(f, ' total'), false))
SELECT id, first_seen FROM b WHERE k > 1""",
    "limited_effects": """WITH a AS (SELECT id, round(confidence * 2 - 1, 6) AS e, coalesce(confidence, 0.5) AS c, coalesce(needs_review, false) AS s FROM segment_rows), b AS (SELECT id, e, CASE WHEN e > 0 AND s AND c >= 0.8 THEN 1.0 WHEN c < 0.5 THEN 0.1 WHEN c < 0.8 THEN 0.25 ELSE 0.5 END AS m FROM a)
SELECT id, round(CASE WHEN e > m THEN m WHEN e < -m THEN -m ELSE e END, 6) AS effect FROM b""",
    "answer_values": """SELECT id, concat_ws('; ', CASE WHEN confidence IS NOT NULL AND NOT (confidence BETWEEN 0 AND 1) THEN 'not a share confidence' END, CASE WHEN trim(segment_name) = '' THEN 'empty segment_name' END, CASE WHEN trim(section_ref) = '' THEN 'empty section_ref' END) AS errors FROM segment_rows""",
    "match_quality": f"""WITH {review._MATCH}, x AS (SELECT pp.v, pp.h, s.normalized_value IS NOT NULL AS has FROM mt JOIN pp USING (gold_id, pred_id) JOIN segment_rows s ON s.id = mt.pred_id),
rec AS ({validate.SQL["reported_vs_explicit_total"]}),
dd AS (SELECT d.id, CASE WHEN rec.status <> 'not_available' THEN rec.status = 'matched' END AS ok, greatest(0, (epoch_us(updated_at) - epoch_us(created_at)) / 1000000) AS seconds, (SELECT count(*) FILTER (needs_review) FROM segment_rows s WHERE s.document_id = d.id) AS issues FROM report_documents d LEFT JOIN rec USING (id))
SELECT (SELECT count(*) FROM x) AS n_matched, (SELECT round(coalesce(count(*) FILTER (v AND has) / nullif(count(*) FILTER (has), 0), 0), 6) FROM x) AS value_accuracy, (SELECT round(coalesce(count(*) FILTER (h) / nullif(count(h), 0), 0), 6) FROM x) AS page_accuracy,
(SELECT round(coalesce(count(*) FILTER (lower(status) = 'edited') / nullif(count(*), 0), 0), 6) FROM segment_rows) AS edit_rate, (SELECT round(coalesce(count(*) FILTER (ok) / nullif(count(ok), 0), 0), 6) FROM dd) AS reconciliation_pass_rate,
(SELECT round(coalesce(avg(issues), 0), 6) FROM dd) AS issues_per_document, (SELECT round(avg(seconds), 3) FROM dd) AS seconds_per_document""",
}
