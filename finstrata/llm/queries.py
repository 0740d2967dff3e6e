"""The queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finstrata.llm import canonical_values, confusions, eval_leaks, languages, name_variants, packing, page_noise, repeated_lines, residue, survivorship
from finstrata.runtime import table

#: Vocabulary whose tokens the containers are measured in.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
FACT_FIELDS = ["normalized_value", "page_number", "fiscal_period"]
SURVIVOR_FIELDS = ["document_id", "segment_name", "revenue_raw", "normalized_value", "page_number", "fiscal_period", "currency", "evidence_text"]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines.repeated_line_occurrences(table(spark, d, "parsed_pages", spread=True))


def p1_clean_pages(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines.without_repeated_lines(table(spark, d, "parsed_pages", spread=True))


def p1_sequences(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines.frequent_sequences(table(spark, d, "parsed_pages", spread=True))


def _labels(values: DataFrame, reference: DataFrame) -> DataFrame:
    """reference(label, key) with how often each label is typed as it stands."""
    counts = values.groupBy("value").agg(F.count(F.lit(1)).alias("frequency"))
    return reference.join(counts, reference["label"] == counts["value"], "left").select("label", "key", "frequency")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    segments = table(spark, d, "segment_rows").select(F.col("id").alias("row_key"), F.col("segment_name_original").alias("value"))
    codes = table(spark, d, "gold_rows").select(F.col("gold_id").alias("row_key"), F.col("nace_code").alias("value"))
    catalogue = table(spark, d, "segment_catalogue").select("label", F.col("segment_key").alias("key"))
    nodes = table(spark, d, "nace_nodes")
    classes = nodes.where(F.col("level") == "class").select(F.col("node_name").alias("label"), F.col("node_code").alias("key"))
    parts = []
    for field, rows, reference, exact, best in (
        ("segment_name_original", segments, catalogue, catalogue.select("label"), canonical_values.best_name),
        ("nace_code", codes, classes, nodes.select(F.col("node_code").alias("label")), canonical_values.best_class),
    ):
        typed = rows.where(F.col("value").isNotNull()).join(exact, F.col("value") == F.col("label"), "left_anti")
        answers = canonical_values.resolve(typed, _labels(rows, reference), best)
        parts.append(typed.join(answers, "value").select(F.lit(field).alias("field_name"), "row_key", "ref_key"))
    return parts[0].unionByName(parts[1])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return languages.foreign_paragraphs(table(spark, d, "parsed_pages", spread=True))


def p3_pages(spark: SparkSession, d: str) -> DataFrame:
    return languages.page_languages(table(spark, d, "parsed_pages", spread=True))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return page_noise.noisy_lines(table(spark, d, "parsed_pages", spread=True))


def p4_readable(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "parsed_pages", spread=True)
    return page_noise.readable_pages(pages, repeated_lines.repeated_line_occurrences(pages))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return name_variants.variant_pairs(table(spark, d, "report_documents"))


def p5_entities(spark: SparkSession, d: str) -> DataFrame:
    """Every spelling of either table with its company, named by its smallest spelling."""
    names = table(spark, d, "report_documents").select("company_name").unionByName(table(spark, d, "documents").select("company_name"))
    entities = name_variants.company_entities(names)
    return entities.join(entities.groupBy("entity").agg(F.min("name").alias("company"), F.count(F.lit(1)).alias("n_spellings")), "entity").drop("entity")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return survivorship.dominating_rows(survivorship.fact_keys(table(spark, d, "prepared_rows")), "fact_id", FACT_FIELDS)


def p7_survivors(spark: SparkSession, d: str) -> DataFrame:
    facts = survivorship.fact_keys(table(spark, d, "prepared_rows"))
    return survivorship.survivors(facts, "fact_id", SURVIVOR_FIELDS, complete=FACT_FIELDS).drop("fact_id")


def p8_packed(spark: SparkSession, d: str, tokenizer: str = TOKENIZER) -> DataFrame:
    packed = packing.pack_kinds(table(spark, d, "documents", spread=True), table(spark, d, "containers"), tokenizer)
    return packed.withColumn("item", F.col("item").cast("long")).withColumnRenamed("item", "doc_id")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return eval_leaks.leaked_items(table(spark, d, "documents", spread=True), table(spark, d, "eval_items"))


def p9_regions(spark: SparkSession, d: str) -> DataFrame:
    """Where each text holds a passage of an item, altered ones included, with the edits between the two."""
    return eval_leaks.leak_regions(table(spark, d, "documents", spread=True), table(spark, d, "eval_items"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "documents", spread=True))


QUERIES = {f.__name__: f for f in (p1_found, p1_clean_pages, p1_sequences, p2_found, p3_found, p3_pages, p4_found, p4_readable, p5_found, p5_entities, p7_found, p7_survivors, p8_packed, p9_found, p9_regions, p10_found)}

# SQL for those that it can express. The others are tested against brute force and stated cases in tests/llm.
_FOLDED = "translate(lower({}), '" + confusions._FROM + "', '" + confusions._TO + "')"
for _single, _pair in confusions._WIDER:
    _FOLDED = f"replace({_FOLDED}, '{_single}', '{_pair}')"
# the page's own number: a run of letters and digits that is nothing else
_OWN = "translate(replace(regexp_replace(f, '([\\pL\\pN]+)', '<\\1>', 'g'), '<' || n || '>', '#'), '<>', '')"
_SEG = "trim(regexp_replace(regexp_replace(regexp_replace(lower(segment_name), '\\(\\d+\\)\\s*$|[*.†‡:]+\\s*$', '', 'g'), '[*.†‡:]+\\s*$', '', 'g'), '[\\s\\-]+', ' ', 'g'))"
_FACTS = f"""WITH r AS (SELECT row_id, document_id, {_SEG} AS seg, CASE WHEN regexp_matches(fiscal_period, '(19|20)\\d{{2}}') THEN CAST(list_last(regexp_extract_all(fiscal_period, '(?:19|20)\\d{{2}}')) AS INT) WHEN regexp_matches(fiscal_period, '(?i)FY\\s?''?\\d{{2}}') THEN 2000 + CAST(regexp_extract(fiscal_period, '(?i)FY\\s?''?(\\d{{2}})', 1) AS INT) END AS y,
coalesce(CAST(normalized_value AS DECIMAL(38,6)), CAST(nullif(regexp_replace(revenue_raw, '[^\\d]', '', 'g'), '') AS DECIMAL(38,6)), CAST(nullif(regexp_replace(regexp_extract(evidence_text, '(\\d[\\d ,.'']*[.,]\\d) \\pL', 1), '[^\\d]', '', 'g'), '') AS DECIMAL(38,6)) * 100000) AS v,
CAST(normalized_value IS NOT NULL AS INT) + CAST(page_number IS NOT NULL AS INT) + CAST(fiscal_period IS NOT NULL AS INT) AS filled, extracted_at, confidence FROM prepared_rows),
a AS (SELECT *, CAST(round(v / 100000, 0) AS BIGINT) AS m FROM r),
o AS (SELECT document_id, seg, m, CASE WHEN min(y) = max(y) THEN min(y) END AS oy FROM a WHERE m IS NOT NULL GROUP BY 1, 2, 3),
w AS (SELECT a.* EXCLUDE (y), coalesce(a.y, o.oy) AS y FROM a JOIN o USING (document_id, seg, m)),
by_y AS (SELECT document_id, seg, y, min(m) AS lo, max(m) AS hi FROM w WHERE y IS NOT NULL GROUP BY 1, 2, 3), by_s AS (SELECT document_id, seg, min(m) AS lo, max(m) AS hi, min(y) AS y0, max(y) AS y1 FROM w GROUP BY 1, 2),
z AS (SELECT a.* EXCLUDE (m, y), CASE WHEN b.lo = b.hi THEN b.lo WHEN s.lo = s.hi AND coalesce(s.y0 = s.y1, true) AND (a.y IS NULL OR s.y0 IS NULL) THEN s.lo END AS m, coalesce(a.y, CASE WHEN s.lo = s.hi AND coalesce(s.y0 = s.y1, true) THEN s.y0 END) AS y FROM a LEFT JOIN by_y b USING (document_id, seg, y) LEFT JOIN by_s s USING (document_id, seg) WHERE a.m IS NULL),
u AS (SELECT row_id, document_id, seg, y, m, filled, extracted_at, confidence, '' AS own FROM w UNION ALL SELECT row_id, document_id, seg, y, m, filled, extracted_at, confidence, CASE WHEN m IS NULL THEN row_id ELSE '' END FROM z)"""
SQL: dict[str, str] = {
    "p1_found": f"""WITH l AS (SELECT id, document_id, page_number, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line_no FROM parsed_pages),
f AS (SELECT id, document_id, line_no, translate({_FOLDED.format('x')}, '<>', '‹›') AS f, {_FOLDED.format('CAST(page_number AS VARCHAR)')} AS n FROM l WHERE length(regexp_replace(x, '[^\\pL]', '', 'g')) >= 12),
k AS (SELECT id, coalesce('=' || document_id, '') AS source, line_no, regexp_replace(CASE WHEN contains(f, n) THEN {_OWN} ELSE f END, '\\s+', '', 'g') AS a, regexp_replace(f, '\\s+', '', 'g') AS b FROM f),
i AS (SELECT id, source, line_no, a AS key FROM k UNION SELECT id, source, line_no, b FROM k),
c AS (SELECT source, key, count(DISTINCT id) AS n FROM i GROUP BY 1, 2),
p AS (SELECT coalesce('=' || document_id, '') AS source, count(*) AS pages FROM parsed_pages GROUP BY 1),
q AS (SELECT source, key FROM c JOIN p USING (source) WHERE n >= 4 AND n * 3 >= pages)
SELECT DISTINCT id AS page_id, CAST(line_no AS BIGINT) AS line_no FROM i JOIN q USING (source, key)""",
    "p7_found": f"""{_FACTS},
g AS (SELECT document_id, seg, y, m, own, count(*) AS n, min(row_id) AS first_id, max(filled) AS most, max(extracted_at) AS late, max(confidence) AS sure FROM u GROUP BY 1, 2, 3, 4, 5 HAVING count(*) >= 2)
SELECT first_id, min(u.row_id) FILTER (extracted_at = late) AS best_id FROM g JOIN u ON u.document_id = g.document_id AND u.seg = g.seg AND u.y IS NOT DISTINCT FROM g.y AND u.m IS NOT DISTINCT FROM g.m AND u.own = g.own
GROUP BY first_id HAVING count(*) FILTER (extracted_at = late) = 1 AND count(*) FILTER (confidence = sure) = 1 AND count(*) FILTER (extracted_at = late AND confidence = sure AND filled = most) = 1""",
    "p7_survivors": f"""{_FACTS},
t AS (SELECT u.document_id AS gd, u.seg AS gs, u.y, u.m, u.own, u.filled, s.*, coalesce(s.extracted_at, TIMESTAMPTZ '0001-01-01') AS late, coalesce(s.confidence, -1e300) AS sure,
CASE s.extractor WHEN 'manual_entry' THEN 3 WHEN 'llm_second_pass' THEN 2 WHEN 'llm_first_pass' THEN 1 WHEN 'table_rules' THEN 0 ELSE -1 END AS rank FROM u JOIN prepared_rows s USING (row_id)),
g AS (SELECT min(row_id) AS first_id, count(*) AS n_rows, arg_max(row_id, row(filled, late, row_id)) AS best_id,
arg_max(row_id, row(late, row_id)) AS _l, arg_min(row_id, row(-epoch_us(extracted_at), row_id)) FILTER (extracted_at IS NOT NULL) AS _l0,
arg_max(row_id, row(sure, row_id)) AS _s, arg_min(row_id, row(-confidence, row_id)) FILTER (confidence IS NOT NULL) AS _s0,
{", ".join(f"arg_max({f}, row(rank, late, row_id)) FILTER ({f} IS NOT NULL) AS {f}" for f in SURVIVOR_FIELDS)} FROM t GROUP BY gd, gs, y, m, own)
SELECT first_id, n_rows, best_id, coalesce(_l = best_id AND _l0 = best_id AND _s = best_id AND _s0 = best_id, false) AS dominant, {", ".join(SURVIVOR_FIELDS)} FROM g""",
    "p9_found": """WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), i AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM eval_items),
x AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 11), lambda k: array_to_string(w[k:k + 12], ' '))) AS run FROM d WHERE len(w) >= 13), y AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 11), lambda k: array_to_string(w[k:k + 12], ' '))) AS run FROM i WHERE len(w) >= 13)
SELECT DISTINCT doc_id, item_id FROM x JOIN y USING (run)""",
}
