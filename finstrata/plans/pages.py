"""Queries of the page operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finstrata.functions import money
from finstrata.operators import pages
from finstrata.runtime import table

FACTOR_TERMS = ["emissions", "emissionen", "co2", "furnaces", "safety"]


def page_relevance_score(spark: SparkSession, d: str) -> DataFrame:
    scores = pages.page_scores(table(spark, d, "parsed_pages", spread=True))
    return scores.select("id", "relevance_score", *[F.col(c).cast("decimal(12,6)").alias(c) for c in ("term_score", "table_score", "number_score", "unit_score", "business_score", "total_score")])


def low_text_pages(spark: SparkSession, d: str) -> DataFrame:
    return pages.text_with_fallback(table(spark, d, "parsed_pages")).select("id", "is_low", "fallback_status")


def toc_heuristic(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parsed_pages").select("id", pages.looks_like_contents(F.coalesce("text", F.lit(""))).alias("is_contents"))


def block_rows(spark: SparkSession, d: str) -> DataFrame:
    b = pages.text_blocks(table(spark, d, "parsed_pages"))
    area = pages.box_overlap({c: F.col(c) for c in ("x0", "y0", "x1", "y1")}, {"x0": F.lit(100.0), "y0": F.lit(100.0), "x1": F.lit(300.0), "y1": F.lit(300.0)})
    return b.select("id", F.col("ordinal").cast("long").alias("ordinal"), "block_index", F.length("text").cast("long").alias("chars"), F.round(area, 3).alias("inside"))


def table_cell_grid(spark: SparkSession, d: str) -> DataFrame:
    c = pages.table_cells(table(spark, d, "parsed_pages"))
    return c.select("id", *[F.col(x).cast("long").alias(x) for x in ("table_no", "row_no", "col_no")], "cell")


def table_extract_rows(spark: SparkSession, d: str) -> DataFrame:
    r = pages.extract_table_rows(table(spark, d, "parsed_pages"))
    return r.select("id", F.col("table_no").cast("long").alias("table_no"), F.col("row_no").cast("long").alias("row_no"), "label", "raw", "year", money.parse_money(F.col("raw")).alias("amount"))


def metric_alignment(spark: SparkSession, d: str) -> DataFrame:
    # the line before a table's numbers stands for the metric line
    p = table(spark, d, "parsed_pages").where(F.size("tables.tables") > 0)
    lined = p.select("id", F.concat(F.lit("2024 2023\nRevenue\n"), F.array_join(F.transform(F.get("tables.tables", F.lit(0))["rows"], lambda r: F.array_join(F.slice(r, 2, 100), "  ")), "\n")).alias("text"))
    return pages.aligned_values(lined, "Revenue", 2).select("id", F.col("ordinal").cast("long").alias("ordinal"), "raw")


def evidence_locate(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "parsed_pages")
    asked = p.select(F.col("id").alias("snippet_id"), "document_id", "page_number", F.substring_index("text", " ", 4).alias("snippet")).where(F.length("snippet") > 0)
    found = pages.locate_evidence(asked, p)
    return found.select("snippet_id", F.col("ordinal").cast("long").alias("ordinal"), "match_type", "shown")


def factor_linking(spark: SparkSession, d: str) -> DataFrame:
    factors = table(spark, d, "documents").where(F.col("document_id").isNotNull()).select(F.col("doc_id").alias("factor_id"), "document_id", "text")
    segments = table(spark, d, "segment_rows").where(F.col("row_type") == "business_segment").select(F.col("id").alias("segment_id"), "document_id", F.col("segment_name").alias("name"))
    return pages.link_by_name(factors, segments)


def factor_page_topk(spark: SparkSession, d: str) -> DataFrame:
    near = table(spark, d, "segment_rows").select("document_id", money.page_of(F.col("page_ref")).alias("page_number"))
    return pages.factor_pages(table(spark, d, "parsed_pages", spread=True), near, FACTOR_TERMS).select("id", F.col("score").cast("long").alias("score"), F.col("rank").cast("long").alias("rank"))


QUERIES = {
    f.__name__: f for f in (
        page_relevance_score, low_text_pages, toc_heuristic, block_rows, table_cell_grid, table_extract_rows, metric_alignment, evidence_locate, factor_linking, factor_page_topk,
    )
}

_FOLD = "trim(regexp_replace(lower(regexp_replace(strip_accents({}), '[^\\x00-\\x7F]', '', 'g')), '\\s+', ' ', 'g'))"


def _has(column: str, term: str) -> str:
    if term == "$" or " " in term or "&" in term:
        return f"contains({column}, '{term}')"
    return f"regexp_matches({column}, '\\b{term}\\b')"


def _count(terms: list[str]) -> str:
    return "(" + " + ".join(f"CAST({_has('f', t)} AS INT)" for t in terms) + ")"


_HITS = " + ".join(f"CAST(len(regexp_extract_all(f, '\\b{b}\\b')) > 0 AS INT) + CAST(len(regexp_extract_all(f, '\\b{b}\\b')) > 1 AS INT)" for b in pages.BUSINESS_TERMS)
_LINES = "list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '')"
_DEC = "CAST({} AS DECIMAL(12,6))"
_MONEY = "TRY_CAST(CASE WHEN regexp_matches({0}, ',[^.]*$') AND regexp_matches({0}, '\\..*,') THEN replace(replace({0}, '.', ''), ',', '.') WHEN contains({0}, ',') AND contains({0}, '.') THEN replace({0}, ',', '') WHEN regexp_matches({0}, ',\\d{{1,2}}$') AND NOT regexp_matches({0}, ',\\d{{3}}(,|$)') THEN replace({0}, ',', '.') ELSE replace({0}, ',', '') END AS DECIMAL(38,6))"
SQL = {
    "page_relevance_score": f"""WITH p AS (SELECT id, coalesce(text, '') AS t, {_FOLD.format("coalesce(text, '')")} AS f, tables.tables AS tb FROM parsed_pages),
c AS (SELECT *, coalesce(len(tb), 0) AS nt, coalesce(list_sum(list_transform(tb, lambda x: list_sum(list_transform(x.rows, lambda r: len(r))))), 0) AS nc FROM p),
s AS (SELECT id, {" + ".join(f"CASE WHEN {_has('f', t)} THEN {w} ELSE 0 END" for t, w in pages.TERM_WEIGHTS.items())} AS a, CASE WHEN nt > 0 THEN least(4.0, nt * 2.0) + least(2.0, nc / 20.0) ELSE 0 END AS b, least(3.0, len(regexp_extract_all(t, '\\(?[$]?\\d[\\d,]*(?:\\.\\d+)?%?\\)?')) / 8.0) AS c, least(3.0, {_count(pages.UNIT_TERMS)} * 0.75) AS e, least(3.0, ({_HITS}) * 0.5) AS g, least(2.0, {_count(pages.TOTAL_TERMS)} * 0.5) AS h FROM c)
SELECT id, {_DEC.format('a')} AS term_score, {_DEC.format('b')} AS table_score, {_DEC.format('c')} AS number_score, {_DEC.format('e')} AS unit_score, {_DEC.format('g')} AS business_score, {_DEC.format('h')} AS total_score,
CAST(round({' + '.join(_DEC.format(x) for x in 'abcegh')}, 3) AS DECIMAL(12,3)) AS relevance_score FROM s""",
    "low_text_pages": "WITH a AS (SELECT id, length(regexp_replace(coalesce(text, ''), '[^\\pL\\pN]', '', 'g')) < 30 AS is_low, coalesce(blocks.text_fallback.status, 'not_needed') AS st FROM parsed_pages) SELECT id, is_low, CASE WHEN NOT is_low THEN 'not_needed' WHEN st = 'not_needed' THEN 'available_not_configured' ELSE st END AS fallback_status FROM a",
    "toc_heuristic": f"""WITH a AS (SELECT id, coalesce(text, '') AS t, list_slice({_LINES}, 1, 100) AS ls FROM parsed_pages),
b AS (SELECT id, t, len(list_filter(list_slice(ls, 1, 8), lambda x: regexp_matches(lower(x), '^(table of )?contents$|^inhalt|^sommaire$|^indice|^índice|^inhoud|^indhold'))) > 0 AS h, len(list_filter(ls, lambda x: regexp_matches(x, '^\\d{{1,3}}$|\\s\\.{{2,}}\\s*\\d{{1,3}}$|\\pL\\s+\\d{{1,3}}$'))) AS n FROM a)
SELECT id, ((h AND n >= 5) OR n >= 8) AND NOT regexp_matches(t, '[$€£]') AS is_contents FROM b""",
    "block_rows": "WITH a AS (SELECT id, unnest(blocks.blocks) AS b, generate_subscripts(blocks.blocks, 1) - 1 AS ordinal FROM parsed_pages) SELECT id, ordinal, b.block_index AS block_index, length(b.text) AS chars, round(greatest(least(b.bbox.x1, 300.0) - greatest(b.bbox.x0, 100.0), 0) * greatest(least(b.bbox.y1, 300.0) - greatest(b.bbox.y0, 100.0), 0), 3) AS inside FROM a WHERE trim(b.text) <> ''",
    "table_cell_grid": "WITH a AS (SELECT id, unnest(tables.tables) AS t, generate_subscripts(tables.tables, 1) - 1 AS table_no FROM parsed_pages), b AS (SELECT id, table_no, unnest(t.rows) AS r, generate_subscripts(t.rows, 1) - 1 AS row_no FROM a), c AS (SELECT id, table_no, row_no, unnest(r) AS cell, generate_subscripts(r, 1) - 1 AS col_no FROM b) SELECT id, table_no, row_no, col_no, coalesce(trim(regexp_replace(cell, '\\s+', ' ', 'g')), '') AS cell FROM c",
    "table_extract_rows": f"""WITH a AS (SELECT id, unnest(tables.tables) AS t, generate_subscripts(tables.tables, 1) - 1 AS table_no FROM parsed_pages),
b AS (SELECT id, table_no, t.rows AS rows, list_position(list_transform(t.rows[1], lambda c: regexp_matches(coalesce(c, ''), '^(FY)?(19|20)\\d{{2}}$')), true) AS col FROM a WHERE len(t.rows) > 1),
c AS (SELECT id, table_no, col, CAST(regexp_extract(rows[1][col], '((?:19|20)\\d{{2}})', 1) AS INT) AS year, unnest(rows[2:]) AS r, generate_subscripts(rows[2:], 1) - 1 AS row_no FROM b WHERE col > 1),
e AS (SELECT id, table_no, row_no, trim(regexp_replace(r[1], '\\s+', ' ', 'g')) AS label, trim(regexp_replace(r[col], '\\s+', ' ', 'g')) AS raw, year FROM c)
SELECT id, table_no, row_no, label, raw, year, {_MONEY.format("regexp_replace(raw, '[^0-9,.]', '', 'g')")} AS amount FROM e WHERE label <> '' AND lower(label) NOT IN ('total', 'subtotal', 'summe', 'gesamt') AND regexp_matches(raw, '\\d')""",
    "metric_alignment": """WITH a AS (SELECT id, list_filter(list_transform(tables.tables[1].rows, lambda r: trim(regexp_replace(array_to_string(r[2:], '  '), '\\s+', ' ', 'g'))), lambda x: x <> '')[1:8] AS w FROM parsed_pages WHERE len(tables.tables) > 0),
b AS (SELECT id, list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform(w, lambda x: regexp_extract_all(x, '\\(?-?\\d[\\d,]*(?:\\.\\d+)?\\)?|-'))), lambda acc, x: CASE WHEN len(acc) >= 4 THEN acc ELSE list_concat(acc, x) END) AS v FROM a),
c AS (SELECT id, CASE WHEN len(v) >= 4 THEN [v[1], v[3]] ELSE v[1:2] END AS p FROM b)
SELECT id, unnest(p) AS raw, generate_subscripts(p, 1) - 1 AS ordinal FROM c WHERE len(p) = 2""",
    "evidence_locate": f"""WITH s AS (SELECT id, blocks, CASE WHEN len(string_split(text, ' ')) <= 4 THEN text ELSE array_to_string(string_split(text, ' ')[1:4], ' ') END AS snippet FROM parsed_pages WHERE length(text) > 0),
a AS (SELECT id AS snippet_id, {_FOLD.format('snippet')} AS fs, unnest(blocks.blocks).text AS block, generate_subscripts(blocks.blocks, 1) - 1 AS ordinal FROM s WHERE trim(snippet) <> ''),
b AS (SELECT *, {_FOLD.format('block')} AS fb FROM a),
c AS (SELECT *, contains(fb, fs) AS ex, len(list_intersect(list_distinct(string_split(fs, ' ')), list_distinct(string_split(fb, ' ')))) AS sh, greatest(1, least(3, len(list_distinct(string_split(fs, ' '))))) AS need FROM b WHERE fb <> ''),
e AS (SELECT *, row_number() OVER (PARTITION BY snippet_id ORDER BY ordinal) AS k, greatest(0, strpos(fb, fs) - 81) AS st, least(length(block), strpos(fb, fs) - 1 + length(fs) + 160) AS en FROM c WHERE ex OR sh >= need)
SELECT snippet_id, ordinal, CASE WHEN ex THEN 'exact_block' ELSE 'token_overlap_block' END AS match_type, CASE WHEN ex THEN trim(substr(block, st + 1, en - st)) ELSE trim(substr(block, 1, 300)) END AS shown FROM e WHERE k <= 3""",
    "factor_linking": f"""WITH s AS (SELECT id AS segment_id, document_id, {_FOLD.format('segment_name')} AS n FROM segment_rows WHERE row_type = 'business_segment'),
t AS (SELECT *, list_filter(list_distinct(string_split(regexp_replace(n, '[^a-z0-9]+', ' ', 'g'), ' ')), lambda w: length(w) >= 4 AND w NOT IN ('segment', 'business', 'division', 'group')) AS w FROM s WHERE n <> ''),
f AS (SELECT doc_id AS factor_id, document_id, {_FOLD.format('text')} AS x FROM documents WHERE document_id IS NOT NULL),
j AS (SELECT factor_id, segment_id, CASE WHEN contains(x, n) THEN 1 WHEN len(list_filter(w, lambda v: contains(x, v))) > 0 THEN 2 END AS r FROM f JOIN t USING (document_id))
SELECT factor_id, segment_id, CASE WHEN r = 1 THEN 'name' ELSE 'activity' END AS linked_by FROM (SELECT *, row_number() OVER (PARTITION BY factor_id ORDER BY r, segment_id) AS k FROM j WHERE r IS NOT NULL) WHERE k = 1""",
    "factor_page_topk": f"""WITH p AS (SELECT id, document_id, page_number, {_FOLD.format("coalesce(text, '')")} AS f FROM parsed_pages), s AS (SELECT document_id, CAST(nullif(regexp_extract(page_ref, '(\\d+)', 1), '') AS INT) AS q FROM segment_rows),
c AS (SELECT id, document_id, page_number, 10 * ({' + '.join(f"CAST(contains(f, '{t}') AS INT)" for t in FACTOR_TERMS)}) AS h, CASE WHEN contains(f, 'management discussion') OR contains(f, 'risk') THEN 5 ELSE 0 END + CASE WHEN EXISTS (SELECT 1 FROM s WHERE s.document_id = p.document_id AND p.page_number BETWEEN s.q - 1 AND s.q + 1) THEN 7 ELSE 0 END AS x FROM p)
SELECT id, CAST(h + x AS BIGINT) AS score, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY h + x DESC, page_number) AS k FROM c WHERE h > 0) WHERE k <= 8""",
}
