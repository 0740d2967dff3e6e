"""Operators over parsed pages: relevance, blocks and tables, evidence, metric alignment, factor pages.

Null texts, blocks and tables count as empty. Vocabularies are parameters; the defaults are fixed values.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from finstrata.functions.text import fold_ascii, matched_terms, nonblank_lines, squeeze, term_pattern

# Weights of phrases that name segment disclosures.
TERM_WEIGHTS = {
    "revenue by segment": 9.0, "net sales by segment": 9.0, "operating segments": 8.5, "reportable segments": 8.5, "segment reporting": 7.5, "business segments": 7.0, "external revenue": 7.0, "disaggregation of revenue": 7.0,
    "segment revenue": 6.5, "segment revenues": 6.5, "sales by segment": 6.5, "management discussion and analysis": 2.5, "md&a": 2.5, "note": 0.8, "segmentos operativos": 6.5, "ingresos por segmento": 6.5, "ventas por segmento": 6.0,
    "cifra de negocios": 5.5, "segmentos de negocio": 5.5, "segmentos reportables": 5.5, "secteurs operationnels": 6.5, "segments operationnels": 6.5, "chiffre d affaires": 6.0, "chiffre d affaires par secteur": 6.5, "secteurs d activite": 5.5,
    "segments a presenter": 5.5, "umsatz nach segment": 6.5, "umsatzerloese": 6.0, "umsatzerlose": 6.0, "operative segmente": 6.0, "berichtspflichtige segmente": 6.0, "geschaeftssegmente": 6.0, "geschaftssegmente": 6.0, "segmentberichterstattung": 6.0,
    "ricavi per settore": 6.5, "settori operativi": 6.0, "segmenti operativi": 6.0, "fatturato": 5.5, "receita por segmento": 6.5, "receitas por segmento": 6.5, "segmentos operacionais": 6.0, "volume de negocios": 5.5, "omzet per segment": 6.5, "operationele segmenten": 6.0,
}
# Words for lines of business, currencies and units, and totals.
BUSINESS_TERMS = "automotive banking commercial consumer corporate energy industrial insurance investment retail technology wholesale".split()
UNIT_TERMS = "$ usd eur euro gbp dollar dollars million millions millones millionen milhoes billion billions thousand thousands".split()
TOTAL_TERMS = ["total revenue", "total revenues", "total sales", "total net sales", "consolidated revenue", "consolidated revenues", "intersegment", "total", "total ingresos", "ingresos totales", "ventas totales", "total chiffre d affaires", "chiffre d affaires total", "total produits", "gesamtumsatz", "umsatz gesamt", "ricavi totali", "totale ricavi", "receita total", "receitas totais", "totaal omzet"]
NUMBER = r"\(?[$]?\d[\d,]*(?:\.\d+)?%?\)?"


def table_signal(tables: Column) -> Column:
    """Two points a table up to four, and a point for every twenty cells up to two."""
    n = F.coalesce(F.size(tables), F.lit(0))
    cells = F.coalesce(F.aggregate(tables, F.lit(0), lambda s, t: s + F.aggregate(t["rows"], F.lit(0), lambda a, r: a + F.size(r))), F.lit(0))
    return F.when(n > 0, F.least(F.lit(4.0), n * 2.0) + F.least(F.lit(2.0), cells / 20)).otherwise(F.lit(0.0))


def page_scores(pages: DataFrame, weights: Mapping[str, float] | None = None, business: Sequence[str] = BUSINESS_TERMS, units: Sequence[str] = UNIT_TERMS, totals: Sequence[str] = TOTAL_TERMS) -> DataFrame:
    """id, document_id, page_number, the six signals of a page and their sum, relevance_score."""
    weights = dict(weights or TERM_WEIGHTS)
    p = pages.select("id", "document_id", "page_number", F.coalesce("text", F.lit("")).alias("t"), F.col("tables.tables").alias("tb")).withColumn("f", fold_ascii(F.col("t")))
    terms = sum((F.when(F.col("f").rlike(term_pattern(t)), F.lit(w)).otherwise(F.lit(0.0)) for t, w in weights.items()), F.lit(0.0))
    counts = [F.regexp_count("f", F.lit(rf"\b{b}\b")) for b in business]
    hits = sum(((c > 0).cast("int") for c in counts), F.lit(0))
    again = sum(((c > 1).cast("int") for c in counts), F.lit(0))
    scored = p.select(
        "id", "document_id", "page_number", terms.alias("term_score"), table_signal(F.col("tb")).alias("table_score"),
        F.least(F.lit(3.0), F.regexp_count("t", F.lit(NUMBER)) / 8).alias("number_score"),
        F.least(F.lit(3.0), F.size(matched_terms(F.col("f"), units)) * 0.75).alias("unit_score"),
        F.least(F.lit(3.0), hits * 0.5 + again * 0.5).alias("business_score"),
        F.least(F.lit(2.0), F.size(matched_terms(F.col("f"), totals)) * 0.5).alias("total_score"),
    )
    parts = ["term_score", "table_score", "number_score", "unit_score", "business_score", "total_score"]
    return scored.withColumn("relevance_score", F.round(sum((F.col(c).cast("decimal(12,6)") for c in parts), F.lit(0).cast("decimal(12,6)")), 3).cast("decimal(12,3)"))


def low_text(text: Column, least: int = 30) -> Column:
    """Fewer letters and digits than a page needs to be read without a fallback."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]", "")) < least


def looks_like_contents(text: Column) -> Column:
    """A table of contents: its heading among the first lines, or many lines that end in a page number, and no amounts."""
    lines = F.slice(nonblank_lines(text), 1, 100)
    heading = F.exists(F.slice(lines, 1, 8), lambda x: F.lower(x).rlike(r"^(table of )?contents$|^inhalt|^sommaire$|^indice|^índice|^inhoud|^indhold"))
    refs = F.size(F.filter(lines, lambda x: x.rlike(r"^\d{1,3}$|\s\.{2,}\s*\d{1,3}$|\p{L}\s+\d{1,3}$")))
    return ((heading & (refs >= 5)) | (refs >= 8)) & ~text.rlike(r"[$€£]")


def text_blocks(pages: DataFrame) -> DataFrame:
    """One row per block with text: id, block_index, its box and its text."""
    b = pages.select("id", F.posexplode("blocks.blocks").alias("ordinal", "b")).where(F.trim("b.text") != "")
    return b.select("id", "ordinal", "b.block_index", "b.text", "b.parser_source", "b.bbox.x0", "b.bbox.y0", "b.bbox.x1", "b.bbox.y1")


def box_overlap(a: Mapping[str, Column], b: Mapping[str, Column]) -> Column:
    """The area two boxes share; 0 if they don't meet."""
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def table_cells(pages: DataFrame) -> DataFrame:
    """One row per cell in row-major order; a missing cell is an empty text."""
    t = pages.select("id", F.posexplode("tables.tables").alias("table_no", "t")).select("id", "table_no", F.posexplode("t.rows").alias("row_no", "r"))
    return t.select("id", "table_no", "row_no", F.posexplode("r").alias("col_no", "cell")).withColumn("cell", F.coalesce(squeeze(F.col("cell")), F.lit("")))


def text_with_fallback(pages: DataFrame) -> DataFrame:
    """id, text and how it was come by: the page's own, or the fallback's for pages with little text."""
    status = F.coalesce("blocks.text_fallback.status", F.lit("not_needed"))
    return pages.select("id", F.coalesce("text", F.lit("")).alias("text"), low_text(F.col("text")).alias("is_low"), F.when(~low_text(F.col("text")), F.lit("not_needed")).when(status == "not_needed", F.lit("available_not_configured")).otherwise(status).alias("fallback_status"))


def extract_table_rows(pages: DataFrame, skip: Sequence[str] = ("total", "subtotal", "summe", "gesamt")) -> DataFrame:
    """Rows of tables whose header holds years: id, table_no, row_no, label, raw value and year of the first year's column."""
    tables = pages.select("id", F.posexplode("tables.tables").alias("table_no", "t")).select("id", "table_no", F.col("t.rows").alias("rows")).where(F.size("rows") > 1)
    header = F.element_at("rows", 1)
    column = F.array_position(F.transform(header, lambda c: F.coalesce(c, F.lit("")).rlike(r"^(?:FY)?(?:19|20)\d{2}$")), True)
    body = tables.withColumns({"col": column, "year": F.when(column > 0, F.regexp_extract(F.element_at(header, F.greatest(column, F.lit(1)).cast("int")), r"((?:19|20)\d{2})", 1).cast("int"))}).where("col > 1")
    flat = body.select("id", "table_no", "year", "col", F.posexplode(F.slice("rows", 2, 100_000)).alias("row_no", "r"))
    named = flat.select("id", "table_no", "row_no", "year", squeeze(F.element_at("r", 1)).alias("label"), squeeze(F.try_element_at("r", F.col("col").cast("int"))).alias("raw"))
    return named.where((F.col("label") != "") & ~F.lower("label").isin(*skip) & F.col("raw").rlike(r"\d"))


def aligned_values(pages: DataFrame, metric: str, n_rows: int) -> DataFrame:
    """id, ordinal, raw: the n_rows numbers after the line that is `metric`; every second one if two years head the columns.

    All or nothing: a page with fewer numbers gives none.
    """
    p = pages.select("id", nonblank_lines(F.col("text")).alias("ls")).withColumn("at", F.array_position(F.transform("ls", lambda x: F.lower(x)), metric.lower()).cast("int")).where("at > 0")
    years = F.array_distinct(F.flatten(F.transform(F.slice("ls", F.greatest(F.lit(1), F.col("at") - 40), F.least(F.lit(40), F.col("at") - 1)), lambda x: F.regexp_extract_all(x, F.lit(r"(?<!\d)((?:19|20)\d{2})(?!\d)"), 1))))
    window = F.slice("ls", F.col("at") + 1, n_rows * 4)
    tokens = F.transform(window, lambda x: F.regexp_extract_all(x, F.lit(r"(\(?-?\d[\d,]*(?:\.\d+)?\)?|-)"), 1))
    # lines are read until there are two numbers a row
    enough = F.aggregate(tokens, F.array().cast("array<string>"), lambda acc, x: F.when(F.size(acc) >= 2 * n_rows, acc).otherwise(F.concat(acc, x)))
    read = p.select("id", years.alias("ys"), enough.alias("v"))
    stride = F.when((F.size("ys") >= 2) & (F.size("v") >= 2 * n_rows), 2).otherwise(1)
    picked = F.slice(F.filter("v", lambda x, i: i % F.col("stride") == 0), 1, n_rows)
    return read.withColumn("stride", stride).withColumn("p", picked).where(F.size("p") == n_rows).select("id", F.posexplode("p").alias("ordinal", "raw"))


def locate_evidence(snippets: DataFrame, pages: DataFrame, most: int = 3) -> DataFrame:
    """snippet_id, block ordinal, how it matched: blocks of the snippet's page that contain it or share three of its words.

    snippets: snippet_id, document_id, page_number, snippet. The first `most` in block order.
    """
    blocks = pages.select("document_id", "page_number", F.posexplode("blocks.blocks").alias("ordinal", "b")).select("document_id", "page_number", "ordinal", F.col("b.text").alias("block"), fold_ascii(F.col("b.text")).alias("fb")).where(F.col("fb") != "")
    asked = snippets.where(F.trim("snippet") != "").withColumn("fs", fold_ascii(F.col("snippet")))
    words = lambda c: F.array_distinct(F.split(c, " "))
    met = asked.join(blocks, ["document_id", "page_number"])
    shared = F.size(F.array_intersect(words(F.col("fs")), words(F.col("fb"))))
    exact = F.contains(F.col("fb"), F.col("fs"))
    found = met.withColumns({"exact": exact, "shared": shared}).where(F.col("exact") | (F.col("shared") >= F.greatest(F.lit(1), F.least(F.lit(3), F.size(words(F.col("fs")))))))
    start = F.greatest(F.lit(0), F.expr("instr(fb, fs)") - 1 - 80)
    end = F.least(F.length("block"), F.expr("instr(fb, fs)") - 1 + F.length("fs") + 160)
    shown = F.when(F.col("exact"), F.trim(F.substring(F.col("block"), start + 1, end - start))).otherwise(F.trim(F.substring(F.col("block"), F.lit(1), F.lit(300))))
    ranked = found.withColumn("k", F.row_number().over(W.partitionBy("snippet_id").orderBy("ordinal"))).where(F.col("k") <= most)
    return ranked.select("snippet_id", "ordinal", F.when(F.col("exact"), "exact_block").otherwise("token_overlap_block").alias("match_type"), shown.alias("shown"))


def link_by_name(factors: DataFrame, segments: DataFrame, key: str = "document_id") -> DataFrame:
    """factor_id, segment_id, how: the first segment of the document whose name the text contains, else the first that shares a word of four letters.

    factors: factor_id, key, text. segments: segment_id, key, name. An equi-join on the document; only the best pair of a factor is kept,
    by an aggregation that combines before the shuffle.
    """
    s = segments.select("segment_id", key, fold_ascii(F.col("name")).alias("n")).where(F.col("n") != "").withColumn("w", F.filter(F.array_distinct(F.split(F.regexp_replace("n", "[^a-z0-9]+", " "), " ")), lambda w: (F.length(w) >= 4) & ~w.isin("segment", "business", "division", "group")))
    met = factors.select("factor_id", key, fold_ascii(F.col("text")).alias("t")).join(s, key)
    rank = F.when(F.contains(F.col("t"), F.col("n")), 1).when(F.exists("w", lambda w: F.contains(F.col("t"), w)), 2)
    return met.withColumn("r", rank).where(F.col("r").isNotNull()).groupBy("factor_id").agg(F.min(F.struct("r", "segment_id")).alias("b")).select("factor_id", "b.segment_id", F.when(F.col("b.r") == 1, "name").otherwise("activity").alias("linked_by"))


def factor_pages(pages: DataFrame, near: DataFrame, terms: Sequence[str], context: Sequence[str] = ("management discussion", "risk"), most: int = 8) -> DataFrame:
    """The best pages of each document for a vocabulary: ten points a term, five for the context, seven next to a page of `near` (document_id, page_number)."""
    p = pages.select("document_id", "page_number", "id", fold_ascii(F.coalesce("text", F.lit(""))).alias("f"))
    hits = sum((F.contains(F.col("f"), F.lit(t)).cast("int") for t in terms), F.lit(0))
    band = near.where(F.col("page_number").isNotNull()).select("document_id", F.explode(F.sequence(F.col("page_number") - 1, F.col("page_number") + 1)).alias("page_number")).distinct().withColumn("beside", F.lit(7))
    scored = p.withColumn("hits", hits).where("hits > 0").join(band, ["document_id", "page_number"], "left")
    about = F.when(F.exists(F.array(*[F.lit(c) for c in context]), lambda c: F.contains(F.col("f"), c)), 5).otherwise(0)
    w = W.partitionBy("document_id").orderBy(F.desc("score"), "page_number")
    return scored.select("id", "document_id", "page_number", (F.col("hits") * 10 + about + F.coalesce("beside", F.lit(0))).alias("score")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
