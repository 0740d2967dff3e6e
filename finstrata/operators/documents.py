"""Operators on whole documents and their rows: metadata, page kinds, excerpts, normalised rows, selections.

Blank texts count as missing. Vocabularies are fixed values unless given.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from finstrata.functions import classify, money
from finstrata.functions.text import contains_any, english_meaning, fold_ascii, label_language, let, nonblank_lines, squeeze

LEGAL_LINE = r"(?i)\b(plc|inc|ltd|se|ag|s\.p\.a|a/s|n\.v|s\.a|gmbh)\b"
HEADINGS = ("consolidated financial statements", "financial statements")
UPDATES = ("new standards", "recently issued", "accounting pronouncements", "not yet adopted", "amendments to ifrs")
PRODUCTS_OR_PLACES = ("revenue by product", "revenue by geography", "geographical information", "by country", "by region")


def first_company_line(text: Column, most: int = 20) -> Column:
    """The first of the leading lines that ends like a company's name, of 3 to 90 characters."""
    lines = F.slice(nonblank_lines(F.coalesce(text, F.lit(""))), 1, most)
    fits = F.filter(lines, lambda x: x.rlike(LEGAL_LINE) & F.length(x).between(3, 90) & ~F.lower(x).rlike("report|copyright|page"))
    return F.try_element_at(fits, F.lit(1))


def document_period(text: Column) -> Column:
    """FY and the year of 'year ended ... YYYY' or 'annual report ... YYYY', else of the latest year."""
    low = F.lower(F.coalesce(text, F.lit("")))
    ended = F.regexp_extract(low, r"year ended[^\n]{0,40}?((?:19|20)\d{2})", 1)
    report = F.regexp_extract(low, r"annual report[^\n]{0,40}?((?:19|20)\d{2})", 1)
    year = F.coalesce(F.nullif(ended, F.lit("")), F.nullif(report, F.lit("")), money.latest_year(low).cast("string"))
    return F.concat(F.lit("FY"), year)


def hint_or(hint: Column, inferred: Column) -> Column:
    """A hint that isn't blank, else what was inferred."""
    return F.coalesce(F.nullif(F.trim(hint), F.lit("")), inferred)


def blank_fields(columns: Sequence[str]) -> Column:
    """The names of the fields that are null or blank, in the given order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", F.lit(c)) for c in columns]))


def page_flags(pages: DataFrame) -> DataFrame:
    """id and what kind of page it is: headed by statements, an accounting update, products or places, a structural table."""
    f = fold_ascii(F.coalesce("text", F.lit("")))
    heads = F.transform(F.slice(nonblank_lines(F.coalesce("text", F.lit(""))), 1, 5), lambda x: F.lower(x))
    cells = F.coalesce(F.aggregate("tables.tables", F.lit(0), lambda s, t: s + F.aggregate(t["rows"], F.lit(0), lambda a, r: a + F.size(r))), F.lit(0))
    numbers = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"\d[\d,]*"))
    headed = F.exists(heads, lambda x: x.isin(*HEADINGS) | x.startswith("financial statements") | x.endswith("financial statements"))
    return pages.select(
        "id", headed.alias("is_statement"), contains_any(f, UPDATES).alias("is_update"), contains_any(f, PRODUCTS_OR_PLACES).alias("is_breakdown"),
        ((F.coalesce(F.size("tables.tables"), F.lit(0)) > 0) & (cells >= 12) & (numbers >= 6)).alias("has_structure"),
    )


def excerpts(pages: DataFrame, head: int = 160, body: int = 900, tables: int = 2, rows: int = 4) -> DataFrame:
    """id, heading, excerpt and table_text: what of a page is shown where candidates are chosen; rows are extracted from page_prompts."""
    t = F.coalesce(F.col("text"), F.lit(""))
    heading = F.substring(F.coalesce(F.try_element_at(nonblank_lines(t), F.lit(1)), F.lit("")), 1, head)
    shown = F.transform(F.slice(F.coalesce("tables.tables", F.array().cast("array<struct<table_index:int,source:string,bbox:struct<x0:double,y0:double,x1:double,y1:double>,rows:array<array<string>>>>")), 1, tables), lambda x: F.array_join(F.transform(F.slice(x["rows"], 1, rows), lambda r: F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), " | ")), "\n"))
    return pages.select("id", heading.alias("heading"), F.substring(squeeze(t), 1, body).alias("excerpt"), F.array_join(shown, "\n--\n").alias("table_text"))


def prompt_parts(head: str, text: str, tables: Sequence[str], most: int) -> list[str]:
    """A page's whole text and tables in one part, or in as many as it takes for none to be longer than `most` characters.

    Parts end at line ends. Each begins with head, and with the header row of a table that goes on; only a line longer
    than a part is cut within, at a blank if it has one.
    """
    whole = "\n".join([head, "Text:", text, *tables])
    if len(whole) <= most:
        return [whole]
    head = head if len(head) <= most // 4 else ""
    parts, shown = [], [head] if head else []

    def show(line: str, lead: Sequence[str]) -> None:
        nonlocal shown
        if len(shown) > 0 and sum(map(len, shown)) + len(shown) + len(line) > most:
            parts.append("\n".join(shown))
            shown = [*([head] if head else []), *lead]
        while (room := most - sum(map(len, shown)) - len(shown)) < len(line):
            at = line.rfind(" ", 1, room + 1)
            at = at if at > 0 else room
            parts.append("\n".join([*shown, line[:at]]))
            line, shown = line[at:].lstrip(" "), [*([head] if head else []), *lead]
        shown.append(line)

    for block, repeated in [("Text:\n" + text, 1), *((t, 2) for t in tables)]:
        lines = block.split("\n")
        lead = lines[:repeated] if sum(map(len, lines[:repeated])) <= most // 4 else []
        for k, line in enumerate(lines):
            show(line, lead if k >= repeated else [])
    return [*parts, "\n".join(shown)]


def page_prompts(pages: DataFrame, most: int) -> DataFrame:
    """id and prompt: the whole text and every row of every table of a page; a page longer than `most` has several prompts."""
    t = F.coalesce(F.col("text"), F.lit(""))
    head = F.concat_ws("\n", F.concat(F.lit("Page "), F.col("page_number").cast("string")), F.concat(F.lit("Section: "), F.substring(F.coalesce(F.try_element_at(nonblank_lines(t), F.lit(1)), F.lit("unknown")), 1, 160)))
    row = lambda r: F.array_join(F.transform(r, lambda c: F.coalesce(squeeze(c), F.lit(""))), " | ")
    tables = F.filter(F.transform("tables.tables", lambda x, i: F.when(F.size(x["rows"]) > 0, F.concat(F.lit("Table "), i.cast("string"), F.lit("\n"), F.array_join(F.transform(x["rows"], row), "\n")))), lambda x: x.isNotNull())

    @F.pandas_udf("array<string>")
    def parts(heads: pd.Series, texts: pd.Series, shown: pd.Series) -> pd.Series:
        return pd.Series([prompt_parts(h, x, list(y), most) for h, x, y in zip(heads, texts, shown)], dtype=object)

    return pages.select("id", F.explode(parts(head, t, F.coalesce(tables, F.array().cast("array<string>")))).alias("prompt"))


def normalised_rows(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """id, currency, scale, period, page, value and warnings of each row: its own fields, else the document's.

    rows: id, document_id, revenue_raw, revenue_value, currency, scale, period_label, page_ref. documents: document_id, doc_currency, doc_scale.
    """
    j = rows.join(documents, "document_id", "left")
    own_currency, own_scale = F.coalesce(money.currency_of(F.col("revenue_raw")), money.currency_of(F.col("currency"))), F.coalesce(money.scale_of(F.col("revenue_raw")), money.scale_of(F.col("scale")))
    currency, scale = F.coalesce(own_currency, money.currency_of(F.col("doc_currency"))), F.coalesce(own_scale, money.scale_of(F.col("doc_scale")))
    value = F.coalesce(money.parse_money(F.col("revenue_raw")), F.col("revenue_value").cast("decimal(38,6)"))
    warn = lambda c, text: F.when(c, F.lit(text))
    warnings = F.array_compact(F.array(
        warn(value.isNull(), "value missing"), warn(own_currency.isNull() & currency.isNotNull(), "currency inferred"), warn(currency.isNull(), "currency missing"),
        warn(own_scale.isNull() & scale.isNotNull(), "scale inferred"), warn(scale.isNull(), "scale missing"), warn(money.latest_year(F.coalesce("period_label", F.lit(""))).isNull(), "period missing"), warn(money.page_of(F.col("page_ref")).isNull(), "page missing"),
    ))
    return j.select("id", currency.alias("currency"), scale.alias("scale"), money.period_label(F.col("period_label")).alias("period"), money.page_of(F.col("page_ref")).alias("page"), money.scaled(value, scale).alias("value"), F.array_join(warnings, "; ").alias("warnings"))


def with_classification(rows: DataFrame) -> DataFrame:
    """rows whose blank row_type, segment_type, normalised name and language are derived from the name."""
    name = F.col("segment_name")
    fill = lambda c, derived: F.coalesce(F.nullif(F.trim(c), F.lit("")), derived).alias(c)
    derived = {"row_type": classify.row_type(name, F.col("normalized_value")), "segment_type": classify.segment_type(name), "segment_name_normalized": english_meaning(name), "language": label_language(name)}
    return rows.select(*[fill(c, derived[c]) if c in derived else F.col(c) for c in rows.columns])


def with_next_page(pages: DataFrame, key: str = "document_id") -> DataFrame:
    """id and the id of the following page, if the next one is directly after it."""
    w = W.partitionBy(key).orderBy("page_number", "id")
    return pages.select("id", F.when(F.lead("page_number").over(w) == F.col("page_number") + 1, F.lead("id").over(w)).alias("next_id"))


def by_last_name(findings: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """findings with the last row (by id) of their document that has their name, case aside; without one they are the document's."""
    last = rows.groupBy(key, F.lower(F.col("segment_name")).alias("_n")).agg(F.max("id").alias("row_id"))
    return findings.join(last, (findings[key] == last[key]) & (F.lower(findings["name"]) == F.col("_n")), "left").select(findings["*"], "row_id", F.when(F.col("row_id").isNull(), "document").otherwise("row").alias("level"))


def rerun_selections(old: DataFrame, new: DataFrame, key: str, source: str = "source", machine: Sequence[str] = ("auto", "model")) -> DataFrame:
    """New machine-made selections, except where a reviewer has chosen: theirs stay."""
    kept = old.where(~F.col(source).isin(*machine))
    untouched = old.where(F.col(source).isin(*machine)).join(new.select(key), key, "left_anti")
    return kept.unionByName(untouched).unionByName(new.join(kept.select(key), key, "left_anti"))


def elapsed_seconds(start: Column, end: Column) -> Column:
    """Seconds from start to end, at least 0."""
    return F.greatest(F.lit(0.0), (F.unix_micros(end) - F.unix_micros(start)) / 1_000_000)


def evidence_bundles(rows: DataFrame, key: str, page: str, text: str, most: int = 4000) -> DataFrame:
    """key, pages and bundle: a row's evidence texts in page order as 'Page n: text', each once, cut to `most` characters."""
    once = rows.where(F.col(text).isNotNull() & (F.trim(F.col(text)) != "")).select(key, page, text).distinct()
    items = F.array_sort(F.collect_list(F.struct(F.coalesce(F.col(page), F.lit(0)).alias("p"), F.col(text).alias("t"))))
    return once.groupBy(key).agg(items.alias("x")).select(
        key, F.array_join(F.array_distinct(F.transform(F.filter("x", lambda i: i["p"] > 0), lambda i: i["p"].cast("string"))), ",").alias("pages"),
        F.substring(F.array_join(F.transform("x", lambda i: F.concat(F.lit("Page "), i["p"].cast("string"), F.lit(": "), i["t"])), " "), 1, most).alias("bundle"),
    )


def denominators(documents: DataFrame, rows: DataFrame) -> DataFrame:
    """id, denominator, origin: the reported total if positive, else the first stated total, else the sum of the parts.

    documents: id, reported_total. rows: document_id, id, row_type, normalized_value.
    """
    r = rows.groupBy(F.col("document_id").alias("_d")).agg(
        F.min_by(F.when(F.col("row_type") == "total", F.col("normalized_value")), F.when((F.col("row_type") == "total") & F.col("normalized_value").isNotNull(), F.col("id"))).alias("stated"),
        F.sum(F.when((F.col("row_type") == "business_segment") & (F.col("normalized_value") > 0), F.col("normalized_value").cast("decimal(28,6)"))).cast("decimal(38,6)").alias("parts"),
    )
    j = documents.join(r, documents["id"] == F.col("_d"), "left")
    reported = F.when(F.col("reported_total") > 0, F.col("reported_total")).cast("decimal(38,6)")
    return j.select("id", F.coalesce(reported, "stated", "parts").cast("decimal(38,6)").alias("denominator"), F.when(reported.isNotNull(), "reported").when(F.col("stated").isNotNull(), "stated").when(F.col("parts").isNotNull(), "parts").otherwise("none").alias("origin"))


# Labels of revenue as a whole, disclosures that aren't about segments, and the headings of segment notes.
GENERIC_REVENUE = ["external revenue", "net revenue", "net revenues", "net sales", "revenue", "revenues", "sales", "total consolidated revenue", "total consolidated revenues", "turnover"]
NOT_SEGMENTS = [
    "accounting and reporting developments", "accounting changes", "accounting standard", "allocation table", "climate impact", "emissions", "collateral", "coverage ratio", "credit risk", "default portfolio",
    "energy consumption", "energy intensity", "energy usage", "energy mix", "eu taxonomy", "fasb", "fuel consumption", "green asset portfolio", "green financing", "taxonomy",
]
SEGMENT_NOTES = r"\b(note\s+\d+\s+segment information|primary segmentation|reporting segments|operating segments|reportable segments|segment reporting)\b"


def rejection(name: Column, metric: Column, evidence: Column, section: Column, page: Column) -> Column:
    """Why an extracted row is no segment's revenue: 'generic_revenue', 'other_disclosure', or null."""
    plain = lambda c: fold_ascii(F.coalesce(c, F.lit("")))
    n, all_ = plain(name), plain(F.concat_ws(" ", F.coalesce(name, F.lit("")), F.coalesce(evidence, F.lit("")), section, page))

    def generic(m: Column) -> Column:
        return n.isin(*GENERIC_REVENUE) & ((m == "") | contains_any(m, ["not a segment", "not segment", "consolidated revenue"]) | (n == m))

    return F.when(generic(plain(metric)), "generic_revenue").when(let(all_, lambda t: generic(t)), "generic_revenue").when(let(all_, lambda t: contains_any(t, NOT_SEGMENTS) & ~t.rlike(SEGMENT_NOTES)), "other_disclosure")


# Kinds of failure that a labeller's note names, tried in this order.
NOTE_FAILURES = [("non_english_issue", ["non-english", "non english", "translation", "language"]), ("scanned_ocr_issue", ["ocr", "scanned", "scan"]), ("nace_ambiguity", ["nace", "classification ambiguity"]), ("table_parsing_error", ["table parsing", "table_parse", "column alignment"])]


def failure_of_note(note: Column) -> Column:
    low = F.lower(F.coalesce(note, F.lit("")))
    found = F.lit(None).cast("string")
    for kind, needles in reversed(NOTE_FAILURES):
        found = F.when(contains_any(low, needles), F.lit(kind)).otherwise(found)
    return found
