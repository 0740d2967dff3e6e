"""The stages in order: pages to candidates, candidates to rows, rows to classes, rows against labels.

Each stage takes and gives DataFrames; nothing is collected between them. Write a stage's tables where several
later ones read them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finstrata.functions import money
from finstrata.functions.text import low_text_count
from finstrata.operators import documents, evaluate, pages, rows, taxonomy, validate
from finstrata.sources import providers


def ingest(parsed: DataFrame, limit: int = 15) -> dict[str, DataFrame]:
    """Pages that can be read, their scores, and the candidate pages of each document."""
    readable = parsed.where(low_text_count(F.col("text")) >= 30)
    scores = pages.page_scores(readable)
    chosen = rows.select_with_neighbours(scores.withColumn("s", F.col("relevance_score").cast("double")), "document_id", "page_number", "s", limit)
    return {"pages": readable, "scores": scores, "candidates": scores.join(chosen, ["document_id", "page_number"], "left_semi")}


def extract(parsed: DataFrame, candidates: DataFrame, report_documents: DataFrame, provider: providers.Provider | None = None, limits: providers.Limits = providers.Limits()) -> dict[str, DataFrame]:
    """Rows of the candidate pages' tables, normalised and without repetitions; with a provider, its answers as well.

    The provider is shown all of a page: a page longer than a prompt may be has an answer for each of its parts.
    """
    own = parsed.join(candidates.select("id"), "id", "left_semi")
    found = pages.extract_table_rows(own).join(own.select("id", "document_id", "page_number"), "id")
    raw = found.select(
        F.concat_ws(":", F.col("id"), F.col("table_no").cast("string"), F.col("row_no").cast("string")).alias("id"), "document_id", F.col("label").alias("segment_name"), F.col("raw").alias("revenue_raw"), F.lit(None).cast("decimal(38,6)").alias("revenue_value"),
        F.lit(None).cast("string").alias("currency"), F.lit(None).cast("string").alias("scale"), F.concat(F.lit("FY"), F.col("year").cast("string")).alias("period_label"), F.concat(F.lit("p. "), F.col("page_number").cast("string")).alias("page_ref"),
    )
    docs = report_documents.select(F.col("id").alias("document_id"), F.col("currency").alias("doc_currency"), F.col("scale").alias("doc_scale"))
    normal = documents.normalised_rows(raw, docs).join(raw.select("id", "document_id", "segment_name"), "id")
    latest = rows.keep_latest_year(normal.withColumn("year", money.latest_year(F.coalesce("period", F.lit("")))), "document_id", "year")
    kept = rows.dedup_neighbouring(latest, ["document_id", "segment_name", "value", "period"], "page", "id")
    result = {"rows": latest.join(kept.select("id"), "id", "left_semi")}
    if provider:
        result["answers"] = providers.answers(documents.page_prompts(own, limits.max_prompt_chars), provider, limits)
    return result


def classify(rows_: DataFrame, nodes: DataFrame, k: int = 5) -> DataFrame:
    """id, node_code, score, rank: the best activities of each row's name."""
    return taxonomy.candidates(rows_.withColumn("context", F.lit("")), nodes, "id", "segment_name", "context", k, fuzzy=True)


def check(rows_: DataFrame, report_documents: DataFrame) -> DataFrame:
    """Each document's reported total against its rows."""
    return validate.reconcile(report_documents, rows_.select(F.col("document_id").alias("id"), "value"), "id", "reported_total", "value")


def score_against(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Precision, recall and F1. Both: id, document_id, segment_name, value, period, page."""
    side = lambda df, p: df.select("document_id", *[F.col(c).alias(f"{p}_{c}") for c in ("id", "segment_name", "value", "period", "page")])
    g, p = side(gold, "gold"), side(predicted, "pred")
    pairs = evaluate.candidate_pairs(
        g, p, "document_id", evaluate.token_similarity(F.col("gold_segment_name"), F.col("pred_segment_name")), money.values_match(F.col("gold_value"), F.col("pred_value")),
        money.period_key(F.col("gold_period")) == money.period_key(F.col("pred_period")), F.col("gold_page") == F.col("pred_page"),
    )
    return evaluate.metrics(evaluate.outcomes(g, p, evaluate.greedy_matches(pairs, "document_id"), "document_id"))
