"""One surviving record for each group of records that state the same fact.

fact_keys() says which rows state one fact; survivors() builds the surviving record of every group in
a single aggregation: for each attribute the maximum of a composite struct (filled, source priority,
timestamp, row id, value). Aggregations combine on the map side, so a group with a third of all rows
never meets in one task as rows.

Edge cases: rows whose segment or document is null form facts of their own null key; a row that could
belong to several facts (no amount, several facts of its year) stays a fact of its own; repeated rows
are ordinary members; ties of timestamp and confidence fall to the smaller row id; empty input gives
an empty result with the same columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: More trusted extractors have the larger number.
SOURCE_PRIORITY = {"manual_entry": 3, "llm_second_pass": 2, "llm_first_pass": 1, "table_rules": 0}
#: Amounts that agree when rounded to this many units are one amount.
ROUNDING = 100_000


def segment_key(name: Column) -> Column:
    """A segment name without case, footnote marks, hyphens against blanks and doubled blanks."""
    plain = F.regexp_replace(F.lower(name), r"\(\d+\)\s*$|[*.†‡:]+\s*$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"[*.†‡:]+\s*$", ""), r"[\s\-]+", " "))


def fiscal_year(period: Column) -> Column:
    """The year that a period names: its last four-digit year, else a two-digit year after FY."""
    four = F.regexp_extract(period, r"((?:19|20)\d{2})(?!.*(?:19|20)\d{2})", 1)
    two = F.regexp_extract(period, r"(?i)FY\s?'?(\d{2})(?!\d)", 1)
    return F.when(four != "", four.cast("int")).when(two != "", two.cast("int") + 2000)


def stated_amount(row_value: Column, raw: Column, evidence: Column) -> Column:
    """The amount of a row: its value, else the printed number, else the rounded one of its evidence."""
    printed = F.regexp_replace(raw, r"[^\d]", "")
    shown = F.regexp_extract(evidence, r"(\d[\d ,.']*[.,]\d) \p{L}", 1)
    whole = F.regexp_replace(F.regexp_replace(shown, r"[.,]\d$", ""), r"[^\d]", "")
    tenth = F.regexp_extract(shown, r"[.,](\d)$", 1)
    from_text = F.when(shown != "", F.concat(whole, tenth).cast("decimal(38,0)") * F.lit(100_000))
    return F.coalesce(
        row_value.cast("decimal(38,6)"),
        F.when(printed != "", printed.cast("decimal(38,0)")).cast("decimal(38,6)"),
        from_text.cast("decimal(38,6)"),
    )


def fact_keys(rows: DataFrame, rounding: int = ROUNDING) -> DataFrame:
    """rows with fact_id: equal for rows of one document, segment and year whose amounts agree up to rounding.

    A column of that name is replaced.
    """
    # the row itself travels as one struct: whatever its columns are called, they can't clash with the keys
    read = rows.select(
        F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_row"), "document_id", "row_id",
        segment_key(F.col("segment_name")).alias("_seg"), fiscal_year(F.col("fiscal_period")).alias("_year"),
        F.round(stated_amount(F.col("normalized_value"), F.col("revenue_raw"), F.col("evidence_text")) / rounding).cast("long").alias("_amount"),
    )
    facts = (
        read.where(F.col("_amount").isNotNull())
        .groupBy("document_id", "_seg", "_amount")
        .agg(F.min("_year").alias("_first"), F.max("_year").alias("_last"))
    )
    # a year that all dated rows of an amount share is the year of the undated ones
    dated = F.when(F.col("_first") == F.col("_last"), F.col("_first"))
    one_year = facts.select("document_id", "_seg", "_amount", dated.alias("_only_year"))
    with_amount = _null_safe(read.where(F.col("_amount").isNotNull()), one_year, ["document_id", "_seg", "_amount"]).withColumn(
        "_year", F.coalesce("_year", "_only_year")
    )
    # rows without an amount belong to the fact of their segment and year if there is just one
    known = with_amount.groupBy("document_id", "_seg", "_year", "_amount").agg(F.count(F.lit(1)).alias("_n"))
    by_year = known.where(F.col("_year").isNotNull()).groupBy("document_id", "_seg", "_year").agg(
        F.min("_amount").alias("_a"), F.max("_amount").alias("_b")
    )
    by_segment = known.groupBy("document_id", "_seg").agg(
        F.min("_amount").alias("_sa"), F.max("_amount").alias("_sb"), F.min("_year").alias("_sy"), F.max("_year").alias("_sz")
    )
    without = _null_safe(_null_safe(read.where(F.col("_amount").isNull()), by_year, ["document_id", "_seg", "_year"]), by_segment, ["document_id", "_seg"])
    single = (F.col("_sa") == F.col("_sb")) & F.coalesce(F.col("_sy") == F.col("_sz"), F.lit(True))
    without = without.withColumns({
        "_amount": F.when(F.col("_a") == F.col("_b"), F.col("_a")).when(single & (F.col("_year").isNull() | F.col("_sy").isNull()), F.col("_sa")),
        "_year": F.coalesce(F.col("_year"), F.when(single, F.col("_sy"))),
    })
    own = F.when(F.col("_amount").isNull(), F.col("row_id"))
    fact_id = F.sha2(F.to_json(F.struct("document_id", "_seg", "_year", "_amount", own.alias("own")), {"ignoreNullFields": "false"}), 256).alias("_fact")
    both = with_amount.select("_row", fact_id).unionByName(without.select("_row", fact_id))
    kept = [c for c in rows.columns if c != "fact_id"]
    return both.select(*[F.col("_row").getField(c).alias(c) for c in kept], F.col("_fact").alias("fact_id"))


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    renamed = right.withColumnsRenamed({k: f"_r{k}" for k in keys})
    on = [left[k].eqNullSafe(renamed[f"_r{k}"]) for k in keys]
    return left.join(renamed, on, "left").drop(*[f"_r{k}" for k in keys])


def survivors(
    rows: DataFrame, group: str, fields: list[str], source: str = "extractor", at: str = "extracted_at", row_id: str = "row_id", trust: str = "confidence",
    priority: dict[str, int] | None = None, complete: list[str] | None = None,
) -> DataFrame:
    """One row per group with the best value of every field, in one aggregation.

    first_id and n_rows tell what it was made of. best_id is the fullest row, the latest of several; dominant says
    that it is as full as any other in the fields of `complete` (all, if not given), later and more trusted than each.
    """
    ranks = F.create_map(*[F.lit(x) for kv in (priority or SOURCE_PRIORITY).items() for x in kv])
    rank = F.coalesce(F.try_element_at(ranks, F.col(source)), F.lit(-1))
    best = lambda f: F.max(F.struct(F.col(f).isNotNull().alias("filled"), rank.alias("rank"), F.col(at).alias("at"), F.col(row_id).alias("id"), F.col(f).alias("value")))
    filled = sum((F.col(f).isNotNull().cast("int") for f in complete or fields), F.lit(0))
    row = lambda *keys: F.max(F.struct(*keys, F.col(row_id).alias("id")))
    # the smallest id of the greatest value: if it differs from the greatest id, several rows share the value
    shared = lambda c, back: F.min(F.when(c.isNotNull(), F.struct(back.alias("back"), F.col(row_id).alias("id"))))["id"]
    made = rows.groupBy(group).agg(
        F.min(row_id).alias("first_id"), F.count(F.lit(1)).alias("n_rows"),
        row(filled.alias("filled"), F.col(at).alias("at")).alias("_best"), row(F.col(at).alias("at"))["id"].alias("_late"), row(F.col(trust).alias("trust"))["id"].alias("_sure"),
        shared(F.col(at), -F.unix_micros(at)).alias("_late0"), shared(F.col(trust), -F.col(trust)).alias("_sure0"),
        *[best(f)["value"].alias(f) for f in fields],
    )
    only = [F.coalesce(F.col(c) == F.col("_best.id"), F.lit(False)) for c in ("_late", "_sure", "_late0", "_sure0")]
    return made.select(group, "first_id", "n_rows", F.col("_best.id").alias("best_id"), (only[0] & only[1] & only[2] & only[3]).alias("dominant"), *[f for f in fields])


def dominating_rows(rows: DataFrame, group: str, fields: list[str], **options) -> DataFrame:
    """first_id, best_id of the survivors of two or more rows that are one of their rows: the most complete, the latest and the most trusted."""
    return survivors(rows, group, fields, **options).where("n_rows >= 2 AND dominant").select("first_id", "best_id")
