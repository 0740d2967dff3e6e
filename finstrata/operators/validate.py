"""Totals against their parts, issues of rows and documents, coverage, and the confidence of a row.

Amounts are decimals from the first step, so sums are exact whatever their order. Nulls: a missing value is no
part of a sum; a document without a total or without parts is not_available.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(38,6)"


def reconcile(totals: DataFrame, parts: DataFrame, key: str, total: str, value: str, explicit: str | None = None, absolute: float = 1, relative: float = 0.005) -> DataFrame:
    """key, target_total, total_source, part_sum, difference and status of each total.

    An explicit total among the parts (the first by its order, given as column `explicit`) comes before the reported
    one, unless it is zero. The parts are summed before the join.
    """
    aggs = [F.sum(F.col(value).cast("decimal(28,6)")).cast(MONEY).alias("part_sum")]
    if explicit:
        aggs.append(F.max(F.col(explicit).cast(MONEY)).alias("_explicit"))
    summed = parts.groupBy(F.col(key).alias("_k")).agg(*aggs)
    joined = totals.join(summed, totals[key] == F.col("_k"), "left")
    stated = F.nullif(F.col("_explicit"), F.lit(0).cast(MONEY)) if explicit else F.lit(None).cast(MONEY)
    target = F.coalesce(stated, totals[total].cast(MONEY))
    gap = (F.col("part_sum") - target).cast(MONEY)
    allowed = F.greatest(F.lit(absolute).cast("decimal(18,6)"), F.abs(target) * F.lit(relative).cast("decimal(6,4)"))
    status = F.when(target.isNull() | F.col("part_sum").isNull(), "not_available").when(F.abs(gap) <= allowed, "matched").otherwise("failed")
    source = F.when(stated.isNotNull(), "explicit").when(target.isNotNull(), "reported").otherwise("none")
    return joined.select(totals[key], target.alias("target_total"), source.alias("total_source"), "part_sum", gap.alias("difference"), status.alias("status"))


def row_issues(rows: DataFrame, keep: Sequence[str], tests: Sequence[tuple[str, str, Column]]) -> DataFrame:
    """One row per failed test (issue_type, severity, condition) of each row. A single pass: no union of scans."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(t).alias("issue_type"), F.lit(s).alias("severity"))) for t, s, c in tests]))
    return rows.select(*keep, F.explode(found).alias("i")).select(*keep, "i.issue_type", "i.severity")


def inconsistent(rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """key, field, found: fields with more than one value within a document, and their values sorted."""
    each = rows.select(key, F.explode(F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*[F.col(c).cast("string") for c in columns]))).alias("field", "v")).where(F.col("v").isNotNull() & (F.col("v") != ""))
    # distinct before collecting: a document has few currencies, scales or years
    return each.distinct().groupBy(key, "field").agg(F.array_sort(F.collect_list("v")).alias("vs")).where(F.size("vs") > 1).select(key, "field", F.array_join("vs", ", ").alias("found"))


def missing_names(declared: DataFrame, extracted: DataFrame, key: str, name: str, normal: Column) -> DataFrame:
    """Declared names of a document that no extracted row has, compared as `normal` of the name."""
    d = declared.withColumn("_n", normal).where(F.col("_n") != "")
    e = extracted.select(key, normal.alias("_n")).distinct()
    return d.join(e, [key, "_n"], "left_anti").select(key, name).distinct()


def row_confidence(extraction: Column, has_page: Column, has_evidence: Column, missing_share: Column, penalty: Column, relevance: Column, reconciled: Column) -> Column:
    """Weighted mean of six parts of what is known about a row, in [0, 1], to four places.

    missing_share is what normalisation lost, penalty what issues cost; relevance saturates at 10.
    """
    d = lambda c: c.cast("decimal(10,6)")
    shown = F.when(has_page & has_evidence, 1.0).when(has_page | has_evidence, 0.5).otherwise(0.0)
    page = F.when(relevance.isNull(), 0.5).otherwise(F.least(F.lit(1.0), relevance / 10))
    parts = ((F.coalesce(extraction, F.lit(0.5)), 0.40), (shown, 0.18), (F.greatest(F.lit(0.0), 1 - missing_share), 0.17), (F.greatest(F.lit(0.0), 1 - penalty), 0.15), (page, 0.05), (reconciled, 0.05))
    total = sum((d(c) * F.lit(w).cast("decimal(4,2)") for c, w in parts), F.lit(0).cast("decimal(10,6)"))
    return F.round(F.greatest(F.lit(0).cast("decimal(12,8)"), F.least(F.lit(1).cast("decimal(12,8)"), total)), 4).cast("decimal(6,4)")
